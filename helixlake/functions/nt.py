"""Scalar functions on nucleotide strings, headers and intervals (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases, and X for masked positions.
BASES, MASK = ("A", "C", "G", "T"), "X"
#: Codes of the compact n-mer index, in the order of the alternate alphabet.
NMER_CODES = {"A": 0, "T": 1, "C": 2, "G": 3}
HALF_LN_2PI = 0.9189385332046727


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_cr(s: Column | str) -> Column:
    return F.replace(col(s), F.lit("\r"), F.lit(""))


def clean_nt(nt: Column | str) -> Column:
    """Upper case without carriage returns."""
    return F.upper(strip_cr(nt))


def valid_nt(nt: Column | str) -> Column:
    return col(nt).rlike("^[ACGTXacgtx]*$")


def bad_letters(nt: Column | str) -> Column:
    return F.length(F.regexp_replace(col(nt), "[ACGTXacgtx]", "")).cast("long")


def revcomp(nt: Column | str) -> Column:
    """Reverse complement; masked positions stay masked."""
    return F.reverse(F.translate(col(nt), "ACGT", "TGCA"))


def distinct_bases(kmer: Column | str) -> Column:
    k = col(kmer)
    return sum((k.contains(b).cast("int") for b in BASES), F.lit(0))


def nmer_index(nmer: Column | str) -> Column:
    """Sum of code * 4^i, i counted from the left."""
    code = F.lit(0).cast("long")
    letters = F.split(col(nmer), "")
    value = lambda x: F.when(x == "A", 0).when(x == "T", 1).when(x == "C", 2).when(x == "G", 3)
    return F.aggregate(F.reverse(F.filter(letters, lambda x: x != "")), code, lambda acc, x: acc * 4 + value(x).cast("long"))


def possible_end(run: Column | str, pos: Column | str, w: int) -> Column:
    """A site of w unmasked bases can end at 0-based pos; run is the valid run up to it."""
    return (col(pos) >= 1) & (col(run) >= w)


def parse_header(h: Column | str) -> Column:
    """'> gene chrom start end tss strand' as a struct."""
    p = F.split(F.trim(F.regexp_replace(col(h), "^>", "")), " ")
    return F.struct(p[0].alias("gene"), p[1].alias("chrom"), p[2].cast("long").alias("start"), p[3].cast("long").alias("end"), p[4].alias("tss"), p[5].alias("strand"))


def flanks(nt: Column | str, start: Column | str, end: Column | str, k: int = 5) -> tuple[Column, Column]:
    """The k lower-case bases on both sides of the 0-based half-open site, blanks beyond the sequence."""
    s, e, n = col(start).cast("int"), col(end).cast("int"), col(nt)
    left = F.lower(F.substring(n, F.greatest(s - k, F.lit(0)) + 1, s - F.greatest(s - k, F.lit(0))))
    right = F.lower(F.substring(n, e + 1, F.lit(k)))
    return F.lpad(left, k, " "), F.rpad(right, k, " ")


def ebox(s: Column | str, compat: bool = False) -> Column:
    """Whether an E-box is in s; compat tests the beginning only."""
    u = F.upper(col(s))
    test = (lambda m: u.startswith(m)) if compat else (lambda m: u.contains(m))
    return test("CACCTG") | test("CAGGTG")


def tss_offsets(start: Column | str, tss: Column | str, region_start: Column | str) -> Column:
    """start relative to each of the comma-joined transcription starts."""
    return F.transform(F.split(col(tss), ","), lambda t: col(start) - (t.cast("long") - col(region_start)))


def overlap_len(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)))


def natural_key(s: Column | str) -> Column:
    """A string that sorts as s does when runs of digits count as numbers."""
    tokens = F.regexp_extract_all(col(s), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.lpad(t, 20, "0")).otherwise(t)), "")


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function by Stirling's series after moving the argument up by eight."""
    y = x + F.lit(8.0)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    up = F.lit(0.0)
    for i in range(8):
        up = up + F.ln(x + F.lit(float(i)))
    return (y - 0.5) * F.ln(y) - y + F.lit(HALF_LN_2PI) + series - up


def ks_tail(d: Column, n1: Column, n2: Column, terms: int = 20) -> Column:
    """Asymptotic p-value of a two-sample Kolmogorov-Smirnov distance."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    total = F.lit(0.0)
    for j in range(1, terms + 1):
        total = total + (2.0 if j % 2 else -2.0) * F.exp(-2.0 * j * j * x * x)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


#: Coefficients of the rational approximation 7.1.26 of the error function in the public handbook of Abramowitz and Stegun.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_tail(z: Column) -> Column:
    """Probability that a normal number is further from zero than z >= 0, within 1.5e-7."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return series * F.exp(-x * x)


def negative_binomial(k: Column, alpha: float, beta: float) -> Column:
    """Probability of k sites under a gamma(alpha, beta) mixed Poisson."""
    a = F.lit(float(alpha))
    return F.exp(ln_gamma(k + a) - ln_gamma(a) - ln_gamma(k + 1.0) + a * F.ln(F.lit(beta / (beta + 1.0))) + k * F.ln(F.lit(1.0 / (beta + 1.0))))


def poisson(k: Column, rate: float) -> Column:
    return F.exp(k * F.ln(F.lit(float(rate))) - F.lit(float(rate)) - ln_gamma(k + 1.0))
