"""Motif counts, models, scans and site statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators.sequences import kmers, unmasked
from helixlake.sources.inputs import windows
from helixlake.sources.store import stored

#: Pseudo-count of a model cell.
PSEUDO = 0.28


def four(df: DataFrame, *keys: str) -> DataFrame:
    """Each distinct combination of keys with each of the four bases."""
    return df.select(*keys).distinct().withColumn("base", F.explode(F.array(*map(F.lit, N.BASES))))


def site_rows(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sites(seq_id, s_start, s_end, ...) with their nucleotides as site."""
    cols = [c for c in sites.columns if c != "site"]
    nt = seqs.select("seq_id", "nt")
    return sites.select(cols).join(nt, "seq_id").select(*cols, F.substring(F.col("nt"), (F.col("s_start") + 1).cast("int"), (F.col("s_end") - F.col("s_start")).cast("int")).alias("site"))


def motif_counts(site_rows: DataFrame) -> DataFrame:
    """(motif, col, base, n) over sites(motif, site)."""
    each = site_rows.select("motif", F.posexplode(F.split("site", "")).alias("col", "base")).where("base != ''")
    return each.groupBy("motif", "col", "base").agg(F.count("*").alias("n"))


def normalised(counts: DataFrame, pc: float = PSEUDO) -> DataFrame:
    """(motif, col, base, p): counts with a pseudo-count, dense over the four bases."""
    dense = four(counts, "motif", "col").join(counts, ["motif", "col", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.select("motif", "col", "base", ((F.col("n") + pc) / F.sum(F.col("n") + pc).over(Window.partitionBy("motif", "col"))).alias("p"))


def mirrored(counts: DataFrame) -> DataFrame:
    """Counts of the reverse complements of the sites."""
    last = F.max("col").over(Window.partitionBy("motif"))
    return counts.select("motif", (last - F.col("col")).alias("col"), F.translate("base", "ACGT", "TGCA").alias("base"), "n")


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("motif", "col", "base").agg(F.sum("n").alias("n"))


def pwm_palindromic(counts: DataFrame, pc: float = PSEUDO) -> DataFrame:
    """Each column tied with the complement of its mirror column; the middle of an odd width is tied with itself."""
    return normalised(summed(counts.unionByName(mirrored(counts))), pc)


def pwm_revcomp(counts: DataFrame, forward: int, reverse: int, pc: float = PSEUDO) -> DataFrame:
    """Two models that share their counts: forward's own and reverse's mirrored ones, and the mirror of that."""
    own = counts.where(F.col("motif") == forward)
    other = mirrored(counts.where(F.col("motif") == reverse)).withColumn("motif", F.lit(forward))
    both = summed(own.unionByName(other))
    return normalised(both, pc).unionByName(normalised(mirrored(both).withColumn("motif", F.lit(reverse)), pc))


def pwm_constrained(counts: DataFrame, classes: DataFrame, pc: float = PSEUDO) -> DataFrame:
    """Cells of one class share the mean of their counts; classes(col, base, cls) ties cells of every model."""
    dense = four(counts, "motif", "col").join(counts, ["motif", "col", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tied = dense.join(F.broadcast(classes), ["col", "base"], "left").withColumn("cls", F.coalesce(F.col("cls"), F.concat("col", "base")))
    return normalised(tied.select("motif", "col", "base", F.avg("n").over(Window.partitionBy("motif", "cls")).alias("n")), pc)


def background_sitefree(seqs: DataFrame, counts: DataFrame, pc: float = 5) -> DataFrame:
    """Base probabilities outside the sites: all counts less those in sites."""
    from helixlake.operators.sequences import base_counts

    inside = counts.groupBy("base").agg(F.sum("n").alias("inside"))
    out = base_counts(seqs).where("base != 'X'").join(inside, "base", "left").select("base", (F.col("n") - F.coalesce("inside", F.lit(0)) + pc).alias("n"))
    return out.select("base", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))


def position_background(table: DataFrame, bg: DataFrame, positions: DataFrame, slack: float = 0.001) -> DataFrame:
    """(pos, base, p) for each of positions(pos): from table(pos, A, C, G, T) where its row adds up to one, else the global background."""
    good = table.where(F.abs(F.col("A") + F.col("C") + F.col("G") + F.col("T") - 1) <= slack)
    each = good.select("pos", F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("own")) for b in N.BASES))).alias("x")).select("pos", "x.*")
    grid = positions.crossJoin(F.broadcast(bg.withColumnRenamed("p", "q")))  # four rows
    return grid.join(each, ["pos", "base"], "left").select(F.col("pos").cast("long").alias("pos"), "base", F.coalesce("own", "q").alias("p"))


def consensus(pwm: DataFrame, cut: float = 0.9) -> DataFrame:
    top = pwm.groupBy("motif", "col").agg(F.max("p").alias("p"), F.max_by("base", F.struct("p", "base")).alias("base"))
    letter = F.when(F.col("p") > cut, F.col("base")).otherwise("?")
    return top.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", letter.alias("b")))), lambda s: s["b"]), "").alias("consensus"))


def info_content(pwm: DataFrame, bg: DataFrame) -> DataFrame:
    met = pwm.join(F.broadcast(bg.withColumnRenamed("p", "q")), "base")
    return met.groupBy("motif", "col").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("bits"))


def kl_pwm(pwm: DataFrame) -> DataFrame:
    """(model_a, model_b, kl_ab, kl_ba, sym) in bits; models are few and of a fixed size."""
    a, b = pwm.withColumnsRenamed({"motif": "model_a", "p": "pa"}), pwm.withColumnsRenamed({"motif": "model_b", "p": "pb"})
    met = a.join(b, ["col", "base"]).where("model_a < model_b")
    out = met.groupBy("model_a", "model_b").agg(F.sum(F.col("pa") * F.log2(F.col("pa") / F.col("pb"))).alias("kl_ab"), F.sum(F.col("pb") * F.log2(F.col("pb") / F.col("pa"))).alias("kl_ba"))
    return out.withColumn("sym", (F.col("kl_ab") + F.col("kl_ba")) / 2)


def log_odds(pwm: DataFrame, bg: DataFrame) -> DataFrame:
    """(motif, w, odds): one row for each model, odds a map from column and base to the log ratio; as large as the model."""
    met = pwm.join(F.broadcast(bg.withColumnRenamed("p", "q")), "base")
    key = F.concat(F.col("col").cast("string"), F.col("base"))
    return met.groupBy("motif").agg((F.max("col") + 1).alias("w"), F.map_from_entries(F.collect_list(F.struct(key, F.ln(F.col("p") / F.col("q"))))).alias("odds"))


#: Columns of a model that are scored by one table of all 4^BLOCK k-mers.
BLOCK = 8


def block_tables(logs: list[np.ndarray]) -> list[np.ndarray]:
    """For each BLOCK columns of the models (arrays column x base, of one width), the summed log ratios of all k-mers by model; a k-mer's number has two bits for each base."""
    out = []
    for start in range(0, len(logs[0]), BLOCK):
        part = [m[start : start + BLOCK] for m in logs]
        table = np.zeros((1, len(logs)))
        for col in range(len(part[0])):
            table = (table[:, None, :] + np.array([m[col] for m in part]).T[None, :, :]).reshape(-1, len(logs))
        out.append(table)
    return out


def window_numbers(codes: np.ndarray, w: int, start: int, k: int) -> np.ndarray:
    """The number of columns start to start + k of each window of w bases."""
    n = len(codes) - w + 1
    out = np.zeros(n, np.int32)
    for j in range(start, start + k):
        out = out * 4 + codes[j : j + n]
    return out


#: Windows of a row batch that leaves a Python worker.
SCANNED = 1 << 16


def scan_arrays(seqs: DataFrame, pwm: DataFrame, bg: DataFrame, w: int, halved: tuple[int, ...] = ()) -> tuple[DataFrame, list[int]]:
    """((seq_id, end, dist_from_end, all_ratios, z), motifs): for every unmasked window the products of foreground over background, one for each of motifs.

    end is the inclusive 0-based end; all_ratios is the sum over the models at that place. A window is a number of two bits for each
    base, which is its place in an array of the scores of all 4^BLOCK k-mers, or, if the models are wider, in one for each BLOCK columns. These
    arrays and the models (a few dozen rows, collected) are small whatever is scanned, and windows don't move. Models of other widths than w are
    left out; those in halved, one for each strand, count half.
    """
    q = {r.base: r.p for r in bg.collect()}  # four rows
    logs: dict[int, np.ndarray] = {}
    for r in pwm.select("motif", "col", "base", "p").collect():
        logs.setdefault(r.motif, np.full((512, 4), np.nan))[r.col, N.BASES.index(r.base)] = math.log(r.p / q[r.base])
    logs = {m: x[: int((~np.isnan(x[:, 0])).sum())] for m, x in sorted(logs.items())}
    names = [m for m, x in logs.items() if len(x) == w]
    out = "seq_id long, end long, dist_from_end long, all_ratios double, z array<double>"
    rows = seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "nt")
    if not names:
        return seqs.sparkSession.createDataFrame([], out), names
    tables, half = block_tables([logs[m] for m in names]), np.array([0.5 if m in halved else 1.0 for m in names])
    # scores of a single array need no logarithms
    ready = np.exp(tables[0]) * half if len(tables) == 1 else None
    code = np.full(256, 4, np.int8)
    code[np.frombuffer("".join(N.BASES).encode(), np.uint8)] = np.arange(4)

    def run(batches):
        for batch in batches:
            for seq, nt in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = code[np.frombuffer(nt.as_buffer(), np.uint8)] if nt.is_valid else np.zeros(0, np.int8)
                if len(codes) < w:
                    continue
                bad = np.concatenate([[0], np.cumsum(codes > 3)])
                ok = bad[w:] == bad[:-w]
                if w == 1:
                    ok[0] = False  # the first place ends no site
                clean = np.minimum(codes, 3).astype(np.int32)
                starts = np.flatnonzero(ok)
                for at in range(0, len(starts), SCANNED):
                    here = starts[at : at + SCANNED]
                    part = clean[here[0] : here[-1] + w]
                    if ready is not None:
                        z = ready[window_numbers(part, w, 0, w)[here - here[0]]]
                    else:
                        z = np.exp(sum(t[window_numbers(part, w, i * BLOCK, min(BLOCK, w - i * BLOCK))[here - here[0]]] for i, t in enumerate(tables))) * half
                    end = here + w - 1
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, len(names), dtype=np.int32)), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), seq)), pa.array(end), pa.array(len(codes) - 1 - end), pa.array(z.sum(axis=1)), flat], [c.split()[0] for c in out.split(", ")])

    return rows.mapInArrow(run, out), names


def by_motif(names: list[int], i, kind):
    """The motif of entry i, counted from 0."""
    return F.element_at(F.array(*map(F.lit, names)), i + 1).cast(kind) if names else F.lit(None).cast(kind)


def pwm_scan(seqs: DataFrame, pwm: DataFrame, bg: DataFrame, w: int, halved: tuple[int, ...] = ()) -> DataFrame:
    """(seq_id, end, dist_from_end, motif, ratio, all_ratios, models): scan_arrays with a row for each motif."""
    found, names = scan_arrays(seqs, pwm, bg, w, halved)
    each = found.select("seq_id", "end", "dist_from_end", "all_ratios", F.posexplode("z").alias("i", "ratio"))
    return each.select("seq_id", "end", "dist_from_end", by_motif(names, F.col("i"), pwm.schema["motif"].dataType).alias("motif"), "ratio", "all_ratios", F.lit(len(names)).alias("models"))


def scan_totals(found: DataFrame, names: list[int], value=None, kind="int") -> DataFrame:
    """(seq_id, motif, n, total, best): number, sum and best of the values at the places of each sequence, of scan_arrays.

    value(ratio, row's all_ratios, number of models) is what counts, the ratio itself without it. Rows are added up before motifs become rows.
    """
    x = [value(F.col("z")[i], F.col("all_ratios"), len(names)) if value else F.col("z")[i] for i in range(len(names))]
    sums = found.groupBy("seq_id").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"_s{i}") for i, v in enumerate(x)), *(F.max(v).alias(f"_m{i}") for i, v in enumerate(x)))
    rows = F.array(*(F.struct(F.lit(m).cast(kind).alias("motif"), F.col("n"), F.col(f"_s{i}").alias("total"), F.col(f"_m{i}").alias("best")) for i, m in enumerate(names)))
    return sums.select("seq_id", F.inline(rows)) if names else sums.select("seq_id", F.lit(None).cast(kind).alias("motif"), "n", F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("best")).where("false")


def site_posterior(scan: DataFrame, prior: float) -> DataFrame:
    """p of each model at each place: odds * prior / (1 - sum of priors + sum of odds * prior)."""
    return scan.withColumn("p", F.col("ratio") * prior / (1 - F.col("models") * prior + F.col("all_ratios") * prior))


def spacing_posterior(scan: DataFrame, spacing: DataFrame) -> DataFrame:
    """The same with a prior by distance from the sequence's end: spacing(dist_from_end, p); none beyond the table."""
    met = scan.join(spacing.withColumnRenamed("p", "prior"), "dist_from_end", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    p = F.col("ratio") * F.col("prior") / (1 - F.col("models") * F.col("prior") + F.col("all_ratios") * F.col("prior"))
    return met.select("seq_id", "end", "motif", "ratio", p.alias("p"))


def nmer_background(seqs: DataFrame, freq: DataFrame, n: int, w: int) -> DataFrame:
    """(seq_id, pos, ln_p): each window's probability by chaining n-mers: the first, then next ones given their prefix."""
    prefix = F.substring("nmer", 1, n - 1)
    cond = freq.select("nmer", F.ln("p").alias("ln_first"), F.ln(F.col("p") / F.sum("p").over(Window.partitionBy(prefix))).alias("ln_next"))
    few = w <= BLOCK  # all 4^w windows are a small table
    kinds = kmers(seqs.sparkSession, w) if few else unmasked(windows(seqs, w)).select("site").distinct()
    parts = kinds.select("site", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(w - n + 1)), lambda i: F.substring(F.col("site"), i, F.lit(n)))).alias("k", "nmer"))
    scored = parts.join(cond, "nmer").groupBy("site").agg(F.sum(F.when(F.col("k") == 0, F.col("ln_first")).otherwise(F.col("ln_next"))).alias("ln_p"), F.count("*").alias("known")).where(F.col("known") == w - n + 1)
    return unmasked(windows(seqs, w)).join(F.broadcast(scored) if few else scored, "site").select("seq_id", "pos", "ln_p")


def sites_per_seq(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(k, n, p): how many sequences have k sites."""
    k = seqs.select("seq_id").join(sites.groupBy("seq_id").agg(F.count("*").alias("k")), "seq_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    n = k.groupBy("k").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def site_composition(counts: DataFrame, seqs: DataFrame) -> DataFrame:
    from helixlake.operators.sequences import base_counts

    inside = counts.groupBy("base").agg(F.sum("n").alias("inside"))
    met = base_counts(seqs).where("base != 'X'").join(inside, "base", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    w = Window.partitionBy()
    return met.select("base", (100 * F.col("inside") / F.sum("inside").over(w)).alias("pct_site"), (100 * F.col("n") / F.sum("n").over(w)).alias("pct_all"))


def site_count_sd(sites: DataFrame, possible: DataFrame, weight: float) -> DataFrame:
    """(motif, n, sd): expected number of sites and its deviation under a beta posterior with weight pseudo-sites of the same rate; possible(n) has one row."""
    k = sites.groupBy("motif").agg(F.count("*").alias("k")).crossJoin(F.broadcast(possible.select(F.col("n").cast("double").alias("total"))))
    a = F.col("k") * (1 + weight)
    b = (F.col("total") - F.col("k")) * (1 + weight)
    return k.select("motif", (a / (a + b) * F.col("total")).alias("n"), (F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) * F.col("total")).alias("sd"))


def transitions(sites: DataFrame) -> DataFrame:
    """(prev, cur, n, p): neighbouring motif types on a sequence; 'begin' stands before the first and 'end' after the last."""
    w = Window.partitionBy("seq_id").orderBy("s_start", "motif")
    m = F.col("motif").cast("string")
    rows = sites.select("seq_id", F.coalesce(F.lag(m).over(w), F.lit("begin")).alias("prev"), m.alias("cur"), F.lead(m).over(w).alias("next"))
    both = rows.select("prev", "cur").union(rows.where("next is null").select(F.col("cur").alias("prev"), F.lit("end").alias("cur")))
    n = both.groupBy("prev", "cur").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def site_numbers(sites: DataFrame) -> DataFrame:
    return sites.withColumn("ord", F.row_number().over(Window.partitionBy("seq_id").orderBy("s_start", "motif")))


def position_matrix(sites: DataFrame) -> DataFrame:
    n = site_numbers(sites).groupBy("ord", "motif").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ord")))


def accumulate(draws: DataFrame, burn_in: int) -> DataFrame:
    """(walk_id, seq_id, motif, pos, n) over draws(walk_id, iter, seq_id, motif, pos) after burn-in."""
    return draws.where(F.col("iter") >= burn_in).groupBy("walk_id", "seq_id", "motif", "pos").agg(F.count("*").alias("n"))


def loglik(counts: DataFrame, pwm: DataFrame) -> DataFrame:
    return counts.join(pwm, ["motif", "col", "base"]).groupBy("motif").agg(F.sum(F.col("n") * F.ln("p")).alias("ll"))


def map_motif(counts: DataFrame, bg: DataFrame, weight: float = 4.0) -> DataFrame:
    """(motif, value): log marginal likelihood of the columns under a Dirichlet prior of weight * background, less that of the background alone."""
    dense = four(counts, "motif", "col").join(counts, ["motif", "col", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    met = dense.join(F.broadcast(bg.withColumnRenamed("p", "q")), "base").withColumn("a", F.col("q") * weight)
    per = met.groupBy("motif", "col").agg(F.sum("n").alias("t"), F.sum(N.ln_gamma(F.col("n") + F.col("a")) - N.ln_gamma(F.col("a")) - F.col("n") * F.ln("q")).alias("v"))
    return per.groupBy("motif").agg(F.sum(F.col("v") + N.ln_gamma(F.lit(weight)) - N.ln_gamma(F.col("t") + weight)).alias("value"))


def dirichlet(n: Column, a: Column, keys: list[str], rows: DataFrame, value: str) -> DataFrame:
    """keys and the log marginal likelihood of the counts n under the Dirichlet prior a, of the rows that share keys."""
    g = rows.groupBy(*keys).agg(F.sum(N.ln_gamma(n + a) - N.ln_gamma(a)).alias("_v"), F.sum(a).alias("_a"), F.sum(n).alias("_n"))
    return g.select(*keys, (F.col("_v") + N.ln_gamma(F.col("_a")) - N.ln_gamma(F.col("_n") + F.col("_a"))).alias(value))


def map_terms(sites: DataFrame, seqs: DataFrame, bg: DataFrame, w: int, blocks: list[float], weight: float = 4.0, max_width: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., term, value): the terms of the log posterior of sites(by..., seq_id, motif, site), all of width w.

    motif: columns under a Dirichlet prior of weight * background; background: the bases outside the sites, and null, less all bases,
    under the same prior; placement: how many of the possible places hold a site, under a flat beta prior; fragmentation: the choice
    of w columns out of max_width, the outer ones being on; sites: the prior blocks of the number of sites of a sequence, the last for that many or more. by: columns of seqs
    and sites that divide them, such as seq_id.
    """
    keys = by or []
    q = F.broadcast(bg.select("base", F.col("p").alias("q"), (F.col("p") * weight).alias("a")))
    cols = sites.select(*keys, "motif", F.posexplode(F.split("site", "")).alias("col", "base")).where("base != ''").groupBy(*keys, "motif", "col", "base").agg(F.count("*").cast("double").alias("n"))
    dense = four(cols, *keys, "motif", "col").join(cols, [*keys, "motif", "col", "base"], "left").join(q, "base").withColumn("n", F.coalesce("n", F.lit(0.0)))
    motif = dirichlet(F.col("n"), F.col("a"), [*keys, "motif", "col"], dense, "v").groupBy(*keys).agg(F.sum("v").alias("value")).withColumn("term", F.lit("motif"))
    total = base_totals(seqs, *keys)
    inside = cols.groupBy(*keys, "base").agg(F.sum("n").alias("i"))
    both = total.join(inside, [*keys, "base"], "left").join(q, "base").withColumn("out", F.col("n") - F.coalesce("i", F.lit(0.0)))
    background = dirichlet(F.col("out"), F.col("a"), keys, both, "value").withColumn("term", F.lit("background"))
    null = dirichlet(F.col("n"), F.col("a"), keys, both, "value").withColumn("value", -F.col("value")).withColumn("term", F.lit("null"))
    places = possible_places(seqs, w, *keys)
    k = sites.groupBy(*keys, "motif").agg(F.count("*").cast("double").alias("k"))
    met = k.join(places, keys) if keys else k.crossJoin(F.broadcast(places))  # one row
    beta = N.ln_gamma(F.col("k") + 1) + N.ln_gamma(F.col("P") - F.col("k") + 1) - N.ln_gamma(F.col("P") + 2)
    fragments = 0.0 if max_width is None else math.log(math.comb(max_width - 2, w - 2))
    of_motifs = met.groupBy(*keys).agg(F.sum(beta).alias("placement"), (-F.lit(fragments) * F.count("*")).alias("fragmentation"))
    of_motifs = of_motifs.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).alias("value")) for t in ("placement", "fragmentation")))).alias("x")).select(*keys, "x.term", "x.value")
    own = list(dict.fromkeys([*keys, "seq_id"]))
    per_seq = seqs.select(*own).join(sites.groupBy(*own).agg(F.count("*").alias("k")), own, "left")
    prior = F.element_at(F.array(*(F.lit(math.log(x)) for x in blocks)), (F.least(F.coalesce("k", F.lit(0)), F.lit(len(blocks) - 1)) + 1).cast("int"))
    per = per_seq.withColumn("value", prior).groupBy(*keys).agg(F.sum("value").alias("value")).withColumn("term", F.lit("sites"))
    names = [*keys, "term", "value"]
    out = motif.select(*names)
    for part in (background, null, of_motifs, per):
        out = out.union(part.select(*names))
    return out


def base_totals(seqs: DataFrame, *keys: str) -> DataFrame:
    """(keys, base, n) over all sequences, for each of the four bases."""
    counted = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), (F.length("nt") - F.length(F.replace("nt", F.lit(b), F.lit("")))).cast("double").alias("n")) for b in N.BASES)))
    return seqs.select(*keys, counted.alias("c")).groupBy(*keys, "c.base").agg(F.sum("c.n").alias("n"))


def possible_places(seqs: DataFrame, w: int, *keys: str) -> DataFrame:
    """(keys, P): places without a masked base where a site may stand, counted in a sequence's own row; keys without such places have no row."""
    n = F.aggregate(F.split("nt", "[^ACGT]"), F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.length(x) - (w - 1), F.lit(0)))
    if w == 1:  # the first place ends no site
        n = n - F.when(F.col("nt").rlike("^[ACGT]"), 1).otherwise(0)
    rows = seqs.select(*keys, n.alias("_n")).where("_n > 0")
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("P")
    return rows.groupBy(*keys).agg(total) if keys else rows.agg(total)


def apart(candidates: DataFrame, chosen: DataFrame, w: int) -> DataFrame:
    """Of candidates(seq_id, s_start, motif, gain), the best ones that don't overlap one another or chosen(seq_id, s_start); all of width w.

    A candidate that beats all that overlap it is taken, and these go, until none is left: as taking the best one
    again and again, for all places at once.
    """
    near = Window.partitionBy("seq_id").orderBy("s_start").rangeBetween(1 - w, w - 1)
    best = F.struct(F.col("gain"), (-F.col("s_start")).alias("p"), (-F.col("motif")).alias("m"))
    taken = chosen.select("seq_id", F.col("s_start").cast("long").alias("s_start"), F.lit(None).cast("int").alias("motif"), F.lit(None).cast("double").alias("gain"), F.lit(True).alias("taken"))
    state = taken.union(candidates.select("seq_id", F.col("s_start").cast("long"), "motif", "gain", F.lit(False)))
    while True:
        # what overlaps a taken one goes; then the best of each neighbourhood are taken
        free = state.withColumn("hit", F.max("taken").over(near)).where("taken or not hit")
        top = F.max(F.when(~F.col("taken"), best)).over(near)
        state = stored(free.withColumn("taken", F.col("taken") | (best == top)).select("seq_id", "s_start", "motif", "gain", "taken"), "apart")
        if state.where("not taken").isEmpty():
            return state.where("gain is not null").select("seq_id", "s_start", "motif", "gain")


def em_refine(seqs: DataFrame, pwm: DataFrame, bg: DataFrame, w: int, prior: float = 0.001, pc: float = PSEUDO, tol: float = 0.1, least: int = 50, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(models, trace) of EM on site probabilities: trace(step, ll); the models have columns motif, col, base, p.

    It ends when the log likelihoods of the last six of at least `least` steps differ by tol at most. A step scores the distinct
    windows and adds up their evidence; the models, as many rows as they have cells, go round through the driver. The
    posterior is site_posterior of a scan with the result.
    """
    spark = seqs.sparkSession
    kinds = stored(unmasked(windows(seqs, w)).groupBy("site").agg(F.count("*").alias("times")), "kinds")
    q = {r.base: r.p for r in bg.collect()}  # four rows
    lls: list[float] = []
    rows = [tuple(r) for r in pwm.select("motif", "col", "base", "p").collect()]
    cell = lambda i: F.concat((i - 1).cast("string"), F.substring(F.col("site"), i, F.lit(1)))
    odds = lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(w)), F.lit(0.0), lambda acc, i: acc + F.element_at(m["odds"], cell(i)))
    while len(lls) < most and not (len(lls) >= max(least, 6) and max(lls[-6:]) - min(lls[-6:]) <= tol):
        tables: dict[int, dict[str, float]] = {}
        for m, c, base, x in rows:
            tables.setdefault(m, {})[f"{c}{base}"] = math.log(x / q[base])
        models = spark.createDataFrame([(sorted(tables.items()),)], "models array<struct<motif: int, odds: map<string, double>>>")
        scored = kinds.crossJoin(F.broadcast(models)).select("site", "times", F.transform("models", lambda m: F.struct(m["motif"].alias("motif"), (F.exp(odds(m)) * prior).alias("share"))).alias("m"))
        rest = scored.withColumn("all", 1 - F.size("m") * prior + F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["share"]))
        soft = rest.select("site", "times", "all", F.posexplode("m").alias("i", "x"))
        cells = soft.select("x.motif", F.when(F.col("i") == 0, F.col("times") * F.ln("all")).otherwise(0.0).alias("ll"), (F.col("x.share") / F.col("all") * F.col("times")).alias("z"), F.posexplode(F.split("site", "")).alias("col", "base")).where("base != ''")
        got = cells.groupBy("motif", "col", "base").agg(F.sum("z").alias("n"), F.sum(F.when(F.col("col") == 0, F.col("ll")).otherwise(0.0)).alias("ll")).collect()
        lls.append(sum(r.ll for r in got))
        sums: dict[tuple, float] = {}
        for r in got:
            sums[r.motif, r.col] = sums.get((r.motif, r.col), 4 * pc) + r.n
        seen = {(r.motif, r.col, r.base): r.n for r in got}
        rows = [(m, c, b, (seen.get((m, c, b), 0.0) + pc) / t) for (m, c), t in sums.items() for b in N.BASES]
    return spark.createDataFrame(rows, pwm.select("motif", "col", "base", "p").schema), spark.createDataFrame(list(enumerate(lls)), "step long, ll double")


def fitness(seqs: DataFrame, candidates: DataFrame, w: int, compat: bool = False) -> DataFrame:
    """(candidate_id, fitness): fit of candidate sets of models (candidate_id, model, col, base, p) to all windows, in one pass.

    A window counts with the better of its product and that of its reverse complement. compat: of the reversed window that begins one base
    further, either being 0 if masked, so that the last window of a sequence doesn't count. Models take
    their part of it in their order, each from what those before have left, weighted by the product over bases of its
    largest column. Without a column model each candidate is one model.
    """
    if "model" not in candidates.columns:
        candidates = candidates.withColumn("model", F.lit(0))
    keys = ["candidate_id", "model"]
    key = F.concat(F.col("col").cast("string"), F.col("base"))
    models = candidates.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, "p"))).alias("m"))
    top = candidates.groupBy(*keys, "base").agg(F.max("p").alias("p")).groupBy(*keys).agg(F.exp(F.sum(F.ln("p"))).alias("weight"))
    found = windows(seqs, w + 1) if compat else unmasked(windows(seqs, w))
    kinds = found.groupBy("site").agg(F.count("*").alias("times"))
    product = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(w)), F.lit(1.0), lambda acc, i: acc * F.coalesce(F.element_at("m", F.concat((i - 1).cast("string"), F.substring(x, i, F.lit(1)))), F.lit(0.0)))
    own, other = (F.left("site", F.lit(w)), F.reverse(F.right("site", F.lit(w)))) if compat else (F.col("site"), N.revcomp("site"))
    # 5^BLOCK windows at most for few columns, so they go to the candidates, which may be many
    met = models.join(top, keys).crossJoin(F.broadcast(kinds) if w + compat <= BLOCK else kinds)
    best = met.select(*keys, "site", "times", "weight", F.greatest(product(own), product(other)).alias("b"))
    sets = best.groupBy("candidate_id", "site", "times").agg(F.array_sort(F.collect_list(F.struct("model", "b", "weight"))).alias("models"))
    start = F.struct(F.lit(1.0).alias("left"), F.lit(0.0).alias("total"))
    each = F.aggregate("models", start, lambda acc, x: F.struct((acc["left"] * (1 - x["b"])).alias("left"), (acc["total"] + acc["left"] * x["b"] * x["weight"]).alias("total")), lambda acc: acc["total"])
    return sets.select("candidate_id", (each * F.col("times")).alias("f")).groupBy("candidate_id").agg(F.sum("f").alias("fitness"))
