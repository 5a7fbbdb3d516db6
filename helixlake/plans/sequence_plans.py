"""Queries over sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators import sequences as S
from helixlake.plans.duck import BACKGROUND, BASES, REV, SEQS, SITES, sql, win
from helixlake.sources import inputs as I

#: In all rounded results, so many decimals.
DP = 6


def rnd(*names: str):
    return {n: F.round(n, DP) for n in names}


RUNS = """regs AS (SELECT seq_id, length(nt) AS len, unnest(r) AS run, generate_subscripts(r, 1) AS k FROM (SELECT seq_id, nt, regexp_extract_all(nt, 'A+|C+|G+|T+|X+') AS r FROM seqs)),
runs AS (SELECT seq_id, len, k, run, sum(length(run)) OVER (PARTITION BY seq_id ORDER BY k) AS upto FROM regs),
run AS (SELECT seq_id, run[1] AS base, CAST(upto - length(run) AS BIGINT) AS start, CAST(length(run) AS BIGINT) AS run_len, upto = len AS is_last, run, k FROM runs)"""
KMERS = f"""k6 AS (SELECT site FROM win6 UNION ALL SELECT nt FROM seqs WHERE length(nt) < 6 AND length(nt) > 0),
kmers AS (SELECT least(site, {REV.format('site')}) AS kmer, count(*) FILTER (WHERE site <= {REV.format('site')}) AS fwd, count(*) FILTER (WHERE site > {REV.format('site')}) AS rev, count(*) AS total FROM k6 GROUP BY 1)"""
FOUR = "kmer LIKE '%A%' AND kmer LIKE '%C%' AND kmer LIKE '%G%' AND kmer LIKE '%T%'"
NMER = f"nm AS (SELECT site AS nmer, count(*) AS n FROM win7 WHERE regexp_full_match(site, '[ACGT]+') GROUP BY 1)"


def masked(spark, d):
    return S.mask_runs(S.validate(I.seqs(spark, d))[0], 4)


def stretch_digest(s, d):
    """The longest run of each sequence, the sum of the runs of all places, and the last place of a longest run; sequences without a base have zeros at their last place."""
    each = S.valid_stretches(I.seqs(s, d)).groupBy("seq_id").agg(F.max("n").alias("longest"), F.sum(F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("total"), F.max_by(F.col("start") + F.col("n") - 1, F.struct("n", "start")).alias("at"))
    q = I.seqs(s, d).where(F.length("nt") > 0).select("seq_id", F.length("nt").cast("long").alias("len"))
    zero = F.lit(0).cast("long")
    return q.join(each, "seq_id", "left").select("seq_id", F.coalesce("longest", zero).alias("longest"), F.coalesce("total", zero).alias("total"), F.coalesce("at", F.col("len") - 1).alias("at"))


def feistel(x: str) -> str:
    """The keyed network as SQL; half and key are columns."""
    left, right = f"({x}) >> half", f"({x}) & ((1 << half) - 1)"
    sides = f"{{'l': {left}, 'r': {right}}}"
    step = f"lambda a, r: {{'l': a.r, 'r': xor(a.l, (((((a.r * {S.MIX1} + ((key + r.l * 104729) & 4294967295)) & 4294967295) * {S.MIX2}) & 4294967295) >> 13) & ((1 << half) - 1))}}"
    rounds = ", ".join(f"{{'l': {i}::BIGINT, 'r': 0::BIGINT}}" for i in range(S.ROUNDS))
    folded = f"list_reduce([{sides}, {rounds}], {step})"
    return f"(({folded}).l << half) | ({folded}).r"


CONTROL = f"""WITH RECURSIVE {SEQS},
q AS (SELECT seq_id, nt, length(nt) AS n, CAST(greatest(1, ceil(log2(greatest(length(nt), 1)) / 2)) AS BIGINT) AS half, (7 * 1000003 + seq_id * 7919) & 4294967295 AS key FROM seqs),
b AS (SELECT seq_id, n, half, key, i, substr(nt, CAST(i + 1 AS BIGINT), 1) AS c FROM (SELECT *, unnest(range(n)) AS i FROM q)),
walk AS (SELECT seq_id, n, half, key, i, {feistel('i')} AS x FROM b UNION ALL SELECT seq_id, n, half, key, i, {feistel('x')} FROM walk WHERE x >= n),
o AS (SELECT seq_id, x, CASE WHEN c = 'X' THEN substr('ACGT', CAST((((((i * {S.MIX1} + key) & 4294967295) * {S.MIX2}) & 4294967295) >> 20 & 3) + 1 AS BIGINT), 1) ELSE c END AS c FROM walk JOIN b USING (seq_id, n, half, key, i) WHERE x < n)
SELECT q.seq_id, coalesce(string_agg(c, '' ORDER BY x), '') AS nt FROM q LEFT JOIN o USING (seq_id) GROUP BY q.seq_id"""
QUERIES = {
    "src_seqs": (lambda s, d: I.seqs(s, d), sql(SEQS, "SELECT seq_id, name, nt FROM seqs")),
    "fn_validate_nt": (
        lambda s, d: I.read(s, d, "documents").select("doc_id", N.valid_nt("text").alias("valid"), N.bad_letters("text").alias("n_bad")),
        "SELECT doc_id, regexp_full_match(text, '[ACGTXacgtx]*') AS valid, length(regexp_replace(text, '[ACGTXacgtx]', '', 'g')) AS n_bad FROM documents",
    ),
    "fn_strip_cr": (lambda s, d: I.read(s, d, "pages").select("page_id", N.strip_cr("html").alias("text")), "SELECT page_id, replace(html, chr(13), '') AS text FROM pages"),
    "fn_revcomp": (lambda s, d: I.seqs(s, d).select("seq_id", N.revcomp("nt").alias("rc")), sql(SEQS, f"SELECT seq_id, {REV.format('nt')} AS rc FROM seqs")),
    "fn_windows": (
        lambda s, d: S.window_digest(I.seqs(s, d), 6),
        sql(SEQS, win(6), "SELECT seq_id, count(*) AS n, count(DISTINCT site) AS kinds, min(site) AS first, max(site) AS last, CAST(max(pos) AS BIGINT) AS at FROM win6 GROUP BY seq_id"),
    ),
    "fn_distinct_bases": (
        lambda s, d: S.kmer_canonical(I.seqs(s, d)).select("kmer", N.distinct_bases("kmer").alias("n_bases")),
        sql(SEQS, win(6), KMERS, "SELECT kmer, CAST(kmer LIKE '%A%' AS INT) + CAST(kmer LIKE '%C%' AS INT) + CAST(kmer LIKE '%G%' AS INT) + CAST(kmer LIKE '%T%' AS INT) AS n_bases FROM kmers"),
    ),
    "fn_nmer_index": (
        lambda s, d: S.nmer_freq(I.seqs(s, d), 7).select("nmer", N.nmer_index("nmer").alias("idx")),
        sql(SEQS, win(7), NMER, "SELECT nmer, CAST(list_sum([(position(substr(nmer, i, 1) IN 'ATCG') - 1) * CAST(pow(4, i - 1) AS BIGINT) FOR i IN range(1, 8)]) AS BIGINT) AS idx FROM nm"),
    ),
    "fn_valid_run": (
        lambda s, d: stretch_digest(s, d),
        sql(SEQS, BASES, "r AS (SELECT seq_id, pos, pos - coalesce(max(CASE WHEN base = 'X' THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos), -1) AS run FROM bases)", "SELECT seq_id, CAST(max(run) AS BIGINT) AS longest, CAST(sum(run) AS BIGINT) AS total, CAST(arg_max(pos, run * 10000000 + pos) AS BIGINT) AS at FROM r GROUP BY seq_id"),
    ),
    "fn_possible_end": (
        # a stretch of n bases has n - 7 windows of eight
        lambda s, d: S.valid_stretches(I.seqs(s, d)).where("n >= 8").groupBy("seq_id").agg(F.sum(F.col("n") - 7).alias("n")),
        sql(SEQS, win(8), "SELECT seq_id, count(*) AS n FROM win8 WHERE regexp_full_match(site, '[ACGT]+') AND pos + 8 > 1 GROUP BY 1"),
    ),
    "fn_math": (
        lambda s, d: I.seqs(s, d).select("seq_id", *(F.round(f, DP).alias(k) for k, f in {"ln_n": F.ln(F.length("nt") + 1.0), "exp_n": F.exp(-F.length("nt") / 1000), "abs_n": F.abs(1000.0 - F.length("nt")), "pow_n": F.pow(F.length("nt") / 1000.0, F.lit(1.5)), "sqrt_n": F.sqrt(F.length("nt").cast("double"))}.items())),
        sql(SEQS, "SELECT seq_id, round(ln(length(nt) + 1.0::DOUBLE), 6) AS ln_n, round(exp(-length(nt) / 1000.0::DOUBLE), 6) AS exp_n, round(abs(1000.0::DOUBLE - length(nt)), 6) AS abs_n, round(pow(length(nt) / 1000.0::DOUBLE, 1.5), 6) AS pow_n, round(sqrt(length(nt)::DOUBLE), 6) AS sqrt_n FROM seqs"),
    ),
    "flt_empty_sequences": (
        lambda s, d: S.non_empty(I.read(s, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace("text", "[^a-zA-Z]", "").alias("nt")))[0].select("seq_id", F.length("nt").cast("long").alias("n_nt")),
        "SELECT doc_id AS seq_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS n_nt FROM documents WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 0",
    ),
    "flt_masked_windows": (
        lambda s, d: S.window_digest(I.seqs(s, d), 8, unmasked=True),
        sql(SEQS, win(8), "SELECT seq_id, count(*) AS n, count(DISTINCT site) AS kinds, min(site) AS first, max(site) AS last, CAST(max(pos) AS BIGINT) AS at FROM win8 WHERE regexp_full_match(site, '[ACGT]+') GROUP BY seq_id"),
    ),
    "runs_find": (lambda s, d: S.find_runs(I.seqs(s, d), 4), sql(SEQS, RUNS, "SELECT seq_id, base, run_len, start, is_last AS is_trailing FROM run WHERE run_len >= 4 AND base <> 'X'")),
    "runs_mask": (
        lambda s, d: S.mask_runs(I.seqs(s, d), 4).select("seq_id", "nt"),
        sql(SEQS, RUNS, "SELECT seq_id, string_agg(CASE WHEN run_len >= 4 THEN repeat('X', run_len) ELSE run END, '' ORDER BY k) AS nt FROM run GROUP BY seq_id"),
    ),
    "runs_mask_compat": (
        lambda s, d: S.mask_runs(I.seqs(s, d), 4, mask_trailing=False).select("seq_id", "nt"),
        sql(SEQS, RUNS, "SELECT seq_id, string_agg(CASE WHEN run_len >= 4 AND NOT is_last THEN repeat('X', run_len) ELSE run END, '' ORDER BY k) AS nt FROM run GROUP BY seq_id"),
    ),
    "win_runs": (
        lambda s, d: S.runs(I.seqs(s, d)).groupBy("seq_id", "base").agg(F.count("*").alias("n"), F.max("run_len").alias("longest"), F.sum("start").alias("starts"), F.bool_or("is_last").alias("ends")),
        sql(SEQS, RUNS, "SELECT seq_id, base, count(*) AS n, max(run_len) AS longest, CAST(sum(start) AS BIGINT) AS starts, bool_or(is_last) AS ends FROM run GROUP BY ALL"),
    ),
    "agg_seq_stats": (lambda s, d: S.seq_stats(I.seqs(s, d)), sql(SEQS, "SELECT count(*) AS n_seq, CAST(sum(length(nt)) AS BIGINT) AS n_nt FROM seqs")),
    "agg_background": (lambda s, d: S.background(I.seqs(s, d)).withColumns(rnd("p")), sql(SEQS, BACKGROUND, "SELECT base, round(p, 6) AS p FROM bg")),
    "agg_background_weighted": (
        lambda s, d: S.background_weighted(I.seqs(s, d), I.read(s, d, "labels").select(F.col("doc_id").alias("seq_id"), (0.5 + F.col("quality") / 2).alias("w"))).select("base", "n", F.round("w", DP).alias("w")),
        sql(SEQS, BASES, "w AS (SELECT doc_id AS seq_id, 0.5 + quality / 2.0 AS w FROM labels)",
            "SELECT base, count(b.base) AS n, round(coalesce(sum(coalesce(w.w, 1.0)), 0)::DOUBLE, 6) AS w FROM bases b LEFT JOIN w USING (seq_id) WHERE base IN ('A', 'C', 'G', 'T', 'X') GROUP BY base"),
    ),
    "agg_pseudocounts": (lambda s, d: S.pseudocounts(S.background(I.seqs(s, d)), 0.1, 3).withColumns(rnd("pc")), sql(SEQS, BACKGROUND, "SELECT base, round(greatest(0.01, p * 0.1 * 3), 6) AS pc FROM bg")),
    "agg_kmer_canonical": (lambda s, d: S.kmer_canonical(I.seqs(s, d)), sql(SEQS, win(6), KMERS, "SELECT kmer, fwd, rev, total FROM kmers")),
    "flt_kmers": (lambda s, d: S.common_kmers(S.kmer_canonical(I.seqs(s, d))), sql(SEQS, win(6), KMERS, f"SELECT * FROM kmers WHERE total > 1 AND {FOUR}")),
    "sort_kmers": (
        lambda s, d: S.sort_kmers(S.common_kmers(S.kmer_canonical(masked(s, d)))),
        sql(SEQS.replace("seqs AS", "all_seqs AS"), RUNS.replace("FROM seqs", "FROM all_seqs"), "seqs AS (SELECT seq_id, string_agg(CASE WHEN run_len >= 4 THEN repeat('X', run_len) ELSE run END, '' ORDER BY k) AS nt FROM run GROUP BY seq_id)", win(6), KMERS, f"SELECT * FROM kmers WHERE total > 1 AND {FOUR} ORDER BY total DESC, kmer"),
    ),
    "agg_nmer_freq": (lambda s, d: S.nmer_freq(I.seqs(s, d), 7).withColumn("p", F.round("p", 9)), sql(SEQS, win(7), NMER, "SELECT nmer, n, round(n / (sum(n) OVER ())::DOUBLE, 9) AS p FROM nm")),
    "agg_possible_sites": (lambda s, d: S.possible_sites(I.seqs(s, d), 8), sql(SEQS, win(8), "SELECT CAST(8 AS BIGINT) AS w, count(*) AS n FROM win8 WHERE regexp_full_match(site, '[ACGT]+') AND pos + 8 > 1")),
    "agg_distinct": (
        lambda s, d: I.genes(s, d).agg(F.countDistinct("chrom").alias("n_chrom")).crossJoin(I.windows(I.seqs(s, d), 6).agg(F.countDistinct("site").alias("n_kmers"))),
        sql(SEQS, win(6), "SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_chrom, (SELECT count(DISTINCT site) FROM win6) AS n_kmers"),
    ),
    "gen_control": (lambda s, d: S.shuffled_control(I.seqs(s, d), 7), CONTROL),
    "set_union_control": (
        lambda s, d: I.seqs(s, d).select("seq_id", F.length("nt").alias("n"), F.lit(False).alias("is_control")).unionByName(S.shuffled_control(I.seqs(s, d), 7).select("seq_id", F.length("nt").alias("n"), F.lit(True).alias("is_control"))).groupBy("is_control").agg(F.count("*").alias("n_seq"), F.sum("n").alias("n_nt")),
        sql(SEQS, "SELECT c AS is_control, count(*) AS n_seq, CAST(sum(length(nt)) AS BIGINT) AS n_nt FROM seqs CROSS JOIN (VALUES (true), (false)) t(c) GROUP BY c"),
    ),
    "sites": (lambda s, d: I.sites(I.seqs(s, d)), sql(SEQS, SITES, "SELECT seq_id, s_start, s_end, motif, strand, site FROM sites")),
}
