"""Queries over walks, results, genes and progress tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators import intervals as V
from helixlake.operators import motifs as M
from helixlake.operators import walks as K
from helixlake.plans.duck import DRAWS, GENES, RESULTS, SAMPLERS, SAMPLES, SEQS, WALKS, sql
from helixlake.sources import inputs as I

CELLS = I.CELLS
R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
SUMS = "sums AS (SELECT walk_id, seq_id, motif, pos, CAST(sum(n) AS BIGINT) AS n, min(step) AS from_step, max(step) AS to_step FROM samples WHERE step >= 10000 GROUP BY ALL)"
RANGE = "rng AS (SELECT seq_id, motif, pos, CAST(sum(n) AS BIGINT) AS n FROM sums WHERE to_step > from_step GROUP BY ALL)"
L1 = """cell AS (SELECT a.sampler_id, a.step, a.walk_id AS walk_a, b.walk_id AS walk_b, sum(least(a.n, b.n)) AS m FROM samples a JOIN samples b USING (sampler_id, step, seq_id, motif, pos) WHERE a.walk_id < b.walk_id GROUP BY ALL),
tot AS (SELECT sampler_id, step, walk_id, sum(n) AS t FROM samples GROUP BY ALL),
l1 AS (SELECT a.sampler_id, a.step, a.walk_id AS walk_a, b.walk_id AS walk_b, CAST(a.t + b.t - 2 * coalesce(m, 0) AS BIGINT) AS d FROM tot a JOIN tot b ON a.sampler_id = b.sampler_id AND a.step = b.step AND a.walk_id < b.walk_id LEFT JOIN cell c ON c.step = a.step AND c.walk_a = a.walk_id AND c.walk_b = b.walk_id)"""
LAGS = "ord AS (SELECT walk_id, step, dense_rank() OVER (PARTITION BY walk_id ORDER BY step) AS k FROM (SELECT DISTINCT walk_id, step FROM samples)), lags AS (SELECT a.walk_id, CAST(b.k - a.k AS INT) AS lag, a.step AS step_a, b.step AS step_b FROM ord a JOIN ord b USING (walk_id) WHERE b.k - a.k BETWEEN 1 AND 10)"
KS = f"""prev AS (SELECT walk_id, step, lag(step) OVER (PARTITION BY walk_id ORDER BY step) AS prev FROM (SELECT DISTINCT walk_id, step FROM samples)),
hist AS (SELECT walk_id, step, n AS v, count(*) AS c FROM samples GROUP BY ALL UNION ALL SELECT walk_id, step, 0, {CELLS} - count(*) FROM samples GROUP BY ALL),
both2 AS (SELECT p.walk_id, p.step, v, sum(c) AS x, 0 AS y FROM prev p JOIN hist h ON h.walk_id = p.walk_id AND h.step = p.step WHERE prev IS NOT NULL GROUP BY ALL UNION ALL SELECT p.walk_id, p.step, v, 0, sum(c) FROM prev p JOIN hist h ON h.walk_id = p.walk_id AND h.step = p.prev GROUP BY ALL),
v AS (SELECT walk_id, step, v, sum(x) AS x, sum(y) AS y FROM both2 GROUP BY ALL),
ks AS (SELECT walk_id, step, max(g) / {float(CELLS)}::DOUBLE AS d FROM (SELECT walk_id, step, abs(sum(x) OVER w - sum(y) OVER w) AS g FROM v WINDOW w AS (PARTITION BY walk_id, step ORDER BY v)) GROUP BY ALL)"""
KS_P = f"""ksx AS (SELECT walk_id, step, d, (sqrt({CELLS} / 2.0::DOUBLE) + 0.12 + 0.11 / sqrt({CELLS} / 2.0::DOUBLE)) * d AS x FROM ks),
ksp AS (SELECT walk_id, step, d, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum([(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0::DOUBLE * j * j * x * x) FOR j IN range(1, 21)]))) END AS p FROM ksx)"""
MERGED = """reach AS (SELECT *, max(g_end) OVER (PARTITION BY chrom ORDER BY g_start, g_end, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r, lag(g_end) OVER (PARTITION BY chrom ORDER BY g_start, g_end, gene) AS l FROM genes),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR g_start >= r THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN l IS NULL OR g_start >= l THEN 1 ELSE 0 END) OVER w AS j, row_number() OVER w AS ord FROM reach WINDOW w AS (PARTITION BY chrom ORDER BY g_start, g_end, gene)),
regions AS (SELECT chrom, min(g_start) AS g_start, max(g_end) AS g_end, count(*) AS k, string_agg(gene, ',' ORDER BY gene) AS genes, string_agg(tss::VARCHAR, ',' ORDER BY gene) AS tss FROM isl GROUP BY chrom, i)"""
VALID = "agreed AS (SELECT wu_id, payload, min(result_id) AS f FROM results WHERE payload <> '' GROUP BY ALL HAVING count(*) >= 2), canon AS (SELECT wu_id, c.f AS canonical_id, c.p AS p FROM (SELECT wu_id, min({'f': f, 'p': payload}) AS c FROM agreed GROUP BY wu_id))"
ROWS = "srows AS (SELECT 'g' || seq_id AS gene, motif, pos, 100.0::DOUBLE * n / (10 + pos) AS pct FROM samples)"
PROGRESS = """m AS (SELECT w.*, s.name, s.samples, CASE WHEN s.samples > 0 THEN burn_in + s.samples ELSE max(current_steps) OVER (PARTITION BY sampler_id) END AS most FROM walks w JOIN samplers s USING (sampler_id))"""


def sums(s, d):
    return K.sum_walk(I.samples(s, d), 10000)


def merged(s, d, rule="max"):
    m = V.merge_overlaps(I.genes(s, d), rule)
    return m.select("chrom", "g_start", "g_end", F.size("members").cast("long").alias("k"), F.array_join("members.gene", ",").alias("genes"), F.array_join(F.transform("members.tss", lambda t: t.cast("string")), ",").alias("tss"))


def half(s, d, k):
    """The samples of the walks of even or odd number, as those of one walk."""
    return I.samples(s, d).where(F.col("walk_id") % 2 == k).withColumn("walk_id", F.lit(k))


def drawn_sites(s, d, k):
    """The places that these walks drew in the first iteration."""
    return I.draws(s, d).where((F.col("walk_id") % 2 == k) & (F.col("iter") == 1)).select("seq_id", "motif", F.col("pos").alias("s_start"))


def site_rows(s, d):
    return I.samples(s, d).select(F.concat(F.lit("g"), F.col("seq_id").cast("string")).alias("gene"), F.col("motif"), "pos", (100.0 * F.col("n") / (10 + F.col("pos"))).alias("pct"))


def chunks(s, d):
    """A chromosome for each supplier: the bases of the documents with its number, cut into rows in one pass."""
    return I.chunked(I.seqs(s, d), 1, V.CHUNK).where("part is not null").select(F.col("seq_id").alias("chrom"), F.col("at").alias("chunk_start"), F.col("part").alias("nt"))


def intervals(s, d):
    n = F.length("nt")
    return I.seqs(s, d).select(F.col("seq_id").alias("chrom"), F.floor(n / 4).cast("long").alias("start"), (F.floor(n / 4) + F.ceil(n / 2)).cast("long").alias("end"))


def wilcoxon_pairs(s, d):
    return I.samples(s, d).select("motif", F.col("n").alias("x"), (F.col("pos") % 13 + 1).alias("y"))


def conv(s, d):
    return K.conv_stats(K.l1_walks(I.samples(s, d)))


QUERIES = {
    "src_samples_table": (lambda s, d: I.samples(s, d), sql(SAMPLES, "SELECT * FROM samples")),
    "src_state_tables": (lambda s, d: I.walks(s, d).join(I.samplers(s, d), "sampler_id").select("walk_id", "sampler_id", "current_steps", "had_error", "burn_in", "samples"), sql(WALKS, SAMPLERS, "SELECT walk_id, sampler_id, current_steps, had_error, burn_in, samples FROM walks JOIN samplers USING (sampler_id)")),
    "agg_sum_walk": (sums, sql(SAMPLES, SUMS, "SELECT * FROM sums")),
    "agg_sum_range": (lambda s, d: K.sum_range(sums(s, d)), sql(SAMPLES, SUMS, RANGE, "SELECT * FROM rng")),
    "set_union_walks": (
        lambda s, d: I.samples(s, d).where("walk_id % 2 = 0").unionByName(I.samples(s, d).where("walk_id % 2 = 1")).groupBy("walk_id").agg(F.count("*").alias("cells"), F.sum("n").alias("n")),
        sql(SAMPLES, "SELECT walk_id, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM samples GROUP BY walk_id"),
    ),
    "agg_accumulate": (
        lambda s, d: M.accumulate(I.draws(s, d), 10),
        sql(DRAWS, "SELECT walk_id, seq_id, motif, pos, count(*) AS n FROM draws WHERE iter >= 10 GROUP BY ALL"),
    ),
    "flt_best_sites": (lambda s, d: R6(K.best_sites(K.sum_range(sums(s, d)), 100.0, 0.1), "frac"), sql(SAMPLES, SUMS, RANGE, "SELECT *, round(n / 100.0::DOUBLE, 6) AS frac FROM rng WHERE n / 100.0::DOUBLE > 0.1")),
    "topk_sites": (lambda s, d: K.topk_sites(K.sum_range(sums(s, d)), 3), sql(SAMPLES, SUMS, RANGE, "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seq_id, motif ORDER BY n DESC, pos) AS INT) AS rank FROM rng) WHERE rank <= 3")),
    "walk_pairs": (lambda s, d: K.walk_pairs(I.samples(s, d)), sql(SAMPLES, "SELECT sampler_id, a.step, seq_id, motif, pos, a.walk_id AS walk_a, a.n AS na, b.walk_id AS walk_b, b.n AS nb FROM samples a JOIN samples b USING (sampler_id, step, seq_id, motif, pos) WHERE a.walk_id < b.walk_id")),
    "dist_l1_walks": (lambda s, d: K.l1_walks(I.samples(s, d)), sql(SAMPLES, L1, "SELECT * FROM l1")),
    "agg_conv_stats": (
        lambda s, d: R6(conv(s, d), "avg", "median", "stddev"),
        sql(SAMPLES, L1, "SELECT sampler_id, step, min(d) AS min, round(avg(d), 6) AS avg, round(quantile_cont(d, 0.5)::DOUBLE, 6) AS median, max(d) AS max, round(stddev_pop(d), 6) AS stddev, count(*) AS n FROM l1 GROUP BY sampler_id, step"),
    ),
    "walk_lags": (lambda s, d: K.walk_lags(I.samples(s, d)), sql(SAMPLES, LAGS, "SELECT * FROM lags")),
    "dist_lag": (
        lambda s, d: R6(K.dist_lag(I.samples(s, d), CELLS), "total", "avg", "min", "max"),
        sql(SAMPLES, LAGS, "e AS (SELECT l.*, seq_id, motif, pos, n AS x FROM lags l JOIN samples s ON s.walk_id = l.walk_id AND s.step = step_a UNION ALL SELECT l.*, seq_id, motif, pos, -n FROM lags l JOIN samples s ON s.walk_id = l.walk_id AND s.step = step_b)",
            "c AS (SELECT walk_id, lag, step_a, step_b, abs(sum(x)) AS d FROM e GROUP BY walk_id, lag, step_a, step_b, seq_id, motif, pos)", "p AS (SELECT walk_id, lag, sum(d) AS t, min(d) AS lo, max(d) AS hi, count(*) AS k FROM c GROUP BY walk_id, lag, step_a, step_b)",
            f"SELECT walk_id, lag, round(avg(t), 6) AS total, round(avg(t / {CELLS}::DOUBLE), 6) AS avg, round(avg(CASE WHEN k < {CELLS} THEN 0 ELSE lo END), 6) AS min, round(avg(hi), 6) AS max FROM p GROUP BY walk_id, lag"),
    ),
    "win_prev_step": (lambda s, d: K.prev_step(I.samples(s, d)), sql(SAMPLES, "SELECT walk_id, step, lag(step) OVER (PARTITION BY walk_id ORDER BY step) AS prev FROM (SELECT DISTINCT walk_id, step FROM samples)")),
    "test_ks": (lambda s, d: R6(K.ks(I.samples(s, d), CELLS), "d", "p"), sql(SAMPLES, KS, KS_P, "SELECT walk_id, step, round(d, 6) AS d, round(p, 6) AS p FROM ksp")),
    "test_ks_summary": (
        lambda s, d: R6(K.ks_summary(K.ks(I.samples(s, d), CELLS)), "d_mean", "d_std", "d_min", "d_max", "p_mean", "p_std", "p_min", "p_max"),
        sql(SAMPLES, KS, KS_P, "SELECT step, round(avg(d), 6) AS d_mean, round(stddev_pop(d), 6) AS d_std, round(min(d), 6) AS d_min, round(max(d), 6) AS d_max, round(avg(p), 6) AS p_mean, round(stddev_samp(p), 6) AS p_std, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max FROM ksp GROUP BY step"),
    ),
    "test_wilcoxon": (
        lambda s, d: R6(K.wilcoxon(wilcoxon_pairs(s, d)), "w_plus", "w_minus", "z", "p"),
        sql(SAMPLES, "df AS (SELECT motif, n - (pos % 13 + 1) AS d FROM samples WHERE n <> pos % 13 + 1)", "r AS (SELECT motif, d, rank() OVER (PARTITION BY motif ORDER BY abs(d)) + (count(*) OVER (PARTITION BY motif, abs(d)) - 1) / 2.0::DOUBLE AS r FROM df)",
            "t AS (SELECT motif, sum(c * c * c - c) AS ties FROM (SELECT motif, abs(d) AS a, count(*)::DOUBLE AS c FROM df GROUP BY ALL) GROUP BY motif)",
            "w AS (SELECT motif, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS m FROM r GROUP BY motif)",
            "y AS (SELECT motif, n, p, m, (p - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) AS z FROM w JOIN t USING (motif))", "e AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::DOUBLE)) AS u FROM y)",
            "SELECT motif, n, round(p, 6) AS w_plus, round(m, 6) AS w_minus, round(z, 6) AS z, round(((((1.061405429::DOUBLE * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-z * z / 2), 6) AS p FROM e"),
    ),
    "win_ranks": (
        lambda s, d: wilcoxon_pairs(s, d).groupBy("motif", F.abs(F.col("x") - F.col("y")).alias("a")).agg(F.count("*").alias("c")).select("motif", "a", "c", (F.sum("c").over(Window.partitionBy("motif").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("c") - 1) / 2).alias("rank")),
        sql(SAMPLES, "SELECT motif, a, count(*) AS c, min(r) + (count(*) - 1) / 2.0::DOUBLE AS rank FROM (SELECT motif, abs(n - (pos % 13 + 1)) AS a, rank() OVER (PARTITION BY motif ORDER BY abs(n - (pos % 13 + 1))) AS r FROM samples) GROUP BY motif, a"),
    ),
    "validate_quorum": (lambda s, d: K.quorum(I.results(s, d)), sql(RESULTS, VALID, "SELECT wu_id, canonical_id, result_id, payload <> '' AND payload = p AS valid FROM results JOIN canon USING (wu_id)")),
    "validate_pair": (
        lambda s, d: R6(K.validate_pair(K.sum_walk(half(s, d, 0), 0), K.sum_walk(half(s, d, 1), 0), drawn_sites(s, d, 0), drawn_sites(s, d, 1)), "avg"),
        sql(DRAWS, SAMPLES.removeprefix(DRAWS + ",\n"), "x AS (SELECT seq_id, motif, pos, sum(n) AS n FROM samples WHERE walk_id % 2 = 0 GROUP BY ALL), y AS (SELECT seq_id, motif, pos, sum(n) AS n FROM samples WHERE walk_id % 2 = 1 GROUP BY ALL)", "e AS (SELECT CAST(abs(coalesce(x.n, 0) - coalesce(y.n, 0)) AS BIGINT) AS d FROM x FULL JOIN y USING (seq_id, motif, pos))",
            "t AS (SELECT seq_id, motif, pos FROM draws WHERE iter = 1 GROUP BY ALL HAVING count(DISTINCT walk_id % 2) = 1)",
            "SELECT CAST(sum(d) AS BIGINT) AS sum_diff, max(d) AS max_diff, count(*) FILTER (WHERE d > 100) AS n_over_100, round(avg(d), 6) AS avg, (SELECT count(*) FROM t) AS n_sites_diff, sum(d) = 0 AND (SELECT count(*) FROM t) = 0 AS match FROM e"),
    ),
    "validate_pair_same": (
        lambda s, d: K.validate_pair(K.sum_walk(half(s, d, 0), 0), K.sum_walk(half(s, d, 0), 0), drawn_sites(s, d, 0), drawn_sites(s, d, 0)),
        sql(SAMPLES, "SELECT CAST(0 AS BIGINT) AS sum_diff, CAST(0 AS BIGINT) AS max_diff, CAST(0 AS BIGINT) AS n_over_100, 0::DOUBLE AS avg, CAST(0 AS BIGINT) AS n_sites_diff, count(*) > 0 AS match FROM samples"),
    ),
    "agg_progress": (
        lambda s, d: R6(K.sampler_progress(I.samplers(s, d), I.walks(s, d)), "avg_steps"),
        sql(WALKS, SAMPLERS, "SELECT sampler_id, name, round(avg(current_steps), 6) AS avg_steps, count(*) AS n_walks FROM samplers JOIN walks USING (sampler_id) GROUP BY ALL"),
    ),
    "join_progress": (
        lambda s, d: R6(K.progress(I.samplers(s, d), I.walks(s, d)), "pct"),
        sql(WALKS, SAMPLERS, PROGRESS, "SELECT walk_id, sampler_id, round(CASE WHEN most > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * current_steps / most) ELSE 0 END, 6) AS pct, CASE WHEN had_error THEN 'error' WHEN samples = 0 THEN 'hidden' WHEN current_steps >= most THEN 'finished' ELSE 'active' END AS state FROM m"),
    ),
    "interval_merge": (merged, sql(GENES, MERGED, "SELECT * FROM regions")),
    "interval_merge_last": (
        lambda s, d: merged(s, d, "last"),
        sql(GENES, MERGED, "SELECT chrom, min(g_start) AS g_start, arg_max(g_end, ord) AS g_end, count(*) AS k, string_agg(gene, ',' ORDER BY gene) AS genes, string_agg(tss::VARCHAR, ',' ORDER BY gene) AS tss FROM isl GROUP BY chrom, j"),
    ),
    "join_strand": (
        lambda s, d: I.genes(s, d).select("gene", "chrom").join(I.read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("chrom"), F.when(F.col("s_acctbal") < 0, "-").otherwise("+").alias("db_strand")), "chrom", "left"),
        sql(GENES, "SELECT gene, chrom, CASE WHEN s_acctbal < 0 THEN '-' WHEN s_acctbal IS NOT NULL THEN '+' END AS db_strand FROM genes LEFT JOIN supplier ON s_suppkey = chrom"),
    ),
    "fn_tss_offset": (
        lambda s, d: merged(s, d).select("chrom", "g_start", F.array_join(F.transform(N.tss_offsets(F.col("g_start") + 7, "tss", "g_start"), lambda t: t.cast("string")), ",").alias("offsets")),
        sql(GENES, MERGED, "SELECT chrom, g_start, array_to_string([(g_start + 7 - (t::BIGINT - g_start))::VARCHAR FOR t IN string_split(tss, ',')], ',') AS offsets FROM regions"),
    ),
    "fn_parse_header": (
        lambda s, d: I.genes(s, d).select(N.parse_header(F.concat_ws(" ", F.concat(F.lit("> "), "gene"), "chrom", "g_start", "g_end", "tss", "strand")).alias("h")).select("h.*"),
        sql(GENES, 'SELECT gene, chrom::VARCHAR AS chrom, g_start AS start, g_end AS "end", tss::VARCHAR AS tss, strand FROM genes'),
    ),
    "fn_natural_key": (lambda s, d: I.genes(s, d).select("gene", N.natural_key("gene").alias("k")), "SELECT 'g' || l_orderkey || '_' || l_linenumber AS gene, 'g' || lpad(l_orderkey::VARCHAR, 20, '0') || '_' || lpad(l_linenumber::VARCHAR, 20, '0') AS k FROM lineitem"),
    "sort_natural": (lambda s, d: V.natural_order(I.genes(s, d).select("gene", "chrom"), "gene"), sql(GENES, "SELECT gene, chrom FROM genes")),
    "sort_genes": (lambda s, d: I.genes(s, d).orderBy("chrom", "g_start", "gene"), sql(GENES, "SELECT * FROM genes ORDER BY chrom, g_start, gene")),
    "limit_genes": (lambda s, d: I.genes(s, d).orderBy("chrom", "g_start", "gene").limit(100), sql(GENES, "SELECT * FROM genes ORDER BY chrom, g_start, gene LIMIT 100")),
    "win_cumulative": (
        lambda s, d: I.genes(s, d).groupBy("chrom").agg(F.sum(F.col("g_end") - F.col("g_start")).alias("size")).transform(V.laid_out),
        sql(GENES, "SELECT chrom, CAST(sum(g_end - g_start) AS BIGINT) AS size, CAST(sum(sum(g_end - g_start)) OVER (ORDER BY chrom) AS BIGINT) AS upto FROM genes GROUP BY chrom"),
    ),
    "join_asof_genome": (
        lambda s, d: V.locate(I.read(s, d, "orders").select((F.col("o_orderkey") * 37).cast("long").alias("point")), I.genes(s, d).groupBy("chrom").agg((F.max("g_end") + 1).alias("size"))),
        sql(GENES, "z AS (SELECT chrom, max(g_end) + 1 AS size FROM genes GROUP BY chrom), l AS (SELECT chrom, sum(size) OVER (ORDER BY chrom) - size AS lo, sum(size) OVER (ORDER BY chrom) AS hi FROM z)", "SELECT CAST(o_orderkey * 37 AS BIGINT) AS point, chrom, CAST(o_orderkey * 37 - lo AS BIGINT) AS local FROM orders JOIN l ON o_orderkey * 37 >= lo AND o_orderkey * 37 < hi"),
    ),
    "join_extract": (lambda s, d: V.extract(intervals(s, d), chunks(s, d)), sql(SEQS, 'SELECT seq_id AS chrom, length(nt) // 4 AS start, length(nt) // 4 + (length(nt) + 1) // 2 AS "end", substr(nt, length(nt) // 4 + 1, (length(nt) + 1) // 2) AS nt FROM seqs')),
    "join_control": (
        lambda s, d: V.join_control(I.seqs(s, d)),
        sql(SEQS, "SELECT a.seq_id, b.seq_id AS control_id, length(a.nt) = length(b.nt) AS ok FROM seqs a JOIN seqs b ON b.seq_id = a.seq_id + (SELECT (max(seq_id) + 1) // 2 FROM seqs)"),
    ),
    "src_seq_weights": (
        lambda s, d: V.with_default(I.seqs(s, d).select("seq_id"), I.read(s, d, "labels").select(F.col("doc_id").alias("seq_id"), (0.5 + F.col("quality") / 2).alias("w")), ["seq_id"], "w", 1.0),
        sql(SEQS, "SELECT seq_id, coalesce(0.5 + quality / 2.0::DOUBLE, 1.0) AS w FROM seqs LEFT JOIN labels ON doc_id = seq_id"),
    ),
    "src_seq_weights_sets": (
        # four sequences are a group, in which every sixth is missing; the table has all sets of four species but one
        lambda s, d: R6(V.species_weights(
            I.seqs(s, d).where("seq_id % 6 != 5").select("seq_id", F.floor(F.col("seq_id") / 4).alias("grp"), (F.col("seq_id") % 4).alias("species")),
            s.range(1, 16).where("id != 7").select(F.col("id").alias("code"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("species")).select("code", "species", (1 / (1 + F.col("code") % 5 + F.col("species"))).alias("w"))), "w"),
        sql(SEQS, "q AS (SELECT seq_id, seq_id // 4 AS grp, seq_id % 4 AS species FROM seqs WHERE seq_id % 6 <> 5), c AS (SELECT grp, bit_or(CAST(1 AS BIGINT) << CAST(species AS INT)) AS code FROM q GROUP BY grp)", "SELECT seq_id, round(CASE WHEN code = 7 THEN 1.0::DOUBLE ELSE 1 / (1 + code % 5 + species)::DOUBLE END, 6) AS w FROM q JOIN c USING (grp)"),
    ),
    "src_groups": (
        lambda s, d: V.groups_of(I.seqs(s, d), I.read(s, d, "nation").select((F.col("n_nationkey") * 17).cast("long").alias("start"))),
        sql(SEQS, "SELECT seq_id, CAST(max(n_nationkey * 17) AS BIGINT) AS grp FROM seqs LEFT JOIN nation ON n_nationkey * 17 <= seq_id GROUP BY seq_id"),
    ),
    "agg_motif_stats": (
        lambda s, d: R6(V.motif_stats(site_rows(s, d)), "total", "avg", "max", "min", "std"),
        sql(SAMPLES, ROWS, "SELECT gene, motif, count(*) AS n, round(sum(pct), 6) AS total, round(avg(pct), 6) AS avg, round(max(pct), 6) AS max, round(min(pct), 6) AS min, round(stddev_pop(pct), 6) AS std FROM srows GROUP BY ALL"),
    ),
    "flt_stats": (
        lambda s, d: R6(V.motif_stats(site_rows(s, d)).where("n > 10 and avg > 10"), "total", "avg", "max", "min", "std"),
        sql(SAMPLES, ROWS, "SELECT gene, motif, count(*) AS n, round(sum(pct), 6) AS total, round(avg(pct), 6) AS avg, round(max(pct), 6) AS max, round(min(pct), 6) AS min, round(stddev_pop(pct), 6) AS std FROM srows GROUP BY gene, motif HAVING count(*) > 10 AND avg(pct) > 10"),
    ),
    "agg_location_stats": (
        lambda s, d: R6(V.location_stats(site_rows(s, d).select("gene", F.col("pos").alias("location"), F.concat(F.lit("M"), F.col("motif").cast("string")).alias("motif"), "pct"), 4.0), "total", "avg"),
        sql(SAMPLES, ROWS, "SELECT gene, pos AS location, 'm' || motif AS motif, round(sum(pct) / 4, 6) AS total, round(avg(pct), 6) AS avg, count(*) AS n FROM srows GROUP BY ALL"),
    ),
    "flt_weighted": (
        lambda s, d: R6(V.location_stats(site_rows(s, d).select("gene", F.col("pos").alias("location"), F.concat(F.lit("M"), F.col("motif").cast("string")).alias("motif"), "pct"), 4.0).where("total > 20"), "total", "avg"),
        sql(SAMPLES, ROWS, "SELECT gene, pos AS location, 'm' || motif AS motif, round(sum(pct) / 4, 6) AS total, round(avg(pct), 6) AS avg, count(*) AS n FROM srows GROUP BY ALL HAVING sum(pct) / 4 > 20"),
    ),
    "win_best_so_far": (
        lambda s, d: R6(K.best_so_far(I.read(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value"), "value", "best"),
        "WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS k, max(value) OVER w AS best, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(value, 6) AS value, round(best, 6) AS best, CAST(k - max(CASE WHEN b IS NULL OR value > b THEN k END) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS since FROM o",
    ),
    "win_recent_range": (
        lambda s, d: R6(K.recent_range(I.read(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value"), "value", "range"),
        "SELECT user_id, event_id, round(value, 6) AS value, round(max(value) OVER w - min(value) OVER w, 6) AS range FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    ),
    "set_except": (
        lambda s, d: I.seqs(s, d).select("seq_id").join(I.read(s, d, "labels").select(F.col("doc_id").alias("seq_id")), "seq_id", "left_anti"),
        sql(SEQS, "SELECT seq_id FROM seqs WHERE seq_id NOT IN (SELECT doc_id FROM labels)"),
    ),
}
