"""Queries over motif sites and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators import intervals as V
from helixlake.operators import motifs as M
from helixlake.operators import sequences as S
from helixlake.plans.duck import BACKGROUND, BASES, COUNTS, PWM, REV, SEQS, SITES, sql, win
from helixlake.sources import inputs as I
from helixlake.sources.store import stored

DP = 6
R6 = lambda df, *cols: df.withColumns({c: F.round(c, DP) for c in cols})
# distinct sites are scored once, then joined back
SCAN = """sco AS (SELECT site, motif, exp(sum(ln(p.p / b.p))) AS ratio FROM (SELECT site, unnest(range(0, 6)) AS col FROM (SELECT DISTINCT site FROM win6 WHERE regexp_full_match(site, '[ACGT]+'))) w JOIN pwm p ON p.col = w.col AND p.base = substr(w.site, w.col + 1, 1) JOIN bg b ON b.base = p.base GROUP BY site, motif),
scan AS (SELECT seq_id, pos + 5 AS "end", motif, ratio FROM win6 JOIN sco USING (site) WHERE pos + 6 > 1)"""
MIRROR = "mir AS (SELECT motif, 5 - col AS col, translate(base, 'ACGT', 'TGCA') AS base, n FROM counts)"


def norm(name: str, source: str) -> str:
    return f"""{name}_d AS (SELECT motif, col, base, coalesce(n, 0) AS n FROM (SELECT DISTINCT motif, col FROM {source}) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) LEFT JOIN (SELECT motif, col, base, sum(n) AS n FROM {source} GROUP BY ALL) USING (motif, col, base)),
{name} AS (SELECT motif, col, base, (n + 0.28) / sum(n + 0.28) OVER (PARTITION BY motif, col) AS p FROM {name}_d)"""


def parts(s, d):
    q = I.seqs(s, d)
    st = I.sites(q)
    c = M.motif_counts(st)
    return q, st, c


def per_motif(rows, value, dp):
    """Places, sum and best value of each sequence and motif."""
    return rows.groupBy("seq_id", "motif").agg(F.count("*").alias("n"), F.round(F.sum(value), dp).alias("total"), F.round(F.max(value), dp).alias("best"))


def pwm(s, d):
    return M.normalised(parts(s, d)[2])


def scan(s, d, halved=()):
    q, _, c = parts(s, d)
    # counts are stored, so that the models are one scan of the sequences, the background another and the scan a third
    return M.pwm_scan(q, M.normalised(stored(c, "counts")), S.background(q), 6, halved)


def totals(s, d, dp, value=None, halved=()):
    """Places, sum and best value of each sequence and motif."""
    q, _, c = parts(s, d)
    found, names = M.scan_arrays(q, M.normalised(stored(c, "counts")), S.background(q), 6, halved)
    return M.scan_totals(found, names, value).withColumns({"total": F.round("total", dp), "best": F.round("best", dp)})


def posterior(x, every, k):
    return x * 0.001 / (1 - k * 0.001 + every * 0.001)


def model_sets(s, d):
    """All motifs as one set, then each alone."""
    p = pwm(s, d).withColumnRenamed("motif", "model")
    return p.withColumn("candidate_id", F.lit(0)).unionByName(p.withColumn("candidate_id", F.col("model") + 1))


def spacing(s):
    return s.range(558).select(F.col("id").alias("dist_from_end"), (0.001 + F.col("id") / 1000000).alias("p"))


def classes(s):
    """Columns 0..2 tied with 3..5, as of a repeated half site."""
    return s.range(6).select(F.col("id").cast("int").alias("col"), F.explode(F.array(*map(F.lit, N.BASES))).alias("base")).withColumn("cls", F.concat((F.col("col") % 3).cast("string"), F.lit("r"), F.col("base")))


ALL = (SEQS, SITES, COUNTS, PWM)
SPACE = "sp AS (SELECT i AS dist_from_end, 0.001 + i / 1000000.0::DOUBLE AS prior FROM range(558) t(i))"
QUERIES = {
    "join_site_seq": (lambda s, d: M.site_rows(parts(s, d)[1].drop("site"), I.seqs(s, d)).select("seq_id", "s_start", "site"), sql(SEQS, SITES, "SELECT seq_id, s_start, site FROM sites")),
    "fn_flanks": (
        lambda s, d: parts(s, d)[1].join(I.seqs(s, d).select("seq_id", "nt"), "seq_id").select("seq_id", "s_start", *(c.alias(n) for c, n in zip(N.flanks("nt", "s_start", "s_end"), ("left_flank", "right_flank")))),
        sql(SEQS, SITES, "SELECT seq_id, s_start, lpad(lower(substr(nt, CAST(greatest(s_start - 5, 0) + 1 AS BIGINT), CAST(s_start - greatest(s_start - 5, 0) AS BIGINT))), 5, ' ') AS left_flank, rpad(lower(substr(nt, CAST(s_end + 1 AS BIGINT), 5)), 5, ' ') AS right_flank FROM sites JOIN seqs USING (seq_id)"),
    ),
    "fn_ebox": (
        lambda s, d: parts(s, d)[1].select("seq_id", "s_start", N.ebox("site").alias("has_ebox"), N.ebox(F.concat(F.lit("ca"), "site"), True).alias("starts_ebox")),
        sql(SEQS, SITES, "SELECT seq_id, s_start, contains(site, 'CACCTG') OR contains(site, 'CAGGTG') AS has_ebox, starts_with(upper('ca' || site), 'CACCTG') OR starts_with(upper('ca' || site), 'CAGGTG') AS starts_ebox FROM sites"),
    ),
    "flt_ebox_only": (lambda s, d: parts(s, d)[1].where(N.ebox("site")).select("seq_id", "s_start", "site"), sql(SEQS, SITES, "SELECT seq_id, s_start, site FROM sites WHERE site IN ('CACCTG', 'CAGGTG')")),
    "agg_motif_counts": (lambda s, d: parts(s, d)[2], sql(SEQS, SITES, COUNTS, "SELECT motif, col, base, n FROM counts")),
    "agg_pwm_normal": (lambda s, d: R6(pwm(s, d), "p"), sql(*ALL, "SELECT motif, col, base, round(p::DOUBLE, 6) AS p FROM pwm")),
    "agg_pwm_palindromic": (lambda s, d: R6(M.pwm_palindromic(parts(s, d)[2]), "p"), sql(SEQS, SITES, COUNTS, MIRROR, "both2 AS (SELECT * FROM counts UNION ALL SELECT * FROM mir)", norm("pal", "both2"), "SELECT motif, col, base, round(p::DOUBLE, 6) AS p FROM pal")),
    "agg_pwm_revcomp": (
        lambda s, d: R6(M.pwm_revcomp(parts(s, d)[2], 0, 1), "p"),
        sql(SEQS, SITES, COUNTS, MIRROR, "both2 AS (SELECT * FROM counts WHERE motif = 0 UNION ALL SELECT 0, col, base, n FROM mir WHERE motif = 1)", "back AS (SELECT 1 AS motif, 5 - col AS col, translate(base, 'ACGT', 'TGCA') AS base, n FROM both2)", norm("f", "both2"), norm("r", "back"),
            "SELECT motif, col, base, round(p::DOUBLE, 6) AS p FROM (SELECT * FROM f UNION ALL SELECT * FROM r)"),
    ),
    "agg_pwm_constrained": (
        lambda s, d: R6(M.pwm_constrained(parts(s, d)[2], classes(s)), "p"),
        sql(*ALL, "tied AS (SELECT motif, col, base, avg(n) OVER (PARTITION BY motif, col % 3, base) AS n FROM dense)", norm("con", "tied"), "SELECT motif, col, base, round(p::DOUBLE, 6) AS p FROM con"),
    ),
    "agg_background_sitefree": (
        lambda s, d: R6(M.background_sitefree(parts(s, d)[0], parts(s, d)[2]), "p"),
        sql(SEQS, SITES, COUNTS, BASES, "n AS (SELECT base, count(*) + 5 - (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.base = b.base) AS n FROM bases b WHERE base <> 'X' GROUP BY base)", "SELECT base, round(n / (sum(n) OVER ())::DOUBLE, 6) AS p FROM n"),
    ),
    "fn_consensus": (
        lambda s, d: M.consensus(pwm(s, d)),
        sql(*ALL, "SELECT motif, string_agg(CASE WHEN p > 0.9 THEN base ELSE '?' END, '' ORDER BY col) AS consensus FROM (SELECT motif, col, max(p) AS p, arg_max(base, p) AS base FROM pwm GROUP BY motif, col) GROUP BY motif"),
    ),
    "agg_info_content": (lambda s, d: R6(M.info_content(pwm(s, d), S.background(I.seqs(s, d))), "bits"), sql(*ALL, BACKGROUND, "SELECT motif, col, round(sum(pwm.p * log2(pwm.p / bg.p))::DOUBLE, 6) AS bits FROM pwm JOIN bg USING (base) GROUP BY motif, col")),
    "dist_kl_pwm": (
        lambda s, d: R6(M.kl_pwm(pwm(s, d)), "kl_ab", "kl_ba", "sym"),
        sql(*ALL, "kl AS (SELECT a.motif AS model_a, b.motif AS model_b, sum(a.p * log2(a.p / b.p)) AS x, sum(b.p * log2(b.p / a.p)) AS y FROM pwm a JOIN pwm b USING (col, base) WHERE a.motif < b.motif GROUP BY ALL)", "SELECT model_a, model_b, round(x::DOUBLE, 6) AS kl_ab, round(y::DOUBLE, 6) AS kl_ba, round((x + y)::DOUBLE / 2, 6) AS sym FROM kl"),
    ),
    "score_pwm_scan": (lambda s, d: totals(s, d, 2), sql(*ALL, BACKGROUND, SCAN, 'SELECT seq_id, motif, count(*) AS n, round(sum(ratio)::DOUBLE, 2) AS total, round(max(ratio)::DOUBLE, 2) AS best FROM scan GROUP BY ALL')),
    "score_site_posterior": (
        lambda s, d: totals(s, d, 5, posterior),
        sql(*ALL, BACKGROUND, SCAN, 'p AS (SELECT seq_id, motif, ratio * 0.001 / (1 - count(*) OVER w * 0.001 + sum(ratio * 0.001) OVER w) AS p FROM scan WINDOW w AS (PARTITION BY seq_id, "end"))', "SELECT seq_id, motif, count(*) AS n, round(sum(p)::DOUBLE, 5) AS total, round(max(p)::DOUBLE, 5) AS best FROM p GROUP BY ALL"),
    ),
    "score_spacing_posterior": (
        lambda s, d: per_motif(M.spacing_posterior(scan(s, d), spacing(s)), "p", 5),
        sql(*ALL, BACKGROUND, SCAN, SPACE, 'm AS (SELECT seq_id, "end", motif, ratio, coalesce(prior, 0) AS prior FROM scan JOIN seqs USING (seq_id) LEFT JOIN sp ON sp.dist_from_end = length(nt) - 1 - "end")',
            'p AS (SELECT seq_id, motif, ratio * prior / (1 - sum(prior) OVER w + sum(ratio * prior) OVER w) AS p FROM m WINDOW w AS (PARTITION BY seq_id, "end"))', "SELECT seq_id, motif, count(*) AS n, round(sum(p)::DOUBLE, 5) AS total, round(max(p)::DOUBLE, 5) AS best FROM p GROUP BY ALL"),
    ),
    "flt_frequency": (
        lambda s, d: R6(M.site_posterior(scan(s, d), 0.001).where("p > 0.5").select("seq_id", "end", "motif", "p"), "p"),
        sql(*ALL, BACKGROUND, SCAN, 'p AS (SELECT seq_id, "end", motif, ratio * 0.001 / (1 - count(*) OVER w * 0.001 + sum(ratio * 0.001) OVER w) AS p FROM scan WINDOW w AS (PARTITION BY seq_id, "end"))', 'SELECT seq_id, "end", motif, round(p::DOUBLE, 6) AS p FROM p WHERE p > 0.5'),
    ),
    "near_optimal": (
        lambda s, d: M.site_posterior(scan(s, d), 0.001).groupBy(F.when(F.col("p") > 0.5, "map").when(F.col("p") >= 0.01, "maybe").otherwise("discard").alias("class")).agg(F.count("*").alias("n")),
        sql(*ALL, BACKGROUND, SCAN, 'p AS (SELECT ratio * 0.001 / (1 - count(*) OVER w * 0.001 + sum(ratio * 0.001) OVER w) AS p FROM scan WINDOW w AS (PARTITION BY seq_id, "end"))', "SELECT CASE WHEN p > 0.5 THEN 'map' WHEN p >= 0.01 THEN 'maybe' ELSE 'discard' END AS class, count(*) AS n FROM p GROUP BY 1"),
    ),
    "score_nmer_background": (
        lambda s, d: M.nmer_background(I.seqs(s, d), S.nmer_freq(I.seqs(s, d), 3), 3, 6).groupBy("seq_id").agg(F.count("*").alias("n"), F.round(F.sum("ln_p"), 3).alias("total")),
        sql(SEQS, win(3), win(6), "f AS (SELECT site AS nmer, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM win3 WHERE regexp_full_match(site, '[ACGT]+') GROUP BY 1)", "c AS (SELECT nmer, ln(p) AS a, ln(p / sum(p) OVER (PARTITION BY substr(nmer, 1, 2))) AS b FROM f)",
            "k AS (SELECT site, sum(CASE WHEN i = 1 THEN a ELSE b END) AS ln_p FROM (SELECT site, unnest(range(1, 5)) AS i FROM (SELECT DISTINCT site FROM win6 WHERE regexp_full_match(site, '[ACGT]+'))) JOIN c ON nmer = substr(site, i, 3) GROUP BY site)",
            "SELECT seq_id, count(*) AS n, round(sum(ln_p), 3) AS total FROM win6 JOIN k USING (site) GROUP BY seq_id"),
    ),
    "agg_sites_per_seq": (
        lambda s, d: R6(M.sites_per_seq(parts(s, d)[1], I.seqs(s, d)), "p"),
        sql(SEQS, SITES, "k AS (SELECT seq_id, count(s_start) AS k FROM seqs LEFT JOIN sites USING (seq_id) GROUP BY seq_id)", "SELECT k, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS p FROM k GROUP BY k"),
    ),
    "agg_site_composition": (
        lambda s, d: R6(M.site_composition(parts(s, d)[2], I.seqs(s, d)), "pct_site", "pct_all"),
        sql(SEQS, SITES, COUNTS, BASES, "a AS (SELECT base, count(*) AS n FROM bases WHERE base <> 'X' GROUP BY base), b AS (SELECT base, sum(n) AS k FROM counts GROUP BY base)", "SELECT base, round((100 * coalesce(k, 0) / sum(coalesce(k, 0)) OVER ())::DOUBLE, 6) AS pct_site, round(100 * n / (sum(n) OVER ())::DOUBLE, 6) AS pct_all FROM a LEFT JOIN b USING (base)"),
    ),
    "agg_site_count_sd": (
        lambda s, d: R6(M.site_count_sd(parts(s, d)[1], S.possible_sites(I.seqs(s, d), 6), 0.1), "n", "sd"),
        sql(SEQS, SITES, "t AS (SELECT count(*)::DOUBLE AS t FROM win6 WHERE regexp_full_match(site, '[ACGT]+') AND pos + 6 > 1)", "k AS (SELECT motif, t, count(*) * 1.1::DOUBLE AS a, (t - count(*)) * 1.1::DOUBLE AS b FROM sites CROSS JOIN t GROUP BY motif, t)", "SELECT motif, round(a / (a + b) * t, 6) AS n, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * t, 6) AS sd FROM k"),
    ),
    "agg_transitions": (
        lambda s, d: R6(M.transitions(parts(s, d)[1]), "p"),
        sql(SEQS, SITES, "t AS (SELECT coalesce(lag(motif::VARCHAR) OVER w, 'begin') AS prev, motif::VARCHAR AS cur, lead(motif) OVER w AS nxt FROM sites WINDOW w AS (PARTITION BY seq_id ORDER BY s_start, motif)), u AS (SELECT prev, cur FROM t UNION ALL SELECT cur, 'end' FROM t WHERE nxt IS NULL)",
            "SELECT prev, cur, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY prev))::DOUBLE, 6) AS p FROM u GROUP BY prev, cur"),
    ),
    "win_site_number": (lambda s, d: M.site_numbers(parts(s, d)[1]).select("seq_id", "s_start", "ord"), sql(SEQS, SITES, "SELECT seq_id, s_start, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY s_start, motif) AS INT) AS ord FROM sites")),
    "agg_position_matrix": (
        lambda s, d: R6(M.position_matrix(parts(s, d)[1]), "p"),
        sql(SEQS, SITES, "o AS (SELECT motif, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY s_start, motif) AS INT) AS ord FROM sites)", "SELECT ord, motif, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY ord))::DOUBLE, 6) AS p FROM o GROUP BY ord, motif"),
    ),
    "score_loglik": (lambda s, d: M.loglik(parts(s, d)[2], pwm(s, d)).withColumn("ll", F.round("ll", 3)), sql(*ALL, "SELECT motif, round(sum(counts.n * ln(p))::DOUBLE, 3) AS ll FROM counts JOIN pwm USING (motif, col, base) GROUP BY motif")),
    "em_refine": (lambda s, d: R6(M.em_refine(I.seqs(s, d), pwm(s, d), S.background(I.seqs(s, d)), 6)[0], "p"), None),
    "score_pwm_scan_strands": (
        lambda s, d: totals(s, d, 2, None, (1, 2)),
        sql(*ALL, BACKGROUND, SCAN, "SELECT seq_id, motif, count(*) AS n, round(sum(ratio / CASE WHEN motif = 0 THEN 1 ELSE 2 END)::DOUBLE, 2) AS total, round(max(ratio / CASE WHEN motif = 0 THEN 1 ELSE 2 END)::DOUBLE, 2) AS best FROM scan GROUP BY seq_id, motif"),
    ),
    "score_fitness": (
        lambda s, d: M.fitness(I.seqs(s, d), model_sets(s, d), 6).withColumn("fitness", F.round("fitness", 3)),
        sql(*ALL, "k AS (SELECT site, count(*) AS times FROM win6 WHERE regexp_full_match(site, '[ACGT]+') GROUP BY site)", f"o AS (SELECT site FROM k UNION SELECT {REV.format('site')} FROM k)", "q AS (SELECT site, motif, exp(sum(ln(p.p))) AS f FROM (SELECT site, unnest(range(0, 6)) AS col FROM o) w JOIN pwm p ON p.col = w.col AND p.base = substr(w.site, w.col + 1, 1) GROUP BY ALL)",
            f"b AS (SELECT k.site, k.times, q.motif, greatest(q.f, r.f) AS b FROM k JOIN q ON q.site = k.site JOIN q r ON r.site = {REV.format('k.site')} AND r.motif = q.motif)", "t AS (SELECT motif, exp(sum(ln(p))) AS w FROM (SELECT motif, base, max(p) AS p FROM pwm GROUP BY motif, base) GROUP BY motif)",
            "c AS (SELECT 0 AS candidate_id, motif FROM t UNION ALL SELECT motif + 1, motif FROM t)", "x AS (SELECT candidate_id, times, b * w * coalesce(exp(sum(ln(1 - b)) OVER (PARTITION BY candidate_id, site ORDER BY motif ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS v FROM c JOIN b USING (motif) JOIN t USING (motif))",
            "SELECT candidate_id, round(sum(times * v)::DOUBLE, 3) AS fitness FROM x GROUP BY candidate_id"),
    ),
    "join_overlap": (
        lambda s, d: V.overlaps(parts(s, d)[1], shifted(parts(s, d)[1])),
        sql(SEQS, SITES, "SELECT a.seq_id, a.s_start AS a_start, b.s_start + b.motif AS b_start, least(a.s_end, b.s_end + b.motif) - greatest(a.s_start, b.s_start + b.motif) AS overlap FROM sites a JOIN sites b USING (seq_id) WHERE least(a.s_end, b.s_end + b.motif) - greatest(a.s_start, b.s_start + b.motif) >= 4"),
    ),
    "join_unmatched": (
        lambda s, d: V.unmatched(parts(s, d)[1], shifted(parts(s, d)[1]).where("strand = 'F'")),
        sql(SEQS, SITES, "sh AS (SELECT seq_id, s_start + motif AS s_start, s_end + motif AS s_end FROM sites WHERE strand = 'F'), m AS (SELECT DISTINCT a.seq_id, a.s_start AS x, b.s_start AS y FROM sites a JOIN sh b USING (seq_id) WHERE least(a.s_end, b.s_end) - greatest(a.s_start, b.s_start) >= 4), u AS (SELECT seq_id FROM sites WHERE (seq_id, s_start) NOT IN (SELECT seq_id, x FROM m) UNION ALL SELECT seq_id FROM sh WHERE (seq_id, s_start) NOT IN (SELECT seq_id, y FROM m))",
            "SELECT seq_id, count(*) AS distance FROM u GROUP BY seq_id"),
    ),
    "fn_overlap_len": (
        lambda s, d: parts(s, d)[1].select("seq_id", "s_start", N.overlap_len("s_start", "s_end", F.col("s_start") + F.col("motif") * 4, F.col("s_end") + F.col("motif") * 4).alias("n")),
        sql(SEQS, SITES, "SELECT seq_id, s_start, greatest(0, 6 - motif * 4) AS n FROM sites"),
    ),
    "fn_sample_from_pwm": (lambda s, d: sampled(s, d), None),
}


def shifted(sites):
    return sites.withColumns({"s_start": F.col("s_start") + F.col("motif"), "s_end": F.col("s_end") + F.col("motif")})


def sampled(s, d, seed: int = 11):
    """One site drawn from its motif's model for each sequence: the first base whose cumulative probability reaches a hashed number."""
    from pyspark.sql import Window

    w = Window.partitionBy("motif", "col").orderBy("base").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.broadcast(pwm(s, d).select("motif", "col", "base", F.sum("p").over(w).alias("cum")))
    draws = I.seqs(s, d).select(F.col("seq_id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col"))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "motif", "col"), F.lit(1 << 30)) / float(1 << 30)
    met = draws.join(cum, "col").where(F.col("cum") > u).groupBy("draw", "motif", "col").agg(F.min_by("base", "cum").alias("b"))
    return met.groupBy("draw", "motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "b"))), lambda x: x["b"]), "").alias("site"))
