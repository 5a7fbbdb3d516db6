"""Queries over samplers, text formats and priors, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators import alignments as A
from helixlake.operators import chains as C
from helixlake.operators import intervals as V
from helixlake.operators import motifs as M
from helixlake.operators import samplers as G
from helixlake.operators import sequences as S
from helixlake.operators import trees as Y
from helixlake.plans.duck import BACKGROUND, BASES, COUNTS, PWM, REV, SAMPLES, SEQS, SITES, sql, win
from helixlake.sources import inputs as I
from helixlake.sources.store import stored

CFG = G.Config()
R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def sequences(s, d):
    """All sequences, derived from the texts once and dealt evenly, as queries read them again and again."""
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), 2 * s.sparkContext.defaultParallelism)
    return stored(I.seqs(s, d).repartition(tasks, "seq_id", F.length("nt")), "seqs")


def plain(s, d):
    q = sequences(s, d)
    return q, stored(S.background(q), "bg")


def base(s, d):
    q, b = plain(s, d)
    st = stored(I.sites(q), "sites")
    return q, st, M.normalised(stored(M.motif_counts(st), "counts")), b


def scan(s, d):
    q, _, p, b = base(s, d)
    return M.pwm_scan(q, p, b, 6)


def four_walks(s):
    return s.range(4).withColumnRenamed("id", "walk_id")


def chains(s, d):
    """Four short chains over all sequences."""
    q, b = plain(s, d)
    return C.gibbs_walks(q, four_walks(s), b, CFG)


def resumed(s, d):
    """The same chains stopped after two sweeps and continued."""
    q, b = plain(s, d)
    walks = four_walks(s)
    return C.gibbs_walks(q, walks, b, CFG, C.gibbs_walks(q, walks, b, CFG, until=2), done=2)


def distances(s, d):
    """Each walk's cells against the pooled ones, by sequence."""
    cells = I.samples(s, d).groupBy("seq_id", "walk_id").agg(F.countDistinct("motif", "pos").alias("k"))
    pooled = I.samples(s, d).groupBy("seq_id").agg(F.countDistinct("motif", "pos").alias("all"))
    return cells.join(pooled, "seq_id").select("seq_id", F.col("walk_id").alias("sample"), (F.col("all") - F.col("k")).alias("distance"))


def seeds(s, d):
    """The sites that the best of four walks ended with, and their score."""
    q, b = plain(s, d)
    final = C.gibbs_walks(q, four_walks(s), b, CFG).where("kind = 'final'").select("walk_id", "seq_id", "motif", (F.col("end") - 5).alias("s_start"))
    return A.best_walk(stored(final, "final"), q, b, 6, BLOCKS).withColumn("map", F.round("map", 3))


def blocked(s, d):
    """Counts after burn-in, last sites and models of one walk."""
    samples, sites, pwm = C.gibbs_blocked(*plain(s, d), CFG)
    nothing = lambda kind: F.lit(None).cast(kind)
    out = samples.select(F.lit("sample").alias("kind"), "seq_id", "motif", F.col("end").alias("at"), nothing("string").alias("base"), F.col("n").cast("double").alias("value"))
    out = out.union(sites.select(F.lit("site"), "seq_id", "motif", "s_start", nothing("string"), F.lit(1.0)))
    return out.union(pwm.select(F.lit("pwm"), nothing("long"), "motif", F.col("col").cast("long"), "base", F.round("p", 6)))


BLOCKS = [0.2, 0.3, 0.5]


#: Alignments of up to four sites of the three motifs.
ALIGNED = G.Config(widths=(6, 6, 6), max_sites=4, blocks=(0.2, 0.2, 0.2, 0.2, 0.2))


def few(q):
    """The first four sites of a sequence."""
    n = F.row_number().over(Window.partitionBy("seq_id").orderBy("s_start"))
    return I.sites(q).withColumn("k", n).where("k <= 4").select("seq_id", "s_start", "motif")


def refined(s, d):
    """The best alignment near that of all sites, with every further place that raises its score."""
    q, b = plain(s, d)
    return A.map_refine(stored(I.sites(q).select("seq_id", "s_start", "motif"), "sites"), q, b, 6, ALIGNED, 40, capped=False)[0]


def near(s, d):
    q, b = plain(s, d)
    return A.near_optimal(stored(few(q), "few"), q, b, 6, ALIGNED, 100).drop("draws")


def map_score(s, d):
    q, st, _, b = base(s, d)
    return M.map_terms(st, q, b, 6, BLOCKS, max_width=10).select("term", F.round("value", 3).alias("value"))


def map_by_sequence(s, d):
    """The terms of the score for each sequence alone."""
    q, st, _, b = base(s, d)
    return M.map_terms(st, q, b, 6, BLOCKS, max_width=10, by=["seq_id"]).groupBy("seq_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("value"), 4).alias("value"))


def grouped(rows):
    return rows.withColumn("grp", F.pmod("seq_id", F.lit(3)).cast("int"))


def bayes_factor(s, d):
    """Three groups of sequences with a score of their own each, less the score of all together."""
    q, st, _, b = base(s, d)
    each = M.map_terms(grouped(st), grouped(q), b, 6, BLOCKS, max_width=10, by=["grp"]).groupBy("term").agg(F.sum("value").alias("split"))
    pooled = M.map_terms(st, q, b, 6, BLOCKS, max_width=10)
    return pooled.join(each, "term").select("term", F.round(F.col("split") - F.col("value"), 3).alias("bf"))


def population(s, d):
    """Four sets of all motifs: the models of the sites, more and more sharpened."""
    q, _, p, _ = base(s, d)
    w = Window.partitionBy("candidate_id", "model", "col")
    many = p.crossJoin(F.broadcast(four_walks(s))).select(F.col("walk_id").alias("candidate_id"), F.col("motif").alias("model"), "col", "base", F.pow("p", 1 + F.col("walk_id") / 4).alias("x"))
    return M.fitness(q, many.select("candidate_id", "model", "col", "base", (F.col("x") / F.sum("x").over(w)).alias("p")), 6).withColumn("fitness", F.round("fitness", 3))


def genome(s, d, size: int = 10_000):
    """(sizes, chunks): each document's bases are a chromosome."""
    q = I.seqs(s, d).where(F.length("nt") > 0)
    chunks = I.chunked(q, 1, size).where("part is not null").select(F.col("seq_id").alias("chrom"), F.col("at").alias("chunk_start"), F.col("part").alias("nt"))
    return q.select(F.col("seq_id").alias("chrom"), F.length("nt").cast("long").alias("size")), chunks


def random_windows(s, d, width: int = 60):
    """A window for each ten sequences, out of twice as many drawn from the whole genome."""
    sizes, chunks = genome(s, d)
    return V.random_windows(sizes, chunks, max(1, sizes.count() // 10), width, 5)


def on(f):
    """A query from a function of sequences, sites, models and background."""
    return lambda s, d: f(*base(s, d))


def columns(s, d, q=None):
    """Alignment columns: the commonest base at each position among the documents of groups of sources, as leaves a to d."""
    leaf = F.substring("source", -1, 1)
    rows = I.read(s, d, "documents").select("doc_id", F.when(leaf.isin("0", "1", "2"), "a").when(leaf.isin("3", "4", "5"), "b").when(leaf.isin("6", "7"), "c").otherwise("d").alias("leaf"))
    met = I.bases(I.seqs(s, d) if q is None else q).join(rows.withColumnRenamed("doc_id", "seq_id"), "seq_id").where("base != 'X'")
    n = met.groupBy("pos", "leaf", "base").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("pos").alias("col"), "leaf").agg(F.max_by("base", F.struct("n", "base")).alias("base"))


def tree_ratio(s, d):
    q, _, p, b = base(s, d)
    found = Y.tree_ratio(columns(s, d, q).withColumn("aln", F.lit(0)), s.createDataFrame(TREE, Y.EDGES), stored(p, "pwm"), b)
    return found.select("start", "motif", F.round("ln_ratio", 4).alias("ln_ratio"))


def map_sql(name: str, by: str = "") -> str:
    """The terms of the score as a table expression: by the given key, grp being the sequence modulo 3."""
    own, key = ("" if not by else f"{by}, "), ("" if not by else f"{'seq_id % 3' if by == 'grp' else by} AS {by}, ")
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""{name}_c AS (SELECT {key}motif, col, substr(site, col + 1, 1) AS base, count(*)::DOUBLE AS n FROM (SELECT *, unnest(range(0, 6)) AS col FROM sites) GROUP BY ALL),
{name}_d AS (SELECT {own}motif, col, x.base, coalesce(n, 0) AS n, p * 4.0 AS a FROM (SELECT DISTINCT {own}motif, col FROM {name}_c) CROSS JOIN (SELECT base, p::DOUBLE AS p FROM bg) x LEFT JOIN {name}_c USING ({own}motif, col, base)),
{name}_m AS (SELECT {own}sum(v) AS value FROM (SELECT {own}motif, col, sum(lgamma(n + a) - lgamma(a)) + lgamma(sum(a)) - lgamma(sum(n) + sum(a)) AS v FROM {name}_d GROUP BY ALL) {group}),
{name}_t AS (SELECT {key}b.base, sum(length(nt) - length(replace(nt, b.base, '')))::DOUBLE AS n, any_value(b.p)::DOUBLE * 4.0 AS a FROM seqs CROSS JOIN bg b GROUP BY ALL),
{name}_i AS (SELECT {own}base, sum(n) AS i FROM {name}_c GROUP BY ALL),
{name}_b AS (SELECT {own}sum(lgamma(n - coalesce(i, 0) + a) - lgamma(a)) + lgamma(sum(a)) - lgamma(sum(n - coalesce(i, 0)) + sum(a)) AS b, sum(lgamma(n + a) - lgamma(a)) + lgamma(sum(a)) - lgamma(sum(n) + sum(a)) AS z FROM {name}_t LEFT JOIN {name}_i USING ({own}base) {group}),
{name}_p AS (SELECT {key}count(*)::DOUBLE AS p FROM win6 WHERE regexp_full_match(site, '[ACGT]+') AND pos + 6 > 1 GROUP BY ALL),
{name}_k AS (SELECT {key}motif, count(*)::DOUBLE AS k FROM sites GROUP BY ALL),
{name}_l AS (SELECT {own}sum(lgamma(k + 1) + lgamma(p - k + 1) - lgamma(p + 2)) AS l, -ln(70.0::DOUBLE) * count(*) AS f FROM {name}_k JOIN {name}_p {join} {group}),
{name}_s AS (SELECT {key}sum(ln(CASE WHEN k = 0 THEN 0.2::DOUBLE WHEN k = 1 THEN 0.3 ELSE 0.5 END)) AS s FROM (SELECT seq_id, count(s_start) AS k FROM seqs LEFT JOIN sites USING (seq_id) GROUP BY seq_id) {'GROUP BY ALL' if by else ''}),
{name} AS (SELECT {own}'motif' AS term, value FROM {name}_m UNION ALL SELECT {own}'background', b FROM {name}_b UNION ALL SELECT {own}'null', -z FROM {name}_b UNION ALL SELECT {own}'placement', l FROM {name}_l UNION ALL SELECT {own}'fragmentation', f FROM {name}_l UNION ALL SELECT {own}'sites', s FROM {name}_s)"""


TREE = [("r", None, 0.0, None), ("x", "r", 0.1, None), ("y", "r", 0.2, None), ("a", "x", 0.1, "a"), ("b", "x", 0.3, "b"), ("c", "y", 0.2, "c"), ("d", "y", 0.1, "d")]
PI = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
#: The commonest base of each group of sources at each place, the groups' bases as a pattern, and the pruning of the patterns over TREE for each of the equilibria eq(e, base, p).
LEAVES = """lf AS (SELECT pos AS col, leaf, base, count(*) AS n FROM bases JOIN (SELECT doc_id AS seq_id, CASE WHEN right(source, 1) IN ('0', '1', '2') THEN 'a' WHEN right(source, 1) IN ('3', '4', '5') THEN 'b' WHEN right(source, 1) IN ('6', '7') THEN 'c' ELSE 'd' END AS leaf FROM documents) USING (seq_id) WHERE base <> 'X' GROUP BY ALL),
top AS (SELECT col, leaf, max({'n': n, 'b': base}).b AS b FROM lf GROUP BY col, leaf),
pat AS (SELECT col, coalesce(max(CASE WHEN leaf = 'a' THEN b END), '-') || coalesce(max(CASE WHEN leaf = 'b' THEN b END), '-') || coalesce(max(CASE WHEN leaf = 'c' THEN b END), '-') || coalesce(max(CASE WHEN leaf = 'd' THEN b END), '-') AS pattern FROM top GROUP BY col)"""
PRUNED = """k AS (SELECT e, 1 / (1 - sum(p * p)) AS k FROM eq GROUP BY e),
tip AS (SELECT pattern, e, s.base, i, CASE WHEN c = '-' THEN 1 ELSE exp(-k * t) * (CASE WHEN s.base = c THEN 1 ELSE 0 END) + (1 - exp(-k * t)) * o.p END AS v FROM (SELECT DISTINCT pattern, i, t, substr(pattern, i, 1) AS c FROM pat CROSS JOIN (VALUES (1, 0.1::DOUBLE), (2, 0.3), (3, 0.2), (4, 0.1)) l(i, t)) x CROSS JOIN eq s JOIN k USING (e) LEFT JOIN eq o ON o.e = s.e AND o.base = c),
mid AS (SELECT pattern, e, base, product(v) FILTER (WHERE i < 3) AS x, product(v) FILTER (WHERE i > 2) AS y FROM tip GROUP BY ALL),
mean AS (SELECT pattern, e, sum(x * p) AS mx, sum(y * p) AS my FROM mid JOIN eq USING (e, base) GROUP BY ALL),
lik AS (SELECT pattern, e, sum(p * (exp(-k * 0.1) * x + (1 - exp(-k * 0.1)) * mx) * (exp(-k * 0.2) * y + (1 - exp(-k * 0.2)) * my)) AS v FROM mid JOIN mean USING (pattern, e) JOIN eq USING (e, base) JOIN k USING (e) GROUP BY ALL)"""
ALL = (SEQS, SITES, COUNTS, PWM)
QUERIES = {
    "count_placements": (
        lambda s, d: G.count_placements(I.seqs(s, d), (6,), 2).where("k > 0").select("seq_id", "k", F.col("n").cast("long").alias("n")),
        sql(SEQS, SITES, "one AS (SELECT seq_id, pos FROM win6 WHERE regexp_full_match(site, '[ACGT]+'))", "v AS (SELECT seq_id, count(*) OVER (PARTITION BY seq_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS before FROM one)",
            "t AS (SELECT seq_id, count(*) AS n1, sum(before) AS n2 FROM v GROUP BY seq_id)", "SELECT seq_id, CAST(k AS INT) AS k, CAST(coalesce(CASE WHEN k = 1 THEN n1 ELSE n2 END, 0) AS BIGINT) AS n FROM seqs CROSS JOIN range(1, 3) r(k) LEFT JOIN t USING (seq_id)"),
    ),
    "forward_dp": (
        on(lambda q, st, p, b: G.forward_dp(q, p, b, 2).where("k > 0 and total > 0").select("seq_id", "k", F.round(F.ln("total"), 6).alias("ln_total"))),
        sql(*ALL, BACKGROUND, "sco AS (SELECT site, sum(r) AS ratio FROM (SELECT site, motif, exp(sum(ln(p.p / b.p))) AS r FROM (SELECT site, unnest(range(0, 6)) AS col FROM (SELECT DISTINCT site FROM win6 WHERE regexp_full_match(site, '[ACGT]+'))) w JOIN pwm p ON p.col = w.col AND p.base = substr(w.site, w.col + 1, 1) JOIN bg b ON b.base = p.base GROUP BY site, motif) GROUP BY site)",
            "v AS (SELECT seq_id, ratio, sum(ratio) OVER (PARTITION BY seq_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS before FROM win6 JOIN sco USING (site))", "t AS (SELECT seq_id, sum(ratio) AS t1, sum(ratio * before) AS t2 FROM v GROUP BY seq_id)",
            "SELECT seq_id, CAST(k AS INT) AS k, round(ln(x)::DOUBLE, 6) AS ln_total FROM (SELECT seq_id, k, CASE WHEN k = 1 THEN t1 ELSE t2 END AS x FROM t CROSS JOIN range(1, 3) r(k)) WHERE x > 0"),
    ),
    "init_uniform": (lambda s, d: G.init_uniform(*plain(s, d), CFG), None),
    "sample_sites": (on(lambda q, st, p, b: G.sample_sites(q, p, b, CFG)), None),
    "gibbs_walks": (chains, None),
    "resume_walk": (resumed, None),
    "gibbs_blocked": (blocked, None),
    "one_site_sampler": (lambda s, d: G.one_site(scan(s, d), 3), None),
    "shift_move": (on(lambda q, st, p, b: G.shift_move(st.select("seq_id", "motif", "s_start", "s_end"), q, b, 6, 2, 5)), None),
    "multi_seed_best": (seeds, None),
    "map_refine": (refined, None),
    "near_optimal_draws": (near, None),
    "score_map": (map_score, sql(*ALL, BACKGROUND, map_sql("m"), "SELECT term, round(value, 3) AS value FROM m")),
    "score_map_by_sequence": (map_by_sequence, sql(*ALL, BACKGROUND, map_sql("m", "seq_id"), "SELECT seq_id, count(*) AS n_terms, round(sum(value), 4) AS value FROM m GROUP BY seq_id")),
    "score_bayes_factor": (bayes_factor, sql(*ALL, BACKGROUND, map_sql("m"), map_sql("g", "grp"), "SELECT term, round(t - value, 3) AS bf FROM m JOIN (SELECT term, sum(value) AS t FROM g GROUP BY term) USING (term)")),
    "score_population": (
        population,
        sql(*ALL, "k AS (SELECT site, count(*) AS times FROM win6 WHERE regexp_full_match(site, '[ACGT]+') GROUP BY site)", f"o AS (SELECT site FROM k UNION SELECT {REV.format('site')} FROM k)", "s AS (SELECT c, motif, col, base, pow(p, 1 + c / 4.0::DOUBLE) / sum(pow(p, 1 + c / 4.0::DOUBLE)) OVER (PARTITION BY c, motif, col) AS p FROM pwm CROSS JOIN range(4) r(c))",
            "q AS (SELECT c, site, motif, exp(sum(ln(p.p))) AS f FROM (SELECT site, unnest(range(0, 6)) AS col FROM o) w JOIN s p ON p.col = w.col AND p.base = substr(w.site, w.col + 1, 1) GROUP BY ALL)", f"b AS (SELECT q.c, k.site, k.times, q.motif, greatest(q.f, r.f) AS b FROM k JOIN q ON q.site = k.site JOIN q r ON r.site = {REV.format('k.site')} AND r.motif = q.motif AND r.c = q.c)",
            "t AS (SELECT c, motif, exp(sum(ln(p))) AS w FROM (SELECT c, motif, base, max(p) AS p FROM s GROUP BY ALL) GROUP BY c, motif)", "x AS (SELECT c, times, b * w * coalesce(exp(sum(ln(1 - b)) OVER (PARTITION BY c, site ORDER BY motif ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS v FROM b JOIN t USING (c, motif))", "SELECT c AS candidate_id, round(sum(times * v)::DOUBLE, 3) AS fitness FROM x GROUP BY c"),
    ),
    "sample_genome_windows": (random_windows, None),
    "centroid_sites": (lambda s, d: G.centroid_sites(I.samples(s, d).groupBy("seq_id", "motif", (F.col("pos") % 8 + 6).alias("end")).agg(F.sum("n").alias("n")), None, (6, 5, 6)), None),
    "credibility": (
        lambda s, d: R6(G.credibility(distances(s, d), 0.5), "mean").select("seq_id", "distance", "mean"),
        sql(SAMPLES, "k AS (SELECT seq_id, walk_id, count(DISTINCT (motif, pos)) AS k FROM samples GROUP BY ALL), p AS (SELECT seq_id, count(DISTINCT (motif, pos)) AS a FROM samples GROUP BY ALL), x AS (SELECT seq_id, walk_id, a - k AS dist, row_number() OVER (PARTITION BY seq_id ORDER BY a - k, walk_id) - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS c FROM k JOIN p USING (seq_id))",
            "SELECT seq_id, max(CASE WHEN i = least(floor(0.5 * c), c - 1) THEN dist END) AS distance, round(avg(dist), 6) AS mean FROM x GROUP BY seq_id"),
    ),
    "score_tree_column": (
        lambda s, d: Y.tree_column(columns(s, d), s.createDataFrame(TREE, Y.EDGES), PI).withColumn("likelihood", F.round("likelihood", 8)),
        sql(SEQS, BASES, LEAVES, "eq AS (SELECT 0 AS e, * FROM (VALUES ('A', 0.3::DOUBLE), ('C', 0.2), ('G', 0.2), ('T', 0.3)) t(base, p))", PRUNED, "SELECT col, round(v, 8) AS likelihood FROM pat JOIN lik USING (pattern)"),
    ),
    "score_tree_ratio": (
        tree_ratio,
        sql(*ALL, BACKGROUND, BASES, LEAVES, "eq AS (SELECT 0 AS e, base, p::DOUBLE AS p FROM bg UNION ALL SELECT 1 + motif * 6 + col, base, p::DOUBLE FROM pwm)", PRUNED, "g AS (SELECT a.pattern, a.e, ln(a.v / b.v) AS x FROM lik a JOIN lik b ON b.pattern = a.pattern AND b.e = 0 WHERE a.e > 0)",
            "SELECT CAST(col - (e - 1) % 6 AS BIGINT) AS start, CAST((e - 1) // 6 AS INT) AS motif, round(sum(x), 4) AS ln_ratio FROM pat JOIN g USING (pattern) GROUP BY ALL HAVING count(*) = 6"),
    ),
    "tree_unmatched": (
        lambda s, d: Y.tree_unmatched(I.read(s, d, "labels").select(F.col("doc_id").alias("leaf")), I.seqs(s, d)),
        sql(SEQS, "SELECT 'leaf' AS what, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT seq_id FROM seqs) UNION ALL SELECT 'sequence', seq_id FROM seqs WHERE seq_id NOT IN (SELECT doc_id FROM labels)"),
    ),
    "sort_pwms": (
        on(lambda q, st, p, b: M.fitness(q, p.withColumnRenamed("motif", "candidate_id"), 6, compat=True).orderBy(F.desc("fitness"), "candidate_id").select("candidate_id", F.round("fitness", 3).alias("fitness"))),
        sql(*ALL, win(7), "k AS (SELECT left(site, 6) AS f, reverse(right(site, 6)) AS r, count(*) AS times FROM win7 GROUP BY ALL)", "q AS (SELECT site, motif, exp(sum(ln(p.p))) AS f FROM (SELECT site, unnest(range(0, 6)) AS col FROM (SELECT f AS site FROM k UNION SELECT r FROM k) WHERE regexp_full_match(site, '[ACGT]+')) w JOIN pwm p ON p.col = w.col AND p.base = substr(w.site, w.col + 1, 1) GROUP BY ALL)",
            "b AS (SELECT m.motif, sum(k.times * greatest(coalesce(q.f, 0), coalesce(r.f, 0))) AS f FROM k CROSS JOIN (SELECT DISTINCT motif FROM pwm) m LEFT JOIN q ON q.site = k.f AND q.motif = m.motif LEFT JOIN q r ON r.site = k.r AND r.motif = m.motif GROUP BY m.motif)", "t AS (SELECT motif, exp(sum(ln(w))) AS w FROM (SELECT motif, base, max(p) AS w FROM pwm GROUP BY motif, base) GROUP BY motif)", "SELECT motif AS candidate_id, round((f * w)::DOUBLE, 3) AS fitness FROM b JOIN t USING (motif)"),
    ),
    "fn_site_priors": (
        on(lambda q, st, p, b: R6(M.sites_per_seq(st, q).select("k", N.poisson(F.col("k"), 2.5).alias("poisson"), N.negative_binomial(F.col("k"), 2.0, 0.8).alias("negbin")), "poisson", "negbin")),
        sql(SEQS, SITES, "k AS (SELECT count(s_start) AS k FROM seqs LEFT JOIN sites USING (seq_id) GROUP BY seq_id)", "SELECT DISTINCT k, round(exp(k * ln(2.5::DOUBLE) - 2.5 - lgamma(k + 1)), 6) AS poisson, round(exp(lgamma(k + 2.0::DOUBLE) - lgamma(2.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) + 2 * ln(0.8 / 1.8::DOUBLE) + k * ln(1 / 1.8::DOUBLE)), 6) AS negbin FROM k"),
    ),
}
