"""DuckDB texts of the input tables, as common table expressions."""

from helixlake.sources.inputs import CODED, LETTERS

SEQS = f"seqs AS (SELECT doc_id AS seq_id, '> doc' || doc_id AS name, translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{CODED}') AS nt FROM documents WHERE length(text) > 0)"
DRAWS = """draws AS (SELECT CAST(user_id // 5 AS BIGINT) AS sampler_id, CAST(user_id AS BIGINT) AS walk_id, CAST(day(ts) AS BIGINT) AS iter, CAST(user_id // 5 * 4 + event_id % 4 AS BIGINT) AS seq_id,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS motif, CAST(floor(value) AS BIGINT) % 50 AS pos, CAST(1 + event_id % 7 AS BIGINT) AS k FROM events)"""
SAMPLES = DRAWS + """,
samples AS (SELECT sampler_id, walk_id, CAST(10000 * ((iter - 1) // 3) AS BIGINT) AS step, seq_id, motif, pos, CAST(sum(k) AS BIGINT) AS n FROM draws GROUP BY ALL)"""
GENES = """genes AS (SELECT 'g' || l_orderkey || '_' || l_linenumber AS gene, CAST(l_suppkey AS BIGINT) AS chrom, CAST(l_partkey * 400 + l_linenumber * 37 AS BIGINT) AS g_start,
  CAST(l_partkey * 400 + l_linenumber * 37 + 40 + CAST(floor(l_quantity) AS BIGINT) AS BIGINT) AS g_end, CAST(l_partkey * 400 + l_linenumber * 37 + 20 AS BIGINT) AS tss, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem)"""
WALKS = "walks AS (SELECT CAST(c_custkey AS BIGINT) AS walk_id, CAST(c_nationkey AS BIGINT) AS sampler_id, CAST(10000 * (c_custkey % 50) AS BIGINT) AS current_steps, c_acctbal < 0 AS had_error FROM customer)"
SAMPLERS = "samplers AS (SELECT CAST(n_nationkey AS BIGINT) AS sampler_id, n_name AS name, CAST(100000 AS BIGINT) AS burn_in, CAST(100000 * n_regionkey AS BIGINT) AS samples FROM nation)"
RESULTS = "results AS (SELECT CAST(l_orderkey AS BIGINT) AS wu_id, CAST(l_linenumber AS BIGINT) AS result_id, CASE WHEN l_quantity < 2 THEN '' ELSE l_returnflag || l_linestatus END AS payload FROM lineitem)"
BASES = "bases AS (SELECT seq_id, i - 1 AS pos, substr(nt, i, 1) AS base FROM (SELECT seq_id, nt, unnest(range(1, length(nt) + 1)) AS i FROM seqs))"
REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def win(w: int) -> str:
    return f"win{w} AS (SELECT seq_id, i - 1 AS pos, substr(nt, i, {w}) AS site FROM (SELECT seq_id, nt, unnest(range(1, greatest(length(nt) - {w} + 2, 1))) AS i FROM seqs))"


SITES = f"""{win(6)}, sites AS (SELECT seq_id, pos AS s_start, pos + 6 AS s_end, CASE WHEN substr(site, 3, 1) IN ('A', 'C') THEN 0 WHEN substr(site, 3, 1) = 'G' THEN 1 ELSE 2 END AS motif,
  CASE WHEN site <= {REV.format('site')} THEN 'F' ELSE 'R' END AS strand, site
  FROM (SELECT *, lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) AS prev FROM win6 WHERE regexp_full_match(site, 'CA[ACGT][ACGT]TG')) WHERE prev IS NULL OR pos - prev >= 6)"""
COUNTS = "counts AS (SELECT motif, CAST(col AS INTEGER) AS col, substr(site, col + 1, 1) AS base, count(*) AS n FROM (SELECT motif, site, unnest(range(0, 6)) AS col FROM sites) GROUP BY ALL)"
PWM = """dense AS (SELECT motif, col, base, coalesce(n, 0) AS n FROM (SELECT DISTINCT motif, col FROM counts) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) LEFT JOIN counts USING (motif, col, base)),
pwm AS (SELECT motif, col, base, (n + 0.28) / sum(n + 0.28) OVER (PARTITION BY motif, col) AS p FROM dense)"""
BACKGROUND = """raw AS (SELECT sum(length(nt) - length(replace(nt, 'A', ''))) + 5 AS a, sum(length(nt) - length(replace(nt, 'C', ''))) + 5 AS c, sum(length(nt) - length(replace(nt, 'G', ''))) + 5 AS g, sum(length(nt) - length(replace(nt, 'T', ''))) + 5 AS t FROM seqs),
bg AS (SELECT b.base, CASE WHEN b.base IN ('A', 'T') THEN (a + t) / 2.0 ELSE (c + g) / 2.0 END / (a + c + g + t) AS p FROM raw CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base))"""


def sql(*parts: str) -> str:
    """Common table expressions, then the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
