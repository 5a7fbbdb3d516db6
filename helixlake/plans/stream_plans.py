"""The streaming jobs drained over the given tables, with the SQL of what they must have left."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.plans.duck import DRAWS, RESULTS, SAMPLERS, SAMPLES, WALKS, sql
from helixlake.plans.walk_plans import KS, KS_P
from helixlake.sources import inputs as I
from helixlake.sources.store import new_path, stored
from helixlake.streaming import chain_state as W
from helixlake.streaming import streams as X


def arriving(s, rows, parts: int, *key: str):
    """rows as a stream of files, a file in a batch; rows that are equal in key share one."""
    path = new_path(s, "arrivals")
    (rows.repartition(parts, *key) if key else rows.repartition(parts)).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_turn(s, rows, turn, turns: int, *key: str):
    """rows as a stream of those of turn 0, 1, ... one after another: a file for each, or with a key as many as tasks.

    Rows that are equal in key share a file of a turn, so they come in turn even where a batch takes files of two turns, a turn having fewer files.
    """
    path = new_path(s, "turns")
    files = max(int(s.conf.get("spark.sql.shuffle.partitions")), 2 * s.sparkContext.defaultParallelism) if key else 1
    for k in range(turns):
        of = rows.where(turn == k)
        (of.repartition(files, *key) if key else of.coalesce(1)).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(s, start, **conf: str) -> None:
    """Runs start, a function of a checkpoint folder that begins a query, to its end."""
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} | conf  # a timeout would keep a drained query going
    before = {k: s.conf.get(k) for k in own}
    for k, v in own.items():
        s.conf.set(k, v)
    try:
        start(new_path(s, "stream")).awaitTermination()
    finally:
        for k, v in before.items():
            s.conf.set(k, v)


def quorum(s, d):
    """Results come in the order of their ids, in three batches."""
    turn = F.when(F.col("result_id") < 3, 0).when(F.col("result_id") < 5, 1).otherwise(2)
    source = in_turn(s, I.results(s, d), turn, 3, "wu_id")
    out = new_path(s, "decided")
    drained(s, lambda c: X.quorum_shards(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", c).outputMode("append").trigger(availableNow=True).start())
    return s.read.schema(X.QUORUM_ROWS).parquet(out).select("wu_id", "canonical_id", "payload", "n_results", "state")


def sample_sums(s, d):
    source = arriving(s, I.draws(s, d).select("walk_id", "seq_id", "motif", "pos", F.col("k").alias("n")), 3)
    out = new_path(s, "sums")
    drained(s, lambda c: X.sample_sums(source, out, c))
    return X.latest_sums(s.read.parquet(out))


def walk_units(s, d):
    """A unit of 10,000 steps for each walk where it stands, those of every seventh failed, and some sent twice."""
    w = I.walks(s, d).where("not had_error")
    units = w.select("walk_id", F.col("current_steps").alias("from_steps"), F.lit(10000).cast("long").alias("steps"), (F.col("walk_id") % 7 == 0).alias("failed"))
    return units.union(units.where("walk_id % 3 = 0"))


def walk_state(s, d):
    table = new_path(s, "walks")
    X.create_walk_table(I.walks(s, d), table)
    source = arriving(s, walk_units(s, d), 3)
    drained(s, lambda c: X.walk_state_stream(source, table, c))
    return s.read.parquet(table).drop("bucket")


def chain_units(s, d):
    """Units of 10,000 steps, in three batches out of order: up to three for each walk, some failed, missing or sent twice."""
    w = I.walks(s, d)
    k = F.col("k")
    units = w.select("walk_id", "current_steps", F.explode(F.sequence(F.lit(0), F.col("walk_id") % 4)).alias("k")).where("not (k = 1 and walk_id % 5 = 0)")
    units = units.select("walk_id", (F.col("current_steps") + 10000 * k).alias("from_steps"), F.lit(10000).cast("long").alias("steps"), (F.col("walk_id") * 10 + k).alias("seed"), F.format_string("0,%d:1,%d.", F.col("walk_id") % 90, k).alias("sites"), ((F.col("walk_id") % 7 == 0) & (k == 1)).alias("failed"))
    return units.union(units.where("walk_id % 3 = 0"))


def chain_state(s, d):
    """Where all walks stand after the units, of which a walk's later ones mostly come first."""
    walks = I.walks(s, d).select("walk_id", "sampler_id", "current_steps", F.lit(None).cast("long").alias("seed"), F.lit(None).cast("string").alias("sites"), "had_error")
    units = stored(chain_units(s, d), "units")
    source = in_turn(s, units, F.pmod(2 - F.col("seed") % 10 + F.col("walk_id") % 2, F.lit(3)), 3)
    out = new_path(s, "chains")
    drained(s, lambda c: W.chain_states(W.chain_stream(source, walks, I.samplers(s, d)), out, c), **W.PROVIDER)
    changed = W.latest(s.read.parquet(out)).withColumnsRenamed({"sampler_id": "s2", "current_steps": "c2", "seed": "seed2", "sites": "sites2"})
    first = walks.join(I.samplers(s, d), "sampler_id")
    state = F.when(F.col("had_error"), "failed").when(F.col("current_steps") >= F.col("burn_in") + F.col("samples"), "finished").otherwise("active")
    both = first.join(changed, "walk_id", "left")
    return both.select("walk_id", "sampler_id", F.coalesce("c2", "current_steps").alias("current_steps"), F.col("seed2").alias("seed"), F.col("sites2").alias("sites"), F.coalesce("state", state).alias("state"))


def ks_tests(s, d):
    source = arriving(s, stored(I.samples(s, d), "samples"), 3, "walk_id", "step")
    out, kept = new_path(s, "tests"), new_path(s, "snapshots")
    drained(s, lambda c: X.ks_stream(source, kept, out, I.CELLS, c))
    tests = X.latest_tests(s.read.parquet(out))
    return tests.select("walk_id", "step", F.round("d", 6).alias("d"), F.round("p", 6).alias("p"))


QUERIES = {
    "stream_quorum": (
        quorum,
        sql(RESULTS, "n AS (SELECT *, row_number() OVER (PARTITION BY wu_id ORDER BY result_id, payload) AS total FROM results)", "o AS (SELECT *, row_number() OVER (PARTITION BY wu_id, payload ORDER BY total) AS same, min(result_id) OVER (PARTITION BY wu_id, payload) AS f FROM n)",
            "c AS (SELECT wu_id, min({'t': total, 'f': f, 'p': payload}) AS x FROM o WHERE payload <> '' AND same = 2 GROUP BY wu_id)", "SELECT wu_id, x.f AS canonical_id, x.p AS payload, CAST(x.t AS INT) AS n_results, 'canonical' AS state FROM c"),
    ),
    "stream_chain_state": (
        chain_state,
        "WITH RECURSIVE " + sql(WALKS, SAMPLERS, "u AS (SELECT DISTINCT walk_id, current_steps + 10000 * k AS from_steps, walk_id * 10 + k AS seed, printf('0,%d:1,%d.', walk_id % 90, k) AS sites, walk_id % 7 = 0 AND k = 1 AS failed FROM (SELECT walk_id, current_steps, unnest(range(0, walk_id % 4 + 1)) AS k FROM walks) WHERE NOT (k = 1 AND walk_id % 5 = 0))",
            "r AS (SELECT walk_id, sampler_id, current_steps, CAST(NULL AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS sites, had_error, burn_in + samples AS total, 0 AS k FROM walks JOIN samplers USING (sampler_id) UNION ALL SELECT r.walk_id, sampler_id, CASE WHEN u.failed THEN current_steps ELSE current_steps + 10000 END, CASE WHEN u.failed THEN r.seed ELSE u.seed END, CASE WHEN u.failed THEN r.sites ELSE u.sites END, u.failed, total, r.k + 1 FROM r JOIN u ON u.walk_id = r.walk_id AND u.from_steps = r.current_steps WHERE NOT r.had_error AND r.current_steps < r.total)",
            "SELECT walk_id, sampler_id, current_steps, seed, sites, CASE WHEN had_error THEN 'failed' WHEN current_steps >= total THEN 'finished' ELSE 'active' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY k DESC) AS o FROM r) WHERE o = 1").removeprefix("WITH "),
    ),
    "stream_samples": (sample_sums, sql(DRAWS, "SELECT walk_id, seq_id, motif, pos, CAST(sum(k) AS BIGINT) AS n FROM draws GROUP BY ALL")),
    "stream_walk_state": (walk_state, sql(WALKS, "SELECT walk_id, sampler_id, CAST(current_steps + CASE WHEN NOT had_error AND walk_id % 7 <> 0 THEN 10000 ELSE 0 END AS BIGINT) AS current_steps, had_error OR walk_id % 7 = 0 AS had_error FROM walks")),
    "stream_ks_incremental": (ks_tests, sql(SAMPLES, KS, KS_P, "SELECT walk_id, step, round(d, 6) AS d, round(p, 6) AS p FROM ksp")),
    "stream_next_steps": (
        lambda s, d: X.next_steps(I.walks(s, d), I.samplers(s, d), 10000).select("walk_id", F.col("burn").cast("long").alias("burn"), F.col("sample").cast("long").alias("sample")),
        sql(WALKS, SAMPLERS, "n AS (SELECT walk_id, greatest(0, least(10000, burn_in - current_steps)) AS burn, least(10000, burn_in + samples - current_steps) AS all_steps FROM walks JOIN samplers USING (sampler_id) WHERE NOT had_error AND current_steps < burn_in + samples)", "SELECT walk_id, CAST(burn AS BIGINT) AS burn, CAST(all_steps - burn AS BIGINT) AS sample FROM n"),
    ),
}
