"""Structured Streaming jobs over arriving results, walk states and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUORUM_ROWS = "wu_id long, canonical_id long, payload string, n_results int, state string"


def quorum_stream(results: DataFrame, need: int = 2, max_errors: int = 8, max_total: int = 16, ttl: str = "1 hour") -> DataFrame:
    """A row when a work unit reaches its quorum ('canonical') or its limit of failed or of all results ('failed').

    results(wu_id, result_id, payload); empty payloads are failures. The state of a unit holds the first result id
    and the count of each payload; a decided unit keeps only the mark for ttl, in which late results are ignored.
    Under an availableNow trigger set spark.sql.streaming.noDataMicroBatches.enabled to false, or the timeout keeps the query going.
    """
    hours = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, names, firsts, counts, errors, total = state.get if state.exists else (False, [], [], [], 0, 0)
        seen = {p: (f, n) for p, f, n in zip(names, firsts, counts)}
        out = []
        for f in frames:
            # a unit has few rows, so lists take less time than a frame's own sort; null payloads come last
            rows = zip(f["result_id"].tolist(), f["payload"].tolist())
            for result, payload in sorted(rows, key=lambda r: (r[0] != r[0], r[0], r[1] is None, r[1] or "")):
                if done:
                    break
                total += 1
                if not payload:
                    errors += 1
                else:
                    first, n = seen.get(payload, (int(result), 0))
                    seen[payload] = (min(first, int(result)), n + 1)
                    if n + 1 >= need:
                        done = True
                        out.append((key[0], seen[payload][0], payload, total, "canonical"))
                if not done and (errors >= max_errors or total >= max_total):
                    done = True
                    out.append((key[0], None, None, total, "failed"))
        left = {} if done else seen
        state.update((done, list(left), [f for f, _ in left.values()], [n for _, n in left.values()], errors, total))
        state.setTimeoutDuration(hours)
        if out:
            yield pd.DataFrame(out, columns=["wu_id", "canonical_id", "payload", "n_results", "state"]).astype({"canonical_id": "Int64"})

    kept = "done boolean, names array<string>, firsts array<long>, counts array<int>, errors int, total int"
    return results.groupBy("wu_id").applyInPandasWithState(step, QUORUM_ROWS, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Keys that quorum_shards deals the work units to.
SHARDS = 512
#: In place of a result id that is null; it comes last.
NO_ID = np.iinfo(np.int64).max


class Quorums:
    """The units of a shard: arrays in step (key, none: the key is null, done, errors, total, seen: when its last result came), and those payloads of undecided ones that were seen (unit, name, first, n)."""

    UNITS = (("key", np.int64), ("none", np.bool_), ("done", np.bool_), ("errors", np.int64), ("total", np.int64), ("seen", np.int64))
    NAMES = (("unit", np.int64), ("name", object), ("first", np.int64), ("n", np.int64))

    def __init__(self, units: dict[str, np.ndarray], names: dict[str, np.ndarray]):
        self.units, self.names = units, names

    @classmethod
    def empty(cls) -> Quorums:
        return cls(*({c: np.array([], kind) for c, kind in cols} for cols in (cls.UNITS, cls.NAMES)))

    @classmethod
    def load(cls, units: bytes, names: bytes) -> Quorums:
        tables = (pa.ipc.open_stream(x).read_all() for x in (units, names))
        return cls(*({c: t.column(c).to_numpy() for c in t.column_names} for t in tables))

    def dump(self) -> tuple[bytes, bytes]:
        out = []
        for columns in (self.units, self.names):
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if v.dtype == object else pa.array(v) for v in columns.values()], [*columns])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_batch(batch)
            out.append(sink.getvalue().to_pybytes())
        return out[0], out[1]

    def kept(self, keep: np.ndarray) -> Quorums:
        """The units of keep."""
        place, own = np.cumsum(keep) - 1, keep[self.names["unit"]]
        names = {c: v[own] for c, v in self.names.items()}
        return Quorums({c: v[keep] for c, v in self.units.items()}, names | {"unit": place[names["unit"]]})

    def after(self, key: np.ndarray, none: np.ndarray, result: np.ndarray, payload: np.ndarray, now: int, hours: int, need: int, max_errors: int, max_total: int) -> tuple[Quorums, pd.DataFrame]:
        """The units after results (NO_ID: null) at the time now, and the rows of those decided by them; all units at once, as quorum_stream does one by one. Units without results for hours go."""
        old, seen = self.units, self.names
        every = np.unique(np.concatenate([old["key"][~old["none"]], key[~none]]))
        place = lambda k, n: np.where(n, len(every), np.searchsorted(every, k))
        was, unit = place(old["key"], old["none"]), place(key, none)
        size = len(every) + bool(old["none"].any() or none.any())
        new = {c: np.zeros(size, kind) for c, kind in self.UNITS}
        for c, v in old.items():
            new[c][was] = v
        new["key"][: len(every)], new["none"][len(every) :] = every, True
        done = new["done"].copy()

        # results in the order of unit, id and payload; null payloads come last
        code, names = pd.factorize(np.concatenate([seen["name"], payload]), sort=True)
        of, code = code[: len(seen["name"])], code[len(seen["name"]) :]
        code, width = np.where(code < 0, len(names), code), len(names) + 1
        order = np.lexsort((code, result, unit))
        unit, code, result = unit[order], code[order], result[order]
        good = np.append(np.array([bool(x) for x in names], bool), False)[code]
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.array([], np.int64)
        begin = np.repeat(heads, np.diff(np.append(heads, len(unit))))
        total = new["total"][unit] + np.arange(len(unit)) - begin + 1
        upto = np.append(0, np.cumsum(~good))
        errors = new["errors"][unit] + upto[1:] - upto[begin]

        # a result's place among those of its unit and payload, which follow those of the state
        both = np.concatenate([was[seen["unit"]] * width + of, (unit * width + code)[good]])
        many, first = np.concatenate([seen["n"], np.ones(good.sum(), np.int64)]), np.concatenate([seen["first"], result[good]])
        by = np.argsort(both, kind="stable")
        ends = np.flatnonzero(np.append(both[by][1:] != both[by][:-1], True)) if len(both) else np.array([], np.int64)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        sums = np.cumsum(many[by])
        here = sums - np.repeat((sums - many[by])[starts], ends - starts + 1)
        least = np.minimum.reduceat(first[by], starts) if len(ends) else first[:0]
        n, low = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
        n[by], low[by] = here, np.repeat(least, ends - starts + 1)
        times, lowest = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        # of the ids up to a result the least is that of the state or the first of this batch, which is in the order of ids
        times[good], lowest[good] = n[len(of) :], low[len(of) :]

        agreed = good & (times >= need)
        over = (agreed | (errors >= max_errors) | (total >= max_total)) & ~done[unit]
        at = np.flatnonzero(over)
        at = at[np.unique(unit[at], return_index=True)[1]]
        last = np.append(heads[1:], len(unit))[: len(heads)] - 1
        open_ = last[~done[unit[last]]]
        for c, v in (("errors", errors), ("total", total)):
            new[c][unit[open_]] = v[open_]
            new[c][unit[at]] = v[at]
        new["done"][unit[at]] = True
        new["seen"][unit[heads]] = now
        ok = agreed[at]
        rows = pd.DataFrame({
            "wu_id": pd.array(new["key"][unit[at]], "Int64"), "canonical_id": pd.array(np.where(ok, lowest[at], 0), "Int64"), "payload": np.where(ok, np.append(names, None).astype(object)[code[at]], None),
            "n_results": total[at].astype(np.int32), "state": np.where(ok, "canonical", "failed"),
        })
        rows.loc[new["none"][unit[at]], "wu_id"] = pd.NA
        rows.loc[~ok | (lowest[at] == NO_ID), "canonical_id"] = pd.NA
        group = both[by][starts]
        left = ~new["done"][group // width]
        out = Quorums(new, {"unit": (group // width)[left], "name": np.asarray(names, object)[(group % width)[left]], "first": least[left], "n": here[ends][left]})
        return out.kept(new["seen"] + hours > now), rows


def quorum_shards(results: DataFrame, need: int = 2, max_errors: int = 8, max_total: int = 16, ttl: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """quorum_stream for many units a batch: a key of the stream's state is a shard of the units, and a batch's results of a shard are counted at once.

    A batch writes the state of those shards anew that it has results for, some ten bytes a unit. A null result id comes last, and is the canonical one only where no other is.
    """
    hours = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        units = Quorums.load(*map(bytes, state.get)) if state.exists else Quorums.empty()
        if state.hasTimedOut:
            units, rows = units.kept(units.units["seen"] + hours > now), None
        else:
            f = pd.concat(frames, ignore_index=True)
            units, rows = units.after(f["wu_id"].to_numpy(np.int64), f["none"].to_numpy(bool), f["result_id"].to_numpy(np.int64), f["payload"].to_numpy(object), now, hours, need, max_errors, max_total)
        if len(units.units["key"]):
            state.update(units.dump())
            state.setTimeoutDuration(int(max(1, units.units["seen"].min() + hours - now)))
        else:
            state.remove()
        if rows is not None and len(rows):
            yield rows

    id_of = F.col("wu_id").cast("long")
    dealt = results.select(F.pmod(F.xxhash64(id_of), F.lit(shards)).cast("int").alias("shard"), F.coalesce(id_of, F.lit(0)).alias("wu_id"), id_of.isNull().alias("none"), F.coalesce(F.col("result_id").cast("long"), F.lit(int(NO_ID))).alias("result_id"), "payload")
    return dealt.groupBy("shard").applyInPandasWithState(step, QUORUM_ROWS, "units binary, names binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def next_steps(walks: DataFrame, samplers: DataFrame, unit: int) -> DataFrame:
    """How the next unit of each unfinished walk splits: burn_in steps first, then samples."""
    met = walks.join(samplers, "sampler_id").where(~F.col("had_error") & (F.col("current_steps") < F.col("burn_in") + F.col("samples")))
    burn = F.greatest(F.lit(0), F.least(F.lit(unit), F.col("burn_in") - F.col("current_steps")))
    return met.select("walk_id", burn.alias("burn"), (F.least(F.lit(unit), F.col("burn_in") + F.col("samples") - F.col("current_steps")) - burn).alias("sample"))


def advance(walks: DataFrame, units: DataFrame) -> DataFrame:
    """walks after units(walk_id, from_steps, steps, failed). A unit counts once, and only if it starts where its walk stands."""
    w = units.dropDuplicates(["walk_id", "from_steps"])
    return walks.join(w, (walks.walk_id == w.walk_id) & (walks.current_steps == w.from_steps), "left").select(
        walks.walk_id, "sampler_id", (F.col("current_steps") + F.when(F.col("failed") == False, F.col("steps")).otherwise(0)).alias("current_steps"), (F.col("had_error") | F.coalesce("failed", F.lit(False))).alias("had_error")  # noqa: E712
    )


BUCKETS = 64


def bucketed(walks: DataFrame) -> DataFrame:
    """walks with the folder they are kept in."""
    return walks.withColumn("bucket", F.pmod(F.xxhash64("walk_id"), F.lit(BUCKETS)).cast("int"))


def create_walk_table(walks: DataFrame, table: str) -> None:
    bucketed(walks).write.partitionBy("bucket").parquet(table)


def walk_state_stream(units: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps a walk table in folders by a hash of the walk; a batch writes only the folders of the walks it has units for.

    A replayed batch changes nothing, as a unit counts only where its walk stands.
    """
    from helixlake.sources.store import stored

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        walks = spark.read.parquet(table)
        touched = [r.bucket for r in bucketed(batch.select("walk_id")).select("bucket").distinct().collect()]  # BUCKETS rows at most
        if touched:
            new = stored(bucketed(advance(walks.where(F.col("bucket").isin(touched)).drop("bucket"), batch)), "walks")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return units.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_stream(samples: DataFrame) -> DataFrame:
    """Running sums of arriving samples(walk_id, seq_id, motif, pos, n), for update or complete mode."""
    return samples.groupBy("walk_id", "seq_id", "motif", "pos").agg(F.sum("n").alias("n"))


def sample_sums(samples: DataFrame, results: str, checkpoint: str) -> StreamingQuery:
    """Writes the running sums that each batch changed to results, by batch; the last batch of a cell has its sum (latest_sums)."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return sample_stream(samples).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("walk_id", "seq_id", "motif", "pos").agg(F.max_by("n", "batch").alias("n"))


def ks_stream(arrivals: DataFrame, samples: str, results: str, cells: int, checkpoint: str) -> StreamingQuery:
    """Tests newly arrived snapshots (walk_id, step) against the one before, and anew the one behind an arrival in between.

    Samples are kept in folders by a hash of the walk, and only those of the walks in the batch are read. A test is done
    again when its pair of snapshots changes; the last batch of a (walk_id, step) has it (latest_tests). A snapshot arrives whole in one batch.
    """
    from helixlake.operators.walks import ks

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = bucketed(batch).withColumn("batch", F.lit(number))
        if new.isEmpty():
            return
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(samples)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS rows at most
        walks = batch.select("walk_id").distinct()
        known = spark.read.parquet(samples).where(F.col("bucket").isin(touched)).join(walks, "walk_id", "left_semi")
        steps = known.groupBy("walk_id", "step").agg(F.max("batch").alias("came"))
        before = F.lag("came").over(Window.partitionBy("walk_id").orderBy("step"))
        due = steps.withColumn("before", before).where((F.col("came") == number) | (F.col("before") == number)).select("walk_id", "step")
        tests = ks(known.drop("batch", "bucket"), cells).join(due, ["walk_id", "step"], "left_semi")
        tests.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_tests(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("walk_id", "step").agg(F.max_by(F.struct("d", "p"), "batch").alias("t"))
    return last.select("walk_id", "step", "t.d", "t.p")
