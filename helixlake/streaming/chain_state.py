"""The state of walks as units of their chains come in, kept by transformWithState.

A unit says where it started (from_steps), how many steps it made, the seed of the next unit and the sites it ended with, or that it
failed. A walk's state is a value: its steps, seed, sites and whether it is active, finished, failed or stalled. Units that start further on than their walk
stands wait in a map until their turn comes; those that start before it are repeats and change nothing. A timer marks a walk whose waiting units
got no predecessor for ttl as stalled, until one comes. So the outcome doesn't depend on the order of arrival or on repeats. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
UNITS = "walk_id long, from_steps long, steps long, seed long, sites string, failed boolean"
OUT = "walk_id long, sampler_id long, current_steps long, seed long, sites string, state string, next_burn long, next_samples long"
KEPT = "sampler_id long, current_steps long, seed long, sites string, state string, burn_in long, samples long"


def next_unit(steps: int, burn_in: int, samples: int, unit: int) -> tuple[int, int]:
    """(burn, samples) of the unit of a walk that stands at steps: what is left of the burn-in first."""
    burn = max(0, min(unit, burn_in - steps))
    return burn, max(0, min(unit, burn_in + samples - steps) - burn)


class ChainProcessor(StatefulProcessor):
    def __init__(self, unit: int, ttl_ms: int):
        self.unit, self.ttl = unit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", KEPT)
        self.waiting = handle.getMapState("waiting", "from_steps long", "steps long, seed long, sites string, failed boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = [initialState] if isinstance(initialState, Row) else list(initialState)
        for r in rows:
            done = r.current_steps >= r.burn_in + r.samples
            self.walk.update((r.sampler_id, r.current_steps, r.seed, r.sites, "failed" if r.had_error else "finished" if done else "active", r.burn_in, r.samples))

    def told(self, key, w) -> Row:
        sampler, steps, seed, sites, state, burn_in, samples = w
        burn, rest = next_unit(steps, burn_in, samples, self.unit) if state in ("active", "stalled") else (0, 0)
        return Row(walk_id=key[0], sampler_id=sampler, current_steps=steps, seed=seed, sites=sites, state=state, next_burn=burn, next_samples=rest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.walk.exists():
            return  # a unit of no known walk
        before = tuple(self.walk.get())
        sampler, steps, seed, sites, state, burn_in, samples = before
        for r in sorted(rows, key=lambda r: (r.from_steps, r.failed, r.steps, r.seed or 0)):
            if state in ("active", "stalled") and r.from_steps >= steps and not self.waiting.containsKey((r.from_steps,)):
                self.waiting.updateValue((r.from_steps,), (r.steps, r.seed, r.sites, r.failed))
        while state in ("active", "stalled") and self.waiting.containsKey((steps,)):
            made, next_seed, now, failed = self.waiting.getValue((steps,))
            self.waiting.removeKey((steps,))
            if failed:
                state = "failed"
            else:
                steps, seed, sites = steps + made, next_seed, now
                state = "finished" if steps >= burn_in + samples else "active"
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state in ("finished", "failed"):
            self.waiting.clear()
        elif self.waiting.exists() and timerValues.getCurrentProcessingTimeInMs() >= 0:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl)
        after = (sampler, steps, seed, sites, state, burn_in, samples)
        if after != before:
            self.walk.update(after)
            yield self.told(key, after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        w = tuple(self.walk.get())
        if w[4] == "active":
            w = (*w[:4], "stalled", *w[5:])
            self.walk.update(w)
            yield self.told(key, w)

    def close(self) -> None:
        pass


def chain_stream(units: DataFrame, walks: DataFrame, samplers: DataFrame, unit: int = 10_000, ttl_ms: int = 3_600_000) -> DataFrame:
    """A row of OUT whenever a walk changes. units of UNITS arrive; walks(walk_id, sampler_id, current_steps, seed, sites, had_error) and samplers(sampler_id, burn_in, samples) are where it begins."""
    first = walks.join(samplers.select("sampler_id", "burn_in", "samples"), "sampler_id").select("walk_id", "sampler_id", "current_steps", "seed", "sites", "had_error", "burn_in", "samples")
    return units.groupBy("walk_id").transformWithState(ChainProcessor(unit, ttl_ms), OUT, "Update", "processingTime", first.groupBy("walk_id"))


def chain_states(changes: DataFrame, results: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of each batch to results by batch; a batch that runs again replaces its own (see latest)."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """The last state of each walk that changed, of rows with their batch."""
    cols = [c.split()[0] for c in OUT.split(", ")][1:]
    last = rows.groupBy("walk_id").agg(F.max_by(F.struct(*cols), F.struct("batch", "current_steps")).alias("w"))
    return last.select("walk_id", *(F.col(f"w.{c}").alias(c) for c in cols))
