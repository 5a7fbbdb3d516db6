"""The keyed state of walks: any order of arrival, repeats, restarts, timers."""

import itertools
import random

import pytest
from pyspark.sql import Row

from helixlake.streaming import chain_state as W

WALKS = [(1, 9, 0, False), (2, 9, 20, False), (3, 9, 30, False), (4, 9, 0, True), (5, 9, 0, False), (6, 8, 0, False)]
SAMPLERS = [(9, 20, 20), (8, 0, 1000)]  # id, burn-in, samples


def brute(units):
    """A unit at a time, each where its walk stands."""
    limits = {s: (b, n) for s, b, n in SAMPLERS}
    out = {}
    for walk, sampler, steps, failed in WALKS:
        total, seed, sites = sum(limits[sampler]), None, None
        state = "failed" if failed else "finished" if steps >= total else "active"
        while state == "active" and (u := next((u for u in units if u[0] == walk and u[1] == steps), None)):
            if u[5]:
                state = "failed"
            else:
                steps, seed, sites = steps + u[2], u[3], u[4]
                state = "finished" if steps >= total else "active"
        out[walk] = (steps, seed, sites, state)
    return out


UNITS = [(1, 0, 10, 101, "0,5.", False), (1, 10, 10, 102, "0,6.", False), (1, 20, 10, 103, "0,7.", False), (2, 20, 10, 201, ".", False), (2, 30, 10, 202, "1,9.", False), (2, 40, 10, 203, "late", False)]
UNITS += [(3, 30, 10, 301, "x", True), (3, 40, 10, 302, "y", False), (4, 0, 10, 401, "z", False), (5, 10, 10, 501, "waits", False), (6, 0, 10, 601, None, False), (77, 0, 10, 1, "nobody's", False)]


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    exists = lambda self: bool(self)
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Handle:
    """What a processor asks of its state, in memory."""

    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def processor(walk):
    sampler = next(s for s in SAMPLERS if s[0] == walk[1])
    p = W.ChainProcessor(10, 1000)
    p.init(Handle())
    p.handleInitialState((walk[0],), Row(sampler_id=walk[1], current_steps=walk[2], seed=None, sites=None, had_error=walk[3], burn_in=sampler[1], samples=sampler[2]), Clock(0))
    return p


def rows(units):
    return [Row(walk_id=u[0], from_steps=u[1], steps=u[2], seed=u[3], sites=u[4], failed=u[5]) for u in units]


@pytest.mark.parametrize("walk", WALKS)
def test_every_order_ends_alike(walk):
    own = [u for u in UNITS if u[0] == walk[0]]
    for order in itertools.permutations(own + own[:1]):
        p = processor(walk)
        for u in order:
            list(p.handleInputRows((walk[0],), rows([u]), Clock(0)))
        assert tuple(p.walk.get())[1:5] == brute(UNITS)[walk[0]]
        together = processor(walk)
        list(together.handleInputRows((walk[0],), iter(rows(order)), Clock(0)))
        assert together.walk.get() == p.walk.get()


def test_timers_mark_stalled_walks():
    p = processor(WALKS[4])
    assert list(p.handleInputRows((5,), rows([UNITS[9]]), Clock(50))) == [] and p.handle.timers == [1050]
    out = list(p.handleExpiredTimer((5,), Clock(1100), None))
    assert [(r.state, r.current_steps, r.next_burn, r.next_samples) for r in out] == [("stalled", 0, 10, 0)]
    out = list(p.handleInputRows((5,), rows([(5, 0, 10, 500, "now", False)]), Clock(2000)))
    assert [(r.state, r.current_steps, r.sites, r.next_burn, r.next_samples) for r in out] == [("active", 20, "waits", 0, 10)] and p.handle.timers == [] and not p.waiting


def test_units_split_at_the_burn_in():
    assert [W.next_unit(s, 25, 20, 10) for s in (0, 20, 25, 40, 45, 60)] == [(10, 0), (5, 5), (0, 10), (0, 5), (0, 0), (0, 0)]


def test_stream_over_restarts(spark, tmp_path):
    """Three batches out of order, the last after a restart, end as the units in order."""
    walks = spark.createDataFrame([(w, s, c, None, None, e) for w, s, c, e in WALKS], "walk_id long, sampler_id long, current_steps long, seed long, sites string, had_error boolean")
    samplers = spark.createDataFrame(SAMPLERS, "sampler_id long, burn_in long, samples long")
    units = UNITS + UNITS[:4]
    random.Random(4).shuffle(units)
    names = {k: spark.conf.get(k) for k in (*W.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled")}
    for k, v in (W.PROVIDER | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}).items():
        spark.conf.set(k, v)
    try:
        for part, upto in (([0, 1], 2), ([2], 3)):
            for k in part:
                spark.createDataFrame(units[k::3], W.UNITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/units")
            source = spark.readStream.schema(W.UNITS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/units")
            W.chain_states(W.chain_stream(source, walks, samplers, 10), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    finally:
        for k, v in names.items():
            spark.conf.set(k, v)
    got = {r.walk_id: (r.current_steps, r.seed, r.sites, r.state) for r in W.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = brute(UNITS)
    assert got == {w: want[w] for w in got} and set(got) == {1, 2, 3, 6}
