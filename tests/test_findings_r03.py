"""Cases of the third round's findings."""

from pyspark.sql import functions as F

from helixlake.operators import intervals as V
from helixlake.operators import walks as K


def test_extract_of_an_interval_without_bases(spark):
    intervals = spark.createDataFrame([(1, 0, 0), (2, 1, 4), (3, 20, 20)], "chrom long, start long, end long")
    chunks = spark.createDataFrame([(2, 0, "ACGTA")], "chrom long, chunk_start long, nt string")
    assert sorted(map(tuple, V.extract(intervals, chunks).collect())) == [(1, 0, 0, ""), (2, 1, 4, "CGT"), (3, 20, 20, "")]


def test_wilcoxon_of_millions_of_rows(spark):
    n = 3_000_000
    pairs = spark.range(n).select(F.lit(0).alias("motif"), (F.col("id") % 5).alias("x"), F.lit(2).cast("long").alias("y"))
    (r,) = K.wilcoxon(pairs).collect()
    assert r.n == n * 4 // 5 and r.w_plus == r.w_minus and r.z == 0


def test_totals_at_the_limit_do_not_depend_on_the_order(spark):
    pct = [100.0 * n / 15 for n in (3, 8, 1)]
    assert (pct[0] + pct[1]) + pct[2] > 80  # the exact sum is 80
    for order in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        rows = spark.createDataFrame([("g", 5, "M", pct[i]) for i in order], "gene string, location long, motif string, pct double").coalesce(1)
        (r,) = V.location_stats(rows, 4.0).collect()
        assert r.total == 20.0


def exchanges(df, what: str) -> int:
    """Exchanges of a plan whose rows have the column what."""
    return sum("Exchange" in line and what in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_runs_and_windows_stay_in_their_rows(spark):
    from helixlake.operators import sequences as S

    seqs = spark.createDataFrame([(1, "AACXXGGG"), (2, ""), (3, "acc?ccT"), (4, "XXXXXXX")], "seq_id long, nt string")
    got = sorted(map(tuple, S.runs(seqs).collect()))
    assert got == [(1, "A", 0, 2, False), (1, "C", 2, 1, False), (1, "G", 5, 3, True), (1, "X", 3, 2, False), (3, "A", 0, 1, False), (3, "C", 1, 2, False), (3, "C", 4, 2, False), (3, "T", 6, 1, True), (4, "X", 0, 7, True)]
    assert exchanges(S.find_runs(seqs, 2), "seq_id") == 0
    assert exchanges(S.window_digest(seqs, 3), "site") == 0


def test_window_digest_by_brute_force(spark):
    from helixlake.operators import sequences as S

    rows = [(1, "AACXXGGGAACT"), (1, "GGGTTTT"), (2, "AC"), (3, "XXXXXXXXXX"), (4, "T" * 12)]
    for w in (3, 8):
        for unmasked in (False, True):
            want = {}
            for s, nt in rows:
                found = [(i, nt[i : i + w]) for i in range(len(nt) - w + 1) if not (unmasked and "X" in nt[i : i + w])]
                if found:
                    want.setdefault(s, []).extend(found)
            want = sorted((s, len(f), len({x for _, x in f}), min(x for _, x in f), max(x for _, x in f), max(i for i, _ in f)) for s, f in want.items())
            assert sorted(map(tuple, S.window_digest(spark.createDataFrame(rows, "seq_id long, nt string"), w, unmasked).collect())) == want


def test_lags_need_one_exchange(spark):
    rows = [(1, 10 * k, 1, 0, p, 1 + (k * p) % 3) for k in range(4) for p in range(3) if (k + p) % 3] + [(2, 0, 1, 0, 1, 5)]
    samples = spark.createDataFrame(rows, "walk_id long, step long, seq_id long, motif int, pos long, n long")
    out = K.dist_lag(samples, 3, 2)
    assert exchanges(out, "hashpartitioning") == 1
    steps, cell = sorted({r[1] for r in rows if r[0] == 1}), {(r[1], r[4]): r[5] for r in rows if r[0] == 1}
    want = {}
    for lag in (1, 2):
        d = [[abs(cell.get((a, p), 0) - cell.get((b, p), 0)) for p in range(3)] for a, b in zip(steps, steps[lag:])]
        want[1, lag] = (sum(map(sum, d)) / len(d), sum(map(max, d)) / len(d))
    assert {(r.walk_id, r.lag): (r.total, r.max) for r in out.collect()} == want


def test_near_duplicates_do_not_compare_all_pairs_of_a_family(spark, monkeypatch):
    """Copies with edits of their own that share what their pivot lacks, few of them similar enough to be linked."""
    import random

    from helixlake.llm import minhash
    from tests.llm.test_llm_operators import brute_components

    rng, base, docs, met = random.Random(3), [f"w{i}" for i in range(150)], {}, []
    for i in range(500):
        own = base[:]
        for at in rng.sample(range(150), 3 if i else 1):
            own[at] = f"x{i}_{at}"
        docs[i] = " ".join(own)
    confirm = minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, sets: (met.append(pairs.count()), confirm(pairs, sets))[1])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame).collect()} == brute_components(docs)
    assert sum(met) < 20 * len(docs)


def test_katz_workers_get_few_packed_partitions_at_once(spark, sf_dir, monkeypatch):
    """A packed partition has megabytes, so batches are bounded by a number of rows that suits it."""
    from helixlake.llm import katz

    rows, saved = {}, katz.saved
    monkeypatch.setattr(katz, "saved", lambda df, tag, rows=None, _r=rows: (_r.update({tag: rows}), saved(df, tag, rows))[1])
    katz.op6_katz(spark, sf_dir, part_tokens=5000).count()
    assert rows["sums"] == rows["gains"] == katz.BLOBS < 10


def test_conv_stats_files_do_not_grow_with_samplers(spark, sf_dir, monkeypatch):
    from helixlake.plans import file_plans as P

    paths, written = [], P.written
    monkeypatch.setattr(P, "written", lambda s, lines, *names: (paths.append(written(s, lines, *names)), paths[-1])[1])
    rows = spark.range(400).select((F.col("id") % 200).alias("sampler_id"), (10 * F.col("id")).alias("step"), *(F.lit(1.5).alias(c) for c in ("min", "avg", "median", "max", "stddev")), F.lit(3).alias("n"))
    monkeypatch.setattr(P.K, "conv_stats", lambda _: rows)
    got = P.conv_file(spark, sf_dir)
    assert sorted((r.sampler_id, r.depth, r.avg, r.n) for r in got.collect()) == sorted((i % 200, 10 * i, 1.5, 3) for i in range(400))
    assert len(spark.read.text(paths[0]).inputFiles()) < 100


def test_katz_pairs_are_held_in_few_bytes(spark):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from helixlake.llm import katz

    # 300,000 words of 60,000 kinds in 300 texts, as one task sees them
    words = np.random.default_rng(1).integers(0, 60_000, (300, 1000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(300), pa.int64()), "text": [" ".join(f"w{x}" for x in row) for row in words.tolist()], "train": [True] * 300})
    h, n = np.array([5, 9], np.uint64), np.array([2, 1])
    shared = katz.Words(h, np.array([0, 1]), n, 3.0, 3, 2, 1, np.ones(katz.GT_MAX + 1), 0.25, 1, 1)
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda run, kind: run)
    run = katz.pair_blobs(docs, shared, 20)
    tracemalloc.start()
    got = list(run(iter([batch] * 3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = sum(len(katz.unpack(b, "u1", "<u4", "<i8", "u1", "u1")[1]) for r in got for b in r["blob"].to_pylist())
    assert pairs == 3 * 300 * 1001
    assert peak < 90 * pairs


def test_position_arrays_move_pieces_instead_of_positions(spark):
    import pytest

    want = {(1, p): [float(p), 1.0] for p in range(150) if p != 70} | {(2, p): [0.5, float(p)] for p in range(66)}
    rows = spark.createDataFrame([(s, p, v) for (s, p), v in want.items()] + [(1, -1, [9.0, 9.0])], "seq_id long, pos long, p array<double>").coalesce(1)
    got = {(r.seq_id, r.at): r.ps for r in V.position_arrays(rows, "p", 3).collect()}
    assert got == {(s, at): [want.get((s, at + i)) for i in range(66)] for s, at in [(1, 0), (1, 64), (1, 128), (2, 0), (2, 64)]}
    sent = V.in_runs(rows.where("pos >= 0").select("seq_id", (F.floor(F.col("pos") / 64) * 64).alias("at"), (F.col("pos") % 64).cast("int").alias("i"), F.col("p").alias("v")))
    assert sent.count() == 5
    mixed = V.position_arrays(rows.repartition(7), "p", 3).collect()
    assert {(r.seq_id, r.at): r.ps for r in mixed} == got
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        V.position_arrays(rows.union(rows), "p", 3).collect()


def test_quorum_steps_take_plain_lists():
    from types import SimpleNamespace

    import pandas as pd

    from helixlake.streaming import streams as X

    stream = SimpleNamespace(groupBy=lambda key: SimpleNamespace(applyInPandasWithState=lambda step, *more: step))
    step = X.quorum_stream(stream)
    state = SimpleNamespace(hasTimedOut=False, exists=False, update=lambda v: kept.append(v), setTimeoutDuration=lambda ms: None)
    kept = []
    # columns alone, without a frame's methods
    rows = {"result_id": pd.Series([4, 2, 2, 1, 3]), "payload": pd.Series(["b", None, "b", "a", "a"], dtype=object)}
    (got,) = step((7,), iter([rows]), state)
    assert got.values.tolist() == [[7, 1, "a", 4, "canonical"]]
    assert kept == [(True, [], [], [], 1, 4)]


def test_sequences_are_derived_from_texts_once(spark, monkeypatch):
    from helixlake.plans import sampler_plans as P

    calls, seqs = [], P.I.seqs
    monkeypatch.setattr(P.I, "seqs", lambda s, d: calls.append(d) or seqs(s, d))
    for name in ("near_optimal_draws", "score_bayes_factor", "score_map_by_sequence"):
        calls.clear()
        plan = P.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(calls) == 1 and "regexp_replace" not in plan and "documents.parquet" not in plan, name


def test_possible_places_are_counted_in_their_rows(spark):
    from helixlake.operators import motifs as M

    rows = [(1, "AACXXGGGAACT"), (2, "AC"), (3, "XXXX"), (4, ""), (5, None), (6, "ACGTNACGT"), (7, "XA")]
    seqs = spark.createDataFrame(rows, "seq_id long, nt string")
    assert "generate" not in M.possible_places(seqs, 3)._jdf.queryExecution().optimizedPlan().toString().lower()
    for w in (1, 3):
        want = {s: sum(i + w > 1 and set(nt[i : i + w]) <= set("ACGT") for i in range(len(nt) - w + 1)) for s, nt in rows if nt}
        assert {r.seq_id: r.P for r in M.possible_places(seqs, w, "seq_id").collect()} == {s: n for s, n in want.items() if n}
        assert M.possible_places(seqs, w).first()[0] == sum(want.values())


def test_gains_of_windows_are_computed_once(monkeypatch):
    import numpy as np

    from helixlake.operators import alignments as A
    from helixlake.operators.motifs import window_numbers

    rng = np.random.default_rng(3)
    f = A.Fixed((0, 1), 6, np.array([1e4, 2e4, 3e4, 1e4]), 1e4, 100, np.array([0.2, 0.3, 0.3, 0.2]), (0.2, 0.3, 0.5))
    counts = rng.random((2, 6, 4))
    counts *= 100 / counts.sum(axis=2, keepdims=True)
    table, codes = A.window_gains(counts, f), rng.integers(0, 4, 3000)
    number = window_numbers(codes.astype(np.int32), 6, 0, 6)
    for m in (0, 1):
        assert np.array_equal(A.added(counts, codes, np.arange(5, 3000), m, f), table[m][number])


def test_pairs_of_blobs_merge_in_little_memory():
    import tracemalloc

    import numpy as np

    from helixlake.llm import katz as Z

    rng, blobs = np.random.default_rng(1), []
    for _ in range(9):
        key = np.sort(rng.integers(0, 90_000, 200_000).astype(np.uint64) << np.uint64(30))
        blobs.append((key, rng.integers(0, 5_000, len(key)).astype(np.uint32), rng.integers(0, 2, len(key)).astype(np.uint8)))
    key, doc, train = (np.concatenate([b[k] for b in blobs]) for k in range(3))
    order = np.lexsort((doc, key))
    want, heads = np.unique(key[order], return_index=True)
    tracemalloc.start()
    got = Z.merged_pairs(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    for x, y in zip(got, (want, np.add.reduceat(train[order].astype(np.int64), heads), np.diff(np.append(heads, len(key))), doc[order])):
        assert np.array_equal(x, y)
    tracemalloc.reset_peak()
    x = rng.integers(0, 1 << 60, 1_000_000)
    before = tracemalloc.get_traced_memory()[0]
    blob = Z.pack(x, x[:0], x[:7])
    packed = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 20 * len(key) and packed < 2.6 * x.nbytes
    assert [list(a) for a in Z.unpack(blob, "<i8", "<i8", "<i8")] == [list(x), [], list(x[:7])]


def test_chains_move_compressed_codes(spark):
    import numpy as np

    from helixlake.operators import chains as C
    from helixlake.operators import samplers as G

    rng = np.random.default_rng(5)
    nt = "".join(rng.choice(list("ACGTX"), 4000, p=[0.3, 0.2, 0.2, 0.25, 0.05]))
    rows = C.squeezed(spark.createDataFrame([(1, nt), (2, "")], "seq_id long, nt string"), G.Config()).orderBy("seq_id").collect()
    assert np.array_equal(C.unpacked_codes(rows[0].codes), G.codes_of(nt)) and len(rows[0].codes) < 0.4 * len(nt)
    assert (rows[1].size, len(C.unpacked_codes(rows[1].codes)), rows[1].places) == (0, 0, [0.0, 0.0, 0.0])
