"""Cases of the fourth round's findings."""

import numpy as np
from pyspark.sql import functions as F


def write_documents(spark, path, nts):
    """A table of documents whose sequences are nts, by doc_id."""
    rows = [(i, nt.translate(str.maketrans("ACGTX", "abcdq")), "en", f"src{i % 10}", len(nt)) for i, nt in nts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")


def test_map_refine_starts_from_all_sites_and_goes_on_to_the_end(spark, tmp_path):
    """Sequences of more than four sites, at odd and even places, keep all of them; and no place is left that adds anything."""
    from helixlake.operators import alignments as A
    from helixlake.operators import sequences as S
    from helixlake.plans import sampler_plans as P
    from helixlake.sources import inputs as I

    rng = np.random.default_rng(4)
    nts = [(i, "".join("".join(rng.choice(list("AGT"), int(rng.integers(40, 60)))) + "CACGTG" for _ in range(9))) for i in range(12)]
    write_documents(spark, tmp_path, nts)
    q = I.seqs(spark, str(tmp_path))
    start = I.sites(q).select("seq_id", "s_start", "motif")
    want, got = ({(r.seq_id, r.s_start) for r in rows.collect()} for rows in (start, P.refined(spark, str(tmp_path))))
    assert len(want) == 108 and want <= got
    out = P.refined(spark, str(tmp_path))
    motifs = tuple(sorted(r.motif for r in start.select("motif").distinct().collect()))
    f = A.fixed(q, S.background(q), motifs, 6, P.ALIGNED.prior())
    value, counts, _ = A.score_of(out, q, f)
    assert value >= A.score_of(start, q, f)[0]
    for r in A.gains(out, q, counts, f, None).collect():
        one = spark.createDataFrame([(r.seq_id, r.s_start, r.motif)], "seq_id long, s_start long, motif int")
        assert A.score_of(out.unionByName(one), q, f)[0] <= value + 1e-6


def test_quorums_of_a_shard_are_those_of_its_units():
    """Many batches, with repeated, null and failed results: the shard decides what each unit's own step decides, and its rows are counted at once."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from helixlake.streaming import streams as X

    rng, hours = random.Random(5), 3_600_000
    stream = SimpleNamespace(groupBy=lambda key: SimpleNamespace(applyInPandasWithState=lambda step, *more: step))
    for need, most_errors, most in ((2, 8, 16), (3, 3, 6)):
        step, states, want, got, shard = X.quorum_stream(stream, need, most_errors, most), {}, [], [], X.Quorums.empty()
        for now in range(6):
            rows = [(rng.choice([None, *range(40)]), rng.randrange(9), rng.choice(["", None, "a", "b", "c", "d"])) for _ in range(90)]
            for unit in {r[0] for r in rows}:
                kept = SimpleNamespace(hasTimedOut=False, exists=unit in states, get=states.get(unit), setTimeoutDuration=lambda ms: None, update=lambda v, u=unit: states.update({u: v}))
                frame = pd.DataFrame([r[1:] for r in rows if r[0] == unit], columns=["result_id", "payload"])
                want += [(now, *r) for f in step((unit,), iter([frame]), kept) for r in f.astype(object).where(f.notna(), None).values.tolist()]
            key, none = np.array([r[0] or 0 for r in rows]), np.array([r[0] is None for r in rows])
            shard, out = shard.after(key, none, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], object), now, hours, need, most_errors, most)
            shard = X.Quorums.load(*shard.dump())
            got += [(now, *r) for r in out.astype(object).where(out.notna(), None).values.tolist()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and {r[-1] for r in got} == ({"canonical", "failed"} if need > 2 else {"canonical"})
        u = shard.units
        assert {(None if n else int(k)): (bool(d), int(e), int(t)) for k, n, d, e, t in zip(u["key"], u["none"], u["done"], u["errors"], u["total"])} == {k: (v[0], v[4], v[5]) for k, v in states.items()}
    assert len(shard.after(*(np.array([], x) for x in (np.int64, bool, np.int64, object)), 5 + hours, hours, 3, 3, 6)[0].units["key"]) == 0


def test_quorum_state_has_few_keys(spark, tmp_path, monkeypatch):
    """Twenty thousand units are a few hundred keys of the stream's state, and come as several files a turn."""
    from pyspark.sql.streaming import StreamingQuery

    from helixlake.plans import stream_plans as P

    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("l_orderkey"), (F.col("id") / 20_000 + 1).cast("int").alias("l_linenumber"), F.lit(5.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, *a: (wait(self, *a), seen.extend(self.recentProgress))[0])
    got = P.quorum(spark, str(tmp_path))
    assert got.count() == 20_000 and got.where("canonical_id = 1 and payload = 'RF' and n_results = 2").count() == 20_000
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]) <= 512


def test_natural_order_computes_its_keys_once(spark):
    import random

    import pyarrow as pa

    from helixlake.functions import nt as N
    from helixlake.operators import intervals as V
    from helixlake.plans import walk_plans as P

    rng = random.Random(2)
    names = [None, "", "g", "7", "007", "a1", "a01b", "a1b", "a12", "a:", "a-", "é9", "é10", "10é2", "\n3", "0", "00", "a0", "9" * 20, "x" + "9" * 98, "x1" + "0" * 98, "x9" + "0" * 98, "x2" + "0" * 99]
    names += ["".join(rng.choice(["g", "_", ".", "0", "1", "9", "12"]) for _ in range(rng.randrange(8))) for _ in range(400)]
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "gene string, chrom long")
    got = V.natural_keys(pa.array(["skipped", *names])[1:]).to_pylist()
    short = [(n, k) for n, k in zip(names, got) if n is not None and len(n) < 21]
    old = {r.gene: r.k for r in frame.select("gene", N.natural_key("gene").alias("k")).collect()}
    for a, k in short:
        for b, j in short:
            assert (k.encode() < j.encode()) == (old[a].encode() < old[b].encode()), (a, b)
    at = dict(zip(names, got))
    assert got[0] is None and at["x" + "9" * 98] < at["x1" + "0" * 98] < at["x9" + "0" * 98] < at["x2" + "0" * 99]
    rows = [r.gene for r in V.natural_order(frame.where("length(gene) < 21 or gene is null").repartition(3), "gene").collect()]
    assert rows[0] is None and [old[n] for n in rows[1:]] == sorted(old[n] for n in rows[1:])
    plan = P.QUERIES["sort_natural"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    (sort,) = [line for line in plan.splitlines() if "Sort [" in line]
    assert "(" not in sort.replace("Sort [", "").split(" ASC")[0]


def test_conservation_of_records_cut_by_splits(spark, tmp_path):
    """Files cut anywhere: records that go on over several splits and files, empty ones, numbers before any header."""
    from helixlake.sources import text as T

    rng, want = np.random.default_rng(1), {}
    lines = ["0.5 0.5", ""]
    for k, n in enumerate([130, 0, 64, 1, 700, 63, 128, 5]):
        want[f"> s{k}"] = [round(x, 3) for x in rng.random(n).tolist()]
        lines += [f"> s{k} "] + [" ".join(map(str, want[f"> s{k}"][i : i + 7])) + ("\r" if i % 3 else " ") for i in range(0, n, 7)] + [""] * (k % 2)
    for k, (a, b) in enumerate(zip([0, 12, 40, 90], [12, 40, 90, len(lines)])):
        (tmp_path / "cons").mkdir(exist_ok=True)
        (tmp_path / "cons" / f"part-{k}").write_text("\n".join(lines[a:b]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = T.read_conservation(spark, f"{tmp_path}/cons").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == sum(-(-len(v) // 64) for v in want.values())
    assert {(r.name, r.at): r["values"] for r in got} == {(n, at): v[at : at + 64] for n, v in want.items() for at in range(0, len(v), 64)}


def test_conservation_lines_move_no_numbers(spark, tmp_path):
    from helixlake.plans import file_plans as P

    write_documents(spark, tmp_path, [(i, "ACGTX" * (7 * i)) for i in range(1, 9)] + [(11, "ACG" * 9), (11, "ACG" * 9)])
    text = [r.value for r in spark.read.text(P.conservation_file(spark, str(tmp_path))[0]).collect()]
    assert ">doc4" in text and len([x for x in text if x[0] == ">"]) == 9
    assert sorted(text) == sorted(x for i, n in [(1, 35), (2, 70), (3, 105), (4, 140), (6, 210), (7, 245), (8, 280), (11, 27), (11, 27)] for x in [f">doc{i}"] + [" ".join(str((k * 7 + i) % 100 / 100) for k in range(a, min(a + 10, n))) for a in range(0, n, 10)])
    got = {r.seq_id: (r.n_arrays, r.n, r.total) for r in P.conservation_totals(spark, str(tmp_path)).collect()}
    assert got[7] == (4, 245, round(sum((k * 7 + 7) % 100 / 100 for k in range(245)), 4)) and 5 not in got
    plan = P.conservation_totals(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert all("aggregate" not in line for line in plan.splitlines() if "Exchange" in line)


def test_position_priors_move_blocks_instead_of_windows(spark, tmp_path):
    """The digest has the sums of the windows' own rows, with blocks cut anywhere, masked bases and bad lines."""
    import pytest

    from helixlake.operators import intervals as V
    from helixlake.sources import text as T

    rng = np.random.default_rng(7)
    nts = {i: "".join(rng.choice(list("ACGTX"), n, p=[0.3, 0.2, 0.2, 0.27, 0.03])) for i, n in enumerate([300, 5, 4, 64, 69, 128, 0, 1])}
    q = spark.createDataFrame([*nts.items()], "seq_id long, nt string")
    lines = [f"{i + 1} - {' '.join(f'{x:.4f}' for x in rng.dirichlet([2] * 4))} {k + 1}" for i, nt in nts.items() if i != 3 for k in range(len(nt)) if (i + k) % 9]
    lines += ["1 - 0.5 0.5 0.5 0.5 1", "# none", "", " 1, - 0.4 0.2 0.2 0.2 10 "]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(f"{tmp_path}/bg")
    bg = spark.createDataFrame([("A", 0.3), ("C", 0.2), ("G", 0.2), ("T", 0.3)], "base string, p double")
    spacing = spark.createDataFrame([(i, 0.01 * (i + 1)) for i in range(40)], "dist_from_end long, p double")
    weights = spark.createDataFrame([(0, 0.5), (5, None), (4, 0.2), (4, 0.3)], "seq_id long, w double")
    each = V.with_position_priors(q, 5, T.read_position_background(spark, f"{tmp_path}/bg")[0], bg, spacing, weights)
    want = each.groupBy("seq_id", "weight").agg(F.count("*"), F.sum("spacing"), F.sum("ln_bg"), F.min("ln_bg")).collect()
    assert len(want) >= 5
    for size in (8, 64, T.BLOCK):
        blocks = T.read_position_blocks(spark, f"{tmp_path}/bg", 5, size=size)
        out = V.position_prior_digest(q, 5, blocks, size, bg, spacing, weights)
        assert sorted(map(tuple, out.collect())) == [pytest.approx(tuple(r)) for r in sorted(want)]
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "inline" not in plan


def test_walks_draw_from_tables_and_one_generator():
    """Ratios of windows are those of their columns, and a generator set anew gives the numbers of one made anew."""
    from helixlake.operators import chains as C
    from helixlake.operators import samplers as G

    rng = np.random.default_rng(3)
    for widths in ((6, 6), (1, 7), (4, 9)):
        for n in (0, 1, 3, 8, 500):
            codes, odds = rng.choice(5, n, p=[0.3, 0.2, 0.2, 0.25, 0.05]).astype(np.int8), rng.normal(size=(3, 2, 9, 4))
            got = C.walk_ratios(codes, odds, widths)
            for k in range(3):
                for m, w in enumerate(widths):
                    assert np.allclose(got[m][k], G.ratios(codes, [odds[k, m, :w]])[0], rtol=1e-12, atol=0)
    for seed, it, seq in ((1, 0, 5), (7, 3, -2), (2**40 + 1, 1 << 30, 2**33 + 4)):
        walks = [0, 1, 63, 2**32 + 9, -1]
        keys = G.keys_of(seed, walks, it, [8, seq])
        for k, one in enumerate((8, seq)):
            for walk, own in zip(walks, G.rngs_of(keys[k])):
                assert [own.random() for _ in range(9)] == G.rng_of(seed, walk, it, one).random(9).tolist()
    full = C.column_numbers(np.array([0, 1, 4, 2, 3, 3], np.int8), 3)
    assert full.tolist() == [64, 64, 64, 47]
