"""Ordered files, their checks, arrays by position and small tables, on hand-made files."""

import pytest
from pyspark.sql import functions as F

from helixlake.operators import intervals as V
from helixlake.operators import motifs as M
from helixlake.operators import sequences as S
from helixlake.sources import text as T


def seqs(spark, *nts):
    return spark.createDataFrame([(i, f"> s{i}", nt) for i, nt in enumerate(nts)], "seq_id long, name string, nt string")


def test_lines_keep_their_places(spark, tmp_path):
    """Line i is sequence i, over many files and whatever the order of the rows."""
    n = 2000
    q = spark.range(n).select(F.col("id").alias("seq_id"), F.concat(F.lit("> "), "id").alias("name"), F.repeat(F.lit("ACGT"), F.lit(30)).alias("nt"))
    sites = q.where("seq_id % 3 != 0").select("seq_id", F.explode(F.array(F.lit(0), F.lit(40))).alias("s_start")).select("seq_id", (F.col("seq_id") % 2).cast("int").alias("motif"), (F.col("s_start") + F.col("seq_id") % 30).alias("s_start")).withColumn("s_end", F.col("s_start") + 6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_sites(sites.orderBy(F.rand(1)), q.orderBy(F.rand(2)), f"{tmp_path}/sites")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    lines = {r.line: r.value for r in T._lines(spark, f"{tmp_path}/sites").collect()}
    assert len(lines) == n and lines[0] == "." and lines[1] == "1,6:1,46." and lines[1999] == f"1,{1999 % 30 + 5}:1,{1999 % 30 + 45}."
    back = T.read_sites(spark, f"{tmp_path}/sites", 6)
    cols = ["seq_id", "motif", "s_start", "s_end"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, sites.select(cols).collect()))
    assert T.bad_sites(back, q, 2).count() == 0


def test_bad_sites(spark, tmp_path):
    q = seqs(spark, "ACGTACGTACGT", "ACGTXACGTACG", "ACGT", "ACGTACGTAC")
    (tmp_path / "sites").write_text("0,5:0,11.\n0,5\n0,3.\n0,3:1,5:7,9.\n.\n0,4.\n")
    bad = {(r.seq_id, r.slot): r.reason for r in T.bad_sites(T.read_sites(spark, f"{tmp_path}/sites", 4), q, 2).collect()}
    assert bad == {(1, 0): "masked", (3, 1): "overlap", (3, 2): "motif", (5, 0): "sequence"}
    (tmp_path / "far").write_text("0,12.\n0,1.\n")
    assert {(r.seq_id, r.reason) for r in T.bad_sites(T.read_sites(spark, f"{tmp_path}/far", 4), q, 2).collect()} == {(0, "range"), (1, "range")}


def test_ragged_samples(spark, tmp_path):
    q = seqs(spark, "ACGT", "ACG")
    (tmp_path / "samples").write_text("0,0,3,0\n1,0,0\n0,0,7\n1,2,3,4\n5\n")
    bad = {(r.seq_id, r.line, r.k) for r in T.bad_sample_lines(T._lines(spark, f"{tmp_path}/samples"), q, 2).collect()}
    assert bad == {(0, 1, 3), (1, 3, 4), (2, 4, 1)}
    assert (0, 0, 2, 3) in {tuple(r) for r in T.read_samples(spark, f"{tmp_path}/samples", 2).collect()}


def test_conservation_arrays(spark, tmp_path):
    (tmp_path / "cons").write_text(">s1\n0.1 0.2 0.3\r\n0.4\n\n>s0\n" + " ".join(f"{i / 1000:.3f}" for i in range(150)) + "\n0.9\n>s2\n")
    got = {(r.name, r.at): list(r["values"]) for r in T.read_conservation(spark, f"{tmp_path}/cons").collect()}
    assert got["> s1", 0] == [0.1, 0.2, 0.3, 0.4] and set(got) == {("> s1", 0), ("> s0", 0), ("> s0", 64), ("> s0", 128)}
    assert got["> s0", 64] == [i / 1000 for i in range(64, 128)] and got["> s0", 128] == [i / 1000 for i in range(128, 150)] + [0.9]
    arrays = spark.createDataFrame([(0, 64, got["> s0", 64]), (0, 128, got["> s0", 128])], "seq_id long, at long, values array<double>")
    asked = spark.createDataFrame([(0, 3), (0, 64), (0, 127), (0, 150), (0, 151), (1, 70)], "seq_id long, pos long")
    assert {(r.seq_id, r.pos): r.p for r in V.at_positions(asked, arrays, "values", 0.5).collect()} == {(0, 3): 0.5, (0, 64): 0.064, (0, 127): 0.127, (0, 150): 0.9, (0, 151): 0.5, (1, 70): 0.5}


def test_three_priors(spark, tmp_path):
    """Each window has its own background, spacing and weight, by hand."""
    nts = ["ACGTACGTAC" * 14, "ACXGT", "AC", "GGGGG"]
    q = seqs(spark, *nts)
    rows = [(1, pos, [0.1, 0.2, 0.3, 0.4]) for pos in range(60, 70)] + [(4, 0, [0.7, 0.1, 0.1, 0.1])]
    bad = [(1, 5, [0.5, 0.5, 0.5, 0.5]), (1, 6, [0.1, 0.1, 0.1, 0.1])]
    (tmp_path / "bg").write_text("# seq - A C G T pos\n" + "".join(f"{s} - {' '.join(map(str, p))} {pos + 1}\n" for s, pos, p in rows + bad))
    good, rejected = T.read_position_background(spark, f"{tmp_path}/bg")
    assert rejected.count() == 2 and good.count() == 11
    bg = spark.createDataFrame([("A", 0.3), ("C", 0.2), ("G", 0.2), ("T", 0.3)], "base string, p double")
    spacing = spark.createDataFrame([(i, 0.01 * (i + 1)) for i in range(5)], "dist_from_end long, p double")
    weights = spark.createDataFrame([(0, 0.5)], "seq_id long, w double")
    got = {(r.seq_id, r.pos): (r.site, r.weight, r.spacing, r.ln_bg) for r in V.with_position_priors(q, 3, good, bg, spacing, weights).collect()}
    import math

    known = {(s - 1, pos): p for s, pos, p in rows}
    usual = {r.base: r.p for r in bg.collect()}
    want = {}
    for i, nt in enumerate(nts):
        for pos in range(len(nt) - 2):
            site = nt[pos : pos + 3]
            if "X" not in site:
                ln = sum(math.log(known[i, pos + j]["ACGT".index(b)] if (i, pos + j) in known else usual[b]) for j, b in enumerate(site))
                left = len(nt) - pos - 3
                want[i, pos] = (site, 0.5 if i == 0 else 1.0, 0.01 * (left + 1) if left < 5 else 0.0, ln)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2:] == pytest.approx(v[2:])


def test_counts_by_step_and_direction(spark, tmp_path):
    counts = spark.createDataFrame([(5, 0, 0, "A", 3), (5, 1, 0, "C", 2), (7, 0, 0, "T", 1)], "step long, motif int, col int, base string, n long")
    T.write_pwm_counts(counts, f"{tmp_path}/counts")
    got = {(r.step, r.direction, r.value) for r in spark.read.text(f"{tmp_path}/counts").collect()}
    assert {(5, "forward", ">motif0 NORMAL 1"), (5, "reverse", ">motif1 NORMAL 1"), (7, "forward", ">motif0 NORMAL 1"), (5, "forward", "3"), (5, "reverse", "2"), (7, "forward", "1")} <= got


def test_layouts_and_weights(spark, tmp_path):
    (tmp_path / "t").write_text(">TRANS\nbegin 0 3\nbegin 1 1\n0 end 2\n")
    assert {(r.prev, r.cur): r.p for r in T.read_layout(spark, f"{tmp_path}/t", "transitions").collect()} == {("begin", "0"): 0.75, ("begin", "1"): 0.25, ("0", "end"): 1.0}
    (tmp_path / "m").write_text("0 1\n1 0\n")
    assert [tuple(r) for r in T.read_layout(spark, f"{tmp_path}/m", "mask").orderBy("col").collect()] == [(0, 1), (1, 0)]
    rows = spark.createDataFrame([(1, 10, 0), (2, 10, 2), (3, 11, 2), (4, 12, 1)], "seq_id long, grp long, species long")
    table = spark.createDataFrame([(5, 0, 0.25), (5, 2, 0.75), (4, 2, 1.5)], "code long, species long, w double")
    assert {r.seq_id: r.w for r in V.species_weights(rows, table).collect()} == {1: 0.25, 2: 0.75, 3: 1.5, 4: 1.0}


@pytest.mark.parametrize("w", [1, 2, 5])
def test_scan_totals_are_those_of_the_rows(spark, w):
    q = seqs(spark, "ACGTXACGTTACG", "A", "", "XXX", "TTTTTTTT")
    pwm = M.normalised(spark.createDataFrame([(m, c, "ACGT"[(m + c) % 4], 5) for m in (2, 4) for c in range(w)], "motif int, col int, base string, n long"))
    bg = S.background(q)
    rows = M.pwm_scan(q, pwm, bg, w).groupBy("seq_id", "motif").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 6).alias("total"), F.round(F.max("ratio"), 6).alias("best"))
    found, names = M.scan_arrays(q, pwm, bg, w)
    got = M.scan_totals(found, names).withColumns({"total": F.round("total", 6), "best": F.round("best", 6)})
    assert names == [2, 4] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) != []
    assert M.scan_arrays(q, pwm, bg, w + 1)[1] == [] and M.pwm_scan(q, pwm, bg, w + 1).count() == 0
