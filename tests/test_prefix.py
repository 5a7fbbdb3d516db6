"""Prefix sums and merged intervals whose keys spread over many ranges, against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators import intervals as V
from helixlake.operators import prefix as P


@pytest.fixture
def many_ranges(spark):
    """Ranges of small tables stay apart."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_prefix_sum(many_ranges):
    draw = random.Random(1)
    rows = [(i, draw.randrange(-5, 9)) for i in draw.sample(range(10_000), 700)] + [(-1, 4)]
    df = many_ranges.createDataFrame(rows, "k long, v long").repartition(5)
    assert P.ranged(df, "k").select(P.PART).distinct().count() == 9
    want, total = {}, 0
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert {r.k: r.upto for r in P.prefix_sum(df, "v", "upto", "k").collect()} == want
    assert sorted(r.k for r in P.first_rows(df, 123, "k").collect()) == sorted(k for k, _ in rows)[:123]
    assert P.prefix_sum(df.where("false"), "v", "upto", "k").count() == 0


@pytest.mark.parametrize("latest", [False, True])
def test_segmented(many_ranges, latest):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 1, 2, 3, 9, None]), i, draw.randrange(1000)) for i in range(600)]
    df = many_ranges.createDataFrame(rows, "g long, k long, v long")
    parts = P.ranged(df, "g", "k")
    assert parts.where("g = 1").select(P.PART).distinct().count() > 3
    want = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        before = [w for h, j, w in rows if h == g and j < k]
        want[k] = (before[-1] if latest else max(before)) if before else None
    assert {r.k: r.out for r in P.segmented_before(parts, "g", "v", "out", "k", latest=latest).collect()} == want


def brute_merge(rows, rule):
    out = []
    for chrom in sorted({r[1] for r in rows}):
        reach = None
        for gene, _, start, end in sorted((r for r in rows if r[1] == chrom), key=lambda r: (r[2], r[3], r[0])):
            if reach is None or start >= reach:
                out.append([chrom, start, end, []])
                reach = end
            reach = max(reach, end) if rule == "max" else end
            out[-1][2] = max(out[-1][2], end) if rule == "max" else end
            out[-1][3].append(gene)
    return sorted((c, a, b, tuple(sorted(g))) for c, a, b, g in out)


@pytest.mark.parametrize("rule", ["max", "last"])
def test_merge_over_ranges(many_ranges, rule):
    """One chromosome has nearly all genes, and a gene of the first range reaches over several others."""
    draw = random.Random(3)
    rows = [(f"g{i}", 1 if i % 40 else i % 7, at := draw.randrange(40_000), at + draw.randrange(1, 60)) for i in range(900)] + [("long", 1, 5000, 21_000)]
    genes = many_ranges.createDataFrame(rows, "gene string, chrom long, g_start long, g_end long").withColumns({"tss": F.col("g_start"), "strand": F.lit("+")})
    got = sorted((r.chrom, r.g_start, r.g_end, tuple(m.gene for m in r.members)) for r in V.merge_overlaps(genes, rule).collect())
    assert got == brute_merge(rows, rule)


def test_random_windows_over_ranges(many_ranges):
    sizes = many_ranges.createDataFrame([(i, 5 + i % 11) for i in range(300)], "chrom long, size long")
    chunks = sizes.select("chrom", F.lit(0).cast("long").alias("chunk_start"), F.substring(F.lit("ACGTACGTACGTACGTACGT"), F.lit(1), F.col("size").cast("int")).alias("nt"))
    out = V.random_windows(sizes, chunks, 100, 4, 3).collect()
    assert len(out) == 100 and all(r.nt == "ACGTACGTACGTACGTACGT"[r.start : r.end] for r in out)
    upto, total = {}, 0
    for i in range(300):
        total += 5 + i % 11
        upto[i] = total
    assert {r.chrom: r.upto for r in V.laid_out(sizes).collect()} == upto
