"""Gene intervals, joins of positions and statistics of sites on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.functions import nt as N
from helixlake.operators import prefix as P
from helixlake.operators.samplers import codes_of
from helixlake.sources.inputs import CHUNK as CHUNK_WINDOWS
from helixlake.sources.inputs import chunked
from helixlake.sources.store import stored

#: Bases of a chromosome in one row.
CHUNK = 10_000


def merge_overlaps(genes: DataFrame, end_rule: str = "max") -> DataFrame:
    """(chrom, g_start, g_end, members): overlapping genes of a chromosome joined; touching ones stay apart.

    end_rule "max" takes the furthest end so far; "last" the end of the gene before, in start order. Genes are cut into ranges of
    (chromosome, start), so one chromosome spreads over all tasks; a range takes the reach of those before it.
    """
    order = ("g_start", "g_end", "gene")
    # one exchange by range serves all windows, whose orders agree
    parts = P.ranged(genes.select("chrom", "gene", "g_start", "g_end", "tss", "strand"), "chrom", *order).repartition(P.PART)
    reached = P.segmented_before(parts, "chrom", "g_end", "reach", *order, latest=end_rule != "max")
    marked = reached.withColumn("new", F.when(F.col("reach").isNull() | (F.col("g_start") >= F.col("reach")), 1).otherwise(0))
    grouped = P.running_sum(marked.drop("reach"), "new", "island", "chrom", *order)
    end = F.max("g_end") if end_rule == "max" else F.max_by("g_end", F.struct(*order))
    return grouped.groupBy("chrom", "island").agg(F.min("g_start").alias("g_start"), end.alias("g_end"), F.array_sort(F.collect_list(F.struct("gene", "tss", "strand"))).alias("members")).drop("island")


def natural_keys(names: pa.Array) -> pa.Array:
    """Strings that sort as names do when runs of digits count as numbers: before the digits of a run, less leading zeros, stands their number."""
    names = names.cast(pa.large_string())
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    digit = (text >= ord("0")) & (text <= ord("9"))
    start = digit.copy()
    start[1:] &= ~digit[:-1]
    first = at[:-1][at[:-1] < at[1:]]  # a run doesn't go on into the next name
    start[first] |= digit[first]
    run, starts = np.cumsum(start) - 1, np.flatnonzero(start)
    upto = np.cumsum(digit & (text != ord("0")))
    keep = ~digit
    keep[digit] = upto[digit] > (upto - (text != ord("0")))[starts][run[digit]]
    digits = np.bincount(run[digit & keep], minlength=len(starts))
    # two digits of length, or 99 and ten more
    head = np.zeros(len(text), np.int64)
    head[starts] = np.where(digits < 99, 2, 12)
    ends = np.append(0, np.cumsum(head + keep))
    out = np.zeros(ends[-1], np.uint8)
    out[(ends[:-1] + head)[keep]] = text[keep]
    out[ends[starts]], out[ends[starts] + 1] = ord("0") + np.minimum(digits, 99) // 10, ord("0") + np.minimum(digits, 99) % 10
    for r in np.flatnonzero(digits >= 99).tolist():
        out[ends[starts[r]] + 2 : ends[starts[r]] + 12] = np.frombuffer(b"%010d" % digits[r], np.uint8)
    keys = pa.Array.from_buffers(pa.large_string(), len(names), [None, pa.py_buffer(ends[at]), pa.py_buffer(out)]).cast(pa.string())
    return pc.if_else(names.is_null(), pa.scalar(None, pa.string()), keys)


def natural_order(rows: DataFrame, name: str) -> DataFrame:
    """rows in the order of name when runs of digits count as numbers (as N.natural_key).

    The keys are computed once a row before the sort, which would compute an expression anew in each comparison.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, natural_keys(batch.column(name))], [*batch.schema.names, "_natural"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_natural", T.StringType())])).orderBy("_natural").select(*rows.columns)


def laid_out(sizes: DataFrame) -> DataFrame:
    """(chrom, size, upto): chromosomes laid end to end in their order; upto is where each ends."""
    return P.prefix_sum(sizes.select("chrom", "size"), "size", "upto", "chrom")


def extract(intervals: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """intervals(chrom, start, end, ...) with nt from chunks(chrom, chunk_start, nt); an interval may span chunks, and one without bases needs none."""
    cols = intervals.columns
    spanned = F.sequence(F.floor(F.col("start") / size) * size, F.floor((F.col("end") - 1) / size) * size, F.lit(size))
    parts = intervals.withColumn("chunk_start", F.explode(F.when(F.col("end") <= F.col("start"), F.array(F.lit(None).cast("long"))).otherwise(spanned)))
    lo, hi = F.greatest("start", "chunk_start"), F.least(F.col("end"), F.col("chunk_start") + size)
    piece = F.when(F.col("chunk_start").isNull(), "").otherwise(F.substring(F.col("nt"), (lo - F.col("chunk_start") + 1).cast("int"), (hi - lo).cast("int")))
    met = parts.join(chunks, ["chrom", "chunk_start"], "left").select(*cols, "chunk_start", piece.alias("piece")).where("piece is not null")
    return met.groupBy(*cols).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", "piece"))), lambda s: s["piece"]), "").alias("nt"))


def locate(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(point, chrom, local): where genome coordinates fall on chromosomes laid end to end.

    Starts and points stand in one order, cut into ranges of equal width, and each point takes the last start before it; a range
    without a start of its own takes the last one of the ranges before. So nothing is compared with all chromosomes.
    """
    laid = stored(laid_out(sizes).select("chrom", (F.col("upto") - F.col("size")).alias("lo"), F.col("upto").alias("hi")), "laid")
    width = 1 << 22
    block = lambda c: F.floor(F.col(c) / width)
    cut = laid.where("hi > lo").withColumn("b", F.explode(F.sequence(block("lo"), F.floor((F.col("hi") - 1) / width))))
    # a chromosome is split at the ranges' bounds, so that each range has all its starts
    starts = cut.select("b", F.greatest("lo", F.col("b") * width).alias("at"), F.struct("chrom", "lo").alias("s"), F.lit(None).cast("long").alias("point"), F.lit(0).alias("kind"))
    asked = points.where(F.col("point") >= 0).select(block("point").alias("b"), F.col("point").alias("at"), F.lit(None).cast(starts.schema["s"].dataType).alias("s"), "point", F.lit(1).alias("kind"))
    last = F.last("s", ignorenulls=True).over(Window.partitionBy("b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    met = starts.union(asked).withColumn("s", last).where("kind = 1 and s is not null")
    total = F.broadcast(laid.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("total")))  # one row
    return met.crossJoin(total).where("point < total").select("point", F.col("s.chrom").alias("chrom"), (F.col("point") - F.col("s.lo")).alias("local"))


def random_windows(sizes: DataFrame, chunks: DataFrame, n: int, width: int, seed: int, size: int = CHUNK) -> DataFrame:
    """(draw, chrom, start, end, nt): the first n of 2n windows, drawn evenly from all chromosomes, that end on theirs and have no masked base."""
    sizes = stored(sizes, "sizes")
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))  # one row
    u = F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(1 << 52)) / float(1 << 52)
    drawn = sizes.sparkSession.range(2 * n).withColumnRenamed("id", "draw").crossJoin(total).select("draw", F.floor(u * F.col("total")).cast("long").alias("point"))
    placed = locate(drawn.select("point").distinct(), sizes).join(drawn, "point").join(sizes, "chrom").where(F.col("local") + width <= F.col("size"))
    spans = placed.select("draw", "chrom", F.col("local").alias("start"), (F.col("local") + width).alias("end"))
    good = extract(spans, chunks, size).where(F.col("nt").rlike("^[ACGT]+$"))
    return P.first_rows(good, n, "draw")


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 64) -> DataFrame:
    """(seq_id, a_start, b_start, overlap): intervals of one sequence sharing over half of the longer; bins keep the join an equi-join."""
    left = a.select("seq_id", F.col("s_start").alias("a_start"), F.col("s_end").alias("a_end")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("a_start") / bin_size), F.floor((F.col("a_end") - 1) / bin_size))))
    right = b.select("seq_id", F.col("s_start").alias("b_start"), F.col("s_end").alias("b_end")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("b_start") / bin_size), F.floor((F.col("b_end") - 1) / bin_size))))
    share = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    half = F.floor(F.greatest(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")) / 2) + 1
    return left.join(right, ["seq_id", "bin"]).withColumn("overlap", share).where(F.col("overlap") >= half).select("seq_id", "a_start", "b_start", "overlap").distinct()


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seq_id, distance): intervals of either table without a partner in the other."""
    met = overlaps(a, b)
    own = a.join(met, (a.seq_id == met.seq_id) & (a.s_start == met.a_start), "left_anti").select("seq_id")
    other = b.join(met, (b.seq_id == met.seq_id) & (b.s_start == met.b_start), "left_anti").select("seq_id")
    return own.union(other).groupBy("seq_id").agg(F.count("*").alias("distance"))


def join_control(seqs: DataFrame) -> DataFrame:
    """Sequence i of 0..n - 1 with its control i + n // 2; ok if the lengths agree."""
    half = seqs.agg(F.floor((F.max("seq_id") + 1) / 2).cast("long").alias("half"))  # one row
    a = seqs.select("seq_id", F.length("nt").alias("n"))
    b = seqs.crossJoin(F.broadcast(half)).select((F.col("seq_id") - F.col("half")).alias("seq_id"), F.col("seq_id").alias("control_id"), F.length("nt").alias("m"))
    return a.join(b, "seq_id").select("seq_id", "control_id", (F.col("n") == F.col("m")).alias("ok"))


def with_default(rows: DataFrame, values: DataFrame, keys: list[str], column: str, default: float) -> DataFrame:
    """rows with column from values, or the default."""
    return rows.join(values, keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def position_arrays(rows: DataFrame, value: str, w: int = 1, size: int = CHUNK_WINDOWS) -> DataFrame:
    """(seq_id, at, <value>s): rows(seq_id, pos, value) as arrays aligned with the pieces that windows of w bases come from.

    A piece at place at has size + w - 1 positions, so one at the beginning of a piece also stands at the end of the one before. Entry i is the
    value at place at + i, null where there is none.
    """
    full = size + w - 1
    own = (F.floor(F.col("pos") / size) * size).cast("long")
    each = in_runs(rows.where(F.col("pos") >= 0).select("seq_id", own.alias("at"), (F.col("pos") - own).cast("int").alias("i"), F.col(value).alias("v")))
    # the first positions of a piece also stand at the end of the one before
    ahead = F.transform(F.filter("run", lambda x: x["i"] < w - 1), lambda x: F.struct((x["i"] + size).cast("int").alias("i"), x["v"].alias("v")))
    both = F.array(F.struct(F.col("at"), F.col("run")), F.struct((F.col("at") - size).alias("at"), ahead.alias("run")))
    each = each.select("seq_id", F.inline(F.filter(both, lambda x: (x["at"] >= 0) & (F.size(x["run"]) > 0))))
    found = each.groupBy("seq_id", "at").agg(F.array_sort(F.flatten(F.collect_list("run")), lambda x, y: x["i"] - y["i"]).alias("run"))
    # without gaps the values are in their places; else, and where a position occurs twice, which is an error, they are looked up
    whole = F.forall(F.transform("run", lambda x, k: x["i"] == k), lambda x: x)
    direct = F.concat(F.transform("run", lambda x: x["v"]), F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.lit(full) - F.size("run")))
    looked = F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda i: F.element_at(F.map_from_entries("run"), i))
    return found.select("seq_id", "at", F.when(whole, direct).otherwise(looked).alias(f"{value}s"))


def in_runs(rows: DataFrame) -> DataFrame:
    """(seq_id, at, run: array of (i, v)) of rows(seq_id, at, i, v): neighbouring rows of a piece in one, so that pieces move instead of positions."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, at, i, v = batch.columns
            new = np.ones(batch.num_rows, bool)
            for c in (seq, at):
                new[1:] &= pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            new[1:] = ~new[1:]
            heads = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, batch.num_rows).astype(np.int32)), pa.StructArray.from_arrays([i, v], ["i", "v"]))
            yield pa.RecordBatch.from_arrays([seq.take(pa.array(heads)), at.take(pa.array(heads)), lists], ["seq_id", "at", "run"])

    return rows.mapInArrow(run, f"seq_id {kind['seq_id']}, at long, run array<struct<i: int, v: {kind['v']}>>")


def with_position_priors(seqs: DataFrame, w: int, background: DataFrame, bg: DataFrame, spacing: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq_id, pos, site, weight, spacing, ln_bg) of each unmasked window of w bases, its three priors attached by piece, not by position.

    background(seq_id, pos, p: array of A, C, G, T) or, where it has no row, bg(base, p) gives the log probability ln_bg of the window; spacing(dist_from_end,
    p), 0 where it has no row, the prior of its last base; weights(seq_id, w), or 1, the weight of its sequence.
    """
    codes = F.create_map(*(x for i, b in enumerate(N.BASES) for x in (F.lit(b), F.lit(i))))
    usual = F.broadcast(bg.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("base", "p"))).alias("usual")))  # one row
    # one table of a few hundred places, each of them once
    near = F.broadcast(spacing.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("dist_from_end").cast("long"), "p"))).alias("near")).select(F.explode("near").alias("_dist", "_near")))
    piece = chunked(seqs, w).where("part is not null").join(position_arrays(background, "p", w), ["seq_id", "at"], "left").join(weights.select("seq_id", F.col("w").alias("weight")), "seq_id", "left")
    piece = piece.crossJoin(usual)
    one = lambda i: F.ln(F.coalesce(F.element_at(F.element_at("ps", i), F.element_at(codes, F.substring(F.col("part"), i, F.lit(1))) + 1), F.element_at("usual", F.substring(F.col("part"), i, F.lit(1)))))
    # each base of a piece is looked up once; a window is the difference of two running sums
    logs = F.transform(F.sequence(F.lit(1), F.length("part")), one)
    each = piece.withColumn("logs", logs).where(F.length("part") >= w).select("seq_id", "len", "at", "part", "logs", "weight", F.explode(F.sequence(F.lit(0), F.least(F.length("part") - w, F.lit(CHUNK_WINDOWS - 1)))).alias("i"))
    site = F.substring(F.col("part"), F.col("i") + 1, F.lit(w))
    ln = F.aggregate(F.slice("logs", F.col("i") + 1, F.lit(w)), F.lit(0.0), lambda a, x: a + x)
    pos = F.col("at") + F.col("i")
    out = each.select("seq_id", pos.alias("pos"), site.alias("site"), F.coalesce("weight", F.lit(1.0)).alias("weight"), ln.alias("ln_bg"), (F.col("len") - pos - w).cast("long").alias("_dist")).where(F.col("site").rlike("^[ACGT]+$"))
    return out.join(near, "_dist", "left").select("seq_id", "pos", "site", "weight", F.coalesce("_near", F.lit(0.0)).alias("spacing"), "ln_bg")


DIGEST = "seq_id long, n long, spacing double, ln_bg double, least double"


def position_prior_digest(seqs: DataFrame, w: int, blocks: DataFrame, size: int, bg: DataFrame, spacing: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq_id, weight, n, spacing, ln_bg, least): of with_position_priors by sequence and weight the number of windows, the sums of their priors and the least ln_bg.

    blocks(seq_id, at, pieces) of T.read_position_blocks with this size stand for the background. Windows don't move: a block of a sequence meets its positions and is counted there.
    """
    p = {r.base: r.p for r in bg.collect()}  # four rows
    usual = np.array([p[b] for b in N.BASES] + [1.0])
    places = [(int(r.dist_from_end), r.p) for r in spacing.collect()]  # a few hundred rows
    near = dict(places)
    if len(near) < len(places):
        raise ValueError("a distance that occurs twice")
    known = np.full(max([d for d in near if d >= 0], default=-1) + 2, 0.0)
    for d, v in near.items():
        if d >= 0 and v is not None:
            known[d] = v

    def digest(row: dict) -> tuple:
        codes = codes_of(row["part"])
        prob = usual[codes]
        met = np.zeros(len(codes) + size + w, bool)
        for piece in row["pieces"] or []:
            i, v = np.frombuffer(piece["i"], "<i4"), np.frombuffer(piece["p"], "<f8").reshape(-1, 4)
            if met[i].any():
                raise ValueError("a position that occurs twice")
            met[i] = True
            inside = i < len(codes)
            i, v = i[inside], v[inside]
            own = codes[i]
            prob[i[own < 4]] = v[own < 4, own[own < 4]]
        n = min(len(codes) - w + 1, size)
        bad = np.append(0, np.cumsum(codes > 3))
        free = np.flatnonzero(bad[w : w + n] == bad[:n])
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(prob > 0, np.log(prob), np.nan)
        ln = np.zeros(n)
        for j in range(w):
            ln += logs[j : j + n]
        ln = ln[free]
        ln = ln[~np.isnan(ln)]
        dist = row["len"] - row["at"] - free - w
        return row["seq_id"], len(free), float(known[np.minimum(dist, len(known) - 1)].sum()), float(ln.sum()) if len(ln) else None, float(ln.min()) if len(ln) else None

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        for batch in batches:
            rows = [r for r in map(digest, batch.to_pylist()) if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    met = chunked(seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "nt"), w, size).where(F.length("part") >= w).join(blocks, ["seq_id", "at"], "left")
    found = stored(met.mapInArrow(run, DIGEST), "digest", size=DIGESTED).join(weights.select("seq_id", F.col("w").alias("weight")), "seq_id", "left")
    sums = [F.sum("n").alias("n"), F.sum("spacing").alias("spacing"), F.sum("ln_bg").alias("ln_bg"), F.min("least").alias("least")]
    return found.withColumn("weight", F.coalesce("weight", F.lit(1.0))).groupBy("seq_id", "weight").agg(*sums)


#: Bytes of blocks that a Python worker gets at once.
DIGESTED = 1 << 24


def at_positions(rows: DataFrame, arrays: DataFrame, values: str, default: float, size: int = CHUNK_WINDOWS) -> DataFrame:
    """rows(seq_id, pos, ...) with p from arrays(seq_id, at, values), or the default; the join has a key for each size positions."""
    met = rows.withColumn("at", F.floor(F.col("pos") / size) * size).join(arrays.select("seq_id", "at", F.col(values).alias("_v")), ["seq_id", "at"], "left")
    return met.withColumn("p", F.coalesce(F.try_element_at("_v", (F.col("pos") - F.col("at") + 1).cast("int")), F.lit(default))).drop("_v", "at")


def groups_of(seqs: DataFrame, starts: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(seq_id, grp): the last group start that isn't after the sequence, null before the first.

    Starts and sequences are put in one order, in ranges of width ids; the last start of each range is carried on to later ranges
    by a window over one row for each range.
    """
    block = F.floor(F.col("at") / width)
    both = starts.select(F.col("start").cast("long").alias("at"), F.col("start").cast("long").alias("g"), F.lit(0).alias("kind")).union(seqs.select(F.col("seq_id").cast("long"), F.lit(None).cast("long"), F.lit(1))).withColumn("b", block)
    ends = both.groupBy("b").agg(F.max("g").alias("last"))
    carried = ends.select("b", F.last("last", ignorenulls=True).over(Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.last("g", ignorenulls=True).over(Window.partitionBy("b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("own", own).where("kind = 1").join(carried, "b").select(F.col("at").alias("seq_id"), F.coalesce("own", "before").alias("grp"))


def species_weights(seqs: DataFrame, table: DataFrame, default: float = 1.0) -> DataFrame:
    """(seq_id, w) of seqs(seq_id, grp, species): the weight of a sequence's species in the set of species that its group has.

    table(code, species, w): code has a bit for each species of the set; a set or species that it lacks takes the default.
    """
    bit = F.expr("shiftleft(1L, cast(species as int))")
    sets = seqs.groupBy("grp").agg(F.bit_or(bit).alias("code"))
    met = seqs.join(sets, "grp").join(table, ["code", "species"], "left")
    return met.select("seq_id", F.coalesce("w", F.lit(default)).alias("w"))


def motif_stats(rows: DataFrame) -> DataFrame:
    """(gene, motif, n, total, avg, max, min, std) of site rows(gene, motif, pct)."""
    return rows.groupBy("gene", "motif").agg(F.count("*").alias("n"), F.sum("pct").alias("total"), F.avg("pct").alias("avg"), F.max("pct").alias("max"), F.min("pct").alias("min"), F.stddev_pop("pct").alias("std"))


def location_stats(rows: DataFrame, weight: float) -> DataFrame:
    """(gene, location, motif, total, avg, n) of site rows(gene, location, motif, pct); the sum is rounded to nine places, so that it doesn't depend on the order of its rows."""
    return rows.groupBy("gene", "location", F.lower("motif").alias("motif")).agg((F.round(F.sum("pct"), 9) / weight).alias("total"), F.avg("pct").alias("avg"), F.count("*").alias("n"))
