"""Near-duplicate documents by circulant MinHash (operator 10).

Two permutations of the 32-bit hash space make the whole signature: ``sigma`` scatters the
shingles once, and coordinate k is the minimum of ``pi`` read k places further round the
circle. Bands of ROWS coordinates are bucket keys. At the linking similarity of 0.85 a pair
shares none of the BANDS buckets with probability (1 - 0.85^5)^24 = 8e-7.

No bucket is expanded into all its pairs. Equal shingle sets collapse into one class first.
Each document of a bucket is then compared with the bucket's pivot only, and linked
documents take one label. Documents of different labels differ where their differences from
the pivot do, so these are indexed, rarest first (difference_index): what comes before
the first common difference tells pairs apart without their texts. The first document of each
difference is compared with the others of it, labels are merged, and only pairs
still of different labels that may be linked are compared, so no link that could join two
components is lost. Links are confirmed on full shingle sets (64-bit fingerprints).

Edge cases: null, empty and blank texts have no shingles, are linked with nothing and are
kept; under five words the whole sequence is the one shingle; ties go to the smaller
doc_id; very long texts are read whole; an empty table gives an empty result; other columns
are ignored. doc_ids may be null or repeated: rows are then told apart by row_key, a group's
component_id is its smallest known doc_id (null where none is known), and the row of the
smallest doc_id (null last), then row_key, is kept; rows alike in doc_id and text are one
document and share its verdict.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.graph import components
from helixlake.llm.shared import dropped, id_text, row_key, saved, table

ROWS, BANDS, SHINGLE = 5, 24, 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Exact copies from which a class is dealt out over SPREAD tasks when its documents are told their representative.
COPIES, SPREAD = 1000, 32
U32 = np.uint32
#: Multipliers of two public 32-bit finalisers, each a bijection.
SIGMA, PI = (U32(0x85EBCA6B), U32(0xC2B2AE35)), (U32(0x7FEB352D), U32(0x846CA68B))


def permute(x: np.ndarray, by: tuple, spare: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    for shift, mul in ((16, by[0]), (15, by[1])):
        np.right_shift(x, U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, mul, out=x)
    np.right_shift(x, U32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def shingle_sets(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after another, and how many each has."""
    w = t.words(K.SPACE, K.FOLDED)
    at, h = w.grams(SHINGLE)
    per = np.maximum(w.counts - SHINGLE + 1, 0)
    ends = np.cumsum(per)
    sets, sizes = [], np.zeros(t.n, dtype=np.int64)
    for i in np.flatnonzero(w.counts):
        if per[i]:
            s = np.unique(h[ends[i] - per[i] : ends[i]])
        else:
            s = K.gram_hash(w.h, w.first[i : i + 1], int(w.counts[i]))
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, K.U64)), sizes


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of ROWS * BANDS minima for the texts with shingles."""
    sizes = sizes[sizes > 0]
    out = np.empty((len(sizes), ROWS * BANDS), dtype=U32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        lo = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + 65536, side="right")))
        x = (shingles[lo : ends[to - 1]] >> K.U64(32)).astype(U32)
        spare, y = np.empty_like(x), np.empty_like(x)
        permute(x, SIGMA, spare)
        heads = ends[at:to] - sizes[at:to] - lo
        for k in range(ROWS * BANDS):
            np.add(x, U32(k), out=y)
            out[at:to, k] = np.minimum.reduceat(permute(y, PI, spare), heads)
        at = to
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    keys = np.empty((len(signature), BANDS), dtype=K.U64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(signature), b + 1, dtype=K.U64)
            for r in range(ROWS):
                key = K.mix64(key * K.BASE + signature[:, b * ROWS + r])
            keys[:, b] = key
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the fingerprint of the set and the bucket keys; no fingerprint where the set is empty."""

    def run(batches):
        for t in K.slices(batches):
            shingles, sizes = shingle_sets(t)
            keys = band_keys(signatures(shingles, sizes))
            ends, prints = np.cumsum(sizes), []
            for n, e in zip(sizes, ends):
                prints.append(hashlib.blake2b(shingles[e - n : e].tobytes(), digest_size=16).digest() if n else None)
            rows = [t.ids(), pa.array(sizes), pa.array(prints, pa.binary()), K.lists(K.signed(keys.reshape(-1)), np.where(sizes > 0, BANDS, 0), pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_shingles", "print", "keys"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, print binary, keys array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the whole sorted shingle set."""

    def run(batches):
        for t in K.slices(batches):
            shingles, sizes = shingle_sets(t)
            yield pa.RecordBatch.from_arrays([t.ids(), K.lists(K.signed(shingles), sizes, pa.int64())], ["doc_id", "shingles"])

    return id_text(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar enough."""
    pairs = saved(pairs, "pairs")
    right = sets.join(pairs, sets.doc_id == pairs.b).select("a", "b", F.col("shingles").alias("y"))
    left = sets.join(pairs.select("a").distinct(), sets.doc_id == F.col("a"), "left_semi").select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    return saved(right.join(left, "a").where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b"), "linked")


def linkable(apart: Column, n: Column, o_n: Column) -> Column:
    """Whether sets of n and o_n elements may be linked if apart elements are in one of them only; the exact rule, where apart is exact."""
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n + o_n)


def profiles(star: DataFrame, sets: DataFrame) -> DataFrame:
    """How each document of star(c, doc_id) differs from its pivot c: n and c_n are the set sizes, diff has the shingles that one of both lacks."""
    own = sets.join(star, "doc_id").select("c", "doc_id", F.col("shingles").alias("y"))
    pivots = sets.join(star.select("c").distinct(), sets.doc_id == F.col("c"), "left_semi").select(F.col("doc_id").alias("c"), F.col("shingles").alias("x"))
    return own.join(pivots, "c").select("c", "doc_id", F.size("y").alias("n"), F.size("x").alias("c_n"), F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("diff"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(c, doc_id, ...) with the labels of the document and, as c_label, of the pivot; an id without one is its own."""
    of = lambda c, label: labels.select(F.col("id").alias(c), F.col("label").alias(label))
    both = rows.join(of("doc_id", "label"), "doc_id", "left").join(of("c", "c_label"), "c", "left")
    return both.withColumn("label", F.coalesce("label", "doc_id")).withColumn("c_label", F.coalesce("c_label", "c"))


def difference_index(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """(c, e, doc_id, n, d, i): element e of a document's differences from its pivot, d in all, i of them before e.

    Under a pivot, rarer elements come first. x and y differ exactly where their differences from c do, so all before the first common
    element are in one of both only, and PERCENT times their number is (100 - PERCENT) * n at most if x and y can be linked (y has 100 / PERCENT
    times as many as x at most). Elements of one label only are left out.
    """
    now = labelled(profile, labels)
    split = now.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("c")
    each = now.join(split, "c", "left_semi").select("c", "doc_id", "n", F.size("diff").alias("d"), "label", F.explode("diff").alias("e"))
    often = each.groupBy("c", "e").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    before = F.row_number().over(Window.partitionBy("c", "doc_id").orderBy("k", "e")) - 1
    return each.join(often, ["c", "e"]).withColumn("i", before).where((PERCENT * F.col("i") <= (100 - PERCENT) * F.col("n")) & (F.col("lo") < F.col("hi"))).select("c", "e", "doc_id", "n", "d", "i")


def open_pairs(index: DataFrame, labels: DataFrame, hubs: bool) -> DataFrame:
    """Pairs (a, b) of different labels under one pivot that may be similar enough; with hubs, only those with the first document of an element.

    Sets without a common difference from the pivot are linked only if both are linked with the pivot, by their sizes, so they have
    its label. Of any other pair one document doesn't have the pivot's label, and of one of both (light) few elements for its size
    come before the first common one. Documents that share an element are met by these two rules, and kept by what their places in
    both differences tell.
    """
    now = labelled(index, labels).withColumn("light", (100 + PERCENT) * F.col("i") <= (100 - PERCENT) * F.col("n"))
    own = ["doc_id", "n", "d", "i", "label"]
    mixed = now.groupBy("c", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("i", "doc_id", "n", "d", "label")).alias("hub")).where("lo < hi and hub is not null")
    if hubs:
        met = now.select("c", "e", *own).join(mixed.select("c", "e", *(F.col(f"hub.{x}").alias(f"o_{x}") for x in own)), ["c", "e"])
        once = F.lit(True)
    else:
        now = now.join(mixed, ["c", "e"], "left_semi")
        apart = now.where("label != c_label").select("c", "e", *own, F.explode(F.when(F.col("light"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("light"), F.col("light").alias("x_light"))
        met = apart.join(now.select("c", "e", "light", *(F.col(x).alias(f"o_{x}") for x in own), (F.col("label") != F.col("c_label")).alias("o_apart")), ["c", "e", "light"])
        # a pair that both sides would find is taken once
        once = ~(F.col("o_apart") & (F.col("doc_id") > F.col("o_doc_id")))
    rest = F.abs(F.col("d") - F.col("i") - F.col("o_d") + F.col("o_i"))
    met = met.where((F.col("label") != F.col("o_label")) & once & linkable(F.col("i") + F.col("o_i") + rest, F.col("n"), F.col("o_n")))
    return met.select(F.least("doc_id", "o_doc_id").alias("a"), F.greatest("doc_id", "o_doc_id").alias("b")).distinct()


def rooted(star: DataFrame, hops: int = 2) -> DataFrame:
    """star(c, doc_id) with each pivot replaced by its own smallest pivot, so that a family has one pivot, not one for each bucket."""
    star = saved(star, "buckets")
    up = saved(star.where("c != doc_id").groupBy(F.col("doc_id").alias("from")).agg(F.min("c").alias("to")), "up")
    for _ in range(hops):
        star = star.join(up, star.c == F.col("from"), "left").select(F.coalesce("to", "c").alias("c"), "doc_id").distinct()
    return star


def represented(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, rep): the representative of each document's exact copies, itself if it has none.

    classes: (print, rep, m). The documents of a class of COPIES or more are dealt out by a hash of their id, and the
    class goes to each of these tasks, so no task gets them all.
    """
    rows = sketch.select("doc_id", "n_shingles", "print", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("salt"))
    large = classes.where(F.col("m") >= COPIES).select("print", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"), "rep")
    dealt = saved(rows.join(large, ["print", "salt"], "left").select("doc_id", "n_shingles", "print", "rep"), "copies")
    small = classes.where((F.col("m") > 1) & (F.col("m") < COPIES)).select("print", F.col("rep").alias("own"))
    rest = dealt.where("rep is null").join(small, "print", "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("rep"))
    return dealt.where("rep is not null").select("doc_id", "n_shingles", "rep").union(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text)."""
    return near_duplicate_rows(docs, *row_key(docs)).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_rows(docs: DataFrame, key: Column, unique: bool) -> DataFrame:
    """near_duplicates with row_key; key and unique as row_key(docs) gives them."""
    if unique:
        return grouped(docs).withColumn("row_key", F.col("doc_id"))
    rows = saved(docs.select(key.alias("row_key"), F.col("doc_id").cast("long").alias("doc_id")), "rows")
    found = saved(grouped(docs.select(key.alias("doc_id"), "text"), True).select(F.col("doc_id").alias("row_key"), "n_shingles", F.col("component_id").alias("of")), "grouped")
    first = rows.distinct().join(found, "row_key").groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    named = found.join(first, "of").select("row_key", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row_key") == F.col("first.row_key")).alias("kept"))
    return rows.join(named, "row_key").select("doc_id", "n_shingles", "component_id", "kept", "row_key")


def grouped(docs: DataFrame, repeated: bool = False) -> DataFrame:
    """near_duplicates, where doc_id is known and differs wherever texts do; if repeated, one row for each doc_id."""

    def once(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["doc_id"]) if repeated else df

    sketch = saved(once(sketches(docs)), "sketch")
    classes = sketch.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    reps = sketch.join(classes.select("rep"), sketch.doc_id == F.col("rep"), "left_semi")
    buckets = reps.select("doc_id", F.explode("keys").alias("key"))
    pivot = buckets.groupBy("key").agg(F.min("doc_id").alias("c"), F.count("*").alias("m")).where("m > 1").select("key", "c")
    star = saved(rooted(buckets.join(pivot, "key").select("c", "doc_id").distinct()), "star")
    ids = star.select("doc_id").distinct()
    sets = saved(once(full_sets(id_text(docs).join(ids, "doc_id", "left_semi"))), "sets")
    profile = saved(profiles(star, sets), "profiles")
    dropped(star)
    found = profile.where((F.col("c") != F.col("doc_id")) & linkable(F.size("diff"), F.col("n"), F.col("c_n"))).select(F.col("c").alias("a"), F.col("doc_id").alias("b"))
    labels = components(found)
    index = saved(difference_index(profile, labels), "index")
    dropped(profile)
    for hubs in (True, False):
        more = confirm(open_pairs(index, labels, hubs), sets)
        if not more.isEmpty():
            labels = components(labels.select(F.col("label").alias("a"), F.col("id").alias("b")).union(more))
    of_class = represented(sketch, classes)
    of_class = of_class.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    return of_class.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
