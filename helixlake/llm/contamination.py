"""Benchmark decontamination by a positional inverted index (operator 1).

Terms are words; a window is 10 consecutive words of a benchmark item (all words of a
shorter item). One pass over the training texts counts the benchmark's terms. Each
window is then anchored at its RAREST terms; a second pass stores the postings of these
terms only, a row for each document: term, position and the words around it. Offset-adjusted posting lists
are intersected, rarest first, within the row, and survivors are compared
word by word with the words stored beside the rarest posting. So neither texts nor postings are
shuffled, and the index holds rare terms, not the corpus. Proximity matches come from the same lists: the two
rarest terms that occur stand within SLOP words of their distance in the window, and so many of its terms (NEAR_SHARE)
within SLOP words of their places.

Windows are taken in blocks of MAX_WINDOWS at most, so what is broadcast has a fixed bound;
a larger benchmark takes more passes.

Edge cases: null or blank texts have no words and no hits; blank items make no window;
equal windows of several items count for each of them; rows are treated one by one, also
where doc_ids are null or repeated (row_key tells them apart); very long texts are read whole;
of equally frequent terms the earlier in a window anchors it; empty tables give zero hits or
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import dropped, id_text, row_key, saved, table

WIDTH, RAREST, MAX_WINDOWS, SLOP, NEAR_SHARE = 10, 2, 100_000, 3, 0.8


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, wid and the term fingerprints of each window of items(item_id, text)."""

    def run(batches):
        for t in K.slices(batches):
            w = t.words(K.NOT_ALNUM, K.FOLDED)
            per = np.where(w.counts > 0, np.maximum(w.counts - width + 1, 1), 0)
            first = np.repeat(w.first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            size = np.repeat(np.minimum(w.counts, width), per)
            grid = np.concatenate([w.h[a : a + n] for a, n in zip(first, size)]) if len(first) else np.zeros(0, K.U64)
            owner = t.ids().take(pa.array(np.repeat(np.arange(t.n), per)))
            yield pa.RecordBatch.from_arrays([owner, K.lists(K.signed(grid), size, pa.int64())], ["item_id", "terms"])

    found = id_text(items, "item_id").mapInArrow(run, "item_id long, terms array<long>")
    return found.withColumn("wid", F.xxhash64("terms")).distinct()


def _find(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the sorted vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n) of the given terms over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for t in K.slices(batches):
            at = _find(shared.value, t.words(K.NOT_ALNUM, K.FOLDED).h)
            total += np.bincount(at[at >= 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(shared.value[used])), pa.array(total[used])], ["term", "n"])

    return id_text(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words and the document's postings: term, pos and the width - 1 words on both sides (0 beyond the ends)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    reach = np.arange(1 - width, width)

    def run(batches):
        for t in K.slices(batches):
            w = t.words(K.NOT_ALNUM, K.FOLDED)
            hit = np.flatnonzero(_find(shared.value, w.h) >= 0)
            doc = w.doc[hit]
            around = hit[:, None] + reach
            inside = (around >= w.first[doc][:, None]) & (around < w.first[doc + 1][:, None])
            near = np.where(inside, w.h[np.clip(around, 0, max(len(w.h) - 1, 0))] if len(hit) else np.zeros_like(around, K.U64), K.U64(0))
            row = pa.StructArray.from_arrays(
                [pa.array(K.signed(w.h[hit])), pa.array((hit - w.first[doc]).astype(np.int64)), K.lists(K.signed(near.reshape(-1)), np.full(len(hit), len(reach)), pa.int64())], ["term", "pos", "near"]
            )
            offsets = np.zeros(t.n + 1, dtype=np.int32)
            np.cumsum(np.bincount(doc, minlength=t.n), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([t.ids(), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), row)], ["doc_id", "n_words", "postings"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, postings array<struct<term: long, pos: long, near: array<long>>>")


def anchors(found: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(wid, terms, term, off, rank, exact): the rarest terms of each distinct window among those that occur, and their offsets; exact unless a term occurs nowhere."""
    each = found.select("wid", "terms").distinct().select("wid", "terms", F.posexplode("terms").alias("off", "term"))
    known = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("wid")
    # a window with a term that no training text has can't match as a phrase
    ranked = known.withColumn("exact", F.min("n").over(w) > 0).where("n > 0").withColumn("rank", F.row_number().over(w.orderBy("n", "off")))
    return ranked.where(F.col("rank") <= rarest).select("wid", "terms", "term", "off", "rank", "exact")


def _array(rows: DataFrame) -> np.ndarray:
    return np.sort(np.array([r[0] for r in rows.collect()], dtype=np.int64).view(K.U64))


class Anchors:
    """The windows of a block (MAX_WINDOWS at most) with their rarest terms, as arrays sorted by term; sent to all tasks."""

    def __init__(self, anchored: DataFrame):
        rows = anchored.toArrow()
        term = rows["term"].to_numpy().view(K.U64)
        order = np.argsort(term, kind="stable")
        self.term, self.off, self.rank = term[order], rows["off"].to_numpy()[order].astype(np.int64), rows["rank"].to_numpy()[order]
        self.wids, first, of = np.unique(rows["wid"].to_numpy(), return_index=True, return_inverse=True)
        self.window = of[order]
        lists = rows["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)[first]
        begin = (lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets.to_numpy()[0])[first]
        flat = lists.flatten().to_numpy().view(K.U64)
        self.terms, self.sizes = np.zeros((len(first), WIDTH), K.U64), sizes
        for i in range(WIDTH):
            has = sizes > i
            self.terms[has, i] = flat[begin[has] + i]
        self.exact = rows["exact"].to_numpy(zero_copy_only=False)[first]

    def lists(self, term: np.ndarray, pos: np.ndarray, doc: np.ndarray):
        """(rank, posting, document, window, offset-adjusted start) of each place of a posting's term in a window."""
        lo, hi = np.searchsorted(self.term, term), np.searchsorted(self.term, term, side="right")
        n = hi - lo
        posting = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return self.rank[at], posting, doc[posting], self.window[at], pos[posting] - self.off[at], self.off[at]


HIT = "doc_id long, wid long, start long, end long, gap long, n_near long, exact boolean"


def intersected(index: DataFrame, anchored: DataFrame, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """(doc_id, wid, start, end, gap, n_near, exact): the matches of windows in documents; start is where the window begins by its rarest term.

    A document's posting lists are in one row, so the lists of a window's rarest terms, moved by their offsets, meet in the row: where
    they are gap <= slop words apart. Then the words beside the rarest posting are compared: exact, if all are those of the
    window in place; and n_near of them are within slop words of their places. Kept are exact matches, and those with the
    given share of words near.
    """
    shared = index.sparkSession.sparkContext.broadcast(Anchors(anchored))
    kinds = pa.schema([("doc_id", pa.int64()), ("wid", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.int64()), ("n_near", pa.int64()), ("exact", pa.bool_())])

    def run(batches):
        w = shared.value
        for batch in K.row_slices(batches, 16):
            lists = batch.column(1)
            rows = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            term, pos = rows.field(0).to_numpy().view(K.U64), rows.field(1).to_numpy()
            near = rows.field(2).flatten().to_numpy().view(K.U64).reshape(-1, 2 * WIDTH - 1)
            rank, posting, d, window, start, off = w.lists(term, pos, doc)
            key = (d * max(len(w.wids), 1) + window) * (1 << 32) + start + WIDTH
            second = np.sort(key[rank == 2])
            one = np.flatnonzero(rank == 1)
            low = np.searchsorted(second, key[one] - slop)
            met = (low < np.searchsorted(second, key[one] + slop, side="right")) | (w.sizes[window[one]] == 1)
            one, low = one[met], low[met]
            gap = np.zeros(len(one), np.int64)
            if len(second):
                right = np.searchsorted(second, key[one])
                gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - key[one]), np.abs(second[np.maximum(right - 1, 0)] - key[one]))
            gap[w.sizes[window[one]] == 1] = 0
            g, o, beside = window[one], off[one], near[posting[one]]
            same, found = np.ones(len(one), bool), np.zeros(len(one), np.int64)
            for i in range(WIDTH):
                has = w.sizes[g] > i
                there = np.zeros(len(one), bool)
                for j in range(-slop, slop + 1):
                    at = WIDTH - 1 + i - o + j
                    inside = has & (at >= 0) & (at < 2 * WIDTH - 1)
                    hit = inside & (beside[np.arange(len(one)), np.clip(at, 0, 2 * WIDTH - 2)] == w.terms[g, i])
                    there |= hit
                    if j == 0:
                        same &= hit | ~has
                found += there
            exact = same & w.exact[g] & (start[one] >= 0) & (gap == 0)
            keep = exact | (found >= np.ceil(share * w.sizes[g] - 1e-9)) & (w.sizes[g] > 1)
            s = start[one][keep]
            ids = batch.column(0).take(pa.array(d[one][keep]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(w.wids[g[keep]]), pa.array(s), pa.array(s + w.sizes[g[keep]]), pa.array(gap[keep]), pa.array(found[keep]), pa.array(exact[keep])], schema=kinds)

    return index.select("doc_id", "postings").mapInArrow(run, HIT)


def matches(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of all documents, and the exact and proximity matches of every window."""
    distinct = saved(found.select("wid", "terms").distinct(), "windows")
    blocks = max(1, -(-distinct.count() // MAX_WINDOWS))
    sizes, hits = None, None
    for b in range(blocks):
        part = distinct.where(F.pmod("wid", F.lit(blocks)) == b)
        counts = saved(term_counts(docs, _array(part.select(F.explode("terms")).distinct())), "terms")
        anchored = saved(anchors(part, counts), "anchors")
        index = saved(postings(docs, _array(anchored.select("term").distinct())), "postings")
        # a document with a passage of the benchmark has many postings, so few rows go to a worker at once
        more = saved(intersected(index, anchored), "hits", 64)
        if sizes is None:
            sizes = saved(index.select("doc_id", "n_words"), "sizes")
        hits = more if hits is None else hits.union(more)
        dropped(index)
    return sizes, hits


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated and n_near (windows with a proximity match) for each row of docs(doc_id, text)."""
    key, unique = row_key(docs)
    if unique:
        return contaminated_keys(docs, items)
    rows = docs.select(key.alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scores = contaminated_keys(rows.select(F.col("row_key").alias("doc_id"), "text"), items).withColumnRenamed("doc_id", "row_key")
    return rows.select("row_key", "doc_id").distinct().join(scores, "row_key").select("doc_id", *scores.columns[1:])


def contaminated_keys(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination, where doc_id is known and differs wherever texts do."""
    found = saved(windows(items), "items")
    sizes, all_hits = matches(docs, found)
    hits = all_hits.where("exact")
    per_start = hits.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    covered = per_start.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    of_doc = hits.select("doc_id", "wid").distinct().join(found.select("wid", "item_id"), "wid").select("doc_id", "item_id").distinct()
    named = of_doc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    close = all_hits.where((F.col("n_near") >= F.ceil(F.lit(NEAR_SHARE) * (F.col("end") - F.col("start")))) & (F.col("end") - F.col("start") > 1)).groupBy("doc_id").agg(F.countDistinct("wid").alias("n_near"))
    out = sizes.join(covered, "doc_id", "left").join(named, "doc_id", "left").join(close, "doc_id", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS k FROM win),
dg AS (SELECT doc_id, i, k, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dg JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
known AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) WHERE t IN (SELECT unnest(g) FROM win) GROUP BY t),
anc AS (SELECT g, t, o, row_number() OVER (PARTITION BY g ORDER BY n, o) AS rk FROM (SELECT g, unnest(g) AS t, unnest(range(0, len(g))) AS o FROM (SELECT DISTINCT g FROM win)) JOIN known USING (t) QUALIFY rk <= 2),
post AS (SELECT doc_id, w, t, p FROM (SELECT doc_id, w, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d) WHERE t IN (SELECT t FROM anc)),
near AS (SELECT DISTINCT x.doc_id, x.g FROM (SELECT doc_id, w, g, o, p FROM post JOIN anc USING (t) WHERE rk = 1) x JOIN (SELECT doc_id, g, p - o AS s FROM post JOIN anc USING (t) WHERE rk = 2) y ON x.doc_id = y.doc_id AND x.g = y.g AND abs(x.p - x.o - y.s) <= 3
  WHERE len([i FOR i IN range(0, len(x.g)) IF list_contains(x.w[greatest(1, x.p - 8, x.p + i - x.o - 2) : least(x.p + 10, x.p + i - x.o + 4)], x.g[i + 1])]) >= ceil(0.8 * len(x.g))),
nr AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
