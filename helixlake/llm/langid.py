"""Language identification with hyperdimensional profiles (operator 12).

Each letter has a pseudo-random vector of DIMENSIONS signs. The vector of an n-gram binds (multiplies) those of its
letters, each permuted (rotated) by its place; spaces between words are letters here. A text bundles (adds) the
vectors of all its n-grams, a language those of all its training texts. Spark adds the partial bundles of
the tasks up by language and dimension; all are whole numbers, so the sums don't depend on their order. A text gets the language
whose prototype has the largest cosine with it, after the mean direction of all prototypes, which tells no language,
has been taken out of the prototypes. Prototypes reach the tasks in blocks of LANGUAGES, each a
bounded size; with more languages the rows pass through one step for each block, in one stage.

N-grams of a slice are counted first, so each distinct one is bound once and a text is a sum of
rows by count. A letter is a character that Unicode calls one, lower-cased if that is one character; anything else separates words.

Edge cases: null texts and texts without a letter are `und` with score 0, as are all texts where nothing could be
learned; ties go to the language that sorts first; rows whose doc_id is null count as held out; repeated rows each count; long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import id_text, saved, table

DIMENSIONS, GRAM, LANGUAGES = 1024, 3, 500
UNKNOWN = "und"
#: Bytes of text at once, distinct n-grams bound at once, most common n-grams of a slice, entries of a table of n-grams.
SLICE, BOUND, COMMON, TABLE = 1 << 20, 8192, 1024, 1 << 22
#: Languages whose bundles a task holds before it hands them on.
HELD = 1024


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_bits(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of pseudo-random bits for each letter; bit 1 stands for the sign -1."""
    with np.errstate(over="ignore"):
        x = K.mix64(letters.astype(K.U64)[:, None] * K.BASE + np.arange(1, dimensions // 64 + 1, dtype=K.U64)[None, :] * K.GOLDEN)
    return np.unpackbits(K.mix64(x).astype("<u8").view(np.uint8), axis=1)


class Grams:
    """The distinct n-grams of a slice (letters: one row each), and per text the ascending numbers of its n-grams with their counts."""

    def __init__(self, t: K.Texts):
        points = folding()[np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")]
        first = np.zeros(len(t.data) + 1, dtype=np.int64)
        np.cumsum((t.data & 0xC0) != 0x80, out=first[1:])
        bounds = first[t.bounds]
        doc = np.repeat(np.arange(t.n), np.diff(bounds))
        # a space before and behind each text, and no space behind another
        x, owner = np.zeros(len(points) + 2 * t.n, np.uint32), np.empty(len(points) + 2 * t.n, np.int64)
        at = np.arange(len(points)) + 2 * doc + 1
        x[at], owner[at] = points, doc
        ends = bounds + 2 * np.arange(t.n + 1)
        owner[ends[:-1]], owner[ends[1:] - 1] = np.arange(t.n), np.arange(t.n)
        stays = np.ones(len(x), bool)
        stays[1:] = (x[1:] != 0) | (x[:-1] != 0) | (owner[1:] != owner[:-1])
        x, owner = x[stays].astype(np.uint64), owner[stays]
        n = max(len(x) - GRAM + 1, 0)
        inside = np.flatnonzero(owner[:n] == owner[GRAM - 1 :][:n])
        here = np.zeros(0x110000, bool)
        here[x] = True
        self.letters = np.flatnonzero(here)
        place = np.zeros(0x110000, np.uint64)
        place[self.letters] = np.arange(len(self.letters))
        x, size = place[x], len(self.letters)
        packed = np.zeros(len(inside), np.uint64)
        for k in range(GRAM):
            packed = packed * np.uint64(max(size, 1)) + x[inside + k]
        if size**GRAM <= TABLE:  # few letters: places in a table stand for a sort
            seen = np.bincount(packed.astype(np.int64), minlength=size**GRAM)
            distinct = np.flatnonzero(seen)
            often = seen[distinct]
            number = np.cumsum(seen > 0)[packed.astype(np.int64)] - 1
        else:
            distinct, number, often = np.unique(packed, return_inverse=True, return_counts=True)
        # the most common first
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.distinct, self.number, self.owner = distinct[order].astype(np.int64), rank[number], owner[inside]
        self.upto, self.n = np.searchsorted(self.owner, np.arange(t.n + 1)), t.n

    def bound(self, at: int, to: int, dimensions: int) -> np.ndarray:
        """The vectors of the distinct n-grams of these numbers, as bits."""
        part = self.distinct[at:to]
        out = np.zeros((len(part), dimensions // 8), np.uint8)
        for k in reversed(range(GRAM)):
            used, where = np.unique(part % len(self.letters), return_inverse=True)
            out ^= np.packbits(np.roll(letter_bits(self.letters[used], dimensions), GRAM - 1 - k, axis=1), axis=1)[where]
            part = part // len(self.letters)
        return np.unpackbits(out, axis=1)

    def bundles(self, group: np.ndarray, groups: int, dimensions: int) -> np.ndarray:
        """The sum of the n-gram vectors of each group of texts (group: of each text, -1 for none); whole numbers."""
        distinct, own = max(len(self.distinct), 1), group[self.owner]
        key, count = np.unique(own[own >= 0] * distinct + self.number[own >= 0], return_counts=True)
        g, number = key // distinct, key % distinct
        exact = np.float32 if len(self.number) < 1 << 24 else np.float64
        count = count.astype(exact)
        # common n-grams as one product of counts and vectors, the others row by row
        dense, common = np.zeros((groups, min(COMMON, distinct)), exact), number < COMMON
        dense[g[common], number[common]] = count[common]
        ones = (dense @ self.bound(0, COMMON, dimensions).astype(exact)).astype(np.float64) if len(self.distinct) else np.zeros((groups, dimensions))
        cut = np.searchsorted(g, np.arange(groups + 1))
        for at in range(COMMON, len(self.distinct), BOUND):
            bits = self.bound(at, at + BOUND, dimensions).astype(exact)
            for i in range(groups):
                a, b = cut[i] + np.searchsorted(number[cut[i] : cut[i + 1]], (at, at + BOUND))
                if a < b:
                    ones[i] += count[a:b] @ bits[number[a:b] - at]
        return np.bincount(g, count, groups)[:, None] - 2 * ones


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, pos, total): the bundle of all texts of each language of docs(text, lang)."""

    def given(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = list(sums)
        total = np.concatenate([sums[k] for k in names]).astype(np.int64)
        lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names), dtype=np.int32), dimensions)), pa.array(names)).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(names))), pa.array(total)], ["lang", "pos", "total"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for t in K.slices(batches, limit=SLICE):
            langs = t.ids("lang").to_pylist()
            names = sorted(set(langs))
            place = {k: i for i, k in enumerate(names)}
            found = Grams(t).bundles(np.array([place[k] for k in langs]), len(names), dimensions)
            for k, v in zip(names, found):
                sums[k] = sums[k] + v if k in sums else v
            if len(sums) > HELD:
                yield given(sums)
                sums = {}
        if sums:
            yield given(sums)

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, pos int, total long")
    return parts.groupBy("lang", "pos").agg(F.sum("total").alias("total"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether nothing may be learned from a row."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def compared(docs: DataFrame, names: list[str], vectors: np.ndarray, last: bool) -> DataFrame:
    """docs(doc_id, text, lang_pred, cosine) with the better of what it has and the best of these languages; last: without text."""
    unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)).T
    dimensions = vectors.shape[1]

    def run(batches):
        for t in K.slices(batches, limit=SLICE):
            grams = Grams(t)
            lang, cosine = t.ids("lang_pred").to_pylist(), t.ids("cosine").to_pylist()
            for a in range(0, t.n, 256):
                b = min(a + 256, t.n)
                group = np.full(t.n, -1)
                group[a:b] = np.arange(b - a)
                own = grams.bundles(group, b - a, dimensions)
                close = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)) @ unit
                best = close.argmax(axis=1)
                for i in np.flatnonzero(np.diff(grams.upto[a : b + 1])):
                    c = float(close[i, best[i]])
                    if cosine[a + i] is None or c > cosine[a + i]:
                        lang[a + i], cosine[a + i] = names[best[i]], c
            kept = [t.ids(), pa.array(lang, pa.string()), pa.array(cosine, pa.float64())]
            yield pa.RecordBatch.from_arrays(kept if last else [kept[0], t.ids("text"), *kept[1:]], ["doc_id", "lang_pred", "cosine"] if last else ["doc_id", "text", "lang_pred", "cosine"])

    return docs.mapInArrow(run, f"doc_id long, {'' if last else 'text string, '}lang_pred string, cosine double")


def languages(docs: DataFrame, dimensions: int = DIMENSIONS, block: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang)."""
    rows = id_text(docs, "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    learned = rows.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = saved(prototypes(learned, dimensions), "prototypes")
    sizes = known.groupBy("lang").agg(F.sqrt(F.sum(F.col("total").cast("double") ** 2)).alias("size")).where("size > 0")
    unit = saved(known.join(sizes, "lang").select("lang", "pos", (F.col("total") / F.col("size")).alias("x")), "prototypes")
    names = sorted(r.lang for r in unit.select("lang").distinct().collect())
    mean = np.zeros(dimensions)
    for r in unit.groupBy("pos").agg(F.avg("x").alias("x")).collect():
        mean[r.pos] = r.x if len(names) > 1 else 0.0
    out = rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("cosine"))
    for at in range(0, len(names), block):
        part = names[at : at + block]
        place = {k: i for i, k in enumerate(part)}
        vectors = np.zeros((len(part), dimensions))
        for r in unit.where(F.col("lang").between(part[0], part[-1])).collect():
            vectors[place[r.lang], r.pos] = r.x - mean[r.pos]
        out = compared(out, part, vectors, at + block >= len(names))
    score = F.least(F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", held_out().alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
