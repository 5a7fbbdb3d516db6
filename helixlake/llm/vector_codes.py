"""Product codes of vectors by per-dimension value dictionaries (operator 13).

Components become integers, floor(SCALE * x). Vectors are stored once in blocks of BLOCK rows; a block has a dictionary of
the distinct integers of each dimension, and each component is its place there. In each round a
task tabulates, for every dimension of a block, the squared differences of the distinct integers to all codebook
entries; the distances of a part are then gathers of table rows by dictionary code, added up over its dimensions. All
arithmetic is on integers, so results don't depend on how rows are dealt. A round's sums and counts by part,
entry and position are added up by Spark; only codebooks (ENTRIES x length of a vector) pass through the driver.

Edge cases: vectors that are null, or hold null, non-finite or very large components (LARGEST or more, whose squares
don't fit 64 bits), are dropped; so are vectors whose length isn't that of the first kept one. Where the length isn't a multiple of
PARTS the first parts are longer by one; parts without components have distance 0. Rows stand in the order of
vec_id (null last), then components; repeated rows count each. Fewer than ENTRIES rows make smaller codebooks; ties go to the lower entry; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import saved, table

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK = 1024, 4, 256, 4, 2048
LARGEST = float(1 << 18)
BLOCKS = "ids array<long>, labels array<string>, values array<long>, sizes array<int>, codes binary"


def kept_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, label) of the usable rows of rows(vec_id, embedding, label)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE).astype(np.int64)


def part_bounds(length: int) -> list[tuple[int, int]]:
    """Where the parts begin and end."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(length), PARTS)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def packed(vectors: DataFrame, length: int) -> DataFrame:
    """The vectors in blocks: dictionaries of all dimensions one after another, their sizes, and 32-bit codes, a dimension after another."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = integers(np.asarray(part.column(1).flatten(), dtype=np.float64)).reshape(part.num_rows, length)
                values, codes = [np.zeros(0, np.int64)], []
                for j in range(length):
                    v, c = np.unique(x[:, j], return_inverse=True)
                    values.append(v)
                    codes.append(c.astype(np.uint32))
                one = lambda a, kind: pa.array([a], pa.list_(kind))
                cols = [one(part.column(0).to_pylist(), pa.int64()), one(part.column(2).to_pylist(), pa.string()), one(np.concatenate(values), pa.int64()), one([len(v) for v in values[1:]], pa.int32()), pa.array([b"".join(c.tobytes() for c in codes)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCKS.split(", ")])
        K.release()

    return vectors.select("vec_id", "v", "label").mapInArrow(run, BLOCKS)


class Block:
    """A stored block: for each dimension its distinct integers and the code of each row."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids, self.labels = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        sizes = np.cumsum([0, *batch.column(3)[i].as_py()])
        values = np.asarray(batch.column(2)[i].values, dtype=np.int64)
        self.values = [values[a:b] for a, b in zip(sizes[:-1], sizes[1:])]
        self.codes = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint32).reshape(len(self.values), len(self.ids))

    def nearest(self, entries: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row's part that begins at dimension first; entries: codebook x dimensions."""
        n, width = len(self.ids), entries.shape[1]
        reach = [int(np.abs(v[[0, -1]][:, None] - entries[None, :, j]).max()) ** 2 for j, v in enumerate(self.values[first : first + width])]
        kind = np.int32 if sum(reach) < 1 << 31 else np.int64
        total, step = np.zeros((n, len(entries)), kind), np.empty((n, len(entries)), kind)
        for j in range(width):
            squares = ((self.values[first + j][:, None] - entries[None, :, j]) ** 2).astype(kind)
            np.take(squares, self.codes[first + j], axis=0, out=step, mode="clip")
            total += step
        best = total.argmin(axis=1)
        return best, total[np.arange(n), best].astype(np.int64)


def stored(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)
    K.release()


def sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, pos, n, s): how many parts are nearest to each entry and the sums of their components."""
    bounds = part_bounds(sum(b.shape[1] for b in books))

    def run(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for block in stored(batches):
            for p, (a, b) in enumerate(bounds):
                best, _ = block.nearest(books[p], a)
                count[p] += np.bincount(best, minlength=len(count[p]))
                for j in range(a, b):
                    total[p][:, j - a] += np.bincount(best, block.values[j][block.codes[j]], len(count[p])).astype(np.int64)
        for p in range(len(books)):
            used = np.flatnonzero(count[p])
            width = books[p].shape[1]
            entry, pos = np.repeat(used, width), np.tile(np.arange(width), len(used))
            cols = [np.full(len(entry), p), entry, pos, count[p][entry], total[p][entry, pos]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["part", "entry", "pos", "n", "s"])

    return blocks.mapInArrow(run, "part long, entry long, pos long, n long, s long").groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def assigned(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) by the given codebooks."""
    bounds = part_bounds(sum(b.shape[1] for b in books))

    def run(batches):
        for block in stored(batches):
            found = [block.nearest(books[p], a) for p, (a, _) in enumerate(bounds)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            cols = [pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.string()), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(f[1] for f in found))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def trained(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after ROUNDS rounds of assigning all parts and averaging."""
    for _ in range(ROUNDS):
        new = [b.copy() for b in books]
        got = sums(blocks, books).toArrow()
        part, entry, pos, n, s = (np.asarray(got.column(c)) for c in got.column_names)
        for p, b in enumerate(new):
            own = part == p
            b[entry[own], pos[own]] = s[own] // n[own]
        books = new
    return books


def vector_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the usable rows of rows(vec_id, embedding, label)."""
    vectors = kept_vectors(rows)
    order = (F.col("vec_id").asc_nulls_last(), "v")
    first = vectors.orderBy(*order).limit(1).collect()
    length = len(first[0].v) if first else 0
    vectors = vectors.where(F.size("v") == length)
    head = vectors.orderBy(*order).limit(ENTRIES).select("v").collect()
    start = np.array([r.v for r in head], dtype=np.float64).reshape(len(head), length)
    books = [integers(start)[:, a:b] for a, b in part_bounds(length)]
    blocks = saved(packed(vectors, length), "blocks", rows=BLOCK)
    books = trained(blocks, books)
    final = saved(assigned(blocks, books), "codes")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    by_label = final.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return final.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after another; |x - y|^2 is x.x - 2 x.y + y.y, exact in doubles at these sizes."""
    nearest = "SELECT part.p, rn, any_value(x) AS x, min({{'d': list_inner_product(y, y) - 2 * list_inner_product(x, y), 'e': e}}) AS m FROM part JOIN b{0} AS b ON b.p = part.p GROUP BY part.p, rn"
    steps = [f"""k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  part AS MATERIALIZED (SELECT rn, p, v[len(v) // {PARTS} * p + 1 : len(v) // {PARTS} * (p + 1)] AS x FROM k, range({PARTS}) AS t(p)),
  b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS y FROM part WHERE rn <= {ENTRIES})"""]  # fmt: skip
    for i in range(ROUNDS):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(i)}),
  n{i} AS (SELECT p, e, list(c ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS c FROM (SELECT p, m.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e),
  b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.y, b.y) AS y FROM b{i} AS b LEFT JOIN n{i} AS n ON n.p = b.p AND n.e = b.e)""")
    return f"""
WITH {", ".join(steps)},
  f AS MATERIALIZED ({nearest.format(ROUNDS)}),
  c AS (SELECT k.vec_id, any_value(k.label) AS label, k.rn, string_agg(printf('%02x', CAST(m.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m.d + list_inner_product(x, x)) AS BIGINT) AS error FROM f JOIN k ON k.rn = f.rn GROUP BY k.vec_id, k.rn),
  s AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS digest FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM c, s
"""


OP13_SQL = _sql()
