"""Vectorised word scanning of Arrow text batches (NumPy, inside Spark tasks).

Words become 64-bit fingerprints: each byte is mapped to a pseudo-random number, and the
word is the sum of these, each times an independent pseudo-random number of its place in the word,
modulo 2^64, then mixed (multilinear hashing). Numbers of two bytes differ in their low 8 bits,
so two different words of a length collide with a probability of 2^-57 at most, whatever
they look like. Slices keep the memory of a task bounded whatever the
number of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18
#: The odd multipliers of the public splitmix64 finaliser and its increment.
MUL1, MUL2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
BASE = U64(0x5851F42D4C957F2D)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MUL1
        x = (x ^ (x >> U64(27))) * MUL2
        return x ^ (x >> U64(31))


def _byte_numbers(lower: bool) -> np.ndarray:
    byte = np.arange(256, dtype=U64)
    with np.errstate(over="ignore"):
        t = (mix64((byte + U64(1)) * GOLDEN) & ~U64(255)) | byte
    if lower:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


#: By byte, case folded for A-Z only, and case kept.
FOLDED, EXACT = _byte_numbers(True), _byte_numbers(False)
#: True for bytes between words: ASCII white space, or everything in ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[ord("0") : ord("9") + 1] = NOT_ALNUM[ord("a") : ord("z") + 1] = NOT_ALNUM[ord("A") : ord("Z") + 1] = False


@lru_cache(maxsize=4)
def _place_numbers(bits: int) -> np.ndarray:
    """Pseudo-random numbers of the first 2^bits places."""
    with np.errstate(over="ignore"):
        return mix64(mix64((np.arange(1 << bits, dtype=U64) + U64(1)) * BASE) + GOLDEN)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans [start, end), which ascend, don't overlap and aren't empty."""
    out = np.empty(len(start), dtype=U64)
    if not len(start):
        return out
    size = end - start
    places = _place_numbers(max(16, int(size.max()).bit_length()))
    upto = np.cumsum(size)
    at, last = 0, len(start)
    with np.errstate(over="ignore"):
        while at < last:
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + BLOCK_BYTES, side="right")))
            n, heads = size[at:to], upto[at:to] - size[at:to] - before
            within = np.arange(int(upto[to - 1]) - before)
            byte = data.take(within + np.repeat(start[at:to] - heads, n))
            within -= np.repeat(heads, n)
            out[at:to] = np.add.reduceat(numbers.take(byte) * places.take(within), heads) + n.astype(U64) * GOLDEN
            at = to
    return mix64(out)


def word_spans(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-separators; texts are data[bounds[i]:bounds[i+1]]."""
    word = ~sep[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = bounds[1:] > bounds[:-1]
    at = bounds[:-1][full]
    first[at] |= word[at]
    at = bounds[1:][full] - 1
    last[at] |= word[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Texts:
    """A slice of rows: ids, the UTF-8 bytes of their texts (null: empty) and where each begins."""

    def __init__(self, rows: pa.RecordBatch, text: str = "text"):
        self.rows = rows
        col = rows.column(rows.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = col.buffers()
        b = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.bounds = raw[b[0] : b[-1]], b - b[0]
        self.n = len(col)

    def ids(self, name: str = "doc_id") -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, sep: np.ndarray = SPACE, numbers: np.ndarray = FOLDED) -> "Words":
        start, end = word_spans(self.data, self.bounds, sep)
        return Words(self, start, end, spans_hash(self.data, start, end, numbers))


class Words:
    """Tokens of a slice: fingerprint h, text number doc, first[i]:first[i+1] are those of text i."""

    def __init__(self, texts: Texts, start: np.ndarray, end: np.ndarray, h: np.ndarray):
        self.start, self.end, self.h = start, end, h
        self.first = np.searchsorted(start, texts.bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and fingerprint, of each run of k words within a text."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, gram_hash(self.h, at, k)


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * BASE + h[at + j]
        return mix64(out + U64(k) * GOLDEN)


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker doesn't keep one stage's peak through the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows in slices of at most about limit bytes of text, of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        b = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(b, b[at] + limit, side="right")) - 1)
            yield Texts(batch.slice(at, to - at), text)
            at = to
    release()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive runs."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
