"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

A rolling hash over the last WINDOW words ends a chunk where its low bits are zero, so texts
that share a passage share its chunks whatever stands before. Chunks are counted by
fingerprint; those of several texts are encoded once, into a table, and each text
meets the ids of its shared chunks in a join. What lies between is encoded where it stands. Which
chunks are worth a row is first asked of a bitmap of fixed size: a bit that is set by chance
costs a needless row, and nothing else.

Joins are repaired: where no white space stands at a reused chunk's edge, the word across the
edge is encoded anew, and its ids take the place of those of its two halves; if the word goes on over
further chunks, that is done at each of their edges, until what was put together is what the whole word gives.
This is for vocabularies whose tokens never cover white space.

Edge cases: null or empty texts have no ids and an empty decoded text; equal rows are encoded
alike, and may share a doc_id or have none; an empty table gives an empty result; other columns are ignored; very long
texts and words without white space are cut into chunks of CHUNK_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.pieces import encoder
from helixlake.llm.shared import dropped, id_text, saved, table

#: Words under the rolling hash; one place in MASK + 1 ends a chunk; longest chunk.
WINDOW, MASK, CHUNK_BYTES = 4, 31, 8192
#: White space in ASCII.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_BYTES = tuple(SPACES[i : i + 1] for i in range(len(SPACES)))
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Pieces that a worker remembers.
MEMO = 400_000
#: Bits of the index into the bitmap of chunks that occur in several texts.
MAP_BITS = 26


def chunk_bounds(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each chunk; chunks cover each text without gaps."""
    w = t.words(K.SPACE, K.EXACT)
    at, h = w.grams(WINDOW)
    ends = at[(h & K.U64(MASK)) == 0] + WINDOW  # the next word begins a chunk
    ends = ends[ends < len(w.h)]
    ends = ends[w.doc[ends] == w.doc[ends - 1]]
    full = np.flatnonzero(t.bounds[1:] > t.bounds[:-1])
    starts = np.unique(np.concatenate([w.start[ends], t.bounds[:-1][full]]))
    stops = np.concatenate([starts[1:], t.bounds[-1:]]) if len(starts) else starts
    long = np.flatnonzero(stops - starts > CHUNK_BYTES)
    if len(long):
        extra = [_inner_cuts(t.data, int(starts[i]), int(stops[i])) for i in long]
        starts = np.unique(np.concatenate([starts, *extra]))
        stops = np.concatenate([starts[1:], t.bounds[-1:]])
    return starts, stops, np.searchsorted(t.bounds, starts, side="right") - 1


def _inner_cuts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Cuts each CHUNK_BYTES, at the next beginning of a character."""
    cuts, at = [], lo + CHUNK_BYTES
    while at < hi:
        while at < hi and (data[at] & 0xC0) == 0x80:
            at += 1
        if at < hi:
            cuts.append(at)
        at += CHUNK_BYTES
    return np.array(cuts, dtype=np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k): k is what a text meets its chunks by, its id or a hash of it. Chunks go by their content, so texts may share one."""
    return id_text(docs).withColumn("k", F.coalesce("doc_id", F.xxhash64("text"), F.lit(0)))


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """(k, h): the distinct chunks of each text."""

    def run(batches):
        for t in K.slices(batches):
            lo, hi, doc = chunk_bounds(t)
            h = K.spans_hash(t.data, lo, hi, K.EXACT)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([t.ids("k").take(pa.array(doc[new])), pa.array(K.signed(h[new]))], ["k", "h"])

    return docs.select("k", "text").mapInArrow(run, "k long, h long")


def bitmap(counts: DataFrame) -> np.ndarray:
    """Bits of the chunks in counts(h), as 2^MAP_BITS bits in 64-bit words; as many rows come to the driver at most."""
    at = F.shiftrightunsigned("h", 64 - MAP_BITS)
    words = counts.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - MAP_BITS}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(K.U64)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> K.U64(64 - MAP_BITS)
    return (bits[(at >> K.U64(6)).astype(np.int64)] >> (at & K.U64(63))) & K.U64(1) == 1


def encoded_chunks(docs: DataFrame, shared: DataFrame, vocabulary: str, memo: int = MEMO) -> DataFrame:
    """(h, ids) of the chunks in shared(h), each encoded once, on its own."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(shared))

    def find(batches):
        for t in K.slices(batches):
            lo, hi, _ = chunk_bounds(t)
            h = K.spans_hash(t.data, lo, hi, K.EXACT)
            first = np.sort(np.unique(h, return_index=True)[1])
            at = first[marked(bits.value, h[first])]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(h[at])), pa.array([t.data[lo[i] : hi[i]].tobytes() for i in at.tolist()], pa.binary())], ["h", "chunk"])

    def encode(batches):
        enc = encoder(vocabulary, False, memo)
        kind = stored_kind(enc)
        for batch in K.row_slices(batches, 2000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in enc.encode(batch.column(1).to_pylist())], pa.binary())], ["h", "ids"])

    once = docs.select("text").mapInArrow(find, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))
    return once.mapInArrow(encode, "h long, ids binary")


def stored_kind(enc) -> str:
    """Numbers that the table of chunks holds ids in."""
    return "<u2" if len(enc.tokens) <= 1 << 16 else "<u4"


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, k) with z, the text under zstandard, in place of text: what moves through a shuffle is half as large."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in K.row_slices(batches):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())], ["doc_id", "k", "z"])

    return docs.select("doc_id", "text", "k").mapInArrow(run, "doc_id long, k long, z binary")


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, reused) of rows (doc_id, z, reused), few at a time."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in K.row_slices(batches):
        texts = pa.array([None if z is None else press.decompress(z) for z in batch.column(1).to_pylist()], pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], ["doc_id", "text", "reused"])


def joined(text: bytes, parts: list[tuple[int, int, bytes]], encode) -> bytes:
    """ids of text from those of its parts (start, end, ids), each encoded alone; encode gives a text's ids."""
    out = b""
    for lo, hi, ids in parts:
        if lo and text[lo - 1] not in SPACES and text[lo] not in SPACES:
            # the word across the edge: what its halves gave goes, and what it gives itself comes
            tail = text[max(map(text.rfind, SPACE_BYTES, repeat(0), repeat(lo))) + 1 : lo]
            at = min((x for x in (text.find(c, lo, hi) for c in SPACE_BYTES) if x >= 0), default=hi)
            head = text[lo:at]
            out = out[: len(out) - len(encode(tail))] + encode(tail + head) + ids[len(encode(head)) :]
        else:
            out += ids
    return out


def encode_chunked(docs: DataFrame, vocabulary: str, decode: bool = False, memo: int = MEMO) -> DataFrame:
    """doc_id and ids (binary, unsigned 32-bit) of every row of docs(doc_id, text); with decode, also the text that the ids decode to. memo: pieces that a worker remembers, also between stages."""
    full = keyed(docs)
    hashes = saved(chunk_hashes(full), "chunks")
    shared = saved(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    once = saved(encoded_chunks(full, shared, vocabulary, memo), "encoded")
    own = hashes.join(once, "h").groupBy("k").agg(F.collect_list(F.struct("h", "ids")).alias("reused"))
    own = saved(own, "reused")
    dropped(hashes, shared, once)

    def run(batches):
        enc = encoder(vocabulary, False, memo)
        kind = stored_kind(enc)
        one = lambda text: enc.encode([text])[0]
        for t in K.slices(unpacked(batches), limit=SLICE):
            lo, hi, doc = chunk_bounds(t)
            h = K.signed(K.spans_hash(t.data, lo, hi, K.EXACT)).tolist()
            first = np.searchsorted(doc, np.arange(t.n + 1)).tolist()
            starts, lo, hi = t.bounds[:-1].tolist(), lo.tolist(), hi.tolist()
            plans, stretches = [], []
            for i, reused in enumerate(t.ids("reused").to_pylist()):
                known, plan, run_from = {x["h"]: np.frombuffer(x["ids"], kind).astype("<u4").tobytes() for x in reused or ()}, [], None
                for c in range(first[i], first[i + 1]):
                    ids = known.get(h[c])
                    if ids is None:
                        run_from = lo[c] if run_from is None else run_from
                        continue
                    if run_from is not None:
                        plan.append((run_from - starts[i], lo[c] - starts[i], len(stretches)))
                        stretches.append(t.data[run_from : lo[c]].tobytes())
                        run_from = None
                    plan.append((lo[c] - starts[i], hi[c] - starts[i], ids))
                if run_from is not None:
                    end = hi[first[i + 1] - 1]
                    plan.append((run_from - starts[i], end - starts[i], len(stretches)))
                    stretches.append(t.data[run_from:end].tobytes())
                plans.append(plan)
            done = enc.encode(stretches)
            ids = []
            for i, plan in enumerate(plans):
                parts = [(a, b, done[x] if isinstance(x, int) else x) for a, b, x in plan]
                ids.append(parts[0][2] if len(parts) == 1 else joined(t.bytes_of(i), parts, one))
            out = {"doc_id": t.ids(), "ids": pa.array(ids, pa.binary())}
            if decode:
                out["decoded"] = pa.array([enc.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    met = packed_texts(full).join(own, "k", "left").select("doc_id", "z", "reused")
    return met.mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decode)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded(doc_id, ids) with its decoded text."""

    def run(batches):
        enc = encoder(vocabulary, False)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for at in range(0, max(len(ids), 1), 500):
                part = [enc.decode(x) for x in ids[at : at + 500]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(part, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    vocabulary = vocabulary or word_vocabulary()
    both = encode_chunked(table(spark, sf_dir, "documents"), vocabulary, decode=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
