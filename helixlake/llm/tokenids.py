"""Token-id files (operator 7).

A file is a run of independent zstandard frames, each with a content checksum, then a
skippable frame with the document index and, last, a skippable frame with the seek table in
the published seekable layout: compressed size, size and checksum of each frame, a footer with
the number of frames. A reader takes the table from the end of the file and decompresses only the
frames of the documents asked for. Ids are little-endian unsigned 32-bit integers.

Rows are dealt by ranges of doc_id, so files are in ascending order and each task writes one.
A file gets its name when it is complete, and only files that successful tasks report are
read, so repeated attempts of a task do no harm.

Edge cases: a null or empty text has the end id alone; equal doc_ids keep their own entries, in
the order of their texts, and null ones come first; an empty table writes no file and reads back no rows; other columns
are ignored; a text longer than a frame has a frame of its own.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.pieces import encoder
from helixlake.llm.shared import id_text, new_path, saved, table

FRAME_BYTES, END_ID, LEVEL = 1 << 20, 0, 3
#: Pieces that a writing worker remembers.
MEMO = 800_000
#: Fixed values of the published frame formats: skippable frames and the footer of a seek table.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Stands for a null doc_id in a file's index; such rows come first.
NO_ID = -(1 << 63)


def open_store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    scheme = path.split(":", 1)[0] if ":" in path else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes one file; add() takes the documents in order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.parts, self.held = [], 0
        self.frames, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes, end: bytes = b"") -> None:
        size = len(ids) + len(end)
        self.parts += (ids, end)
        self.held += size
        self.docs.append((NO_ID if doc_id is None else doc_id, len(self.frames), size // 4))
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.parts:
            raw = b"".join(self.parts)
            small = self.press.compress(raw)
            self.out.write(small)
            self.frames.append((len(small), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.parts, self.held = [], 0

    def close(self) -> int:
        """Ends the file; the number of ids in it."""
        self.flush()
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 3)
        index = self.press.compress(docs.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        rows = b"".join(struct.pack("<III", *f) for f in self.frames)
        rows += struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(rows)) + rows)
        return int(docs[:, 2].sum())


class FrameReader:
    """Reads one file by its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", self._at(source.size() - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = source.size() - 9 - 12 * n
        self.frames = np.frombuffer(self._at(begin, 12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        magic, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        self.docs = np.frombuffer(self.unpress.decompress(self._at(int(self.starts[-1]) + 8, size)), dtype="<i8").reshape(-1, 3)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.unpress.decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} has another checksum than the seek table says")
        return raw

    def read(self, wanted: set[int] | None = None):
        """(row in the file, doc_id, ids) of the documents wanted, or of all; only their frames are decompressed."""
        rows = np.arange(len(self.docs)) if wanted is None else np.flatnonzero(np.isin(self.docs[:, 0], list(wanted)))
        last, raw, offsets = -1, b"", None
        ends = np.cumsum(self.docs[:, 2])
        firsts = np.searchsorted(self.docs[:, 1], np.arange(len(self.frames)))
        for i in rows.tolist():
            k = int(self.docs[i, 1])
            if k != last:
                last, raw = k, self.frame(k)
                offsets = int(ends[firsts[k]] - self.docs[firsts[k], 2])
            at = 4 * (int(ends[i] - self.docs[i, 2]) - offsets)
            doc = int(self.docs[i, 0])
            yield i, None if doc == NO_ID else doc, raw[at : at + 4 * int(self.docs[i, 2])]


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files under folder; (path, first_doc, n_docs, n_tokens) of each."""
    end = struct.pack("<I", end_id)

    def run(batches):
        enc, writer = encoder(vocabulary, True, MEMO), None
        for t in K.slices(batches):
            if writer is None:
                store, base = open_store(folder)
                store.create_dir(base, recursive=True)
                name = uuid.uuid4().hex
                out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                writer = FrameWriter(out)
            for i, ids in zip(t.ids().to_pylist(), enc.encode([t.bytes_of(i) for i in range(t.n)])):
                writer.add(i, ids, end)
        if writer is not None:
            n = writer.close()
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}.zst")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}.zst", "first_doc": writer.docs[0][0], "n_docs": len(writer.docs), "n_tokens": n}], schema=pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    dealt = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(dealt.mapInArrow(run, "path string, first_doc long, n_docs long, n_tokens long"), "manifest")


def read_ids(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) from the files of a manifest.

    The manifest has one row for each file, so the start of each file is added up on the driver.
    """
    spark = manifest.sparkSession
    at, files = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.first_doc):
        files.append((r.path, at))
        at += r.n_tokens

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source)
                    before = np.cumsum(reader.docs[:, 2]) - reader.docs[:, 2]
                    rows, held = [], 0
                    for i, doc, ids in reader.read(wanted):
                        rows.append((doc, base + int(before[i]), len(ids) // 4, ids))
                        held += len(ids)
                        if held > K.SLICE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_ids(table(spark, sf_dir, "documents"), vocabulary, new_path(spark, "ids"))
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
