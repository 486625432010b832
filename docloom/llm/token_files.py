"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is the published seekable zstandard format, so any zstandard reader can read it whole:

* one frame for each document (its ids, little-endian, 2 or 4 bytes each), in ascending doc_id order;
* one frame with the int64 doc_ids of the file;
* a skippable frame that holds the seek table: compressed size, plain size and checksum (low half of XXH64) of each
  frame, then the number of frames, a descriptor byte and a magic number.

A reader takes the footer, the table and the doc_id frame, and then decompresses only the documents it is asked for;
every frame is checked against its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import spans
from docloom.llm.encoding import encoder
from docloom.llm.shared import shared_folder, written

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
FOOTER = "<IBI"
FOOTER_BYTES = struct.calcsize(FOOTER)

MANIFEST = "file string, width int, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"
ROWS = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"
IDS = "doc_id long, ids array<int>"


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    def __init__(self, out: BinaryIO, width: int, level: int):
        self.out, self.dtype = out, np.dtype(f"<u{width}")
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.n_tokens = 0
        self.n_bytes = 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))
        self.n_bytes += len(packed)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self._frame(ids.astype(self.dtype).tobytes())
        self.doc_ids.append(doc_id)
        self.n_tokens += len(ids)

    def close(self) -> None:
        self._frame(np.array(self.doc_ids, "<i8").tobytes())
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.n_bytes += 8 + len(table)


class FrameReader:
    """Random access to the documents of one file. ``source`` can seek; ``size`` is its length."""

    def __init__(self, source: BinaryIO, size: int, width: int):
        self.source, self.dtype = source, np.dtype(f"<u{width}")
        self.unpacker = zstandard.ZstdDecompressor()
        source.seek(size - FOOTER_BYTES)
        n, flags, magic = struct.unpack(FOOTER, source.read(FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - FOOTER_BYTES - n * ENTRY.itemsize)
        self.entries = np.frombuffer(source.read(n * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        self.doc_ids = np.frombuffer(self._frame(n - 1), "<i8")

    def _frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        data = self.unpacker.decompress(self.source.read(int(self.entries["packed"][k])))
        if len(data) != self.entries["plain"][k] or _checksum(data) != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self._frame(k), self.dtype).astype("<u4")

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Every frame of the wanted documents, a repeated doc_id as often as it was written."""
        for d in doc_ids:
            for k in range(*np.searchsorted(self.doc_ids, [d, d + 1]).tolist()):
                yield d, self.ids(k)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, width: int = 2, level: int = 3) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file for each range of doc_ids; returns the manifest, a row for each file.

    A null or empty text gives the end id alone. Rows that share a doc_id stand one after the other, by text; many
    of them may fill several files. Rows with a null doc_id have no place in the order and are left out. Other columns are not read. No documents: no files.
    A file is named by its task attempt and counts only once the manifest, written by Spark's own commit, names it; so
    attempts that died leave nothing that is read.
    """
    if width not in (2, 4):
        raise ValueError("width is 2 or 4 bytes")
    keyed = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    ordered = keyed.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
        out = writer = None
        for batch in batches:
            for part in spans.slices(batch, "text", 2 * spans.SLICE_BYTES):
                if writer is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = FrameWriter(out, width, level)
                ids, bounds = encoder(tokenizer).encode(part.column("text"))
                for d, a, b in zip(part.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                    writer.add(d, np.append(ids[a:b], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            row = (name, width, writer.doc_ids[0], writer.doc_ids[-1], len(writer.doc_ids), writer.n_tokens, writer.n_bytes)
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], pa.schema(list(zip(names, [pa.string(), pa.int32(), *[pa.int64()] * 5], strict=True))))

    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_rows(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every file back: per document its place in the whole sequence, its number of ids and their checksum."""
    by_id = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not document
    offsets = manifest.select("file", F.coalesce(F.sum("n_tokens").over(by_id), F.lit(0)).alias("before"))
    n_files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    reader = FrameReader(f, row["n_bytes"], row["width"])
                    sizes, sums = [], []
                    for k in range(len(reader.doc_ids)):
                        ids = reader.ids(k)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.tobytes()))
                    size = np.array(sizes, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(size)), pa.array(reader.doc_ids), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(sums, pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.select("file", "width", "n_bytes").repartition(n_files, "file").mapInArrow(read, ROWS)
    return rows.join(offsets, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Ids of the ``wanted`` documents (doc_id): only files whose range holds one are opened, only their frames decompressed."""
    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    per_file = manifest.join(keys, F.col("doc_id").between(F.col("first_id"), F.col("last_id")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        held, reader, source = None, None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] != held:
                    if source is not None:
                        source.close()
                    source, held = store.open_input_file(f"{base}/{row['file']}"), row["file"]
                    reader = FrameReader(source, row["n_bytes"], row["width"])
                found += [{"doc_id": d, "ids": ids.astype(np.int32)} for d, ids in reader.find([row["doc_id"]])]
            if found:
                yield pa.RecordBatch.from_pylist(found, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return per_file.select("file", "width", "n_bytes", "doc_id").repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(read, IDS)


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, read all files back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_folder(spark, "token-files")
    return read_token_rows(write_token_files(docs, tokenizer, folder), folder)
