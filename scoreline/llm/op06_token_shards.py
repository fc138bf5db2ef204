"""Token-id shards: independent zstandard frames, a trailing seek table, checksums.

File format (all integers little-endian):

* frames: each an independent zstandard frame of 16-bit or 32-bit token ids of some
  whole documents, in ascending order of doc_id;
* a skippable frame (magic 0x184D2A5E) that holds the seek table: for each document
  its id (int64, -2**63 for null) and number of ids (uint32); for each frame its
  compressed size, decompressed size, number of documents and the crc32 of its
  decompressed bytes (4 x uint32); then numbers of documents and frames, bytes of an id
  (3 x uint32), crc32 of the table so far (uint32) and the magic 0x8F92EAB1.

A reader takes the last 20 bytes, then the table, and then only the frames that hold the
documents it wants. Any zstandard reader can decompress a shard as a stream, too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PartIds, part_ids
from .storage import saved
from .tokens import word_chunks

FRAME_BYTES = 1 << 20
_SKIPPABLE, _MAGIC = 0x184D2A5E, 0x8F92EAB1
_DOC, _FRAME = np.dtype([("doc_id", "<i8"), ("n", "<u4")]), np.dtype([("size", "<u4"), ("raw", "<u4"), ("docs", "<u4"), ("crc", "<u4")])
NULL_ID = -(2**63)


class ShardWriter:
    """Writes one shard to a binary file object; documents come in their final order."""

    def __init__(self, out, width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.docs, self.frames, self.held, self.size, self.waiting = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.held.append(data)
        self.size += len(data)
        self.waiting += 1
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), self.waiting, zlib.crc32(raw)))
            self.held, self.size, self.waiting = [], 0, 0

    def close(self) -> None:
        self._flush()
        table = np.array(self.docs, _DOC).tobytes() + np.array(self.frames, _FRAME).tobytes()
        table += struct.pack("<III", len(self.docs), len(self.frames), self.width)
        table += struct.pack("<II", zlib.crc32(table), _MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


class ShardReader:
    """Reads documents of one shard from a seekable binary file object."""

    def __init__(self, file, size: int):
        self.file = file
        n_docs, n_frames, self.width, crc, magic = struct.unpack("<IIIII", self._at(size - 20, 20))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        length = n_docs * _DOC.itemsize + n_frames * _FRAME.itemsize
        table = self._at(size - 20 - length, length + 12)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.docs = np.frombuffer(table, _DOC, n_docs)
        self.frames = np.frombuffer(table, _FRAME, n_frames, n_docs * _DOC.itemsize)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["size"], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"], dtype=np.int64)])

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(length))

    def frame(self, k: int) -> list[np.ndarray]:
        """The ids of each document of a frame, after its checksum has been verified."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], self.frames["size"][k]), max_output_size=int(self.frames["raw"][k]))
        if len(raw) != self.frames["raw"][k] or zlib.crc32(raw) != self.frames["crc"][k]:
            raise ValueError(f"frame {k} is damaged")
        ids = np.frombuffer(raw, f"<u{self.width}")
        return np.split(ids, np.cumsum(self.docs["n"][self.first[k] : self.first[k + 1]], dtype=np.int64)[:-1])

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.frames)):
            for (doc_id, _), ids in zip(self.docs[self.first[k] : self.first[k + 1]], self.frame(k), strict=True):
                yield None if doc_id == NULL_ID else int(doc_id), ids

    def read(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """Only the frames that hold these documents are read and decompressed."""
        rows = np.flatnonzero(np.isin(self.docs["doc_id"], np.array(list(doc_ids), np.int64)))
        out: dict[int, np.ndarray] = {}
        for k in np.unique(np.searchsorted(self.first, rows, "right") - 1):
            held = self.frame(int(k))
            for r in rows[(rows >= self.first[k]) & (rows < self.first[k + 1])]:
                out[int(self.docs["doc_id"][r])] = held[r - self.first[k]]
        return out


def encode_texts(column: pa.Array, parts: PartIds, end_id: int) -> list[np.ndarray]:
    """Ids of each row's whole text, with the end id appended; null and empty texts have
    it alone. The tokenizer must not join or split across white space."""
    out = []
    for lo, hi, data, _, words in word_chunks(column, 1 << 20):
        ids, first = parts.ids_of(data, words)
        ids = np.insert(ids, first[1:], end_id)
        out += np.split(ids, first[1:-1] + np.arange(1, hi - lo))
    return out


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards under ``folder`` (any place that pyarrow.fs and Spark both
    reach) and return their manifest: shard (its number), path, docs, tokens, bytes.

    Shards are ranges of doc_id, documents in ascending order within; rows with one id
    are ordered by text, null ids come first. Null texts count as empty. An
    empty table writes no shard. A task writes under a name of its own attempt and the
    manifest names the files of the attempts that Spark committed, so lost or repeated
    tasks leave unused files only. ``tokenizer`` is a file that all executors have."""
    def write(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        name, writer, out, tokens, own = f"{root}/{uuid.uuid4().hex}.tok", None, None, 0, None
        for batch in batches:
            own = own or part_ids(tokenizer)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), own, end_id), strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name)
                    wide = max(end_id, own.vocabulary) >= 1 << 16
                    writer = ShardWriter(out, 4 if wide else 2)
                tokens += len(ids)
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            out.close()
            row = (TaskContext.get().partitionId(), name, len(writer.docs), tokens, store.get_file_info(name).size)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "path", "docs", "tokens", "bytes"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard long, path string, docs long, tokens long, bytes long")
    return saved(manifest, "shards")


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read all shards of a manifest back: doc_id, start (ids of all documents before it),
    n_tokens, ids (uint32 little-endian). Only the number of tokens of each shard goes
    through the driver."""
    rows = manifest.select("shard", "tokens", "path", "bytes").orderBy("shard").collect()
    starts, total = {}, 0
    for r in rows:
        starts[r["path"]] = total
        total += r["tokens"]
    held = manifest.sparkSession.sparkContext.broadcast(starts)

    def read(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    shard, at, part, waiting = ShardReader(file, size), held.value[path], [], 0
                    for doc_id, ids in shard.all():
                        part.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        waiting += len(ids)
                        if waiting >= 1 << 20:
                            yield _batch(part)
                            part, waiting = [], 0
                    if part:
                        yield _batch(part)

    few = manifest.select("path", "bytes").repartition(max(1, len(rows)))
    return few.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(part: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
