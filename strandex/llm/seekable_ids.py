"""Token-ID files: one independent zstandard frame per document, a trailing seek table, a checksum for each frame.

Layout of a file: a frame for each document (its ids as little-endian unsigned 32-bit integers), one more frame with the
document index (n int64 doc_ids, then n bytes that are 1 where the id is null), and the public seekable-format table
in a skippable frame: for each frame its compressed size, its size and the low 32 bits of its content's xxh64,
then the number of frames, a descriptor byte and the closing magic number. Ordinary zstandard tools can decompress a file.
A reader fetches the table and the index and then only the frames of the documents that it is asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_tokens import encoder
from .common import batches, shared_path, stored

# Fixed values of the public format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class FrameWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.table, self.ids = out, [], []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self._frame(ids)

    def finish(self) -> None:
        self._frame(np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class FrameReader:
    """Random access to the documents of a file; source: a seekable binary file object."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        if size < 17:
            raise ValueError("not a seekable file: too short")
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file: no seek table with checksums")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        index, n = self._content(frames - 1), frames - 1
        self.doc_ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(index[: 8 * n], "<i8"), index[8 * n :])]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _checked(self, packed: bytes, k: int) -> bytes:
        import xxhash

        data = self.decompressor.decompress(packed, max_output_size=max(1, int(self.table[k, 1])))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def _content(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        return self._checked(self.source.read(int(self.table[k, 0])), k)

    def read(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; no other frame is read."""
        return np.frombuffer(self._content(k), "<u4")

    def scan(self, block: int = 4 << 20):
        """(doc_id, ids as bytes) of all documents, read in blocks of whole frames."""
        k = 0
        while k < len(self):
            end = max(k + 1, min(len(self), int(np.searchsorted(self.starts, self.starts[k] + block, "right")) - 1))
            self.source.seek(int(self.starts[k]))
            held = memoryview(self.source.read(int(self.starts[end] - self.starts[k])))
            for i in range(k, end):
                a = int(self.starts[i] - self.starts[k])
                yield self.doc_ids[i], self._checked(held[a : a + int(self.table[i, 0])], i)
            k = end


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


MANIFEST = "part int, path string, n_docs long, n_ids long, first_id long, last_id long, n_null long"
FEW = 10_000  # so many requested ids are compared with each file's range
TASK_IDS = 16 << 20  # about so many ids, 64 MiB, are read by one task


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, directory: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them in ascending doc_id order, one file for each range of ids.

    Returns the manifest, a row per file, written to the same directory (manifest); `part` ascends with doc_id, first_id and last_id are the smallest and largest id of a file. A file's
    name is unique to the task attempt, and the manifest names only those of attempts that Spark counted, so lost executors
    leave at most unreferenced files. The manifest's rows are dealt by `part`, so a part that is written anew replaces its own row only, and they lie in as few files as their size
    needs: on a file system without Hadoop's native library an executor starts several processes for each file that Spark writes. Null texts count as empty, null ids come first, rows that repeat an id are kept, ordered by text.
    Other columns of docs are ignored, whatever their names; an empty table gives an empty manifest and no files.
    """
    spark = docs.sparkSession
    directory = directory or shared_path(spark, "ids")

    def write(it):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        writer, stream, n_ids = None, None, 0
        part = TaskContext.get().partitionId()
        system, root = _open(directory)
        path = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        for rows in batches(it, ["doc_id", "text"]):
            if writer is None:
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(f"{root}/{path}", compression=None)
                writer = FrameWriter(stream)
            for (doc_id, _), ids in zip(rows, enc.encode([r[1] for r in rows])):
                writer.add(doc_id, ids + end)
                n_ids += len(ids) // 4 + 1
        if writer is not None:
            writer.finish()
            stream.close()
            known = [i for i in writer.ids if i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{directory}/{path}"]), pa.array([len(writer.ids)], pa.int64()), pa.array([n_ids], pa.int64()), *(pa.array([x], pa.int64()) for x in (min(known, default=None), max(known, default=None), len(writer.ids) - len(known)))], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST).repartition("part").write.parquet(f"{directory}/manifest")
    return open_ids(spark, directory)


def open_ids(spark: SparkSession, directory: str) -> DataFrame:
    """The manifest of files that write_ids() wrote, in this or any later session."""
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names; null and repeated ids as they were written. An empty manifest gives an empty
    result."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tasks = -(-(manifest.agg(F.sum("n_ids")).first()[0] or 0) // TASK_IDS) or 1
    files = based.repartition(tasks, "part")  # a number, as a few small manifest rows stand for large files

    def read(it):
        for rows in batches(it, ["path", "base"]):
            for uri, at in rows:
                system, path = _open(uri)
                with system.open_input_file(path) as source:
                    found = []
                    for doc_id, data in FrameReader(source, source.size()).scan():
                        found.append((doc_id, at, len(data) // 4, zlib.crc32(data)))
                        at += len(data) // 4
                        if len(found) >= 10_000:
                            yield _documents(found)
                            found = []
                    if found:
                        yield _documents(found)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids (array) of the requested documents only; doc_ids: a DataFrame with a column doc_id.

    Only files whose range of ids may hold a requested one are opened, by the manifest; the index in a file gives the frames, and only the matching ones are
    decompressed. Unknown ids give no row, repeated ones in doc_ids count once, an id that was written several times gives a row for each; null asks for nothing. An empty manifest or no
    requests give an empty result.
    """
    wanted = doc_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = [r.doc_id for r in wanted.limit(FEW + 1).collect()]
    if len(some) <= FEW:
        held = F.exists(F.lit(sorted(some)).cast("array<bigint>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    else:
        ends = wanted.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        held = (F.col("first_id") <= ends.high) & (F.col("last_id") >= ends.low)
    manifest = stored(manifest.where(held), "ids-asked")
    index = manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(_index_of, "path string, k long, doc_id long")
    hits = index.join(wanted, "doc_id").select("path", "k").repartition(F.col("path")).sortWithinPartitions("path", "k")
    return hits.mapInArrow(_frames_of, "doc_id long, ids array<long>")


def _index_of(it):
    for rows in batches(it, ["path"]):
        for (uri,) in rows:
            system, path = _open(uri)
            with system.open_input_file(path) as source:
                ids = FrameReader(source, source.size()).doc_ids
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())], ["path", "k", "doc_id"])


def _frames_of(it):
    reader, at, source = None, None, None
    for rows in batches(it, ["path", "k"]):
        ids, frames = [], []
        for uri, k in rows:
            if uri != at:
                if source is not None:
                    source.close()
                system, path = _open(uri)
                source, at = system.open_input_file(path), uri
                reader = FrameReader(source, source.size())
            ids.append(reader.doc_ids[k])
            frames.append(reader.read(k).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(frames, pa.list_(pa.int64()))], ["doc_id", "ids"])
    if source is not None:
        source.close()
