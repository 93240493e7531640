"""Token ids in binary shard files: one zstandard dictionary, a frame per document, an offset index.

File format (all integers little-endian). Header: 8 bytes ``IDZSTD01``, 32 bytes SHA-256
of the dictionary, 1 byte width of an id (2 or 4). Then one zstandard frame per document,
compressed with the dictionary on its own. Then the index, one entry per document in file
order: doc_id int64, start uint64 (ids of all documents before it in this file), frame
offset uint64, frame length uint32, ids uint32, flags uint32 (bit 0: null doc_id). Last a footer: entries uint64, offset of the
index uint64, 8 bytes ``IDZSTDIX``. The dictionary is a file beside the shards, named by
its hash. Any document is read by its index entry and one frame.

The dictionary is trained on the serialised ids of a bounded sample: the ``SAMPLE``
documents with the least hashes of their ids. Everything else covers all documents.

Files are written by the tasks that hold their range of doc_id, under a name of the
attempt, and the names that the job returns are the files that count; a task that runs
again after a lost executor writes another file. They lie in the shared folder.

Defined results. A null or empty text has the end id only. Null ids come first. Rows that
repeat an id are written each, ordered by text. An empty table gives no files and no
rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from scriptorium.llm.lean import lean
from scriptorium.llm.tokens import encoder
from scriptorium.plans.workspace import Workspace

END_ID = 1
#: Documents that train the dictionary; bytes of a dictionary; ids that a sample document gives at most; documents in a file, about; files, about, beyond which they have more documents.
SAMPLE, DICTIONARY, SHARE, SHARD, FILES = 1024, 65536, 16384, 8192, 50_000
LEVEL = 3

MAGIC, TAIL = b"IDZSTD01", b"IDZSTDIX"
ENTRY, FOOTER = struct.Struct("<qQQIII"), struct.Struct("<QQ8s")


def serialised(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids as ids of ``width`` bytes; ValueError for one that has no room."""
    if width == 4:
        return ids
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() >= 65536:
        raise ValueError(f"the id {wide.max()} does not fit into two bytes: use width 4")
    return wide.astype("<u2").tobytes()


def widened(data: bytes, width: int) -> bytes:
    if width == 4:
        return data
    import numpy as np

    return np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary; samples that are too few or too small give an empty one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Codec:
    def __init__(self, dictionary: bytes, level: int = LEVEL):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=d, write_dict_id=False).compress  # the header names the dictionary
        self.unpack = zstandard.ZstdDecompressor(dict_data=d).decompress


def store(uri: str):
    """(filesystem, path) of a URI in any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):  # Hadoop's names for the store
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_file(uri: str, documents: Iterator[tuple[int | None, bytes]], dictionary: bytes, width: int, level: int = LEVEL) -> tuple[int, int, int]:
    """Write (doc_id, 32-bit ids) in order; gives documents, ids and bytes. Memory: one frame and the index."""
    files, path = store(uri)
    codec, index, at, total = Codec(dictionary, level), bytearray(), 0, 0
    with files.open_output_stream(path) as out:
        at += out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))
        for doc, ids in documents:
            frame = codec.pack(serialised(ids, width))
            index += ENTRY.pack(doc or 0, total, at, len(frame), len(ids) // 4, doc is None)
            at += out.write(frame)
            total += len(ids) // 4
        n = len(index) // ENTRY.size
        out.write(bytes(index))
        out.write(FOOTER.pack(n, at, TAIL))
    return n, total, at + len(index) + FOOTER.size


class Reader:
    """A shard file. Iterating gives (doc_id, start, 32-bit ids); ``ids(n)`` reads one frame."""

    def __init__(self, uri: str, dictionary: bytes):
        files, path = store(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, at, tail = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        head = self.file.read_at(41, 0)
        if tail != TAIL or head[:8] != MAGIC:
            raise ValueError(f"{uri} is no file of ids")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} needs another dictionary")
        self.width, self.codec = head[40], Codec(dictionary)
        self.index = list(ENTRY.iter_unpack(self.file.read_at(n * ENTRY.size, at)))

    def ids(self, n: int) -> bytes:
        _, _, at, size, _, _ = self.index[n]
        return widened(self.codec.unpack(self.file.read_at(size, at)), self.width)

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        for n, (doc, start, _, _, _, null) in enumerate(self.index):
            yield None if null else doc, start, self.ids(n)


def write(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, sample: int = SAMPLE, dictionary_size: int = DICTIONARY, shard: int = SHARD, width: int = 2, level: int = LEVEL, destination: str | None = None) -> tuple[DataFrame, bytes]:
    """Write all documents in ascending order of id. (manifest, dictionary).

    Manifest: file, part, docs, ids, bytes; parts ascend with the ids. width 2 is for
    vocabularies of at most 65,536 ids; a larger id fails. destination: a folder that all
    executors reach, for files that stay; else they go with the session.
    """
    ws = Workspace(spark, "ids")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = d.count()
    rate = F.lit(min(1.0, 2.0 * sample / max(1, n)) * 2**31).cast("long")
    near = d.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**31)) <= rate)
    end = end_id.to_bytes(4, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = encoder(vocabulary).each
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([serialised((ids + end)[: 4 * SHARE], width) for ids in each(batch.column(1).to_pylist())], pa.binary())], ["doc_id", "data"])

    picked = near.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample).mapInArrow(lean(encoded), "doc_id long, data binary")
    dictionary = train([bytes(r["data"]) for r in picked.collect()], dictionary_size)
    root = destination.rstrip("/") if destination else f"{ws.path}/files"
    files, path = store(root)
    files.create_dir(path)
    with files.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dict") as out:
        out.write(dictionary)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        each = encoder(vocabulary).each
        uri = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        rows = ((doc, ids + end) for batch in batches for doc, ids in zip(batch.column(0).to_pylist(), each(t.as_py() for t in batch.column(1))))
        first = next(rows, None)
        if first is None:
            return

        def all_rows():
            yield first
            yield from rows

        docs_, ids_, bytes_ = write_file(uri, all_rows(), dictionary, width, level)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([docs_], pa.int64()), pa.array([ids_], pa.int64()), pa.array([bytes_], pa.int64())], ["file", "part", "docs", "ids", "bytes"])

    parts = max(1, min(FILES, math.ceil(n / shard)))
    # the start of the text spreads rows that share an id, null ones too, over several files
    ranged = d.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ws.save(ranged.mapInArrow(lean(write_part), "file string, part long, docs long, ids long, bytes long"), "manifest"), dictionary


def read(spark: SparkSession, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    # one row per file: their offsets are a running sum over the files
    starts = manifest.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(LongType()).alias("before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[list] = [[], [], [], []]
                for doc, start, ids in Reader(uri, dictionary):
                    for column, x in zip(out, (doc, before + start, len(ids) // 4, zlib.crc32(ids))):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "file").mapInArrow(lean(rows), "doc_id long, start long, n_tokens long, ids_crc32 long")
