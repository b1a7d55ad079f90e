"""Token-id files: length-delimited binary records with masked checksums and a separate offset index.

A record is one document's sequence: the payload's length (8 bytes, little-endian), the masked crc32 of
those 8 bytes, the payload, the masked crc32 of the payload, and one closing line feed. The payload is
the document's id (length-prefixed text), the width of an id in bytes (2 where all ids fit, else 4), and
the ids. Files are in ascending order of document ids, within and across files. They are written and
read by Spark, so any store that Spark reaches will do. The index (Parquet) holds for every record its
file, offset, size, number of ids and first id's place in the whole stream, so that readers can fetch
records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.llm.common import shared_dir, shuffle_partitions
from scopeloom.llm.tokens import default_vocabulary, encoded_column, ids_crc32

#: Bytes of records in one output batch, and bytes of text that give one file, so that a file is read back as one value.
BATCH_BYTES, FILE_BYTES = 2 << 20, 128 << 20
END = b"\n"


def masked(data: bytes) -> int:
    """A rotated and shifted crc32: a checksum of data that holds checksums stays apart from them."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: object, ids: np.ndarray) -> bytes:
    name = b"" if doc_id is None else str(doc_id).encode()
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack("<iB", -1 if doc_id is None else len(name), width) + name + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)) + END


def unframe(data: memoryview, at: int) -> tuple[str | None, np.ndarray, int]:
    """The record at an offset: document id as text, ids, offset of the next record."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"bad record length at byte {at}")
    size = struct.unpack("<Q", length)[0]
    payload = bytes(data[at + 12 : at + 12 + size])
    stop = at + 12 + size
    if len(payload) < size or struct.unpack("<I", data[stop : stop + 4])[0] != masked(payload) or bytes(data[stop + 4 : stop + 5]) != END:
        raise ValueError(f"bad record payload at byte {at}")
    n, width = struct.unpack_from("<iB", payload)
    name = None if n < 0 else payload[5 : 5 + n].decode()
    return name, np.frombuffer(payload, f"<u{width}", offset=5 + max(n, 0)).astype("<u4"), stop + 5


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write all rows under ``path``/records, in ascending order of ids (nulls first).

    Null texts count as empty and have the end id alone; rows that repeat an id stay, next to each other.
    There are as many files as the session has shuffle partitions, and more where these would hold more than
    ``FILE_BYTES`` of text on average; rows are dealt by ranges of ids, and of texts within an id.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    files = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    ordered = rows.repartitionByRange(max(files, shuffle_partitions(spark)), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0).to_pylist(), [], 0
            for doc_id, found in zip(ids, encoded_column(batch.column(1), vocabulary), strict=True):
                held.append(frame(doc_id, found)[:-1])  # the writer adds the closing line feed
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    # Spark's text writer puts a binary value's bytes into the file as they are, then the separator
    ordered.mapInArrow(apply, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")


ENTRY = "file string, id string, offset bigint, size bigint, n_tokens bigint, ids_crc32 bigint"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Decode and verify all files: file, id (text), offset, size, n_tokens, ids_crc32."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, rows = memoryview(content.as_py()), 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((name, doc_id, at, after - at, len(ids), ids_crc32(ids)))
                    at = after
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["file", "id", "offset", "size", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select("path", "content").mapInArrow(apply, ENTRY)


def tokens_before(files: DataFrame) -> DataFrame:
    """file and the tokens of all files before it; files (file, held) follow by number, which names show in five digits or more."""
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    return files.select("file", (F.sum("held").over(W.orderBy(number)) - F.col("held")).alias("before"))


def write_index(spark: SparkSession, path: str) -> None:
    """Read the record files back and write ``path``/index: their records and each one's start in the stream.

    Starts are sums within a file plus a running sum over the files, of which there are few.
    """
    entries = read_records(spark, path)
    entries.write.option("compression", "zstd").parquet(f"{path}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{path}/entries")
    files = entries.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = tokens_before(files)
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    entries.join(before, "file").withColumn("start", F.col("before") + inside).drop("before").write.option("compression", "zstd").parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRY}, start bigint").parquet(f"{path}/index")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Shuffled read: the ids of the wanted index rows (file, offset), in any order: file, offset, id, ids.

    A file is the unit that Spark reads; the wanted offsets go to it, so its bytes stay where they are read unless the
    offsets are too many for a broadcast. Files without a wanted record are dropped before they are decoded.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                found = [unframe(data, at)[:2] for at in offsets]
                columns = [pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([ids.astype(np.int64) for _, ids in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select(F.col("path").alias("file"), "content")
    offsets = wanted.groupBy("file").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    return files.join(offsets, "file").mapInArrow(apply, "file string, offset bigint, id string, ids array<bigint>")


def record_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the records and their index below the shared folder, and report what the files hold."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    write_records(docs, path, vocabulary)
    write_index(spark, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_index(spark, path).select(F.col("id").cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")
