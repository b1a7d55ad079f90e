"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of an ASCII-lower-cased UTF-8 text: digits, letters and everything beyond ASCII.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text that one numpy pass handles, so that its temporaries stay small.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split into words; null has none."""
    return WORD_BYTES.findall(text.encode().lower()) if text else []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Drop a query's shuffle files as soon as it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder: computed once, safe when executors are lost.

    Nothing reads the shuffle files of the write any more, so they go with it.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def runs(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs (lo, hi) of about ``limit`` bytes; a longer row makes a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def sampled(df: DataFrame, id_col: str, group_col: str, per_group: int, seed: str) -> DataFrame:
    """About ``per_group`` rows of each group at most, by a hash of the id: the same rows on every run.

    The groups' sizes are counted first (one narrow pass); groups within the bound are taken whole.
    """
    sizes = {r[0]: r[1] for r in df.where(F.col(group_col).isNotNull()).groupBy(group_col).count().collect()}
    if not sizes:
        return df.limit(0)
    shares = F.create_map(*[F.lit(x) for group, n in sizes.items() for x in (group, min(1.0, per_group / n))])
    point = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(point < F.try_element_at(shares, F.col(group_col)))


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``: the folds of the supervised operators."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
