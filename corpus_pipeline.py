"""The training-data pipeline: drop toxic documents, exact and near copies and benchmark leaks, then pack.

Each stage reads what its predecessor kept and returns the columns of ``documents``; the last returns the
packed pieces. Nothing leaves a stage but what its operator rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeloom.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from scopeloom.llm.common import stored, table


#: Keys of rows whose own id cannot tell them apart lie above all ids.
_ODD_KEYS = 1 << 62


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, which no two rows share: the id, or a key of its own for rows whose id is null or repeated.

    Such rows are written with their keys, so that every later read sees the same ones; where there are none, nothing is.
    """
    ids = docs.groupBy("doc_id").count()
    odd = stored(ids.where("doc_id IS NULL OR count > 1").select(F.col("doc_id").alias("odd_id")))
    if odd.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    apart = stored(docs.join(odd, same, "left_semi").withColumn("row_key", F.lit(_ODD_KEYS) + F.monotonically_increasing_id()))
    return docs.join(odd, same, "left_anti").withColumn("row_key", F.col("doc_id")).unionByName(apart)


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows without the rejected keys, and without the key."""
    return keyed.join(rejected.select("row_key"), "row_key", "left_anti").drop("row_key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents outside the held-out fold, then keep the clean ones."""
    return toxicity.keep_clean(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that of the largest id, one with a null id only where all are null.

    Rows are told apart by id and text; of rows that repeat both, the one least in its other columns stays.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    groups = stored(exact_dedup.exact_duplicates(docs, last=True).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").count().select(F.col("doc_id").alias("own_id"), F.col("text_sha256").alias("own_sha"), "kept", "count"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (sha == F.col("own_sha"))
    again = groups.where("kept AND count > 1")
    left = docs.join(groups.where("NOT kept OR count > 1"), same, "left_anti")
    if again.isEmpty():
        return left
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = docs.join(again, same, "left_semi").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("body")).agg(F.min(F.struct("text", *others)).alias("row"))
    return left.unionByName(first.select("doc_id", "row.*").select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest id stays; rows with a null or repeated id come after all others."""
    keyed = _keyed(docs)
    return _without(keyed, near_dedup.near_duplicates(keyed, id_col="row_key").where(~F.col("kept")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    keyed = _keyed(docs)
    found = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="row_key")
    return _without(keyed, found.where(F.size("spans") > 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Model scores, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
