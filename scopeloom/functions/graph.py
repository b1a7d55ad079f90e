"""Iterative table algorithms. Lineage is cut with checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder: computed once, columns can be read alone."""
    spark = df.sparkSession
    checkpointed(spark.range(1))  # sets a folder in a local session without one
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id reached) for every end of the links (a, b)."""
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = checkpointed(lower.join(jump, "label", "left").select("id", "was", F.coalesce("far", "label").alias("label")))
        labels = new.select("id", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def greedy_leaders(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Leader clustering in order of ids: a row joins its earliest linked leader, else becomes one.

    ``rows``: id; ``links``: (a, b), a < b, similar enough. Each round settles all rows whose earlier
    neighbours are settled, so the result is that of the sequential loop in as many rounds as the longest
    chain of undecided neighbours.
    """
    links = checkpointed(links.select("a", "b").distinct())
    done = checkpointed(rows.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("leader")))
    left = checkpointed(rows.join(done, "id", "left_anti").select("id"))
    while not left.isEmpty():
        near = left.join(links.withColumnRenamed("b", "id"), "id").join(done.select(F.col("id").alias("a"), "leader"), "a", "left")
        state = near.groupBy("id").agg(F.min(F.when(F.col("leader") == F.col("a"), F.col("a"))).alias("first"), F.min(F.when(F.col("leader").isNull(), F.col("a"))).alias("open"))
        # settled when no undecided neighbour comes before the first leader
        ready = state.where(F.col("open").isNull() | (F.col("first") < F.col("open"))).select("id", F.coalesce("first", "id").alias("leader"))
        done = checkpointed(done.unionByName(ready))
        left = checkpointed(left.join(done, "id", "left_anti"))
    return done
