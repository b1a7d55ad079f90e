"""Approximate cosine search over vectors stored by cell.

Cells are the means of a bounded sample of unit vectors; every vector is stored under its nearest mean. A query reads the
cells of its nearest means only, and scores their vectors exactly. How many cells it takes is read off the sample:
the fewest that hold ``recall`` of the sample's own nearest neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.operators.retrieval import dot, nearest_in_blocks

#: Vectors of the sample, those of them whose neighbours are looked at, most cells, and vectors of a cell that are aimed at.
SAMPLE, ASKED, MOST_CELLS, CELL_ROWS = 8192, 256, 1024, 256


@dataclass
class CellIndex:
    path: str
    means: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each unit vector, nearest first."""
        far = (self.means**2).sum(1)[None] - 2 * vectors @ self.means.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def _unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Id and vector of length 1; null and zero vectors are left out."""
    held = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.transform(vector_col, lambda x: x.cast("double")).alias("unit"))
    held = held.withColumn("norm", F.sqrt(dot("unit", "unit"))).where("norm > 0")
    return held.select(id_col, F.transform("unit", lambda x: x / F.col("norm")).alias("unit"))


def _calibrated(sample: np.ndarray, means: np.ndarray, recall: float, k: int) -> int:
    index = CellIndex("", means, 0)
    home = index.nearest(sample, 1)[:, 0]
    asked = sample[:: max(1, len(sample) // ASKED)]
    near = np.argsort(-(asked @ sample.T), axis=1)[:, 1 : k + 1]
    order = index.nearest(asked, len(means))
    place = np.argsort(order, axis=1)  # place[q, c]: when query q comes to cell c
    at = np.take_along_axis(place, home[near], 1)
    held = np.array([(at < n).mean() for n in range(1, len(means) + 1)])
    return int(np.argmax(held >= recall)) + 1 if (held >= recall).any() else len(means)


def write_cells(chunks: DataFrame, path: str, recall: float = 0.97, k: int = 10, seed: int = 7) -> CellIndex:
    """Write all vectors of chunks (chunk_id, embedding) under their cell; the sample and its size are bounded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = _unit(chunks, "chunk_id", "embedding")
    n = unit.count()
    point = F.pmod(F.xxhash64(F.lit("cells"), "chunk_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = unit.where(point < min(1.0, SAMPLE / max(n, 1))).orderBy("chunk_id").limit(2 * SAMPLE)
    rows = np.array([r["unit"] for r in drawn.select("unit").collect()])
    if not len(rows):
        unit.withColumn("cell", F.lit(0)).write.mode("overwrite").partitionBy("cell").parquet(path)
        return CellIndex(path, np.zeros((1, 1)), 1)
    cells = int(max(1, min(MOST_CELLS, len(rows) // 8, -(-n // CELL_ROWS))))
    if cells == 1:
        means = rows.mean(0)[None]
    else:
        means = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(drawn.select(array_to_vector("unit").alias("features"))).clusterCenters())
    index = CellIndex(path, means, _calibrated(rows, means, recall, k))
    shared = chunks.sparkSession.sparkContext.broadcast(index)

    def assign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.nearest(np.stack(part.to_numpy()), 1)[:, 0], dtype="int32") if len(part) else pd.Series([], dtype="int32")

    of = F.pandas_udf(assign, "int")
    # a crowded cell is written by several tasks
    unit.withColumn("cell", of("unit")).repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return index


def cosine_topk_ann(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The best ``k`` stored chunks of each query (query_id, vector): query_id, chunk_id, score, rank.

    Only folders of probed cells are read. With as many probes as cells the answer is exact.
    """
    spark = queries.sparkSession
    n, shared = min(probes or index.probes, len(index.means)), spark.sparkContext.broadcast(index)

    def visit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            every = np.arange(n, dtype="int32")
            yield pd.Series([every] * len(part) if n == len(shared.value.means) else list(shared.value.nearest(np.stack(part.to_numpy()), n)), dtype=object) if len(part) else pd.Series([], dtype=object)

    visits = F.pandas_udf(visit, "array<int>")
    asked = _unit(queries, "query_id", "vector").withColumnRenamed("unit", "vector").withColumn("cells", visits("vector"))
    stored = spark.read.schema("chunk_id bigint, unit array<double>, cell int").parquet(index.path)
    return nearest_in_blocks(stored.select("cell", "chunk_id", F.col("unit").alias("embedding"), F.lit(1.0).alias("norm")), asked.select("query_id", "vector", F.lit(1.0).alias("q_norm"), F.explode("cells").alias("cell")), k, "cell")
