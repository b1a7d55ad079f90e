"""Approximate nearest neighbours by p-stable hashing with many probes a table.

A table hashes a vector by ``HASHES`` Gaussian projections, each cut into cells of a fixed width. A query estimates for
every cell of every projection how likely a near neighbour lies there, from the cell of the query outwards, and visits
the perturbed buckets of a table in the order of the product of these estimates, until their sum says that the tables
together find a neighbour with probability ``SUCCESS``. How far neighbours stray from a query is fitted on a bounded
sample; every vector is indexed.

Vectors meet queries in shards. A shard is a hash of table and bucket, and crowded buckets are dealt over several
shards by id, so no bucket lands in one task. A query goes once to each shard that holds one of its buckets, with
these buckets, and streams past the shard's vectors; there, and not in a join, candidates of all tables are merged, and
distances are exact. Each shard hands on the ten nearest at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeloom.llm.common import mix, shuffle_partitions, stored

#: Tables, projections of a table, cell width in deviations of a projection, probability to find a neighbour.
TABLES, HASHES, WIDTH, SUCCESS = 2, 8, 2.0, 0.96
#: Vectors that the model is fitted on, and those of them whose neighbours are looked at.
SAMPLE, ASKED = 8192, 512
#: Most cells of a projection, and the share of success that a partial bucket may hold and still be dropped.
CELLS, DUST = 127, 1e-4
#: Vectors of a shard, and the share of a shard's vectors beyond which one bucket is dealt over several.
SHARD_ROWS, CROWDED = 1 << 16, 0.25
TOP = 10


@dataclass
class Model:
    """Projections, and where neighbours of a query lie: around ``slope`` times its projection, with ``spread``."""

    centre: np.ndarray  # (dimension,)
    directions: np.ndarray  # (dimension, tables * hashes), scaled to deviation 1
    shifts: np.ndarray
    low: np.ndarray  # first and last cell of each projection
    high: np.ndarray
    slope: float
    spread: float
    stray: float  # spread of the nearest neighbours alone

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.directions

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((projected + self.shifts) / WIDTH), self.low, self.high).astype(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket in each table as one number."""
        return _number((self.cells(self.project(x)) - self.low.astype(np.int64)).reshape(len(x), TABLES, HASHES))


def _number(cells: np.ndarray) -> np.ndarray:
    out = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        out = (out << 8) | cells[..., j]
    return out


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def fit(sample: np.ndarray, seed: int = 13) -> Model:
    """Projections from ``seed``; scale, cells and the neighbours' spread from the sample."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    directions = rng.normal(size=(sample.shape[1], TABLES * HASHES))
    seen = (sample - centre) @ directions
    scale = seen.std(0)
    directions = directions / np.where(scale > 0, scale, 1)
    shifts = rng.uniform(0, WIDTH, TABLES * HASHES)
    seen = (sample - centre) @ directions
    cells = np.floor((seen + shifts) / WIDTH)
    low, high = cells.min(0) - 1, cells.max(0) + 1
    high = np.minimum(high, low + CELLS)
    step = max(1, len(sample) // ASKED)
    asked, norms, pairs, nearest = np.arange(0, len(sample), step)[:ASKED], (sample**2).sum(1), [], []
    for a in asked.tolist():
        d = norms - 2 * sample @ sample[a]
        d[a] = np.inf
        near = np.argsort(d)[: min(TOP, len(sample) - 1)]
        pairs.append((np.repeat(seen[a][None], len(near), 0), seen[near]))
        nearest.append(seen[near[:1]] - seen[a])
    q, x = (np.concatenate([p[k] for p in pairs]).ravel() if pairs else np.zeros(0) for k in (0, 1))
    slope = float(q @ x / (q @ q)) if q @ q > 0 else 1.0
    spread = float(np.sqrt(np.mean((x - slope * q) ** 2))) if len(q) else 0.0
    stray = float(np.sqrt(np.mean(np.concatenate(nearest) ** 2))) if pairs and len(sample) > 1 else 0.0
    return Model(centre, directions, shifts, low, high, slope, max(spread, 1e-3), max(stray, 1e-3))


def probes(model: Model, projected: np.ndarray, table: int, success: float) -> np.ndarray:
    """Buckets of one table in estimated success order, until their success adds up to ``success``.

    ``projected`` is the query's row of ``Model.project``. Buckets grow projection by projection; a beginning whose success
    is dust beside what is asked for goes, and what went counts as missed.
    """
    own = slice(table * HASHES, (table + 1) * HASHES)
    keys, chance = np.zeros(1, np.int64), np.ones(1)
    for p, shift, low, high in zip(projected[own], model.shifts[own], model.low[own], model.high[own], strict=True):
        cell = np.arange(int(low), int(high) + 1)
        edges = np.append(cell, cell[-1] + 1) * WIDTH - shift
        edges[0], edges[-1] = -np.inf, np.inf
        share = np.diff(_normal((edges - model.slope * p) / model.spread))
        chance = (chance[:, None] * share).ravel()
        keys = ((keys[:, None] << 8) | (cell - int(low))).ravel()
        order = np.argsort(-chance, kind="stable")
        order = order[: int(np.searchsorted(np.cumsum(chance[order]), (1 - DUST) * chance.sum())) + 1]
        keys, chance = keys[order], chance[order]
    n = int(np.searchsorted(np.cumsum(chance), success)) + 1
    home = _number((model.cells(projected)[own] - model.low[own].astype(np.int64))[None])
    return np.append(home, keys[:n][keys[:n] != home[0]])


def _shard(table: np.ndarray | int, bucket: np.ndarray, part: np.ndarray | int, shards: int) -> np.ndarray:
    x = bucket.astype(np.uint64) + (np.uint64(0x9E3779B97F4A7C15) * np.asarray(np.asarray(table) * 65_537 + part + 1).astype(np.uint64))
    return (mix(x) % np.uint64(shards)).astype(np.int64)


def vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: not null, not zero, all components finite, and of the usual length.

    The usual length is the most frequent one, the smaller among equals; distances between other lengths are not defined.
    """
    held = embeddings.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = held.where(whole & F.exists("v", lambda x: x != 0))
    usual = held.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return held.where(F.size("v") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1).astype(np.float64, copy=False)


def nearest(embeddings: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, success: float = SUCCESS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """The ``top`` nearest vectors found for each query by Euclidean distance: query_id, rank, vec_id, score.

    Null, zero and unfinite vectors, those of an unusual length, and null ids take no part. A query does not meet rows of its own id.
    Equal distances go by the smaller id. Rows that repeat an id and its vector count once; an id with several vectors is as near as
    the nearest of them. A query whose buckets hold fewer than ``top`` others visits all buckets. Of equal vectors only the ``top`` + 1 smallest ids are indexed: any other is at the same
    distance as ``top`` smaller ids and never among the nearest. A table of fewer rows gives all of them, an empty one none.
    """
    spark = embeddings.sparkSession
    same = Window.partitionBy("v").orderBy("id")
    base = stored(vectors(embeddings, id_col, vector_col).distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= top + 1).drop("place"))
    asked = vectors(queries, id_col, vector_col).distinct()
    rows = base.count()
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    share = min(1.0, sample / rows)
    point = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = base.where(point < share).orderBy("id").limit(2 * sample).collect() or base.orderBy("id").limit(sample).collect()
    model = fit(np.array([r["v"] for r in drawn]))
    dim = len(drawn[0]["v"])
    asked = asked.where(F.size("v") == dim)
    sent = spark.sparkContext.broadcast(model)

    def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = sent.value.buckets(_matrix(batch.column(1), batch.num_rows))
            table = np.tile(np.arange(TABLES), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(b.ravel())], ["table", "bucket"])

    # at most TABLES * rows / limit buckets are crowded: no more than four a shard, whatever the data
    shards = max(shuffle_partitions(spark), -(-rows * TABLES // shard_rows))
    limit = max(1, int(CROWDED * rows * TABLES / shards))
    counts = base.mapInArrow(bucket_rows, "table int, bucket bigint").groupBy("table", "bucket").count().where(F.col("count") > limit)
    crowded = spark.sparkContext.broadcast({(r[0], r[1]): -(-r[2] // limit) for r in counts.collect()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once to each shard that one of its buckets is in."""
        for batch in batches:
            x, ids = _matrix(batch.column(1), batch.num_rows), np.asarray(batch.column(0))
            b, point = sent.value.buckets(x), mix(ids.astype(np.uint64)) >> np.uint64(8)
            place = np.zeros(b.shape, np.int64)
            for t in range(TABLES):
                parts = np.array([crowded.value.get((t, k), 1) for k in b[:, t].tolist()], np.uint64)
                place[:, t] = _shard(t, b[:, t], (point % parts).astype(np.int64), shards)
            row = np.repeat(np.arange(len(x)), TABLES)
            table = np.tile(np.arange(TABLES), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), pa.array(np.zeros(len(row), np.int32)), pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array([[x] for x in table.tolist()], pa.list_(pa.int32())), pa.array(b.reshape(-1, 1).tolist(), pa.list_(pa.int64()))], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once to each shard that holds a bucket it visits, with these buckets in their order."""
        each = 1 - (1 - success) ** (1 / TABLES)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                p = sent.value.project(_matrix(one.column(1), 1))[0]
                table, bucket, place = [], [], []
                for t in range(TABLES):
                    visits = probes(sent.value, p, t, each)
                    spots = [_shard(t, visits, 0, shards)]
                    extra = [(k, crowded.value[t, k]) for k in visits.tolist() if (t, k) in crowded.value] if crowded.value else []
                    more = [(k, int(_shard(t, np.array([k]), part, shards)[0])) for k, parts in extra for part in range(1, parts)]
                    bucket.append(np.concatenate([visits, np.array([k for k, _ in more], np.int64)]))
                    place.append(np.concatenate([*spots, np.array([s for _, s in more], np.int64)]))
                    table.append(np.full(len(bucket[-1]), t, np.int32))
                table, bucket, place = np.concatenate(table), np.concatenate(bucket), np.concatenate(place)
                order = np.argsort(place, kind="stable")
                cut = np.flatnonzero(np.diff(place[order], prepend=-1))
                n = len(cut)
                tables, buckets = np.split(table[order], cut[1:]), np.split(bucket[order], cut[1:])
                again = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(place[order][cut]), pa.array(np.ones(n, np.int32)), one.column(0).take(again), one.column(1).take(again), pa.array(tables, pa.list_(pa.int32())), pa.array(buckets, pa.list_(pa.int64()))], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, found = None, [], []
        for batch in batches:
            place, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo in (edges := np.flatnonzero(np.diff(place * 2 + kind, prepend=-1))).tolist():
                hi = int(edges[edges > lo][0]) if (edges > lo).any() else batch.num_rows
                part = batch.slice(lo, hi - lo)
                if place[lo] != (shard if shard is not None else -1):
                    shard, held, ready = int(place[lo]), [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    ready = Shard(held) if held else Shard([])
                    held = []
                found += ready.nearest(part, top)
                if len(found) >= 50_000:
                    yield _pairs(found)
                    found = []
        if found:
            yield _pairs(found)

    names = ["shard", "kind", "id", "v", "tables", "buckets"]
    form = "shard bigint, kind int, id bigint, v array<double>, tables array<int>, buckets array<bigint>"

    def ranked(visits: DataFrame) -> DataFrame:
        both = base.select("id", "v").mapInArrow(deal, form).unionByName(visits)
        met = both.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "kind").mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
        best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    first = stored(ranked(asked.select("id", "v").mapInArrow(ask, form)))
    need = min(top, base.select("id").distinct().limit(top + 1).count() - 1)
    counts = first.groupBy(F.col("query_id").alias("id")).count()
    short = asked.join(counts, "id", "left").where(F.coalesce("count", F.lit(0)) < need).select("id", "v")
    if not short.take(1):
        return first
    # the few queries whose buckets hold too little visit all of them
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    everywhere = short.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(1).alias("kind"), "id", "v", none[0].alias("tables"), none[1].alias("buckets"))
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(ranked(everywhere))


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


class Shard:
    """Vectors of one shard, found by table and bucket."""

    def __init__(self, parts: list[pa.RecordBatch]):
        sizes = [p.num_rows for p in parts]
        self.ids = np.concatenate([np.asarray(p.column(2)) for p in parts]) if parts else np.zeros(0, np.int64)
        self.x = np.concatenate([_matrix(p.column(3), n) for p, n in zip(parts, sizes, strict=True)]) if parts else np.zeros((0, 1))
        key = [np.stack([np.asarray(p.column(4).flatten()), np.asarray(p.column(5).flatten())], 1).astype(np.int64) for p in parts]
        key = np.concatenate(key) if parts else np.zeros((0, 2), np.int64)
        order = np.lexsort((key[:, 1], key[:, 0]))
        self.ids, self.x, key = self.ids[order], self.x[order], key[order]
        self.norms = (self.x**2).sum(1)
        self.spans: dict[tuple[int, int], tuple[int, int]] = {}
        cut = np.flatnonzero(np.any(np.diff(key, axis=0, prepend=-1) != 0, axis=1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
            self.spans[int(key[a, 0]), int(key[a, 1])] = (a, b)

    def nearest(self, queries: pa.RecordBatch, top: int) -> list[tuple]:
        out = []
        for i, q in enumerate(_matrix(queries.column(3), queries.num_rows)):
            own = queries.column(2)[i].as_py()
            visits = zip(queries.column(4)[i].values.to_pylist(), queries.column(5)[i].values.to_pylist(), strict=True)
            spans = sorted(s for v in visits if (s := self.spans.get(v))) if len(queries.column(4)[i]) else [(0, len(self.ids))]
            if not spans:
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in spans])
            rows = rows[self.ids[rows] != own]
            rough = self.norms[rows] - 2 * (self.x[rows] @ q)
            n = 2 * TABLES * top
            if len(rows) > n:  # the rounding of this form is far below the slack
                bar = np.partition(rough, n - 1)[n - 1]
                rows = rows[rough <= bar + 1e-9 * (1 + abs(bar) + float(q @ q))]
            score = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
            seen: set = set()
            for k in np.lexsort((self.ids[rows], score)).tolist():
                vec = int(self.ids[rows[k]])
                if vec not in seen:
                    seen.add(vec)
                    out.append((own, vec, float(score[k])))
                    if len(seen) == top:
                        break
        return out


def neighbour_report(embeddings: DataFrame) -> DataFrame:
    """The fixed query set: rows whose vec_id is divisible by 100, against all other rows."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
