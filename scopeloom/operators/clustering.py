"""Similarity clusters of items and vendors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.functions.graph import checkpointed, connected_components, greedy_leaders
from scopeloom.operators.evidence import is_admin
from scopeloom.operators.retrieval import dot

WITHIN_CODE, ACROSS_CODES, SAME_VENDOR = 0.92, 0.85, 0.78
#: Pivots of a group, rows of a ring that one task takes, and what sets the ids of mined rows behind all others.
PIVOTS, CROWDED, LATER = 32, 4096, 1 << 40
#: Guests that meet a part of a ring in one task, in parts, and of these in one product.
GUESTS, SLICE = 4, 1024


def representatives(rows: DataFrame, group_key: str) -> DataFrame:
    """id and rep: the smallest id of the same group and vector. Rows without a vector or with a zero one have no rep.

    Equal vectors are summed per task before the shuffle; a vector that very many rows share is compared once.
    """
    held = rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("id", F.col(group_key).alias("g"), "embedding")
    first = held.groupBy("g", "embedding").agg(F.min("id").alias("rep"))
    return held.join(first, ["g", "embedding"]).select("id", "g", "embedding", "rep")


def _dealt(rows: DataFrame, least: float, pivots: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, g, embedding) at home, and as guests of all rings where rows may be that the triangle inequality cannot rule out.

    Every row belongs to the nearest of its group's pivots, which is its cell, and to a ring of the cell by the angle to
    the pivot. For a pair within the angle of ``least`` whose rows have cells p and q, the row of q is at most twice
    that angle farther from p than from q, and both angles to p differ by that angle at most. So a row looks into
    such cells before its own in three rings each, and a pair meets in one cell. Rings of more than ``crowded`` rows are split.
    """
    angle = _angle(least)
    unit = rows.withColumn("norm", F.sqrt(dot("embedding", "embedding"))).where("norm > 0")
    unit = unit.withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")))
    drawn = unit.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= pivots)
    held = drawn.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "unit"))), lambda x: x["unit"]).alias("pivots"))
    far = F.transform("pivots", lambda p: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("unit", p)))))
    placed = unit.join(held, "g").select("g", "id", "embedding", "norm", far.alias("far"))
    placed = placed.withColumn("cell", F.array_position("far", F.array_min("far")).cast("int") - 1)
    ring = lambda at: F.floor(at / angle)
    home = placed.select("g", "cell", ring(F.col("far")[F.col("cell")]).alias("ring"), F.col("id").alias("a"), F.col("embedding").alias("x"), F.col("norm").alias("n"), F.col("far")[F.col("cell")].alias("at"))
    sizes = home.groupBy("g", "cell", "ring").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowded)
    sizes = sizes.select("g", "cell", "ring", F.ceil(F.col("size") / crowded).cast("int").alias("parts"))
    home = home.join(sizes, ["g", "cell", "ring"], "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    reached = F.filter(F.sequence(F.lit(0), F.col("cell")), lambda k: (F.col("far")[k] - F.col("far")[F.col("cell")]) <= 2 * angle)
    guests = placed.select("g", F.col("id").alias("b"), F.col("embedding").alias("y"), F.col("norm").alias("m"), "far", F.col("cell").alias("own"), F.explode(reached).alias("cell"))
    guests = guests.select("g", "b", "y", "m", "own", "cell", F.col("far")[F.col("cell")].alias("to"))
    guests = guests.withColumn("ring", F.explode(F.sequence(ring(F.col("to")) - 1, ring(F.col("to")) + 1)))
    guests = guests.join(sizes, ["g", "cell", "ring"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return home, guests


def _angle(least: float) -> float:
    return math.acos(max(-1.0, min(1.0, least))) + 1e-6


def candidate_pairs(rows: DataFrame, least: float, pivots: int = PIVOTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs of rows (id, g, embedding) of one group that ``similar_pairs`` compares: a, b, their vectors and norms."""
    home, guests = _dealt(rows, least, pivots, crowded)
    met = home.join(guests, ["g", "cell", "ring", "part"]).where((F.abs(F.col("at") - F.col("to")) <= _angle(least)) & ((F.col("own") > F.col("cell")) | (F.col("a") < F.col("b"))))
    return met.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y", "n", "m")


def _similar(home: pd.DataFrame, guests: pd.DataFrame, least: float) -> pd.DataFrame:
    """Similar pairs of a part of a ring and guests: products of blocks single out pairs, which are summed up again in order."""
    found = [np.empty((0, 2), dtype="int64")]
    if len(home) and len(guests):
        x, n, a, at = np.stack(home["x"].to_list()).astype("float64"), home["n"].to_numpy(), home["a"].to_numpy(), home["at"].to_numpy()
        for begin in range(0, len(guests), SLICE):
            part = guests.iloc[begin : begin + SLICE]
            y, m, b = np.stack(part["y"].to_list()).astype("float64"), part["m"].to_numpy(), part["b"].to_numpy()
            i, j = np.nonzero((x / n[:, None]) @ (y / m[:, None]).T >= least - 1e-9)
            kept = (np.abs(at[i] - part["to"].to_numpy()[j]) <= _angle(least)) & ((part["own"] > part["cell"]).to_numpy()[j] | (a[i] < b[j]))
            i, j = i[kept], j[kept]
            total = np.zeros(len(i))
            for d in range(x.shape[1]):
                total += x[i, d] * y[j, d]
            kept = total >= least * n[i] * m[j]
            found.append(np.stack([np.minimum(a[i], b[j])[kept], np.maximum(a[i], b[j])[kept]], axis=1))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def similar_pairs(rows: DataFrame, least: float, pivots: int = PIVOTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs a < b of one group (id, g, embedding; vectors of one length) whose vectors reach the cosine.

    At most ``crowded`` rows of a ring meet some ``GUESTS`` times as many in one task, as products of blocks: no pair that is not similar becomes a row.
    """
    home, guests = _dealt(rows, least, pivots, crowded)
    ring = ["g", "cell", "ring", "part"]
    many = guests.groupBy(*ring).agg(F.ceil(F.count(F.lit(1)) / (GUESTS * crowded)).cast("int").alias("shares"))
    home = home.join(many, ring).select(*ring, "a", "x", "n", "at", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    guests = guests.join(many, ring).withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    own = lambda df, *names: df.select(*[F.col(c).alias(c) for c in ("g", "ring", "part", "share", *names)], F.col("cell").alias("at_cell"))
    by = ["g", "at_cell", "ring", "part", "share"]
    left, right = own(home, "a", "x", "n", "at"), own(guests.withColumn("to_cell", F.col("cell")), "b", "y", "m", "own", "to", "to_cell").withColumnRenamed("to_cell", "cell")
    kind = rows.schema["id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda held, met: _similar(held, met, least), f"a {kind}, b {kind}")


def cluster_by_similarity(rows: DataFrame, least: float, group_key: str) -> DataFrame:
    """id and leader: each row joins the first earlier leader of its group that is similar enough.

    Rows with equal vectors have the same leader; rows without a vector are their own.
    """
    reps = checkpointed(representatives(rows, group_key))
    distinct = reps.where("id = rep").select("id", "g", "embedding")
    leaders = greedy_leaders(distinct.select("id"), similar_pairs(distinct, least))
    known = reps.select("id", "rep").join(leaders.withColumnRenamed("id", "rep"), "rep")
    return rows.select("id").join(known.select("id", "leader"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def append_to_clusters(clusters: DataFrame, old: DataFrame, new: DataFrame, least: float, group_key: str) -> DataFrame:
    """Clusters (id, leader) of ``old`` rows with ``new`` rows added, whose ids come after all old ones.

    New rows meet the leaders and each other, never the members; the result is that of clustering old and new at once.
    """
    leaders = old.join(clusters.where("id = leader").select("id"), "id", "left_semi")
    grown = cluster_by_similarity(leaders.select("id", group_key, "embedding").unionByName(new.select("id", group_key, "embedding")), least, group_key)
    return clusters.unionByName(grown.join(clusters.select("id"), "id", "left_anti"))


def dedupe_items(items: DataFrame, clusters: DataFrame, chunks: DataFrame) -> DataFrame:
    """One item per cluster (id, leader): the longest description, of these the last specification, then the smallest id.

    What it lacks (null or empty) comes from the first member that has it; ``chunks`` (item_id, chunk_id) and extraction
    methods are united. An item without a cluster is one of its own.
    """
    joined = items.join(clusters.select(F.col("id").alias("item_id"), "leader"), "item_id", "left").withColumn("leader", F.coalesce("leader", "item_id"))
    said = lambda c: F.nullif(c, F.lit(""))
    order = F.struct(F.length(F.coalesce("description", F.lit(""))), F.coalesce("specification", F.lit("")), -F.col("item_id"))
    fill = lambda c: F.coalesce(F.max_by(F.struct(said(c).alias("v")), order)["v"], F.min_by(said(c), F.when(said(c).isNotNull(), F.col("item_id")))).alias(c)
    merged = joined.groupBy("leader").agg(F.max_by("description", order).alias("description"), fill("specification"), fill("quantity"), fill("unit"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set(said("extraction_method"))), "+").alias("found_by"))
    united = joined.select("item_id", "leader").join(chunks, "item_id").select("leader", "chunk_id").distinct().groupBy("leader").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return merged.join(united, "leader", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast(united.schema["chunk_ids"].dataType)))


def merge_extractors(extracted: DataFrame, mined: DataFrame, least: float = WITHIN_CODE, relevant: DataFrame | None = None) -> DataFrame:
    """Candidates of all extractors (item_id, division, group, embedding) by division, deduplicated, with mined ones added.

    Returns item_id (the leader), division, origin (extracted; appended to a division that has extracted ones; new_division),
    members, and the division's candidates. Mined candidates come after extracted ones and meet their leaders only. With
    ``relevant`` (division), mined rows of other divisions are marked as surfaced.
    """
    after = lambda df, n: df.withColumn("id", F.col("item_id") + F.lit(n)).select("id", "group", "embedding")
    old, new = after(extracted, 0), after(mined, LATER)
    clusters = append_to_clusters(checkpointed(cluster_by_similarity(old, least, "group")), old, new, least, "group")
    both = extracted.select(F.col("item_id").alias("id"), "division").unionByName(mined.select((F.col("item_id") + F.lit(LATER)).alias("id"), "division"))
    placed = checkpointed(clusters.join(both, "id"))
    totals = placed.groupBy("division").agg(F.count(F.lit(1)).alias("candidates"), F.max((F.col("id") < LATER).cast("int")).alias("emitted"))
    merged = placed.groupBy(F.col("leader").alias("id")).agg(F.count(F.lit(1)).alias("members"), F.min_by("division", "id").alias("division")).join(totals, "division")
    origin = F.when(F.col("id") < LATER, "extracted").when(F.col("emitted") == 1, "appended").otherwise("new_division")
    out = merged.select((F.col("id") % LATER).alias("item_id"), "division", origin.alias("origin"), "members", "candidates")
    if relevant is None:
        return out
    known = relevant.select("division").distinct().withColumn("known", F.lit(True))
    return out.join(known, "division", "left").withColumn("origin", F.when(F.col("known").isNull() & (F.col("origin") != "extracted"), "surfaced").otherwise(F.col("origin"))).drop("known")


def conflict_cross_division(items: DataFrame, least: float = ACROSS_CODES) -> DataFrame:
    """Clusters of two or more items (item_id, group, division, description, extraction_method, embedding) of two divisions or more.

    Administrative and quality items, by method or words, belong to their division by nature and are left out.
    """
    method = F.coalesce(F.lower("extraction_method"), F.lit(""))
    work = items.where(~(method.endswith(":admin") | method.endswith(":qc") | is_admin(F.col("description"))))
    clusters = cluster_by_similarity(work.withColumnRenamed("item_id", "id"), least, "group")
    joined = clusters.join(work.select(F.col("item_id").alias("id"), "division"), "id")
    c = joined.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("division").alias("divisions"))
    return c.where("members >= 2 AND divisions >= 2")


def canonicalize_vendors(names: DataFrame, least: float = SAME_VENDOR, group_key: str = "project_id") -> DataFrame:
    """name → canonical: similar names are linked transitively; the longest name that is no acronym stands for them."""
    reps = checkpointed(representatives(names, group_key))
    distinct = reps.where("id = rep").select("id", "g", "embedding")
    labels = connected_components(similar_pairs(distinct, least))
    known = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("label"))
    joined = names.join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    acronym = (F.upper("name") == F.col("name")) & (F.length(F.regexp_replace("name", " ", "")) <= 4)
    best = joined.groupBy("label").agg(F.max_by("name", F.struct((~acronym).cast("int"), F.length("name"), F.col("name"))).alias("canonical"))
    return joined.join(best, "label").select("id", "name", "canonical")
