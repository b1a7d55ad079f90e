"""Evaluation metrics and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.operators.retrieval import dot


def context_precision(verdicts: DataFrame) -> DataFrame:
    """Per fixture: sum of precision@k over relevant ranks by their number; none relevant is 0. ``verdicts``: fixture_id, rank, relevant."""
    w = W.partitionBy("fixture_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = F.col("relevant").cast("double")
    at = verdicts.withColumn("p", F.sum(hit).over(w) / F.count(F.lit(1)).over(w))
    return at.groupBy("fixture_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("p") * hit), F.sum(hit)), F.lit(0.0)), 6).alias("context_precision"))


def supported_share(statements: DataFrame, name: str, retrieved: DataFrame | None = None) -> DataFrame:
    """Supported statements of all. ``statements``: fixture_id, supported (null: no statement).

    1 without statements; else 0 where ``retrieved`` (fixture_id), if given, has no chunk of the fixture.
    """
    share = F.avg(F.col("supported").cast("double"))
    out = statements.groupBy("fixture_id").agg(share.alias("share"))
    found = F.lit(True)
    if retrieved is not None:
        out = out.join(retrieved.select("fixture_id").distinct().withColumn("found", F.lit(True)), "fixture_id", "left")
        found = F.coalesce("found", F.lit(False))
    return out.select("fixture_id", F.when(F.col("share").isNull(), 1.0).when(found, F.round("share", 6)).otherwise(0.0).alias(name))


def context_recall(statements: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """Share of the true answer's statements that the retrieved chunks support."""
    return supported_share(statements, "context_recall", retrieved)


def faithfulness(claims: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """Share of the given answer's claims that the retrieved chunks support."""
    return supported_share(claims, "faithfulness", retrieved)


def answer_relevancy(pairs: DataFrame) -> DataFrame:
    """Mean cosine of generated questions' vectors (fixture_id, vector, original); missing ones give 0."""
    cosine = dot("vector", "original") / F.sqrt(dot("vector", "vector") * dot("original", "original"))
    return pairs.groupBy("fixture_id").agg(F.round(F.coalesce(F.avg(cosine), F.lit(0.0)), 6).alias("answer_relevancy"))


def eval_run(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each metric over fixtures, and the geometric mean of the positive ones."""
    means = metrics.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    logs = F.array(*[F.when(F.col(n) > 0, F.log(F.col(n))) for n in names])
    held = F.filter(logs, lambda x: x.isNotNull())
    return means.withColumn("overall", F.round(F.when(F.size(held) > 0, F.exp(F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))).otherwise(0.0), 6))


def compare_runs(a: DataFrame, b: DataFrame, citations: DataFrame, gaps_a: DataFrame, gaps_b: DataFrame, sections: int = 30) -> DataFrame:
    """Two runs side by side, in long form: part, key, a, b, flag.

    Parts: total (items, divisions, sections, keys only in one), division (a fall below half is a regression, a new one new
    coverage), section (the ``sections`` largest of both together), citation by evidence type, gap by type, and the verdict: a loss of
    more than 15 % of the items, or of more than 20 % of A's keys. A key is an item's code and the first 120 characters of its description.
    """
    sides = {"a": a, "b": b}
    both = None
    for side, df in sides.items():
        rows = df.select(F.lit(side).alias("side"), "item_id", F.coalesce("division", F.lit("")).alias("division"), F.coalesce("code", F.lit("")).alias("code"), F.substring(F.lower(F.trim(F.coalesce("description", F.lit("")))), 1, 120).alias("text"))
        both = rows if both is None else both.unionByName(rows)
    on = lambda side: F.count_if(F.col("side") == side)
    counted = lambda df, part, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(on("a").alias("a"), on("b").alias("b")).select(F.lit(part).alias("part"), "key", "a", "b")
    keys = both.groupBy("code", "text").agg(on("a").alias("n_a"), on("b").alias("n_b"))
    only = keys.agg(F.count_if(F.col("n_b") == 0).alias("only_a"), F.count_if(F.col("n_a") == 0).alias("only_b"))
    sizes = both.agg(*[f(F.when(F.col("side") == s, F.col(c))).alias(f"{n}_{s}") for s in sides for n, f, c in (("items", F.count, "side"), ("divisions", F.count_distinct, "division"), ("sections", F.count_distinct, "code"))])
    facts = sizes.crossJoin(only)  # one row each
    total = facts.select(F.inline(F.array(*[F.struct(F.lit("total").alias("part"), F.lit(k).alias("key"), F.col(x).alias("a"), F.col(y).alias("b")) for k, x, y in (("items", "items_a", "items_b"), ("divisions", "divisions_a", "divisions_b"), ("sections", "sections_a", "sections_b"), ("only", "only_a", "only_b"))])))
    division = counted(both, "division", "division")
    section = counted(both, "section", "code").orderBy(F.desc(F.col("a") + F.col("b")), "key").limit(sections)
    cited = citations.select("item_id", F.coalesce("evidence_type", F.lit("?")).alias("kind")).join(both.select("side", "item_id"), "item_id")
    gaps = gaps_a.select(F.lit("a").alias("side"), "gap_type").unionByName(gaps_b.select(F.lit("b").alias("side"), "gap_type"))
    flag = F.when((F.col("part") == "division") & (F.col("a") == 0), "new_coverage").when((F.col("part") == "division") & (F.col("b") * 2 < F.col("a")), "regression").otherwise("")
    out = total.unionByName(division).unionByName(section).unionByName(counted(cited, "citation", "kind")).unionByName(counted(gaps, "gap", "gap_type")).withColumn("flag", flag)
    verdict = F.when(F.col("items_b") < 0.85 * F.col("items_a"), "fewer_items").when(F.col("only_a") > 0.20 * F.col("items_a"), "lost_items").otherwise("no_major_drop")
    return out.unionByName(facts.select(F.lit("verdict").alias("part"), F.lit("").alias("key"), F.col("items_a").alias("a"), F.col("items_b").alias("b"), verdict.alias("flag")))


def compare_extractors(old: DataFrame, new: DataFrame, sections: DataFrame, types: list[str]) -> DataFrame:
    """Items (code, extraction_method) of two extractors for each of the ``sections`` (code, title): counts, and the new one's by type.

    A type is the last part of the method, ``eve:qc`` being ``qc``; ``types`` become columns, others count in new_items only.
    Sections that neither has stay, with zeros; items of sections not asked for are left out.
    """
    kind = F.element_at(F.split(F.coalesce("extraction_method", F.lit("")), "[:/]"), -1)
    both = old.select("code", F.lit(True).alias("is_old"), kind.alias("type")).unionByName(new.select("code", F.lit(False).alias("is_old"), kind.alias("type")))
    is_new = ~F.col("is_old")
    counts = both.groupBy("code").agg(F.count_if("is_old").alias("old_items"), F.count_if(is_new).alias("new_items"), *[F.count_if(is_new & (F.col("type") == t)).alias(t) for t in types])
    asked = sections.groupBy("code").agg(F.coalesce(F.min("title"), F.lit("(?)")).alias("title"))
    return asked.join(counts, "code", "left").fillna(0, ["old_items", "new_items", *types])


def spot_check(items: DataFrame, citations: DataFrame, n: int, seed: int, by: str = "code") -> DataFrame:
    """A repeatable sample of ``n`` items for each section, with up to two cited excerpts each, the best first.

    Rows: ``by``, item_id, description, place, chunk_id, excerpt; an item without citations has one row with nulls. The order
    is that of md5(seed:item_id), whatever the partitions.
    """
    order = W.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string")).cast("binary")), "item_id")
    drawn = items.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(by, "item_id", "description")
    cited = drawn.select("item_id").join(citations.select("item_id", "citation_id", "chunk_id", "excerpt", "rerank"), "item_id")
    best = W.partitionBy("item_id").orderBy(F.desc_nulls_last("rerank"), "citation_id")
    shown = cited.withColumn("place", F.row_number().over(best)).where("place <= 2").select("item_id", "place", "chunk_id", "excerpt")
    return drawn.join(shown, "item_id", "left")
