"""Retrieval judged against sections and sheets of one document per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pages of a block, by which pages and page ranges meet.
PAGE_BLOCK = 16


def keys_by_page(pages: DataFrame, ranges: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """Rows with document_id and page_number, once per section (document_id, code, first_page, last_page) around them.

    A range is listed under every block of pages that it touches, so rows and ranges meet by document and block and
    a long document is split; a row without a page has no section.
    """
    of = lambda c: F.floor(F.col(c) / block)
    spread = ranges.withColumn("block", F.explode(F.sequence(of("first_page"), of("last_page"))))
    met = pages.where("page_number IS NOT NULL").withColumn("block", of("page_number")).join(spread, ["document_id", "block"])
    return met.where("page_number BETWEEN first_page AND last_page").drop("block", "first_page", "last_page").withColumnRenamed("code", "key")


def keys_by_sheet(hits: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows with chunk_id, once per sheet (chunk_id, sheet_id) that the chunk is on."""
    return hits.join(sheets.select("chunk_id", F.col("sheet_id").alias("key")).where("key IS NOT NULL").distinct(), "chunk_id")


def ranked_in_document(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, rank, document_id, ...) in their query's document, ranked anew among themselves."""
    own = hits.join(queries.select("query_id", "document_id"), ["query_id", "document_id"])
    return own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def retrieval_eval(queries: DataFrame, hits: DataFrame, keyed: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: candidates, candidates in its document, truth keys found and missing, recall, rank of the first hit.

    ``queries``: query_id, document_id; ``hits``: all candidates with query_id and document_id; ``keyed``: ranked hits of
    the document with their key; ``truth``: query_id, key. A query without truth is a control: recall is null.
    """
    sizes = hits.join(queries.select("query_id", F.col("document_id").alias("own")), "query_id")
    sizes = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("document_id") == F.col("own")).alias("in_document"))
    first = keyed.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    judged = truth.distinct().join(first, ["query_id", "key"], "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("key")))), "|")
    found = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("truth"), F.count("rank").alias("found"), F.min("rank").alias("first_rank"), names(F.col("rank").isNotNull()).alias("covered"), names(F.col("rank").isNull()).alias("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = queries.join(sizes, "query_id", "left").join(found, "query_id", "left")
    return out.select("query_id", "document_id", zero("candidates"), zero("in_document"), zero("truth"), zero("found"), F.round(F.col("found") / F.col("truth"), 6).alias("recall"), "first_rank", F.coalesce("covered", F.lit("")).alias("covered"), F.coalesce("missing", F.lit("")).alias("missing"))


def retrieval_summary(evaluated: DataFrame) -> DataFrame:
    """Queries, controls, recall, hit rate and mean reciprocal rank by difficulty and overall; controls only count as such."""
    scored = F.col("recall").isNotNull()
    share = lambda c: F.round(F.avg(F.when(scored, c)), 6)
    rows = evaluated.rollup("difficulty").agg(
        F.grouping("difficulty").alias("all"),
        F.count_if(scored).alias("n"),
        F.count_if(~scored).alias("controls"),
        share(F.col("recall")).alias("recall"),
        share((F.col("found") > 0).cast("double")).alias("hit_rate"),
        share(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
    )
    return rows.withColumn("difficulty", F.when(F.col("all") == 1, "OVERALL").otherwise(F.col("difficulty"))).drop("all")
