"""The components of a run's trust score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeloom.operators.evidence import TRUST_WEIGHTS, version_consistency

# Kinds of documents whose pages should carry text.
TEXT_TYPES = ("written-spec", "bid-quote", "scope-letter")


def _share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def section_coverage(runs: DataFrame, relevant: DataFrame, items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per run: the share of the taxonomy's sections of its project's relevant divisions that some item of the run has.

    Division roots (``NN 00 00``) count on neither side. Runs without any expected section have no row.
    """
    sections = taxonomy.where(~F.col("code").endswith(" 00 00")).select("division", "code").distinct()
    expected = runs.select("run_id", "project_id").join(relevant.distinct(), "project_id").join(sections, "division").select("run_id", "code").distinct()
    present = items.select("run_id", "code").distinct().withColumn("present", F.lit(True))
    met = expected.join(present, ["run_id", "code"], "left")
    return met.groupBy("run_id").agg(_share(F.col("present").isNotNull()).alias("spec_section_coverage"))


def schedule_validity(schedules: DataFrame) -> DataFrame:
    """Per project: the share of typed schedules (project_id, name, n_rows) that have rows; untyped ones do not count."""
    typed = schedules.where(F.col("name").startswith("[typed:"))
    return typed.groupBy("project_id").agg(_share(F.coalesce(F.col("n_rows") > 0, F.lit(False))).alias("schedule_extraction_validity"))


def text_coverage(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per project: the share of pages (document_id, text) with a text, over documents that should carry text."""
    bearing = documents.where(F.col("doc_type").isin(*TEXT_TYPES)).select("document_id", "project_id")
    # pages are counted by document before they meet it, so no text is shuffled
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count("text").alias("texts"))
    return counts.join(bearing, "document_id").groupBy("project_id").agg((F.sum("texts") / F.sum("pages")).alias("ocr_text_coverage"))


def trust_components(runs: DataFrame, items: DataFrame, citations: DataFrame | None, relevant: DataFrame, taxonomy: DataFrame, pages: DataFrame, documents: DataFrame, schedules: DataFrame, revisions: DataFrame) -> DataFrame:
    """The seven components of each run (run_id, project_id), and n_items; null where a run or project has no rows for one.

    ``items``: item_id, run_id, code, confidence, pattern_match (see ``evidence_tier``); ``citations``: item_id, link_pass, null
    where unjudged. Link judgements reach a run through its items. Without ``citations``, items carry their own ``judged`` and
    ``passed``, as ``evidence_rollup`` counts them.
    """
    if citations is not None:
        judged = citations.where(F.col("link_pass").isNotNull()).groupBy("item_id").agg(F.count(F.lit(1)).alias("judged"), F.count_if("link_pass").alias("passed"))
        items = items.join(judged, "item_id", "left")
    own = items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        _share(F.coalesce("pattern_match", F.lit(False))).alias("bilateral_coverage"),
        F.avg("confidence").alias("extraction_confidence_avg"),
        F.try_divide(F.sum("passed"), F.sum("judged")).alias("link_judge_pass_rate"),
    )
    out = runs.select("run_id", "project_id").join(own, "run_id", "left").join(section_coverage(runs, relevant, items, taxonomy), "run_id", "left")
    for part in (text_coverage(pages, documents), schedule_validity(schedules), version_consistency(revisions)):
        out = out.join(part, "project_id", "left")
    return out.select("run_id", "project_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), *TRUST_WEIGHTS)
