"""Gaps and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.operators.grounding import is_valid_sheet_id

GAP = ("gap_type", "severity", "division", "subject")


def _gap(df: DataFrame, kind: str, severity: str, subject: Column) -> DataFrame:
    return df.select("run_id", F.lit(kind).alias("gap_type"), F.lit(severity).alias("severity"), "division", subject.cast("string").alias("subject"))


def gap_missing_division(runs: DataFrame, relevant: DataFrame, items: DataFrame) -> DataFrame:
    """Relevant divisions (project_id, division) of a run's project without any item of the run."""
    wanted = runs.join(relevant, "project_id").select("run_id", "division")
    missing = wanted.join(items.select("run_id", "division").distinct(), ["run_id", "division"], "left_anti")
    return _gap(missing, "missing_division", "blocker", F.col("division"))


def gap_missing_section(runs: DataFrame, relevant: DataFrame, items: DataFrame, coded: DataFrame, taxonomy: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Taxonomy sections of covered relevant divisions that the specs (project_id, code) mention and no coded item has.

    ``items`` cover divisions; ``coded`` are those whose codes count, usually the same rows.
    """
    covered = runs.join(relevant, "project_id").join(items.select("run_id", "division").distinct(), ["run_id", "division"], "left_semi")
    sections = taxonomy.where(~F.col("code").endswith(" 00 00")).select("division", "code")
    wanted = covered.join(sections, "division").join(mentioned.select("project_id", "code").distinct(), ["project_id", "code"], "left_semi")
    missing = wanted.join(coded.select("run_id", "code").distinct(), ["run_id", "code"], "left_anti")
    return _gap(missing, "missing_section", "warn", F.col("code"))


def gap_unresolved_xref(references: DataFrame, cited: DataFrame) -> DataFrame:
    """Valid target sheets (run_id, ord, target, division) that no citation (run_id, sheet) names; the first of each stays."""
    valid = references.where(is_valid_sheet_id(F.col("target")))
    first = valid.groupBy("run_id", "target").agg(F.min("ord").alias("ord"), F.min_by("division", "ord").alias("division"))
    missing = first.join(cited.select("run_id", F.col("sheet").alias("target")).distinct(), ["run_id", "target"], "left_anti")
    return _gap(missing, "unresolved_cross_reference", "warn", F.col("target"))


def gap_quantities(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of ``quantity_sanity`` as gap rows of their items' runs; the subject is the item."""
    found = findings.select("item_id", "division", "severity").join(items.select("item_id", "run_id"), "item_id")
    return found.select("run_id", F.lit("qty_implausible").alias("gap_type"), "severity", "division", F.col("item_id").cast("string").alias("subject"))


def gap_one_sided(signals: DataFrame) -> DataFrame:
    """Rows of ``discipline_gap_rows`` as gap rows; the division is that of the code, if there is one."""
    return _gap(signals.withColumn("division", F.substring("code", 1, 2)), "unilateral_evidence", "warn", F.col("description"))


def gap_table(parts: list[DataFrame]) -> DataFrame:
    """Union of gap rows, all open."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.lit("open"))


def gap_counts(gaps: DataFrame, kinds: list[str]) -> DataFrame:
    """Gaps of each kind by run, as columns; absent kinds count 0."""
    return gaps.groupBy("run_id").pivot("gap_type", kinds).count().fillna(0)


def conflict_within_code(members: DataFrame) -> DataFrame:
    """Clusters (conflict_id, item_id, unit, value) of two or more: several units, or values over 5 % apart."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    c = members.groupBy("conflict_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"), F.max(positive).alias("high"), F.min(positive).alias("low"))
    kind = F.when(F.col("units") > 1, "unit_mismatch").when((F.col("high") - F.col("low")) / F.col("high") > 0.05, "qty_mismatch")
    return c.where("n >= 2").select("conflict_id", kind.alias("kind")).where(F.col("kind").isNotNull())


def conflict_eligibility(members: DataFrame, least: float = 0.8) -> DataFrame:
    """Whether every member is confident enough; a null confidence is not."""
    return members.groupBy("conflict_id").agg(F.every(F.coalesce(F.col("confidence") > least, F.lit(False))).alias("eligible"))


def conflict_members(members: DataFrame, citations: DataFrame) -> DataFrame:
    """Role of each member (the first is primary) and its best citation."""
    best = citations.groupBy("item_id").agg(F.max(F.struct("rerank", "citation_id")).alias("best"))
    order = W.partitionBy("conflict_id").orderBy("item_id")
    ranked = members.withColumn("role", F.when(F.row_number().over(order) == 1, "primary").otherwise("contradictor"))
    return ranked.join(best, "item_id", "left").select("conflict_id", "item_id", "role", F.col("best.citation_id").alias("citation_id"))


def apply_arbitration(members: DataFrame, winners: DataFrame) -> DataFrame:
    """Per member: conflict status, item outcome, and the winner's value and unit. A winner outside its conflict, or none, defers it."""
    valid = winners.join(members.select("conflict_id", F.col("item_id").alias("winner"), F.col("value").alias("winner_value"), F.col("unit").alias("winner_unit")), ["conflict_id", "winner"])
    joined = members.join(valid, "conflict_id", "left")
    outcome = F.when(F.col("winner").isNull(), "deferred").when(F.col("winner") == F.col("item_id"), "kept").otherwise("rejected")
    return joined.select("run_id", "conflict_id", "item_id", F.when(F.col("winner").isNull(), "open").otherwise("resolved").alias("conflict_status"), outcome.alias("outcome"), "winner_value", "winner_unit")


def arbitration_counts(arbitrated: DataFrame) -> DataFrame:
    """Per run: conflicts, resolved and deferred ones, and items rejected."""
    c = lambda test: F.count_distinct(F.when(test, F.col("conflict_id")))
    resolved = F.col("conflict_status") == "resolved"
    return arbitrated.groupBy("run_id").agg(F.count_distinct("conflict_id").alias("conflicts"), c(resolved).alias("resolved"), c(~resolved).alias("deferred"), F.count_if(F.col("outcome") == "rejected").alias("rejected_items"))


def discipline_gap_rows(answers: DataFrame) -> DataFrame:
    """One-sided signals (run_id, json with three lists of text and section) as ``unilateral_evidence`` gaps.

    A section that is no canonical code stays in the description; blank signals are dropped.
    """
    from scopeloom.operators.grounding import canonical_code_or_null

    entry = "array<struct<text:string,section:string>>"
    parsed = answers.select("run_id", F.from_json("json", f"spec_only {entry}, drawing_only {entry}, contradictions {entry}").alias("p"))
    out = None
    for side in ("spec_only", "drawing_only", "contradictions"):
        part = parsed.select("run_id", F.lit(side).alias("side"), F.explode(f"p.{side}").alias("e"))
        out = part if out is None else out.unionByName(part)
    section = F.trim("e.section")
    code = canonical_code_or_null(section)
    text = F.trim("e.text")
    described = F.when(code.isNull() & (F.length(section) > 0), F.concat(text, F.lit(" ["), section, F.lit("]"))).otherwise(text)
    return out.where(F.length(text) > 0).select("run_id", "side", F.lit("unilateral_evidence").alias("gap_type"), code.alias("code"), described.alias("description"))
