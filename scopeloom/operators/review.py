"""Review actions: an ordered log folded over conflicts, gaps and items, with an audit row for every action.

``actions``: seq, actor, action (resolve, acknowledge, reclassify), entity_id, winner (a member's item), new_code. Later
numbers see what earlier ones did. The fold is by entity: actions of one entity are ordered among themselves, and no action
depends on another entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.operators.grounding import ground_code

AUDIT = ("seq", "actor", "action", "entity_type", "entity_id", "outcome", "before", "after")


def _audit(rows: DataFrame, entity_type: str, outcome: Column, before: Column, after: Column) -> DataFrame:
    """One row per action; a refused one changes nothing, so it has no state after."""
    applied = outcome == "applied"
    return rows.select("seq", "actor", "action", F.lit(entity_type).alias("entity_type"), "entity_id", outcome.alias("outcome"), before.alias("before"), F.when(applied, after).alias("after"))


def resolve_conflicts(conflicts: DataFrame, members: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts (conflict_id, status) with the winner that the first valid action names, and the audit of all actions.

    An action is valid on an open conflict (null counts as none) whose members (conflict_id, item_id) hold its winner. After
    the first valid one the conflict is resolved and later ones are refused.
    """
    own = actions.where("action = 'resolve'")
    state = conflicts.select(F.col("conflict_id").alias("entity_id"), F.coalesce("status", F.lit("")).alias("status"), F.lit(True).alias("known"))
    part = members.select(F.col("conflict_id").alias("entity_id"), F.col("item_id").alias("winner")).distinct().withColumn("member", F.lit(True))
    judged = own.join(state, "entity_id", "left").join(part, ["entity_id", "winner"], "left")
    valid = F.coalesce((F.col("status") == "open") & F.col("member"), F.lit(False))
    first = F.min(F.when(valid, F.col("seq"))).over(W.partitionBy("entity_id"))
    judged = judged.withColumn("first", first)
    resolved = F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    now = F.when(resolved, "resolved").otherwise(F.col("status"))
    outcome = F.when(F.col("known").isNull(), "not_found").when(now != "open", F.concat(F.lit("already_"), now)).when(F.col("member").isNull(), "not_a_member").otherwise("applied")
    audit = _audit(judged, "conflict", outcome, now, F.concat(F.lit("resolved:"), F.col("winner").cast("string")))
    won = judged.where("seq = first").select(F.col("entity_id").alias("conflict_id"), F.col("winner").alias("winner_item"))
    out = conflicts.join(won, "conflict_id", "left")
    return out.withColumn("status", F.when(F.col("winner_item").isNotNull(), "resolved").otherwise(F.col("status"))), audit


def acknowledge_gaps(gaps: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaps (gap_id, status) with the acknowledged ones; a gap may be acknowledged again, which is audited as well."""
    own = actions.where("action = 'acknowledge'")
    state = gaps.select(F.col("gap_id").alias("entity_id"), "status", F.lit(True).alias("known"))
    joined = own.join(state, "entity_id", "left").withColumn("n", F.row_number().over(W.partitionBy("entity_id").orderBy("seq")))
    outcome = F.when(F.col("known").isNull(), "not_found").otherwise("applied")
    before = F.when((F.col("n") > 1) & F.col("known"), "acknowledged").otherwise(F.col("status"))
    done = own.select(F.col("entity_id").alias("gap_id")).distinct().withColumn("done", F.lit(True))
    out = gaps.join(done, "gap_id", "left").withColumn("status", F.when(F.col("done"), "acknowledged").otherwise(F.col("status"))).drop("done")
    return out, _audit(joined, "gap", outcome, before, F.lit("acknowledged"))


def reclassify_items(items: DataFrame, actions: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, code, division, section_title) moved to the grounded code of their last action; audit with both states.

    Each action starts from what the one before left. Without any taxonomy all actions are refused.
    """
    said = lambda code, division, title: F.concat_ws("|", code, division, F.coalesce(title, F.lit("")))
    own = ground_code(actions.where("action = 'reclassify'"), taxonomy, "new_code")
    titles = taxonomy.groupBy("code").agg(F.min_by("title", "ord").alias("new_title"))
    own = own.join(titles.withColumnRenamed("code", "grounded"), "grounded", "left").join(taxonomy.select(F.lit(True).alias("grounds")).limit(1), how="left", on=F.lit(True))
    state = items.select(F.col("item_id").alias("entity_id"), said(F.col("code"), F.col("division"), F.col("section_title")).alias("was"), F.lit(True).alias("known"))
    joined = own.join(state, "entity_id", "left").withColumn("after", said(F.col("grounded"), F.col("grounded_division"), F.col("new_title")))
    before = F.coalesce(F.lag("after").over(W.partitionBy("entity_id").orderBy("seq")), F.col("was"))
    outcome = F.when(F.col("known").isNull(), "not_found").when(F.col("grounds").isNull(), "no_taxonomy").otherwise("applied")
    judged = joined.withColumns({"before": F.when(F.col("known"), F.when(F.col("grounds"), before).otherwise(F.col("was"))), "outcome": outcome})
    last = judged.where("outcome = 'applied'").groupBy(F.col("entity_id").alias("item_id")).agg(F.max_by(F.struct("grounded", "grounded_division", "new_title"), "seq").alias("to"))
    moved = items.join(last, "item_id", "left")
    change = lambda new, old: F.when(F.col("to").isNotNull(), F.col(f"to.{new}")).otherwise(F.col(old))
    out = moved.withColumns({"code": change("grounded", "code"), "division": change("grounded_division", "division"), "section_title": change("new_title", "section_title")}).drop("to")
    return out, _audit(judged, "scope_item", F.col("outcome"), F.col("before"), F.col("after"))


def apply_review_actions(conflicts: DataFrame, members: DataFrame, gaps: DataFrame, items: DataFrame, actions: DataFrame, taxonomy: DataFrame) -> dict[str, DataFrame]:
    """The state after all actions, and the audit: conflicts, gaps, items (losers of a resolved conflict are rejected), audit."""
    decided, a = resolve_conflicts(conflicts, members, actions)
    known, b = acknowledge_gaps(gaps, actions)
    moved, c = reclassify_items(items, actions, taxonomy)
    won = decided.where("winner_item IS NOT NULL").select("conflict_id", "winner_item")
    losers = members.join(won, "conflict_id").where("item_id <> winner_item").select("item_id").distinct().withColumn("lost", F.lit(True))
    moved = moved.join(losers, "item_id", "left").withColumn("review_status", F.when(F.col("lost"), "rejected").otherwise(F.col("review_status"))).drop("lost")
    return {"conflicts": decided, "gaps": known, "items": moved, "audit": a.unionByName(b).unionByName(c)}
