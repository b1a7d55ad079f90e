"""Runs, review, audit and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rates per million tokens: model, input, output, cache write, cache read.
RATES = [("claude-sonnet-4-5", 3.0, 15.0, 3.75, 0.30), ("claude-haiku-4-5", 1.0, 5.0, 1.25, 0.10), ("claude-opus-4-5", 5.0, 25.0, 6.25, 0.50), ("voyage-3-large", 0.18, 0.0, None, None)]
# Allowed moves of a project.
MOVES = [("setup", "open-for-bids"), ("open-for-bids", "setup"), ("open-for-bids", "complete"), ("complete", "open-for-bids")]


def latest_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    """The newest run of each project, of one status where given; ties by run_id."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    return rows.groupBy("project_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def project_overview(documents: DataFrame) -> DataFrame:
    """Documents of each project by source and type."""
    return documents.groupBy("project_id").agg(F.count_if(F.col("source_kind") == "bid_submission").alias("bid_documents"), F.count_if(F.col("source_kind") != "bid_submission").alias("project_documents"), F.count_distinct("doc_type").alias("doc_types"))


def review_queue(items: DataFrame, gaps: DataFrame, conflicts: DataFrame, low: float = 0.6, gap_statuses: tuple = ("open",), severities: tuple | None = None) -> DataFrame:
    """What a run leaves to review, with a snapshot: open conflicts and their members' items, gaps of the asked statuses and
    severities (all without), low-confidence items that are not rejected (null is not)."""
    open_items = items.where((F.col("confidence") < low) & (F.col("review_status").isNull() | (F.col("review_status") != "rejected")))
    asked = gaps.where(F.col("status").isin(*gap_statuses) if severities is None else F.col("status").isin(*gap_statuses) & F.col("severity").isin(*severities))
    row = lambda df, k, c, status, severity, snapshot: df.select("run_id", F.lit(k).alias("kind"), F.col(c).cast("string").alias("subject"), status.alias("status"), severity.alias("severity"), snapshot.alias("snapshot"))
    said = F.concat_ws(": ", "code", "description")
    named = conflicts.where("status = 'open'").join(items.select("item_id", said.alias("said")), "item_id")
    members = F.array_sort(F.collect_list(F.struct("item_id", F.concat(F.col("item_id").cast("string"), F.lit("="), "said").alias("said"))))
    held = named.groupBy("run_id", "conflict_id").agg(F.array_join(F.transform(members, lambda m: m["said"]), " | ").alias("snapshot"))
    out = row(open_items, "item", "item_id", F.coalesce("review_status", F.lit("")), F.lit("low"), said)
    out = out.unionByName(row(asked, "gap", "gap_id", F.col("status"), F.col("severity"), F.concat_ws(": ", "gap_type", "description")))
    return out.unionByName(row(held, "conflict", "conflict_id", F.lit("open"), F.lit("conflict"), F.col("snapshot")))


def lifecycle_check(events: DataFrame) -> DataFrame:
    """Whether each state (project_id, seq, state) may follow the one before; the same state again is a no-op."""
    before = F.lag("state").over(W.partitionBy("project_id").orderBy("seq"))
    allowed = F.concat_ws(">", "before", "state").isin([f"{a}>{b}" for a, b in MOVES])
    verdict = F.when(F.col("before").isNull(), "first").when(F.col("before") == F.col("state"), "no-op").when(allowed, "allowed").otherwise("rejected")
    return events.withColumn("before", before).withColumn("verdict", verdict)


def newest(rows: DataFrame, n: int, by: str = "project_id", ts: str = "ts", tie: str = "audit_id") -> DataFrame:
    """The newest ``n`` rows of each project with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("rank") <= n)


def audit_log_query(audit: DataFrame, entity_type: str | None = None, entity_id: int | None = None, actor: str | None = None, action: str | None = None, since=None, until=None, limit: int = 100, skip: int = 0) -> DataFrame:
    """A page of the newest audit rows of each project; each filter that is given must hold. ``actor`` is the beginning of a name."""
    tests = [(entity_type, F.col("entity_type") == entity_type), (entity_id, F.col("entity_id") == entity_id), (action, F.col("action") == action)]
    tests += [(actor, F.col("actor").startswith(actor or "")), (since, F.col("ts") >= F.lit(since)), (until, F.col("ts") < F.lit(until))]
    for value, test in tests:
        audit = audit if value is None else audit.where(test)
    return newest(audit, skip + limit).where(F.col("rank") > skip)


def activity_feed(calls: DataFrame, audit: DataFrame, n: int) -> DataFrame:
    """Calls and human actions as typed events; the newest ``n`` of each project."""
    kind = F.when(F.col("status") == "error", "error").otherwise("cost")
    a = calls.select("project_id", F.concat(F.lit("call-"), F.col("call_id").cast("string")).alias("event"), kind.alias("kind"), "ts")
    b = audit.select("project_id", F.concat(F.lit("audit-"), F.col("audit_id").cast("string")).alias("event"), F.lit("pipeline").alias("kind"), "ts")
    return newest(a.unionByName(b), n, tie="event")


def load_rates(spark: SparkSession, rates: list[tuple] = RATES) -> DataFrame:
    """A rate table: rate_model, r_in, r_out, r_write, r_read."""
    return spark.createDataFrame(rates, "rate_model string, r_in double, r_out double, r_write double, r_read double")


def llm_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost by model rate (``load_rates``); cache tokens without a rate cost as input; unknown models cost null."""
    # the rates' keys are name parts of a model: the first four parts of its id, less a date, else the first three
    key4, key3 = F.substring_index("model", "-", 4), F.substring_index("model", "-", 3)
    joined = calls.join(rates, F.col("rate_model").isin(key4, key3), "left")
    cost = F.col("input_tokens") * F.col("r_in") + F.col("output_tokens") * F.col("r_out") + F.col("cache_write") * F.coalesce("r_write", "r_in") + F.col("cache_read") * F.coalesce("r_read", "r_in")
    return joined.withColumn("cost", F.round(cost / 1e6, 8)).drop("rate_model", "r_in", "r_out", "r_write", "r_read")


def cost_breakdown(costed: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Calls and cost by key; the ``top`` dearest, and all others as ``(other)``.

    Each task keeps its dearest keys, so the ranking never sees all keys at once.
    """
    per = costed.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))
    dearest = per.orderBy(F.desc(F.coalesce(F.round("cost", 6), F.lit(0.0))), "key").limit(top).select(F.struct("key").alias("k"), F.lit(True).alias("named"))
    named = per.withColumn("k", F.struct("key")).join(dearest, "k", "left").withColumn("key", F.when(F.col("named"), F.col("key")).otherwise("(other)"))
    return named.groupBy("key").agg(F.sum("calls").alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def citation_summary(citations: DataFrame) -> DataFrame:
    """Citations by evidence type with passes, failures and unjudged ones, and a total row."""
    rolled = citations.rollup("evidence_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("link_pass").alias("passed"), F.count_if(~F.col("link_pass")).alias("failed"), F.count_if(F.col("link_pass").isNull()).alias("not_run"))
    return rolled.withColumn("evidence_type", F.coalesce("evidence_type", F.lit("TOTAL")))


def processing_progress(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with text of all pages per document; null totals for documents in a terminal state."""
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length("text") > 0).alias("completed"))
    joined = documents.join(counted, "document_id", "left")
    running = F.col("processing_status") != "ready"
    return joined.select("document_id", F.when(running, F.coalesce("completed", F.lit(0))).alias("completed"), F.when(running, F.coalesce("total", F.lit(0))).alias("total"))


def readiness_check(pages: DataFrame) -> DataFrame:
    """A document is ready only where all its pages are done; else it stays extracting, with a message."""
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNotNull()).alias("done"))
    ready = F.col("n") == F.col("done")
    return counted.select("document_id", F.when(ready, "ready").otherwise("extracting").alias("status"), F.when(~ready, F.concat((F.col("n") - F.col("done")).cast("string"), F.lit(" pages are not done"))).alias("message"))


def system_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, and the total cost of those that have one."""
    cost = lambda df: F.round(F.sum("cost"), 6) if "cost" in df.columns else F.lit(None).cast("double")
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), cost(df).alias("cost")).select(F.lit(name).alias("name"), "rows", "cost") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rfi_inputs(gaps: DataFrame, conflicts: DataFrame, items: DataFrame) -> DataFrame:
    """Per run the first 50 open gaps, 20 open conflicts and the 10 least confident items of low evidence (tier).

    Items without a confidence come last; runs without gaps and conflicts have no rows.
    """
    first = lambda df, order, n: df.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(*order))).where(F.col("rank") <= n)
    shape = lambda df, k, c: df.select("run_id", F.lit(k).alias("kind"), F.col(c).cast("string").alias("subject"))
    g = shape(first(gaps.where("status = 'open'"), ["gap_id"], 50), "gap", "gap_id")
    c = shape(first(conflicts.where("status = 'open'").select("run_id", "conflict_id").distinct(), ["conflict_id"], 20), "conflict", "conflict_id")
    i = shape(first(items.where(F.col("tier") == "INFERRED_LOW_CONFIDENCE"), [F.asc_nulls_last("confidence"), "item_id"], 10), "item", "item_id")
    return g.unionByName(c).unionByName(i.join(g.unionByName(c).select("run_id").distinct(), "run_id", "left_semi"))


def item_flags(items: DataFrame, shown: int = 60) -> DataFrame:
    """Item lines of a run, by code, with flags, the first ``shown``; ``omitted`` says how many are left out.

    ``items``: run_id, item_id, code, description, quantity, unit, qty_confidence, tier, bilateral. Flags name a band of the
    quantity other than high, low evidence, and items without evidence of both sides.
    """
    band = F.when(F.col("qty_confidence") != "high", F.concat(F.lit("qty:"), "qty_confidence"))
    flags = F.concat_ws(", ", band, F.when(F.col("tier") == "INFERRED_LOW_CONFIDENCE", "evidence:low"), F.when(~F.col("bilateral"), "one-sided"))
    amount = F.when(F.length("quantity") > 0, F.concat(F.lit(" — qty "), F.concat_ws(" ", "quantity", F.nullif("unit", F.lit("")))))
    line = F.concat_ws("", F.lit("- "), "code", F.lit(": "), "description", amount, F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))))
    w = W.partitionBy("run_id")
    ranked = items.withColumn("rank", F.row_number().over(w.orderBy("code", "item_id"))).where(F.col("rank") <= shown)
    counts = items.groupBy("run_id").agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("omitted"))
    return ranked.select("run_id", "item_id", line.alias("line")).join(counts, "run_id")


def supervised_examples(audit: DataFrame, items: DataFrame) -> DataFrame:
    """Human actions joined to the text they judged, as message pairs; incomplete ones are dropped."""
    human = audit.where(F.col("actor").like("user:%"))
    joined = human.join(items.select(F.col("item_id").alias("entity_id"), "description"), "entity_id")
    verdict = F.coalesce(F.get_json_object("payload", "$.verdict"), F.get_json_object("payload", "$.k"))
    return joined.select("audit_id", F.col("description").alias("prompt"), F.concat_ws(": ", "action", verdict).alias("answer")).where(F.col("prompt").isNotNull() & F.col("answer").isNotNull())


def run_rollup(runs: DataFrame, conflicts: DataFrame, gaps: DataFrame, packages: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and score of each run (run_id, project_id, started_at), and the latest score of each project."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    joined = runs
    for df, name in ((conflicts.select("run_id", "conflict_id").distinct(), "conflicts"), (gaps, "gaps"), (packages.select("run_id", "package").distinct(), "packages")):
        joined = joined.join(count(df, name), "run_id", "left")
    joined = joined.fillna(0, ["conflicts", "gaps", "packages"]).join(scores.select("run_id", "score"), "run_id", "left")
    latest = joined.where(F.col("score").isNotNull()).groupBy("project_id").agg(F.max_by("score", F.struct("started_at", "run_id")).alias("trust_score_latest"))
    return joined, latest


def extraction_overview(pages: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per page how many schedules, notes, references and entities were found, 0 where none."""
    out = pages.select("page_id")
    for name, df in tables.items():
        out = out.join(df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name)), "page_id", "left")
    return out.fillna(0)


def rfi_markdown(rfis: DataFrame) -> DataFrame:
    """RFIs (run_id, number, subject, question) as one Markdown text per run, in order of numbers."""
    block = F.concat(F.lit("### RFI "), F.col("number").cast("string"), F.lit(": "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("question", F.lit("")))
    parts = rfis.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("number", block.alias("text")))).alias("p"))
    return parts.select("run_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("markdown"))
