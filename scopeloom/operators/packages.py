"""Work packages and statements of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rule table of our own: package key, label, divisions.
PACKAGES = [
    ("general", "General requirements", "00 01"),
    ("concrete", "Concrete", "03"),
    ("masonry", "Masonry", "04"),
    ("steel", "Structural and miscellaneous steel", "05"),
    ("carpentry", "Wood and millwork", "06"),
    ("envelope", "Roofing and envelope", "07"),
    ("openings", "Doors and glazing", "08"),
    ("finishes", "Finishes", "09"),
    ("specialties", "Specialties and equipment", "10 11 12 13 14"),
    ("fire", "Fire protection", "21"),
    ("plumbing", "Plumbing", "22"),
    ("hvac", "HVAC", "23"),
    ("electrical", "Electrical and low voltage", "26 27 28"),
    ("site", "Sitework and utilities", "31 32 33"),
]


#: Extraction methods of administrative and quality items, and words of gaps that speak of order.
ADMIN, SEQUENCING = ":(admin|qc)$", "(?i)before|after|prior to|sequenc|coordinate|phase"
# Sections that govern the schedule.
SCHEDULE_SECTIONS = ("01 11 00", "01 12 00", "01 14 00", "01 32 16", "01 32 33", "01 32 50", "01 33 00", "01 35 00", "01 73 00", "01 77 00")


def load_rule_dims(spark: SparkSession, rules=PACKAGES) -> DataFrame:
    """division → package; divisions are padded to two digits, and one that two packages claim is an error."""
    rows = [(d.zfill(2), key, label) for key, label, divisions in rules for d in divisions.split()]
    twice = {d for d, *_ in rows if sum(r[0] == d for r in rows) > 1}
    if twice:
        raise ValueError(f"divisions of two packages: {sorted(twice)}")
    return spark.createDataFrame(rows, "division string, package string, label string")


def resolve_bundling(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (division, package) claim their divisions; the rules fill the rest. Two overrides of one division are an error."""
    rest = rules.select("division", "package").join(overrides, "division", "left_anti")
    claimed = overrides.groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.first("package").alias("package"))
    once = F.when(F.col("n") == 1, F.col("package")).otherwise(F.raise_error(F.concat(F.lit("two overrides of division "), "division")))
    return claimed.select("division", once.alias("package")).unionByName(rest)


def bundle_items(items: DataFrame, bundling: DataFrame) -> DataFrame:
    """Adds package; items of unmapped divisions go to ``unbundled-NN``."""
    joined = items.join(bundling.select("division", "package"), "division", "left")
    return joined.withColumn("package", F.coalesce("package", F.concat(F.lit("unbundled-"), "division")))


def package_rollup(bundled: DataFrame) -> DataFrame:
    """Items, bilateral items and mean confidence of each package."""
    return bundled.groupBy("run_id", "package").agg(F.count(F.lit(1)).alias("item_count"), F.count_if(F.col("expected") == "bilateral").alias("bilateral"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def package_list(bundled: DataFrame, gaps: DataFrame, bundling: DataFrame, low: float = 0.6) -> DataFrame:
    """Packages with counts of items, low-confidence items and open gaps."""
    p = bundled.groupBy("run_id", "package").agg(F.count(F.lit(1)).alias("item_count"), F.count_if(F.col("confidence") < low).alias("low_confidence"))
    g = bundle_items(gaps.where("status = 'open'"), bundling).groupBy("run_id", "package").agg(F.count(F.lit(1)).alias("open_gaps"))
    return p.join(g, ["run_id", "package"], "left").fillna(0, ["open_gaps"])


def package_sections(bundled: DataFrame) -> DataFrame:
    """Items of each package nested by section, in order of ids."""
    nested = bundled.groupBy("run_id", "package", "code").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return nested.select("run_id", "package", "code", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def move_items(bundled: DataFrame, moves: DataFrame) -> DataFrame:
    """The last move (item_id, seq, target) of an item replaces its package; counts of both sides follow."""
    last = moves.groupBy("item_id").agg(F.max_by("target", "seq").alias("target"))
    moved = bundled.join(last, "item_id", "left").withColumn("package", F.coalesce("target", "package"))
    return moved.groupBy("run_id", "package").agg(F.count(F.lit(1)).alias("item_count"), F.count("target").alias("moved_in"))


def ensure_action_verb(items: DataFrame) -> DataFrame:
    """Prefix a description that does not open with a verb; only the first letter of sentence case is lowered."""
    verbs = r"(?i)^(provide|install|furnish|supply|submit|perform|coordinate|remove|demolish|patch|paint|test)\b"
    sentence = F.col("description").rlike(r"^[A-Z][a-z]")
    lowered = F.when(sentence, F.concat(F.lower(F.substring("description", 1, 1)), F.expr("substring(description, 2)"))).otherwise(F.col("description"))
    verb = F.when(F.col("extraction_method").endswith(":admin"), "Submit ").when(F.col("extraction_method").endswith(":qc"), "Perform ").otherwise("Provide ")
    return items.withColumn("line", F.when(F.col("description").rlike(verbs), F.col("description")).otherwise(F.concat(verb, lowered)))


def sow_lines(items: DataFrame, citations: DataFrame) -> DataFrame:
    """One Markdown line per item: ``- verb description (quantity unit) per sheets; per spec section code.``

    A quantity is shown with its unit only, a unit also alone; the section where a specification is cited.
    """
    spec = F.max(F.col("evidence_type") == "spec").alias("spec")
    sheets = citations.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("evidence_type") == "drawing", F.col("sheet")))), ", ").alias("sheets"), spec)
    joined = ensure_action_verb(items).join(sheets, "item_id", "left")
    said = lambda c: F.nullif(c, F.lit(""))
    amount = F.when(said("unit").isNotNull(), F.concat(F.lit(" ("), F.concat_ws(" ", said("quantity"), "unit"), F.lit(")"))).otherwise("")
    refs = F.concat_ws("; ", F.concat(F.lit("per "), said("sheets")), F.when(F.col("spec") & F.col("code").isNotNull(), F.concat(F.lit("per spec section "), "code")))
    return joined.select("item_id", "run_id", "code", F.concat(F.lit("- "), "line", amount, F.when(refs != "", F.concat(F.lit(" "), refs)).otherwise(""), F.lit(".")).alias("line"))


def sow_summary(items: DataFrame, bundled: DataFrame, citations: DataFrame) -> DataFrame:
    """Per run: items, divisions, packages, and how many items cite drawings, specs or both."""
    sides = citations.groupBy("item_id").agg(F.max(F.col("evidence_type") == "drawing").alias("d"), F.max(F.col("evidence_type") == "spec").alias("s"))
    j = bundled.join(sides, "item_id", "left")
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("division").alias("divisions"), F.count_distinct("package").alias("packages"), F.count_if("d").alias("drawing_cited"), F.count_if("s").alias("spec_cited"), F.count_if(F.col("d") & F.col("s")).alias("both_cited"))


def is_schedule_section(code: Column) -> Column:
    return code.isin(*SCHEDULE_SECTIONS)


def sow_sections(items: DataFrame) -> DataFrame:
    """Per run, division and section: work items, admin or QC items, all, and whether the section governs the schedule."""
    admin = F.coalesce(F.col("extraction_method").rlike(ADMIN), F.lit(False))
    return items.groupBy("run_id", "division", "code").agg(F.count_if(~admin).alias("work_items"), F.count_if(admin).alias("admin_items"), F.count(F.lit(1)).alias("used")).withColumn("schedule", is_schedule_section(F.col("code")))


def sow_coordination(conflicts: DataFrame, gaps: DataFrame, exclusions: DataFrame, shown: int = 8) -> DataFrame:
    """Per run: open conflicts, unresolved references, exclusions (run_id, n), sequencing gaps with the texts shown and how many more.

    Sequencing gaps are blockers and warnings whose words speak of order; the first by id are shown.
    """
    c = conflicts.where("status = 'open'").groupBy("run_id").agg(F.count_distinct("conflict_id").alias("open_conflicts"))
    waiting = F.col("severity").isin("blocker", "warn") & F.col("description").rlike(SEQUENCING)
    g = gaps.groupBy("run_id").agg(F.count_if(F.col("gap_type") == "unresolved_cross_reference").alias("unresolved_refs"), F.count_if(waiting).alias("n"))
    first = gaps.where(waiting).withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy("gap_id"))).where(F.col("rank") <= shown)
    texts = first.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda x: x["description"]), " | ").alias("sequencing"))
    both = c.join(g, "run_id", "full_outer").join(exclusions.select("run_id", F.col("n").alias("exclusions")), "run_id", "full_outer").fillna(0).join(texts, "run_id", "left")
    return both.select("run_id", "open_conflicts", "unresolved_refs", "exclusions", F.least("n", F.lit(shown)).alias("shown"), F.greatest(F.col("n") - shown, F.lit(0)).cast("long").alias("more"), F.coalesce("sequencing", F.lit("")).alias("sequencing"))


def gap_report(gaps: DataFrame, conflicts: DataFrame, items: DataFrame, cap: int = 200) -> DataFrame:
    """Headline counts of a run, and how many gaps its capped list shows."""
    g = gaps.where("status = 'open'").groupBy("run_id").agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warn").alias("warns"), F.least(F.count(F.lit(1)), F.lit(cap)).alias("listed"))
    c = conflicts.where("status = 'open'").groupBy("run_id").agg(F.count_distinct("conflict_id").alias("open_conflicts"))
    i = items.groupBy("run_id").agg(F.count_if(F.col("confidence") < 0.6).alias("low_confidence"))
    return i.join(g, "run_id", "left").join(c, "run_id", "left").fillna(0)


def gap_report_rows(gaps: DataFrame, items: DataFrame, conflicts: DataFrame, gap_cap: int = 200, item_cap: int = 60) -> DataFrame:
    """The lists of a run's report: run_id, kind, rank, subject, text; all conflicts, and gaps and low-confidence items up to a cap.

    Gaps come by severity and id, items by id, conflicts by id. Texts are cut at 280 characters.
    """
    def ranked(df: DataFrame, kind: str, order: list, text: Column, cap: int | None) -> DataFrame:
        out = df.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(*order)))
        out = out if cap is None else out.where(F.col("rank") <= cap)
        return out.select("run_id", F.lit(kind).alias("kind"), "rank", F.col("subject").cast("string").alias("subject"), text.alias("text"))

    g = ranked(gaps.withColumn("subject", F.col("gap_id")), "gap", ["severity", "gap_id"], F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.regexp_replace("gap_type", "_", " "), F.lit(": "), F.substring("description", 1, 280)), gap_cap)
    low = items.where(F.col("confidence") < 0.6).withColumn("subject", F.col("item_id"))
    i = ranked(low, "item", ["item_id"], F.concat("code", F.lit(" · "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%: "), F.substring("description", 1, 280)), item_cap)
    c = conflicts.groupBy("run_id", "conflict_id").agg(F.min("status").alias("status"), F.count(F.lit(1)).alias("members")).withColumn("subject", F.col("conflict_id"))
    return g.unionByName(i).unionByName(ranked(c, "conflict", ["conflict_id"], F.concat(F.lit("status="), "status", F.lit(" members="), F.col("members").cast("string")), None))
