"""Statements of work: ordered Markdown lines in ten sections, written to many files with a manifest.

A statement is never a row. Its lines carry their place (section, place, at); the files cut the order of all statements into
ranges, so a long one spans several files and short ones share one. The manifest says which lines of a file are whose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.functions.graph import checkpointed
from scopeloom.operators.packages import ADMIN, SEQUENCING, is_schedule_section, sow_lines

HEADINGS = ["Project", "Summary", "Included work", "Exclusions", "Assumptions", "Specifications", "Schedule", "Submittals and closeout", "Coordination", "Changes"]
#: Lines that every statement has, by section.
STANDING = {
    4: ["- Items that the owner supplies and installs.", "- Loose furniture and equipment.", "- Permits that others obtain."],
    5: ["- Priced on the documents as issued for bid.", "- Work in ordinary hours, one mobilization.", "- Quantities are checked against the drawings; differences become requests for information."],
    7: ["- Dates are those of the project schedule."],
    10: ["- Changes need a written order before the work, priced by unit prices or by agreement."],
}
#: Sequencing gaps that are shown.
SHOWN = 8


def _line(df: DataFrame, key: str, section: int, place: Column | str, at: Column | int, text: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.col(key).cast("string").alias("sow_id"), F.lit(section).alias("section"), lit(place).alias("place"), lit(at).cast("long").alias("at"), F.regexp_replace(text, r"\s*\n\s*", " ").alias("text"))


def statement_lines(items: DataFrame, citations: DataFrame, gaps: DataFrame, conflicts: DataFrame, exclusions: DataFrame, titles: DataFrame, key: str = "run_id") -> DataFrame:
    """Lines (sow_id, section, place, at, text) of one statement per ``key``: a run, or a package of one.

    ``items`` and ``gaps``, ``conflicts`` and ``exclusions`` (key, n) have the key; ``items`` also project_id and package.
    ``titles``: code, title. Line breaks inside texts become blanks. A key without items has no statement.
    """
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("—")) for p in parts])
    text = lambda c: F.col(c)
    keys = items.groupBy(key).agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).alias("items"), F.count_distinct("division").alias("divisions"), F.count_distinct("package").alias("packages"))
    sides = citations.groupBy("item_id").agg(F.max(F.col("evidence_type") == "drawing").alias("d"), F.max(F.col("evidence_type") == "spec").alias("s"))
    cited = items.select("item_id", key).join(sides, "item_id").groupBy(key).agg(F.count_if("d").alias("d"), F.count_if("s").alias("s"), F.count_if(F.col("d") & F.col("s")).alias("b"))
    keys = keys.join(cited, key, "left").fillna(0, ["d", "s", "b"])
    standing = [(n, -1, f"## {n}. {h}") for n, h in enumerate(HEADINGS, 1)] + [(n, k, x) for n, xs in STANDING.items() for k, x in enumerate(xs)]
    fixed = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(x).alias("x")) for n, k, x in standing]))
    out = [keys.select(F.col(key).cast("string").alias("sow_id"), fixed.alias("f")).select("sow_id", F.col("f.n").alias("section"), F.lit("").alias("place"), F.col("f.k").cast("long").alias("at"), F.col("f.x").alias("text"))]
    out.append(_line(keys, key, 1, "", -2, F.lit("# Scope of work")))
    out.append(_line(keys, key, 1, "a", 0, s("- Project: ", text("project_id"))))
    out.append(_line(keys, key, 1, "a", 1, s("- Statement: ", text(key))))
    out.append(_line(keys, key, 2, "a", 0, s("- ", text("items"), " items in ", text("divisions"), " divisions and ", text("packages"), " packages.")))
    out.append(_line(keys, key, 2, "a", 1, s("- ", text("d"), " cite drawings, ", text("s"), " specifications, ", text("b"), " both.")))
    admin = F.coalesce(F.col("extraction_method").rlike(ADMIN), F.lit(False))
    lines = sow_lines(items, citations).select("item_id", "line").join(items.select("item_id", key, "division", "code", admin.alias("admin")), "item_id").join(titles, "code", "left")
    work, office = lines.where("NOT admin"), lines.where("admin")
    heads = work.groupBy(key, "division", "code").agg(F.first("title").alias("title"))
    of = lambda *c: F.concat_ws("/", *c)
    out.append(_line(heads.select(key, "division").distinct(), key, 3, F.col("division"), -1, s("### Division ", text("division"))))
    out.append(_line(heads, key, 3, of("division", "code"), -1, s("**", text("code"), " — ", text("title"), "**")))
    out.append(_line(work, key, 3, of("division", "code"), F.col("item_id"), text("line")))
    out.append(_line(exclusions.join(keys.select(key), key), key, 4, "a", 0, s("- ", text("n"), " more are named in bids.")))
    used = lines.groupBy(key, "code").agg(F.count(F.lit(1)).alias("n"), F.first("title").alias("title"))
    out.append(_line(used, key, 6, F.col("code"), 0, s("- **", text("code"), "** — ", text("title"), " (", text("n"), ")")))
    out.append(_line(used.where(is_schedule_section(F.col("code"))), key, 7, of(F.lit("a"), "code"), 0, s("- **", text("code"), "** — ", text("title"))))
    waiting = gaps.join(keys.select(key), key).where(F.col("severity").isin("blocker", "warn") & F.col("description").rlike(SEQUENCING))
    first = waiting.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("gap_id"))).where(F.col("rank") <= SHOWN)
    out.append(_line(first, key, 7, "b", F.col("rank"), s("- ", text("description"))))
    more = waiting.groupBy(key).agg((F.count(F.lit(1)) - SHOWN).alias("n")).where("n > 0")
    out.append(_line(more, key, 7, "c", 0, s("- and ", text("n"), " more")))
    out.append(_line(office.groupBy(key, "code").agg(F.first("title").alias("title")), key, 8, F.col("code"), -1, s("### ", text("code"), " — ", text("title"))))
    out.append(_line(office, key, 8, F.col("code"), F.col("item_id"), text("line")))
    open_ = conflicts.where("status = 'open'").join(keys.select(key), key).groupBy(key).agg(F.count_distinct("conflict_id").alias("n"))
    out.append(_line(open_, key, 9, "a", 0, s("- ", text("n"), " open conflicts")))
    lost = gaps.where("gap_type = 'unresolved_cross_reference'").join(keys.select(key), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out.append(_line(lost, key, 9, "a", 1, s("- ", text("n"), " references without a sheet")))
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return union


_ORDER = ("sow_id", "section", "place", "at")


def write_statements(lines: DataFrame, path: str, files: int | None = None) -> None:
    """``text``: the lines in order over the files part-0, part-1, ... by number; ``manifest``: whose lines a file has.

    A task writes one range of the order to the file of its own number.

    A row of the manifest: file, sow_id, start (its first line in the file), lines, before (its lines in earlier files),
    and the sections that it begins and ends with there.
    """
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(lines.repartitionByRange(n, *_ORDER).withColumn("file", F.spark_partition_id()))
    placed.sortWithinPartitions(*_ORDER).select("text").write.mode("overwrite").text(f"{path}/text")
    own = placed.groupBy("file", "sow_id").agg(F.count(F.lit(1)).alias("lines"), F.min("section").alias("first_section"), F.max("section").alias("last_section"))
    earlier = lambda by, order: F.coalesce(F.sum("lines").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own.withColumns({"start": earlier("file", "sow_id"), "before": earlier("sow_id", "file")}).write.mode("overwrite").parquet(f"{path}/manifest")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """sow_id, n (line of the statement, from 1) and text, from the files and their manifest."""
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    whole = spark.read.text(f"{path}/text", wholetext=True).withColumn("file", number)
    each = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("i", "text"))
    met = each.join(spark.read.parquet(f"{path}/manifest"), "file").where("i >= start AND i < start + lines")
    return met.select("sow_id", (F.col("before") + F.col("i") - F.col("start") + 1).alias("n"), "text")
