"""Tables inside documents: schedules, their rows and the items mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Column words of schedules that define codes, and of schedules that assign them to rooms.
CATALOG = "code mark tag symbol designation item material product name manufacturer mfr brand supplier vendor description spec remarks size sku model pattern style collection".split()
MAPPING = "room room_number room_name room_no space floor flooring floor_finish base wall walls wall_finish wainscot ceiling ceilings ceiling_finish trim soffit".split()
# The order of kinds.
KIND_RANK = {"catalog": 3, "unknown": 2, "mixed": 1, "mapping": 0}
# Unit rules by schedule type, the first that matches counts; untyped schedules take the finish rules.
UNIT_RULES = (
    ("finish", r"\b(TR[0-9]|TN[0-9]|TRANSITION|EDGE PROTECTION|SCHLUTER)\b", "LF"),
    ("finish", r"\b(B[0-9]|BASE TILE|BASE TRIM|WALL BASE|RUBBER BASE)\b", "LF"),
    ("finish", r"\b(WT\d*|WALL TILE|WP\d*|WALL PANEL)\b", "SF"),
    ("finish", r"\b(GWB|GB\d*|GYPSUM|DRYWALL|GYP\.|SHEETROCK)\b", "SF"),
    ("finish", r"\b(ACT|CEILING TILE|ACOUSTICAL CEILING|ACOUSTIC PANEL(?:ING)?|ACOUSTIC SLATS?|ACOUSTIC GRIDS?)\b", "SF"),
    ("finish", r"\b(WOOD SLATS?|DECK(?:ING)?|COMPOSITE DECK)\b", "SF"),
    ("finish", r"\bP\d+\b|\b(?:SHERWIN|BENJAMIN MOORE)\b|\bPAINT\b(?!\s+(?:FINISH|FRAME|GRADE|TYPE|COAT|JOB))", "SF"),
    ("finish", r"\b(LVT|VCT|FT|RF|SC|CT|SEALED CONCRETE|FLOOR TILE|RESILIENT|VINYL|CARPET)\d*\b", "SF"),
    ("equipment", r"\b(LED|LIGHTING|FIXTURE|EMERGENCY|EXIT SIGN)\b", "EA"),
    ("equipment", r"\b(REFRIGERANT LINE|REFRIGERANT PIPING|DUCTWORK MAIN)\b", "LF"),
)
# Types whose rows are single pieces unless a rule says otherwise, types whose rows may be unused circuits, and their words.
PIECES = ("door", "window", "fixture", "equipment", "panel", "plant")
CIRCUITS = ("equipment", "panel")
NO_LOAD = r"\b(SPARE|PROVISIONAL\s+SPACE|PROVISIONAL|RESERVED|FUTURE|BLANK|NO\s+LOAD|UNUSED|EMPTY)\b"


def schedule_type(name: Column) -> Column:
    """The ``x`` of a leading ``[typed:x]``, else null."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(?i)^\s*\[typed:([a-z]+)\]", 1)), F.lit(""))


def stripped_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"(?i)^\s*\[typed:[a-z]+\]", "")))


def schedule_kind(columns: Column) -> Column:
    """catalog, mapping, mixed or unknown, by the words of the column names."""
    names = F.array_distinct(F.transform(columns, lambda c: F.trim(F.regexp_replace(F.lower(c), "-", "_"))))
    hit = lambda words: F.size(F.filter(names, lambda c: c.rlike("(^|_)(" + "|".join(words) + ")$")))
    catalog, mapping = hit(CATALOG), hit(MAPPING)
    return F.when((catalog >= 2) & (mapping == 0), "catalog").when((mapping >= 2) & (catalog == 0), "mapping").when((catalog > 0) & (mapping > 0), "mixed").otherwise("unknown")


def pick_schedule_pass(schedules: DataFrame) -> DataFrame:
    """One of the schedules (ord, page, name, columns) with the same page and stripped name: best kind, then typed, then first."""
    ranks = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind"))
    named = schedules.withColumn("kind", schedule_kind(F.col("columns"))).withColumn("stripped", stripped_name(F.col("name")))
    order = W.partitionBy("page", "stripped").orderBy(F.desc(ranks), schedule_type(F.col("name")).isNull(), "ord")
    return named.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def explode_schedule_rows(schedules: DataFrame) -> DataFrame:
    """One row per schedule row with its text ``From name (row n): column=value; …``; empty cells are left out."""
    rows = schedules.select("ord", "name", "columns", F.posexplode("rows").alias("row_index", "row"))
    cells = F.filter(F.transform("columns", lambda c: F.struct(c.alias("c"), F.try_element_at(F.col("row"), c).alias("v"))), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    text = F.concat(F.lit("From "), "name", F.lit(" (row "), (F.col("row_index") + 1).cast("string"), F.lit("): "), F.array_join(F.transform(cells, lambda x: F.concat(x["c"], F.lit("="), x["v"])), "; "))
    return rows.select("ord", F.col("row_index").cast("long").alias("row_index"), "row", F.size(cells).cast("long").alias("filled"), text.alias("text"))


def skip_rows(rows: DataFrame) -> DataFrame:
    """Adds skip: why a row gives no item (empty_row, circuit_no_load), else null. ``rows``: type, row, filled.

    A circuit has no load where its description, load and remarks are blank or say so.
    """
    said = F.map_filter("row", lambda k, v: F.lower(k).isin("description", "load", "remarks") & v.isNotNull())
    text = F.trim(F.array_join(F.map_values(said), " "))
    no_load = F.col("type").isin(*CIRCUITS) & ((text == "") | text.rlike(f"(?i){NO_LOAD}"))
    return rows.withColumn("skip", F.when(F.col("filled") == 0, "empty_row").when(no_load, "circuit_no_load"))


def unit_override(rows: DataFrame) -> DataFrame:
    """id and unit of rows (id, type, text, and answered, if any): by the first rule of the type, else as answered, else EA for pieces, else null."""
    by_type = {t: [(p, u) for kind, p, u in UNIT_RULES if kind == t] for t, _, _ in UNIT_RULES}
    unit = F.lit(None).cast("string")
    for t, rules in by_type.items():
        own = F.lit(None).cast("string")
        for pattern, value in reversed(rules):
            own = F.when(F.col("text").rlike(f"(?i){pattern}"), value).otherwise(own)
        unit = F.when(F.coalesce("type", F.lit("finish")) == t, own).otherwise(unit)
    answered = F.col("answered") if "answered" in rows.columns else F.lit(None).cast("string")
    return rows.select("id", F.coalesce(unit, answered, F.when(F.col("type").isin(*PIECES), "EA")).alias("unit"))


def row_overlap(description: Column, text: Column) -> Column:
    """Share of a description's words that the row has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"[A-Z0-9]{2,}"), F.lit(0)))
    return F.when(F.size(words(description)) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(words(description), words(text))) / F.size(words(description)), 6))


def mine_schedule_items(rows: DataFrame, schedules: DataFrame, answers: DataFrame, least: float = 0.20) -> DataFrame:
    """Items from per-row answers: division, code, ord, row_index, description, specification, quantity, unit, extraction_method.

    ``rows`` as ``skip_rows`` gives them (ord, row_index, type, text, skip); ``schedules`` (ord, is_quantifiable, division, section,
    default_unit) are answers on whole schedules, of which those that can't be counted or have no division give nothing. ``answers``:
    ord, row_index, description, quantity, unit, specification. A row must exist and not be skipped, and its words must hold a share
    of the description's. The quantity is 1 unless answered; the unit is ``unit_override``'s, else the row's, the schedule's or EA.
    """
    said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    counted = schedules.where(F.col("is_quantifiable") & (F.length(F.trim("division")) >= 2))
    head = F.substring(F.trim("division"), 1, 2)
    counted = counted.select("ord", F.coalesce(said("section"), F.concat(head, F.lit(" 00 00"))).alias("code"), said("default_unit").alias("default_unit"))
    met = rows.where(F.col("skip").isNull()).join(answers.where(said("description").isNotNull()), ["ord", "row_index"]).join(counted, "ord")
    kept = met.where(row_overlap(F.col("description"), F.col("text")) >= least)
    item = F.struct(F.substring("code", 1, 2).alias("division"), "code", "ord", "row_index", F.trim("description").alias("description"), "specification", F.coalesce(said("quantity"), F.lit("1")).alias("quantity"), F.lit("schedule_miner").alias("extraction_method"))
    asked = kept.select(item.alias("id"), "type", F.trim("description").alias("text"), F.coalesce(said("unit"), "default_unit", F.lit("EA")).alias("answered"))
    return unit_override(asked).select("id.*", "unit")
