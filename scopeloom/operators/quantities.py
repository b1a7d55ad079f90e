"""Quantities: units, parsing, resolution between sources, plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Unit aliases, written without case, spaces and dots.
UNITS = {"sf": "SF", "sqft": "SF", "lf": "LF", "linft": "LF", "cy": "CY", "cuyd": "CY", "ea": "EA", "lbs": "LB", "lb": "LB", "pounds": "LB", "pound": "LB", "ton": "TON", "tons": "TON", "gal": "GAL"}
# Patterns of a number and of a quantity.
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?"
QUANTITY = rf"(?i)(?<![\w.])({NUMBER})\s*(SF|sq\.?\s*ft\.?|S\.?F\.?|LF|lin\.?\s*ft\.?|L\.?F\.?|CY|cu\.?\s*yd\.?|C\.?Y\.?|EA|ea\.?|lbs?|pounds?|TON|tons?|GAL|gal\.?)(?![A-Za-z])"
# Plausible range by division and unit.
RANGES = [
    ("03", "CY", 0.5, 50_000), ("03", "SF", 10, 500_000), ("03", "LF", 1, 50_000), ("04", "SF", 10, 200_000), ("04", "EA", 1, 100_000),
    ("05", "TON", 0.1, 5_000), ("05", "LB", 10, 5_000_000), ("05", "LF", 1, 50_000), ("06", "SF", 10, 200_000), ("06", "LF", 1, 100_000),
    ("07", "SF", 10, 500_000), ("07", "LF", 1, 50_000), ("08", "EA", 1, 5_000), ("08", "SF", 1, 50_000), ("09", "SF", 10, 1_000_000),
    ("09", "LF", 1, 100_000), ("09", "EA", 1, 100_000), ("10", "EA", 1, 10_000), ("21", "EA", 1, 50_000), ("21", "LF", 1, 100_000),
    ("22", "EA", 1, 5_000), ("22", "LF", 1, 100_000), ("22", "GAL", 1, 100_000), ("23", "EA", 1, 5_000), ("23", "LF", 1, 100_000),
    ("23", "TON", 0.5, 10_000), ("26", "EA", 1, 100_000), ("26", "LF", 1, 1_000_000), ("31", "CY", 1, 1_000_000), ("31", "SF", 10, 5_000_000),
    ("31", "LF", 1, 200_000), ("32", "SF", 10, 5_000_000), ("32", "LF", 1, 500_000), ("32", "EA", 1, 50_000), ("33", "LF", 1, 1_000_000), ("33", "EA", 1, 50_000),
]
# Units expected in a division.
EXPECTED_UNITS = {"03": "CY SF LF", "04": "SF EA", "05": "TON LB LF EA", "06": "SF LF EA", "07": "SF LF", "08": "EA SF", "09": "SF LF EA", "10": "EA", "21": "EA LF", "22": "EA LF GAL", "23": "EA LF TON", "26": "EA LF", "31": "CY SF LF", "32": "SF LF EA", "33": "LF EA"}
# Sources of a quantity, best first.
PRIORITY = ("schedule_miner_stated", "sonnet_stated", "excerpt_regex")


def canonical_unit(unit: Column) -> Column:
    """A known alias becomes its unit, anything else upper case; empty is null."""
    key = F.regexp_replace(F.lower(unit), r"[ .]", "")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), key)
    return F.when(F.length(unit) > 0, F.coalesce(known, F.upper(unit)))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("double")


def parse_quantity(text: Column) -> Column:
    """Struct (value, unit): the first number with a unit, else a bare number; nulls where neither is there."""
    number, unit = F.regexp_extract(text, QUANTITY, 1), F.regexp_extract(text, QUANTITY, 2)
    bare = F.regexp_extract(text, rf"^\s*({NUMBER})\s*$", 1)
    value = F.when(number != "", _number(F.nullif(number, F.lit("")))).when(bare != "", _number(F.nullif(bare, F.lit(""))))
    return F.struct(value.alias("value"), F.when(number != "", unit).alias("unit"))


def sniff_quantities(excerpt: Column) -> Column:
    """Every number with a unit in a text, as an array of structs (value, unit)."""
    found = lambda g: F.regexp_extract_all(excerpt, F.lit(QUANTITY), F.lit(g))
    return F.zip_with(found(1), found(2), lambda n, u: F.struct(_number(n).alias("value"), canonical_unit(u).alias("unit")))


def quantity_signals(items: DataFrame, citations: DataFrame) -> DataFrame:
    """Every signal of an item's quantity: item_id, value, uom, prio (its place in ``PRIORITY``), ref, pos and detail.

    Signals are the stated quantity (a miner's before a model's; the detail is its text) and the numbers in cited excerpts
    (ref and detail name the citation, pos the number's place in the excerpt). Without a number or a unit there is no signal.
    """
    stated = parse_quantity(F.col("quantity"))
    source = F.when(F.col("extraction_method") == "schedule_miner", 0).otherwise(1)
    own = items.select("item_id", stated["value"].alias("value"), F.coalesce(canonical_unit(stated["unit"]), canonical_unit(F.col("unit"))).alias("uom"), source.alias("prio"), F.lit("").alias("ref"), F.lit(0).alias("pos"), F.col("quantity").alias("detail"))
    own = own.where(F.col("value").isNotNull() & F.col("uom").isNotNull())
    seen = citations.select("item_id", "citation_id", F.posexplode(sniff_quantities(F.col("excerpt"))).alias("pos", "q"))
    seen = seen.select("item_id", F.col("q.value").alias("value"), F.col("q.unit").alias("uom"), F.lit(2).alias("prio"), F.col("citation_id").alias("ref"), "pos", F.col("citation_id").alias("detail"))
    return own.unionByName(seen)


def resolve_quantity(items: DataFrame, citations: DataFrame) -> DataFrame:
    """Per item: qty_value, qty_uom, confidence band, number of signals, and where the value comes from.

    The unit with the best source is chosen; where its values disagree beyond five per cent, the band is ``conflicting`` and
    spread_pct tells by how much (``quantity_signals`` lists them). qty_source is one of ``PRIORITY`` and qty_detail the text or
    citation; both are null without any signal. ``items``: item_id, quantity, unit, extraction_method; ``citations``: citation_id, item_id, excerpt.
    """
    signals = quantity_signals(items, citations)
    by_unit = signals.groupBy("item_id", "uom").agg(
        F.min(F.struct("prio", "ref", "pos", "value", "detail")).alias("best"),
        F.min(F.round("value", 2)).alias("low"),
        F.max(F.round("value", 2)).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    per_item = by_unit.groupBy("item_id").agg(F.min_by(F.struct("uom", "best", "low", "high"), F.struct(F.col("best.prio"), F.col("best.ref"), F.col("best.pos"), "uom")).alias("c"), F.sum("n").alias("signals"))
    prio = F.col("c.best.prio")
    spread = (F.col("c.high") - F.col("c.low")) / F.greatest(F.col("c.low"), F.lit(1.0))
    source = F.get(F.array(*[F.lit(s) for s in PRIORITY]), prio)
    band = F.when(spread > 0.05, "conflicting").when(prio == 0, "high").when((prio == 1) & (F.col("signals") > 1), "high").otherwise("medium")
    joined = items.select("item_id").join(per_item, "item_id", "left")
    return joined.select("item_id", F.col("c.best.value").alias("qty_value"), F.col("c.uom").alias("qty_uom"), F.when(F.col("c").isNull(), "unverified").otherwise(band).alias("qty_confidence"), F.coalesce("signals", F.lit(0)).cast("long").alias("signals"), source.alias("qty_source"), F.col("c.best.detail").alias("qty_detail"), F.when(spread > 0.05, F.round(spread * 100, 1)).alias("spread_pct"))


def _rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    ranges = spark.createDataFrame([(d, u, float(a), float(b)) for d, u, a, b in RANGES], "division string, qty_uom string, low double, high double")
    units = spark.createDataFrame([(d, u.split()) for d, u in EXPECTED_UNITS.items()], "division string, expected array<string>")
    return ranges, units


def quantity_sanity(items: DataFrame) -> DataFrame:
    """Gap rows for items (item_id, division, qty_value, qty_uom) with a wrong unit or an odd amount."""
    ranges, units = _rules(items.sparkSession)
    judged = items.where(F.col("qty_value").isNotNull() & F.col("qty_uom").isNotNull()).join(F.broadcast(units), "division", "left").join(F.broadcast(ranges), ["division", "qty_uom"], "left")
    wrong = F.col("expected").isNotNull() & ~F.array_contains("expected", F.col("qty_uom"))
    odd = (F.col("qty_value") < F.col("low")) | (F.col("qty_value") > F.col("high"))
    severity = F.when(wrong, "blocker").when(odd, "warn")
    return judged.select("item_id", "division", "qty_uom", F.lit("qty_implausible").alias("gap_type"), severity.alias("severity")).where(F.col("severity").isNotNull())
