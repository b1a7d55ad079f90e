"""Evidence rollups, tiers, relevance and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the confidence from which evidence is strong.
STRONG = 0.85
# Weights of the trust score.
TRUST_WEIGHTS = {"bilateral_coverage": 0.30, "extraction_confidence_avg": 0.15, "link_judge_pass_rate": 0.15, "spec_section_coverage": 0.15, "ocr_text_coverage": 0.10, "schedule_extraction_validity": 0.05, "document_version_consistency": 0.10}


def effective_relevance() -> Column:
    """The override where there is one, else the verdict."""
    return F.when(F.col("overridden"), F.col("override_value")).otherwise(F.col("is_relevant"))


def relevance_gate(rows: DataFrame) -> DataFrame:
    """Relevant without evidence becomes not relevant, unless the project has no evidence at all."""
    project = rows.groupBy("project_id").agg(F.max("has_evidence").alias("any_evidence"))
    joined = rows.join(project, "project_id")
    veto = F.col("is_relevant") & F.col("any_evidence") & ~F.col("has_evidence")
    return joined.select("project_id", "division", (F.col("is_relevant") & ~veto).alias("is_relevant"), veto.alias("vetoed"))


def reevaluate_relevance(rows: DataFrame) -> DataFrame:
    """Apply the gate again; an override that forces a division without evidence or verdict is cleared."""
    gated = relevance_gate(rows).select("project_id", "division", F.col("is_relevant").alias("gated"))
    clear = F.col("overridden") & F.col("override_value") & ~F.col("is_relevant") & ~F.col("has_evidence")
    out = rows.withColumn("clear", F.coalesce(clear, F.lit(False))).join(gated, ["project_id", "division"])
    return out.select("project_id", "division", F.col("gated").alias("is_relevant"), (F.col("overridden") & ~F.col("clear")).alias("overridden"))


def apply_link_verdicts(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pass where ENTAILED (any case); unjudged citations stay null. ``verdicts``: citation_id, verdict, confidence."""
    joined = citations.join(verdicts, "citation_id", "left")
    return joined.withColumns({"link_pass": F.upper("verdict") == "ENTAILED", "link_score": F.col("confidence")}).drop("verdict", "confidence")


def evidence_rollup(citations: DataFrame, counts: bool = False) -> DataFrame:
    """Per item: evidence types, best rerank, link pass (null: none judged; false: any failed).

    With ``counts`` also ``judged`` and ``passed``, so that ``trust_components`` needs no second pass over the citations.
    """
    # sums of fixed width are hashed; what is collected is one row per item and type
    typed = citations.groupBy("item_id", "evidence_type").agg(F.max("rerank").alias("rerank"), F.bool_and("link_pass").alias("link_pass"), F.count("link_pass").alias("judged"), F.count_if("link_pass").alias("passed"))
    sums = [F.sum(c).alias(c) for c in ("judged", "passed")] if counts else []
    return typed.groupBy("item_id").agg(F.array_sort(F.collect_set("evidence_type")).alias("types"), F.round(F.max("rerank"), 6).alias("rerank"), F.bool_and("link_pass").alias("link_pass"), *sums)


def pattern_match() -> Column:
    """Whether the evidence types meet the expected pattern."""
    has = lambda t: F.array_contains("types", t)
    return F.coalesce(F.when(F.col("expected") == "spec_only", has("spec")).when(F.col("expected") == "drawing_only", has("drawing")).otherwise(has("spec") & has("drawing")), F.lit(False))


def evidence_tier(items: DataFrame, rollup: DataFrame) -> DataFrame:
    """Adds pattern_match and tier to items (item_id, expected, confidence)."""
    joined = items.join(rollup, "item_id", "left").withColumn("pattern_match", pattern_match())
    conf = F.coalesce("confidence", F.lit(0.0))
    failed = F.coalesce(~F.col("link_pass"), F.lit(False))
    strong = F.coalesce(F.col("rerank") >= 0.5, F.lit(False))
    tier = F.when(F.col("pattern_match") & (conf >= STRONG) & ~failed, "EXPLICITLY_CITED").when(F.col("pattern_match") | ((conf >= STRONG) & strong), "INFERRED_HIGH_CONFIDENCE").otherwise("INFERRED_LOW_CONFIDENCE")
    return joined.withColumn("tier", tier)


def project_sides(documents: DataFrame) -> DataFrame:
    """Per project: whether its documents (project_id, doc_type) hold specs (project_spec) and drawings (project_drawing)."""
    has = lambda kind: F.coalesce(F.bool_or(F.col("doc_type") == kind), F.lit(False))
    return documents.groupBy("project_id").agg(has("written-spec").alias("project_spec"), has("drawing-set").alias("project_drawing"))


def spec_divisions(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """project_id and division of all divisions that section chunks of written specs head.

    ``chunks``: project_id, document_id, chunk_type, text.
    """
    specs = documents.where("doc_type = 'written-spec'").select("document_id").distinct()
    headed = lambda group: F.regexp_extract_all("text", F.lit(SIDE_HEADING), F.lit(group))
    heads = chunks.where("chunk_type = 'spec_section'").join(specs, "document_id", "left_semi").select("project_id", F.explode(F.array_distinct(F.concat(headed(1), headed(2)))).alias("found"))
    return heads.where("found <> ''").select("project_id", F.lpad("found", 2, "0").alias("division")).distinct()


def downgrade_pattern(items: DataFrame, projects: DataFrame, specs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Bilateral becomes one-sided where the project, or else the division in it, can supply one side only.

    ``items``: project_id, division, expected and any others; ``projects`` as ``project_sides`` gives them, ``specs`` as
    ``spec_divisions`` does. Drawings, where the project has any, may show every division of the ``taxonomy`` (division).
    With neither side, or without a division, the pattern stays.
    """
    is_true = lambda name: F.coalesce(name, F.lit(False))
    headed = specs.select("project_id", "division").distinct().withColumn("has_spec", F.lit(True))
    known = taxonomy.select("division").distinct().withColumn("has_drawing", F.lit(True))
    joined = items.join(projects, "project_id", "left").join(headed, ["project_id", "division"], "left").join(known, "division", "left")
    both = is_true("project_spec") & is_true("project_drawing")
    spec, drawing = (F.when(both, is_true(own)).otherwise(is_true(whole)) for own, whole in (("has_spec", "project_spec"), ("has_drawing", "project_drawing")))
    one = F.when(spec & ~drawing, "spec_only").when(drawing & ~spec, "drawing_only")
    new = F.when(F.col("expected") == "bilateral", F.coalesce(one, F.col("expected"))).otherwise(F.col("expected"))
    return joined.withColumn("expected", new).select(*items.columns)


def flag_for_review(items: DataFrame, least: float = 0.60) -> DataFrame:
    """Items of low confidence or with conflicting quantities, with the reasons."""
    low, odd = F.coalesce(F.col("confidence") < least, F.lit(False)), F.coalesce(F.col("qty_confidence") == "conflicting", F.lit(False))
    return items.where(low | odd).withColumn("reasons", F.concat_ws("; ", F.when(low, "low confidence"), F.when(odd, "conflicting quantity")))


def apply_review_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """keep, revised (given fields overwrite, confidence at least 0.85) or rejected (kept and marked)."""
    joined = items.join(verdicts, "item_id", "left")
    revised = F.coalesce(F.col("verdict") == "revised", F.lit(False))
    return joined.select(
        "item_id",
        F.when(revised, F.coalesce("new_description", "description")).otherwise(F.col("description")).alias("description"),
        F.when(revised, F.greatest("confidence", F.lit(STRONG))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("verdict") == "rejected", "rejected").otherwise(F.col("review_status")).alias("review_status"),
    )


def sum_region_counts(answers: DataFrame) -> DataFrame:
    """Per sheet and item: summed counts of found regions, best confidence, distinct places; counts of 0 or less are ignored."""
    good = answers.where((F.col("count") > 0) & F.col("item_id").isNotNull())
    return good.groupBy("sheet", "item_id").agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("place")), "|").alias("places"))


def version_consistency(revisions: DataFrame) -> DataFrame:
    """Per project: the share of sheets whose documents agree on the newest revision."""
    # a greatest text is found by sorting, so repeated rows go first, by hashing; a plain distinct() below a maximum would be optimised away
    told = revisions.groupBy("project_id", "sheet_id", "document_id", "rev_number").agg(F.count(F.lit(1)).alias("rows")).where("rows > 0")
    newest = told.groupBy("project_id", "sheet_id", "document_id").agg(F.max("rev_number").alias("rev"))
    sheets = newest.groupBy("project_id", "sheet_id").agg(F.count_distinct("rev").alias("n"))
    return sheets.groupBy("project_id").agg(F.round(F.avg((F.col("n") == 1).cast("double")), 4).alias("document_version_consistency"))


def trust_score(runs: DataFrame) -> DataFrame:
    """Adds score and tier to runs that carry the seven components; a missing one counts as neutral.

    A run whose n_items, where the column is there, is 0 scores 0.
    """
    neutral = {"link_judge_pass_rate": 0.5, "bilateral_coverage": 0.0, "extraction_confidence_avg": 0.0}
    score = sum((F.round(F.coalesce(c, F.lit(neutral.get(c, 1.0))), 4) * w for c, w in TRUST_WEIGHTS.items()), F.lit(0.0))
    tier = F.when(F.col("score") >= 0.8, "GREEN").when(F.col("score") >= 0.6, "YELLOW").otherwise("RED")
    if "n_items" in runs.columns:
        score = F.when(F.col("n_items") > 0, score).otherwise(0.0)
    return runs.withColumn("score", F.round(score, 4)).withColumn("tier", tier)


# Words of administrative and quality items.
ADMIN_WORDS = (
    "submittal|submittals|mockup|mockups|warranty|warranties|closeout|punch list|shop drawing|shop drawings|quality control|quality assurance|"
    "testing requirement|testing requirements|test report|permit|permits|bond|bonds|mobilization|demobilization|cleanup|clean-up|general cleanup|"
    "final cleaning|dumpster|dumpsters|site clean|supervision|general conditions|overhead|as-built|as-builts|operation and maintenance manual|"
    "o&m manual|o&m manuals|schedule of values|pay application|insurance|indemnification"
)
# Disciplines whose sheets often show another's items.
NEIGHBOURS = {"architectural": ("interior",), "interior": ("architectural",), "civil": ("site",)}
# Fixed value: headings that name a division.
SIDE_HEADING = r"(?i)\b(?:DIVISION\s+0*(\d{1,2})|SECTION\s+(\d{2})\s\d{2}\s\d{2})\b"
# Sections whose evidence is on drawings only, and divisions with specs only.
DRAWING_ONLY = ("02 41 00", "02 41 13", "02 41 16", "02 41 19", "02 42 00", "31 10 00", "31 11 00", "33 05 33.13")
SPEC_ONLY_DIVISIONS = ("01",)


def is_admin(description: Column) -> Column:
    return F.coalesce(description.rlike(rf"(?i)\b(?:{ADMIN_WORDS})\b"), F.lit(False))


def expected_pattern(code: Column, description: Column) -> Column:
    """Admin words mean spec_only; then the section, its ``NN NN 00`` family, its division; else bilateral."""
    own = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    family = F.concat(F.substring(own, 1, 5), F.lit(" 00"))
    return F.when(is_admin(description), "spec_only").when(own.isin(*DRAWING_ONLY) | family.isin(*DRAWING_ONLY), "drawing_only").when(F.substring(own, 1, 2).isin(*SPEC_ONLY_DIVISIONS), "spec_only").otherwise("bilateral")


def corpus_evidence(chunks: DataFrame, sheets: DataFrame) -> DataFrame:
    """project_id and key of all that the corpus speaks of: divisions named in headings, disciplines of sheets, and ``general``."""
    from scopeloom.operators.grounding import discipline_of_sheet

    heads = F.regexp_extract_all("text", F.lit(r"(?:DIVISION|SECTION) (\d{1,2})"), F.lit(1))
    named = chunks.select("project_id", F.explode(heads).alias("key")).select("project_id", F.lpad("key", 2, "0").alias("key"))
    drawn = sheets.select("project_id", discipline_of_sheet(F.col("sheet_id")).alias("key")).where(F.col("key").isNotNull())
    drawn = drawn.withColumn("key", F.when(F.col("key") == "landscape", "site").otherwise(F.col("key")))
    always = chunks.select("project_id").distinct().withColumn("key", F.lit("general"))
    return named.unionByName(drawn).unionByName(always).distinct()


def items_for_sheets(items: DataFrame, sheets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with the sheets that may show them: item_id, sheet_id, page, chunk_id.

    ``items`` (item_id, project_id, code, description, extraction_method) that are administrative or quality items, by their
    words or their method, are left out. An item's discipline is its division's; ``NEIGHBOURS`` names others whose sheets count
    too. A sheet (project_id, sheet_id, document_id, page) stands on its first page; its chunk there is a page summary, if there
    is one, else the first chunk, else null. ``chunks``: document_id, page_number, chunk_id, chunk_type.
    """
    from scopeloom.operators.grounding import discipline_of_division, discipline_of_sheet

    site = lambda c: F.when(c == "landscape", "site").otherwise(c)
    metas = sheets.groupBy("project_id", "sheet_id").agg(F.min(F.struct("page", "document_id")).alias("at"))
    metas = metas.select("project_id", "sheet_id", "at.page", "at.document_id", site(discipline_of_sheet(F.col("sheet_id"))).alias("discipline")).where(F.col("discipline").isNotNull())
    best = chunks.groupBy("document_id", F.col("page_number").alias("page")).agg(F.min_by("chunk_id", F.struct(F.col("chunk_type") != "page_summary", "chunk_id")).alias("chunk_id"))
    own = site(discipline_of_division(F.substring("code", 1, 2)))
    near = F.create_map(*[x for d, others in NEIGHBOURS.items() for x in (F.lit(d), F.array(*[F.lit(o) for o in others]))])
    kind = F.element_at(F.split(F.coalesce("extraction_method", F.lit("")), "[:/]"), -1)
    shown = items.where(~is_admin(F.col("description")) & ~kind.isin("admin", "qc")).select("item_id", "project_id", own.alias("own")).where(F.col("own").isNotNull())
    asked = shown.select("item_id", "project_id", F.explode(F.concat(F.array("own"), F.coalesce(F.try_element_at(near, F.col("own")), F.array().cast("array<string>")))).alias("discipline"))
    placed = metas.join(best, ["document_id", "page"], "left")
    return asked.join(placed, ["project_id", "discipline"]).select("item_id", "sheet_id", "page", "chunk_id")


def symbol_lookup(glyphs: DataFrame, symbols: DataFrame) -> DataFrame:
    """glyphs (id, glyph, discipline) → code where it is unambiguous; rows of the same discipline are preferred.

    ``symbols``: glyph, code, discipline.
    """
    norm = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    # a glyph's codes are one code when the least is the greatest, so its symbols are two codes by discipline, never a list
    ends = lambda lo, hi, *names: (F.min(lo).alias(names[0]), F.max(hi).alias(names[1]))
    owned = symbols.groupBy(norm(F.col("glyph")).alias("g"), F.col("discipline").alias("own")).agg(*ends("code", "code", "lo", "hi"))
    every = owned.groupBy("g").agg(*ends("lo", "hi", "any_lo", "any_hi"))
    asked = glyphs.select("id", "discipline", norm(F.col("glyph")).alias("g"))
    near = owned.select("g", F.col("own").alias("discipline"), F.col("lo").alias("near_lo"), F.col("hi").alias("near_hi"))
    met = asked.join(near, ["g", "discipline"], "left").join(every, "g", "left")
    per = met.groupBy("id").agg(*ends("near_lo", "near_hi", "near_lo", "near_hi"), *ends("any_lo", "any_hi", "any_lo", "any_hi"))
    one = lambda side: F.when(F.col(f"{side}_lo") == F.col(f"{side}_hi"), F.col(f"{side}_lo"))
    return per.select("id", F.when(F.col("near_lo").isNotNull(), one("near")).otherwise(one("any")).alias("code"))


def backfill_legend(rows: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Fill missing code hints of legend rows (id, code) from a lookup (id, code)."""
    return rows.join(looked_up.select("id", F.col("code").alias("found")), "id", "left").select("id", F.coalesce("code", "found").alias("code"))


def legend_candidates(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Sheets that may hold a legend, by title or number, from an index and from pages; the index comes first."""
    hint = F.coalesce(F.col("title").rlike(r"(?i)legend|symbol|abbreviation"), F.lit(False)) | F.upper("sheet_id").rlike(r"^G|-?00[12]$")
    tagged = index.where(hint).withColumn("prio", F.lit(0)).unionByName(pages.where(hint).withColumn("prio", F.lit(1)))
    norm = F.upper(F.regexp_replace("sheet_id", r"[^A-Za-z0-9]", ""))
    from pyspark.sql import Window as W

    order = W.partitionBy("document_id", norm).orderBy("prio", "ord")
    return tagged.withColumn("n", F.row_number().over(order)).where("n = 1").select("document_id", "sheet_id", "prio", "ord")
