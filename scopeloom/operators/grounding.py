"""Codes, sheet ids, citations and the admission of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of sheet headers and title blocks.
HEADER_WORDS = (
    "PLAN PLANS SCHEDULE SCHEDULES DETAIL DETAILS ELEVATION ELEVATIONS SECTION SECTIONS LEGEND INDEX COVER GENERAL NOTES SHEET DRAWING "
    "DRAWINGS TITLE BLOCK PARTIAL FOUNDATION FOUNDATIONS FRAMING ROOF FLOOR FLOORS CEILING CEILINGS REFLECTED EXTERIOR INTERIOR STRUCTURAL "
    "ARCHITECTURAL ELECTRICAL PLUMBING MECHANICAL CIVIL FIRE PROTECTION LANDSCAPE SITE LIFE SAFETY EGRESS ENERGY DEMOLITION ENLARGED "
    "OVERALL KEY WALL WALLS BUILDING DOOR DOORS WINDOW WINDOWS FINISH FINISHES CABINET CABINETS MILLWORK STAIR STAIRS RESTROOM RESTROOMS "
    "EQUIPMENT FIXTURE FIXTURES POWER LIGHTING PANEL PANELS DIAGRAM DIAGRAMS RISER ISOMETRIC FIRST SECOND THIRD FOURTH FIFTH GROUND "
    "BASEMENT ATTIC MEZZANINE PROJECT MANUAL VOLUME SET REVISIONS REVISION ISSUED ISSUE DATE BID PERMIT CONSTRUCTION FOR"
).split()
# Words that say nothing about an item.
COMMON_WORDS = (
    "THE AND FOR WITH OF TO PER AT IN ON BY FROM AS OR A AN IS BE SHALL PROVIDE INSTALL SCHEDULE SEE DETAIL SHEET SPEC SPECIFICATION "
    "DRAWINGS GENERAL NOTES PROJECT WORK"
).split()
# Words that look like sheet ids but name a discipline, a kind of drawing or a device.
NOT_SHEETS = (
    *"STRUCTURAL STRUCT ARCHITECTURAL ARCH CIVIL MECHANICAL ELECTRICAL ELEC PLUMBING PLUMB INTERIOR LANDSCAPE FIRE MEP GENERAL HVAC SITE".split(),
    "FIRE PROTECTION",
    *"RCP FFP FP ELEV ELEVATIONS PLAN PLANS DETAIL DETAILS SECTION SECTIONS SCHEDULE SCHEDULES FACP FAAP AHU VAV RTU".split(),
    *"TYP TYPICAL SIM SIMILAR NIC NTS OPP OPPOSITE ABOVE BELOW THIS OTHER OTHERS".split(),
)
# Sheet prefix to discipline.
PREFIX_DISCIPLINE = {"A": "architectural", "S": "structural", "M": "mechanical", "E": "electrical", "P": "plumbing", "FP": "fire-protection", "C": "civil", "L": "landscape", "I": "interior", "G": "general", "T": "general"}
# Phrase endings, taken off in this order.
SHEET_SUFFIXES = (" DRAWINGS", " DRAWING", " DWG", " DWGS", " PLAN", " PLANS", " SHEET", " SHEETS", " SET")

# Patterns of a token and of a sheet line. A token ends where ASCII words do: what ``\b`` takes for a word differs by engine and version.
TOKEN = r"(?<![0-9A-Za-z_])[A-Z0-9][A-Z0-9\-/.]*(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: Signs whose upper case is more than one letter; they stay one sign that is no letter of a token.
MANY_LETTERS = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
SHEET_LINE = r"(?i)^[A-Z]{1,4}\d+(?:\.\d+)?(?:\s*[-—:]?\s+[A-Z0-9 ,&/]+)?$"


def normalize_code(code: Column) -> Column:
    """Six or more digits in a code become ``NN NN NN``; else null."""
    digits = F.regexp_replace(code, r"\D", "")
    return F.when(F.length(digits) >= 6, F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def canonical_code_or_null(code: Column) -> Column:
    """Keep exact ``NN NN NN`` or ``NN`` codes only."""
    return F.when(code.rlike(r"^\d{2}( \d{2} \d{2})?$"), code)


def ground_code(items: DataFrame, taxonomy: DataFrame, code_col: str = "proposed") -> DataFrame:
    """Adds grounded code, division and method by a taxonomy (code, division, ord).

    Exact, else the nearest code of the division (same middle pair first, ties by ``ord``), else unknown.
    Only distinct codes meet the taxonomy, and only codes of their own division.
    """
    canonical = normalize_code(F.col(code_col))
    wanted = items.select(canonical.alias("canonical")).where(F.col("canonical").isNotNull()).distinct().withColumn("division", F.substring("canonical", 1, 2))
    number = lambda c: F.regexp_replace(c, " ", "").cast("int")
    met = wanted.join(taxonomy.select("division", F.col("code").alias("candidate"), "ord"), "division")
    same = (F.substring("candidate", 4, 2) == F.substring("canonical", 4, 2)).cast("int")
    order = W.partitionBy("canonical").orderBy(F.desc(F.col("candidate") == F.col("canonical")), F.desc(same), F.abs(number("candidate") - number("canonical")), "ord")
    best = met.withColumn("n", F.row_number().over(order)).where("n = 1").select("canonical", "candidate")
    joined = items.withColumn("canonical", canonical).join(best, "canonical", "left")
    method = F.when(F.col("candidate") == F.col("canonical"), "exact").when(F.col("candidate").isNotNull(), "snapped").otherwise("division-fallback")
    return joined.withColumns({
        "grounded": F.coalesce("candidate", "canonical", F.trim(code_col)),
        "grounded_division": F.coalesce(F.substring("canonical", 1, 2), F.lit("??")),
        "method": method,
    }).drop("canonical", "candidate")


def nearest_codes(codes: DataFrame, taxonomy: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` taxonomy codes most like each code of its division, by edit distance over the longer length."""
    met = codes.select("code").distinct().withColumn("division", F.substring("code", 1, 2)).join(taxonomy.select("division", F.col("code").alias("candidate")), "division")
    score = F.round(1 - F.levenshtein("code", "candidate") / F.greatest(F.length("code"), F.length("candidate")), 6)
    order = W.partitionBy("code").orderBy(F.desc("score"), "candidate")
    return met.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("code", "candidate", "score", "rank")


def squeezed_sheet(value: Column) -> Column:
    """Upper case, single spaces, phrase endings taken off."""
    s = F.upper(F.trim(F.regexp_replace(value, r"\s+", " ")))
    cut = lambda held, end: F.when(F.endswith(held, end), F.rtrim(F.substring(held, F.lit(1), F.length(held) - F.length(end)))).otherwise(held)
    return F.aggregate(F.array(*[F.lit(x) for x in SHEET_SUFFIXES]), s, cut)


def is_valid_sheet_id(value: Column) -> Column:
    """Whether a text looks like a sheet number, not like the name of a discipline or a device."""
    s = squeezed_sheet(value)
    ok = (s != "") & ~s.isin(list(NOT_SHEETS)) & (s.rlike(r"^[A-Z]{1,3}\-?\d{1,4}([.\-]\d{1,3})?[A-Z]?$") | s.rlike(r"^[A-Z]{1,4}$"))
    return F.coalesce(ok, F.lit(False))


def sheet_id_variants(sheet: Column) -> Column:
    """Ways to write a sheet id: as is, without signs, without leading zeros of its number."""
    upper = F.upper(F.trim(sheet))
    bare = F.regexp_replace(upper, r"[^A-Z0-9]", "")
    return F.array_sort(F.array_distinct(F.array(upper, bare, F.regexp_replace(bare, r"^([A-Z]+)0+(?=\d)", "$1"))))


def match_sheets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two lists of sheet ids through any variant: ord, page of the first match on the right."""
    a = left.select("ord", F.explode(sheet_id_variants(F.col("sheet_id"))).alias("v"))
    b = right.select("page", F.explode(sheet_id_variants(F.col("sheet_id"))).alias("v")).groupBy("v").agg(F.min("page").alias("page"))
    return a.join(b, "v").groupBy("ord").agg(F.min("page").alias("page"))


def discipline_of_sheet(sheet: Column) -> Column:
    """By prefix: ``FP`` first, else the first letter."""
    upper = F.upper(F.trim(sheet))
    table = F.create_map(*[F.lit(x) for kv in PREFIX_DISCIPLINE.items() for x in kv])
    return F.when(upper.startswith("FP"), F.lit(PREFIX_DISCIPLINE["FP"])).otherwise(F.try_element_at(table, F.substring(upper, 1, 1)))


def sheet_manifest(index: DataFrame) -> DataFrame:
    """project_id, place (from 1), sheet_id, discipline of each sheet (project_id, sheet_id, ord) once, where it comes first.

    Blank ids are left out; a sheet without a known prefix is of discipline ``unknown``.
    """
    first = index.where(F.length(F.trim("sheet_id")) > 0).groupBy("project_id", "sheet_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(W.partitionBy("project_id").orderBy("ord", "sheet_id"))
    return first.select("project_id", place.alias("place"), "sheet_id", F.coalesce(discipline_of_sheet(F.col("sheet_id")), F.lit("unknown")).alias("discipline"))


def upper_tokens(text: Column) -> Column:
    """Tokens in upper case, each letter of the text giving one."""
    return F.regexp_extract_all(F.upper(F.translate(text, MANY_LETTERS, "ẞ" * len(MANY_LETTERS))), F.lit(TOKEN), F.lit(0))


def specific_tokens(text: Column) -> Column:
    """Distinct upper-case tokens of two characters or more that say something about an item."""
    found = upper_tokens(F.coalesce(text, F.lit("")))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2)), F.array(*[F.lit(w) for w in COMMON_WORDS]))


def is_header_only(text: Column, max_len: int = 120) -> Column:
    """Short text of at most four lines, each a sheet id or header words only."""
    s = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(s, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = F.array(*[F.lit(w) for w in HEADER_WORDS])
    header = F.forall(lines, lambda x: x.rlike(SHEET_LINE) | ((F.size(upper_tokens(x)) > 0) & (F.size(F.array_except(upper_tokens(x), words)) == 0)))
    return F.when(s == "", True).when(F.length(s) > max_len, False).otherwise((F.size(lines) <= 4) & header)


def citation_verdict(description: Column, chunk: Column, min_overlap: float = 0.10, prose: Column | None = None) -> tuple[Column, Column]:
    """(reason, overlap): EMPTY, HEADER_ONLY, LOW_OVERLAP or '' for a valid citation.

    ``prose`` says which chunks are known to be running text: one like ``For.`` is short, but no header.
    """
    wanted = specific_tokens(description)
    overlap = F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, specific_tokens(chunk))) / F.size(wanted))
    empty = F.coalesce(F.trim(chunk) == "", F.lit(True))
    header = is_header_only(chunk) & ~F.coalesce(F.lit(False) if prose is None else prose, F.lit(False))
    reason = F.when(empty, "EMPTY").when(header, "HEADER_ONLY").when(overlap < min_overlap, "LOW_OVERLAP").otherwise("")
    return reason, F.when(empty | header, F.lit(0.0)).otherwise(F.round(overlap, 6))


def judge_citations(citations: DataFrame, min_overlap: float = 0.10) -> DataFrame:
    """Adds reason and overlap to rows with description, text and, where it is known, prose."""
    reason, overlap = citation_verdict(F.col("description"), F.col("text"), min_overlap, F.col("prose") if "prose" in citations.columns else None)
    return citations.withColumns({"reason": reason, "overlap": overlap})


def admit_candidates(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Per candidate: admitted, why not, and how many citations survive; mined candidates pass unseen.

    ``candidates``: item_id, extraction_method; ``judged``: item_id, reason.
    """
    per = judged.groupBy("item_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("reason") == "").alias("valid"))
    joined = candidates.join(per, "item_id", "left")
    why = F.when(F.col("extraction_method") == "schedule_miner", "").when(F.coalesce("cited", F.lit(0)) == 0, "no_supporting_chunks").when(F.col("valid") == 0, "all_l2_rejected").otherwise("")
    return joined.select("item_id", (why == "").alias("admitted"), why.alias("why"), F.coalesce("valid", F.lit(0)).cast("long").alias("kept"))


def keep_known_citations(claims: DataFrame, pool: DataFrame, least: float = 0.18, least_drawing: float = 0.05) -> DataFrame:
    """Claimed citations (section, item_id, description, chunk_id) against the section's pool (section, chunk_id, text, evidence_type).

    Per item: cited, bad_id (chunks outside the pool), low_overlap (other verdicts against), kept. Words read off drawings
    need less overlap. Items without a kept citation go. A pool may have ``prose``, as of ``citation_verdict``.
    """
    prose = F.col("prose") if "prose" in pool.columns else F.lit(False)
    met = claims.join(pool.select("section", "chunk_id", "text", "evidence_type", prose.alias("prose"), F.lit(True).alias("known")), ["section", "chunk_id"], "left")
    reason, overlap = citation_verdict(F.col("description"), F.col("text"), 0.0, F.col("prose"))
    enough = overlap >= F.when(F.col("evidence_type") == "drawing", least_drawing).otherwise(least)
    known = F.coalesce("known", F.lit(False))
    counted = met.select("item_id", known.alias("known"), (known & (reason == "") & enough).alias("good")).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("cited"), F.count_if(~F.col("known")).alias("bad_id"), F.count_if(F.col("known") & ~F.col("good")).alias("low_overlap"), F.count_if("good").alias("kept")
    )
    return counted.where("kept > 0")


def materialize_items(admitted: DataFrame, citations: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of admitted candidates and of their citations.

    ``admitted``: item_id, code, proposed, description, confidence, ground_method, query; ``citations``: item_id, chunk_id,
    document_id, page_number, doc_type, rerank, text. Items get their section's title, their division's label and the
    provenance of their code; citations the evidence type of their document and an excerpt of 240 characters.
    """
    titles = taxonomy.groupBy("code").agg(F.min("title").alias("section_title"))
    labels = taxonomy.groupBy("division").agg(F.min("division_title").alias("label"))
    division = F.substring("code", 1, 2)
    items = admitted.withColumn("division", division).join(titles, "code", "left").join(labels, "division", "left")
    untitled = F.concat("division", F.lit(" - (untitled)"))
    provenance = F.to_json(F.struct(F.col("query").alias("found_by_query"), F.col("proposed").alias("csi_code_proposed"), F.coalesce("ground_method", F.lit("exact")).alias("ground_method")))
    items = items.select("item_id", "code", "division", F.coalesce("label", untitled).alias("division_label"), "section_title", "description", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), provenance.alias("provenance"))
    evidence = F.when(F.col("doc_type") == "drawing-set", "drawing").when(F.col("doc_type") == "written-spec", "spec").when(F.col("doc_type").isin("bid-quote", "scope-letter"), "bid").otherwise("other")
    kept = citations.join(admitted.select("item_id"), "item_id", "left_semi")
    excerpt = F.nullif(F.substring("text", 1, 240), F.lit(""))
    return items, kept.select("item_id", "chunk_id", "document_id", "page_number", evidence.alias("evidence_type"), "doc_type", "rerank", excerpt.alias("excerpt"))


def audit_citations(items: DataFrame, judged: DataFrame) -> dict[str, DataFrame]:
    """What the verdicts on stored citations (item_id, evidence_type, reason) would do to items (item_id, extraction_method).

    drops: rejected citations by reason, alone and with evidence type or extraction method (null where summed over);
    uncited: items that had citations and keep none; demoted: items that had spec and drawing evidence and keep
    some, but not both. Citations of unknown items are not counted; missing types and methods are ``?``.
    """
    known = judged.join(items.select("item_id", F.coalesce("extraction_method", F.lit("?")).alias("extraction_method")), "item_id").withColumn("evidence_type", F.coalesce("evidence_type", F.lit("?")))
    dropped = known.where("reason <> ''")
    drops = dropped.groupingSets([["reason"], ["reason", "evidence_type"], ["reason", "extraction_method"]], "reason", "evidence_type", "extraction_method").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    has = lambda kind, kept="true": F.max(F.expr(f"evidence_type = '{kind}' AND {kept}"))
    state = known.groupBy("item_id").agg(F.count_if(F.col("reason") == "").alias("kept"), (has("spec") & has("drawing")).alias("was_both"), (has("spec", "reason = ''") & has("drawing", "reason = ''")).alias("is_both"))
    return {"drops": drops, "uncited": state.where("kept = 0").select("item_id"), "demoted": state.where("kept > 0 AND was_both AND NOT is_both").select("item_id")}


def vote_rollup(votes: DataFrame) -> DataFrame:
    """Accept with two accepting votes or more; confidence is the mean support, 0.5 for an empty one."""
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("confidence"))
    support = F.when(F.col("accept"), conf).otherwise(1 - conf)
    return votes.groupBy("candidate_id").agg((F.count_if(F.col("accept")) >= 2).alias("accepted"), F.round(F.avg(support), 6).alias("confidence"))


def select_divisions(relevance: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Divisions that are relevant in effect and known to the taxonomy."""
    from scopeloom.operators.evidence import effective_relevance

    return relevance.where(effective_relevance()).join(taxonomy.select("division").distinct(), "division", "left_semi").select("project_id", "division")

# Rule table of our own: discipline and its divisions.
DISCIPLINES = {"general": "00 01", "structural": "03 04 05", "architectural": "06 07 08 10", "interior": "09 12", "fire-protection": "21", "plumbing": "22", "mechanical": "23 25", "electrical": "26 27 28", "civil": "31 33", "landscape": "32"}


def discipline_of_division(division: Column) -> Column:
    """The discipline that owns a division, else null."""
    table = F.create_map(*[F.lit(x) for d, ns in DISCIPLINES.items() for n in ns.split() for x in (n, d)])
    return F.try_element_at(table, F.lpad(division, 2, "0"))
