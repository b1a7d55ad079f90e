"""Queries of the evidence, gap and package operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scopeloom.operators import evidence as E
from scopeloom.operators import gaps as G
from scopeloom.operators import packages as P
from scopeloom.operators import quantities as Q
from scopeloom.operators import statement as D
from scopeloom.operators import trust as T
from scopeloom.plans.fixtures import citation_keys, folder, view, with_views
from scopeloom.plans.grounding_queries import _RESOLVED, _SANITY, quantity_sanity
from scopeloom.plans.registry import register


@register("effective_relevance", with_views("f_relevance") + " SELECT project_id, division, CASE WHEN overridden THEN override_value ELSE is_relevant END AS relevant FROM f_relevance")
def effective_relevance(spark, sf):
    return view(spark, sf, "f_relevance").select("project_id", "division", E.effective_relevance().alias("relevant"))


_GATE = ", p AS (SELECT project_id, bool_or(has_evidence) AS any_evidence FROM f_relevance GROUP BY project_id), g AS (SELECT *, is_relevant AND any_evidence AND NOT has_evidence AS vetoed FROM f_relevance JOIN p USING (project_id))"


@register("relevance_gate", with_views("f_relevance") + _GATE + " SELECT project_id, division, is_relevant AND NOT vetoed AS is_relevant, vetoed FROM g")
def relevance_gate(spark, sf):
    return E.relevance_gate(view(spark, sf, "f_relevance"))


@register("reevaluate_relevance", with_views("f_relevance") + _GATE + " SELECT project_id, division, is_relevant AND NOT vetoed AS is_relevant, overridden AND NOT coalesce(overridden AND override_value AND NOT is_relevant AND NOT has_evidence, false) AS overridden FROM g")
def reevaluate_relevance(spark, sf):
    return E.reevaluate_relevance(view(spark, sf, "f_relevance"))


@register("apply_link_verdicts", with_views("f_citations") + " SELECT citation_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id % 2 = 0 END AS link_pass, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 0.75 END::DOUBLE AS link_score FROM f_citations")
def apply_link_verdicts(spark, sf):
    c = citation_keys(spark, sf)
    verdicts = c.where("item_id % 3 <> 0").select("citation_id", F.expr("CASE WHEN item_id % 2 = 0 THEN 'Entailed' ELSE 'NEUTRAL' END").alias("verdict"), F.lit(0.75).alias("confidence"))
    return E.apply_link_verdicts(c, verdicts).select("citation_id", "link_pass", "link_score")


_ROLL = ", r AS (SELECT item_id, list_sort(list_distinct(list(evidence_type))) AS types, round(max(rerank), 6) AS rerank, bool_and(link_pass) AS link_pass FROM f_citations GROUP BY item_id)"


@register("evidence_rollup", with_views("f_citations") + _ROLL + " SELECT item_id, array_to_string(types, ',') AS types, rerank, link_pass FROM r")
def evidence_rollup(spark, sf):
    return E.evidence_rollup(view(spark, sf, "f_citations")).withColumn("types", F.array_join("types", ","))


_TIER = _ROLL + """, m AS (SELECT i.*, r.rerank, r.link_pass, coalesce(CASE expected WHEN 'spec_only' THEN list_contains(types, 'spec') WHEN 'drawing_only' THEN list_contains(types, 'drawing') ELSE list_contains(types, 'spec') AND list_contains(types, 'drawing') END, false) AS pattern_match FROM f_items i LEFT JOIN r USING (item_id)),
tiered AS (SELECT *, CASE WHEN pattern_match AND coalesce(confidence, 0) >= 0.85 AND NOT coalesce(NOT link_pass, false) THEN 'EXPLICITLY_CITED' WHEN pattern_match OR coalesce(confidence, 0) >= 0.85 AND coalesce(rerank >= 0.5, false) THEN 'INFERRED_HIGH_CONFIDENCE' ELSE 'INFERRED_LOW_CONFIDENCE' END AS tier FROM m)"""


@register("evidence_tier", with_views("f_items", "f_citations") + _TIER + " SELECT item_id, pattern_match, tier FROM tiered")
def evidence_tier(spark, sf):
    return E.evidence_tier(view(spark, sf, "f_items"), E.evidence_rollup(view(spark, sf, "f_citations"))).select("item_id", "pattern_match", "tier")


#: One project without written specs, one without drawings, two with both.
_SIDED = "CASE WHEN project_id = 1 AND doc_type = 'written-spec' OR project_id = 2 AND doc_type = 'drawing-set' THEN 'other' ELSE doc_type END"


@register("downgrade_pattern", with_views("f_items", "f_documents", "f_chunks", "f_taxonomy") + f""", d AS (SELECT document_id, project_id, {_SIDED} AS doc_type FROM f_documents),
p AS (SELECT project_id, bool_or(doc_type = 'written-spec') AS ps, bool_or(doc_type = 'drawing-set') AS pd FROM d GROUP BY project_id),
h AS (SELECT project_id, unnest(list_concat(regexp_extract_all(text, '{E.SIDE_HEADING}', 1), regexp_extract_all(text, '{E.SIDE_HEADING}', 2))) AS found FROM f_chunks WHERE chunk_type = 'spec_section' AND document_id IN (SELECT document_id FROM d WHERE doc_type = 'written-spec')),
s AS (SELECT DISTINCT project_id, lpad(found, 2, '0') AS division, true AS spec FROM h WHERE found <> ''), x AS (SELECT DISTINCT division, true AS drawn FROM f_taxonomy),
j AS (SELECT item_id, expected, coalesce(CASE WHEN ps AND pd THEN spec ELSE ps END, false) AS spec, coalesce(CASE WHEN ps AND pd THEN drawn ELSE pd END, false) AS drawn FROM f_items LEFT JOIN p USING (project_id) LEFT JOIN s USING (project_id, division) LEFT JOIN x USING (division))
SELECT item_id, CASE WHEN expected = 'bilateral' AND spec AND NOT drawn THEN 'spec_only' WHEN expected = 'bilateral' AND drawn AND NOT spec THEN 'drawing_only' ELSE expected END AS expected FROM j""")
def downgrade_pattern(spark, sf):
    documents = view(spark, sf, "f_documents").select("document_id", "project_id", F.expr(_SIDED).alias("doc_type"))
    specs = E.spec_divisions(documents, view(spark, sf, "f_chunks"))
    return E.downgrade_pattern(view(spark, sf, "f_items"), E.project_sides(documents), specs, view(spark, sf, "f_taxonomy")).select("item_id", "expected")


@register("flag_for_review", with_views("f_items", "f_citations") + _RESOLVED + """ SELECT item_id, array_to_string([x FOR x IN [CASE WHEN confidence < 0.6 THEN 'low confidence' END, CASE WHEN qty_confidence = 'conflicting' THEN 'conflicting quantity' END] IF x IS NOT NULL], '; ') AS reasons
FROM f_items JOIN resolved USING (item_id) WHERE confidence < 0.6 OR qty_confidence = 'conflicting'""")
def flag_for_review(spark, sf):
    items = view(spark, sf, "f_items")
    return E.flag_for_review(items.join(Q.resolve_quantity(items, view(spark, sf, "f_citations")).select("item_id", "qty_confidence"), "item_id")).select("item_id", "reasons")


@register("apply_review_verdicts", with_views("f_items") + """ SELECT item_id, CASE WHEN item_id % 4 = 0 AND item_id % 8 = 0 THEN 'new text' ELSE description END AS description, CASE WHEN item_id % 4 = 0 THEN greatest(confidence, 0.85) ELSE confidence END AS confidence,
CASE WHEN item_id % 4 = 1 THEN 'rejected' ELSE review_status END AS review_status FROM f_items""")
def apply_review_verdicts(spark, sf):
    items = view(spark, sf, "f_items")
    verdicts = items.where("item_id % 4 < 2").select("item_id", F.expr("CASE WHEN item_id % 4 = 0 THEN 'revised' ELSE 'rejected' END").alias("verdict"), F.expr("CASE WHEN item_id % 8 = 0 THEN 'new text' END").alias("new_description"))
    return E.apply_review_verdicts(items, verdicts)


@register("sum_region_counts", with_views("f_citations") + ", a AS (SELECT sheet, item_id, item_id % 5 - 1 AS c, rerank, evidence_type FROM f_citations) SELECT sheet, item_id, sum(c)::BIGINT AS count, max(rerank) AS confidence, array_to_string(list_sort(list_distinct(list(evidence_type))), '|') AS places FROM a WHERE c > 0 GROUP BY ALL")
def sum_region_counts(spark, sf):
    answers = view(spark, sf, "f_citations").select("sheet", "item_id", (F.col("item_id") % 5 - 1).alias("count"), F.col("rerank").alias("confidence"), F.col("evidence_type").alias("place"))
    return E.sum_region_counts(answers)


_VERSIONS = ", n AS (SELECT project_id, sheet_id, document_id, max(rev_number) AS rev FROM f_revisions GROUP BY ALL), s AS (SELECT project_id, sheet_id, count(DISTINCT rev) AS k FROM n GROUP BY ALL), versions AS (SELECT project_id, round(avg(CAST(k = 1 AS INT)), 4) AS document_version_consistency FROM s GROUP BY project_id)"


@register("version_consistency", with_views("f_revisions") + _VERSIONS + " SELECT * FROM versions")
def version_consistency(spark, sf):
    return E.version_consistency(view(spark, sf, "f_revisions"))


_REL = ", rel AS (SELECT project_id, division FROM f_relevance WHERE CASE WHEN overridden THEN override_value ELSE is_relevant END), runs AS (SELECT DISTINCT run_id, run_id AS project_id FROM f_items)"


#: Every third schedule has no type, every fifth no rows.
_SCHEDULED = "SELECT p_partkey % 4 AS project_id, CASE WHEN p_partkey % 3 = 0 THEN 'Door' ELSE '[typed:door] Door' END AS name, p_partkey % 5 AS n_rows FROM part"
_TRUST_VIEWS = ("f_items", "f_citations", "f_pages", "f_documents", "f_relevance", "f_taxonomy", "f_revisions")
_TRUST = _TIER + _VERSIONS + _REL + f""", i AS (SELECT run_id, round(avg(CAST(pattern_match AS INT)), 4) AS a, round(avg(confidence), 4) AS b FROM tiered GROUP BY run_id),
j AS (SELECT item_id % 4 AS run_id, round(avg(CAST(link_pass AS INT)), 4) AS c FROM f_citations WHERE link_pass IS NOT NULL GROUP BY 1),
want AS (SELECT DISTINCT run_id, code FROM runs JOIN rel USING (project_id) JOIN f_taxonomy USING (division) WHERE NOT ends_with(code, ' 00 00')),
l AS (SELECT run_id, round(avg(CAST((run_id, code) IN (SELECT run_id, code FROM f_items) AS INT)), 4) AS d FROM want GROUP BY run_id),
o AS (SELECT project_id AS run_id, round(avg(CAST(p.text IS NOT NULL AS INT)), 4) AS e FROM f_pages p JOIN f_documents USING (document_id) WHERE doc_type IN ('written-spec', 'bid-quote', 'scope-letter') GROUP BY project_id),
k AS (SELECT project_id AS run_id, round(avg(CAST(n_rows > 0 AS INT)), 4) AS f FROM ({_SCHEDULED}) WHERE starts_with(name, '[typed:') GROUP BY project_id),
t AS (SELECT i.run_id, a, b, coalesce(c, 0.5) AS c, coalesce(d, 1) AS d, coalesce(e, 1) AS e, coalesce(f, 1) AS f, coalesce(document_version_consistency, 1) AS g, round(a * 0.30 + b * 0.15 + coalesce(c, 0.5) * 0.15 + coalesce(d, 1) * 0.15 + coalesce(e, 1) * 0.10 + coalesce(f, 1) * 0.05 + coalesce(document_version_consistency, 1) * 0.10, 4) AS score
FROM i LEFT JOIN j USING (run_id) LEFT JOIN l USING (run_id) LEFT JOIN o USING (run_id) LEFT JOIN k USING (run_id) LEFT JOIN versions v ON v.project_id = i.run_id)"""


def _components(spark, sf):
    runs, relevant, items = _gap_inputs(spark, sf)
    tiered = E.evidence_tier(items, E.evidence_rollup(view(spark, sf, "f_citations"), counts=True))
    schedules = spark.sql(_SCHEDULED.replace("FROM part", "FROM {part}"), part=view(spark, sf, "part"))
    return T.trust_components(runs, tiered, None, relevant, view(spark, sf, "f_taxonomy"), view(spark, sf, "f_pages"), view(spark, sf, "f_documents"), schedules, view(spark, sf, "f_revisions"))


@register("trust_components", with_views(*_TRUST_VIEWS) + _TRUST + " SELECT run_id, a AS bilateral_coverage, b AS extraction_confidence_avg, c AS link_judge_pass_rate, d AS spec_section_coverage, e AS ocr_text_coverage, f AS schedule_extraction_validity, g AS document_version_consistency FROM t")
def trust_components(spark, sf):
    return _components(spark, sf).select("run_id", *[F.round(c, 4).alias(c) for c in E.TRUST_WEIGHTS])


@register("trust_score", with_views(*_TRUST_VIEWS) + _TRUST + " SELECT run_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'GREEN' WHEN score >= 0.6 THEN 'YELLOW' ELSE 'RED' END AS tier FROM t")
def trust_score(spark, sf):
    return E.trust_score(_components(spark, sf)).select("run_id", "score", "tier")


def _gap_inputs(spark, sf):
    items = view(spark, sf, "f_items")
    runs = items.select("run_id", F.col("run_id").alias("project_id")).distinct()
    relevant = view(spark, sf, "f_relevance").where(E.effective_relevance()).select("project_id", "division")
    return runs, relevant, items


_MISSING_D = " SELECT run_id, 'missing_division' AS gap_type, 'blocker' AS severity, division, division AS subject FROM runs JOIN rel USING (project_id) WHERE (run_id, division) NOT IN (SELECT run_id, division FROM f_items)"


@register("gap_missing_division", with_views("f_items", "f_relevance") + _REL + _MISSING_D)
def gap_missing_division(spark, sf):
    runs, relevant, items = _gap_inputs(spark, sf)
    return G.gap_missing_division(runs, relevant, items)


_MISSING_S = """ SELECT run_id, 'missing_section' AS gap_type, 'warn' AS severity, t.division, t.code AS subject FROM runs JOIN rel USING (project_id) JOIN f_taxonomy t ON t.division = rel.division
WHERE NOT ends_with(t.code, ' 00 00') AND (run_id, t.division) IN (SELECT run_id, division FROM f_items) AND (run_id, t.code) NOT IN (SELECT run_id, code FROM f_items)"""


def _mentioned(spark, sf):
    return view(spark, sf, "f_taxonomy").select("code", F.explode(F.array(*[F.lit(p).cast("long") for p in range(4)])).alias("project_id"))


@register("gap_missing_section", with_views("f_items", "f_relevance", "f_taxonomy") + _REL + _MISSING_S)
def gap_missing_section(spark, sf):
    runs, relevant, items = _gap_inputs(spark, sf)
    return G.gap_missing_section(runs, relevant, items, items, view(spark, sf, "f_taxonomy"), _mentioned(spark, sf))


_XREF = """ SELECT project_id AS run_id, 'unresolved_cross_reference' AS gap_type, 'warn' AS severity, min_by(lpad(CAST(ord % 34 AS VARCHAR), 2, '0'), ord) AS division, sheet_id AS subject FROM f_sheets
WHERE ord % 8 IN (0, 1, 2, 3, 5, 6) AND (project_id, sheet_id) NOT IN (SELECT item_id % 4, sheet FROM f_citations) GROUP BY project_id, sheet_id"""


@register("gap_unresolved_xref", with_views("f_sheets", "f_citations") + _XREF)
def gap_unresolved_xref(spark, sf):
    refs = view(spark, sf, "f_sheets").select(F.col("project_id").alias("run_id"), "ord", F.col("sheet_id").alias("target"), F.lpad((F.col("ord") % 34).cast("string"), 2, "0").alias("division"))
    return G.gap_unresolved_xref(refs, view(spark, sf, "f_citations").select((F.col("item_id") % 4).alias("run_id"), "sheet"))


_KINDS = ("missing_division", "missing_section", "unresolved_cross_reference", "unilateral_evidence", "qty_implausible")
#: Each order brings one signal of a side with a code and one contradiction without.
_SIGNALS = """ SELECT o_orderkey % 4 AS run_id, 'unilateral_evidence' AS gap_type, 'warn' AS severity, '03' AS division, 'a' || o_custkey AS subject FROM orders UNION ALL SELECT o_orderkey % 4, 'unilateral_evidence', 'warn', NULL, 'c [see x]' FROM orders"""
_ODD = " SELECT run_id, gap_type, severity, sane.division, CAST(item_id AS VARCHAR) AS subject FROM sane JOIN f_items USING (item_id) WHERE severity IS NOT NULL"


@register("gap_table", with_views("f_items", "f_relevance", "f_taxonomy", "f_sheets", "f_citations") + _REL + _RESOLVED + _SANITY + f", a AS ({_MISSING_D} UNION ALL {_MISSING_S} UNION ALL {_XREF} UNION ALL {_SIGNALS} UNION ALL {_ODD}) SELECT run_id, {', '.join(f"count(*) FILTER (gap_type = '{k}') AS {k}" for k in _KINDS)} FROM a GROUP BY run_id")
def gap_table(spark, sf):
    text = F.expr("""concat('{"spec_only":[{"text":"a', o_custkey, '","section":"03 30 00"},{"text":" "}],"drawing_only":[],"contradictions":[{"text":"c","section":"see x"}]}')""")
    signals = G.discipline_gap_rows(view(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("run_id"), text.alias("json")))
    odd = G.gap_quantities(view(spark, sf, "f_items"), quantity_sanity(spark, sf))
    all_gaps = G.gap_table([gap_missing_division(spark, sf), gap_missing_section(spark, sf), gap_unresolved_xref(spark, sf), G.gap_one_sided(signals), odd])
    return G.gap_counts(all_gaps, list(_KINDS))


@register("conflict_within_code", with_views("f_conflicts") + """, c AS (SELECT conflict_id, count(*) AS n, count(DISTINCT unit) AS u, max(value) FILTER (value > 0) AS h, min(value) FILTER (value > 0) AS l FROM f_conflicts GROUP BY conflict_id),
k AS (SELECT conflict_id, CASE WHEN u > 1 THEN 'unit_mismatch' WHEN (h - l) / h > 0.05 THEN 'qty_mismatch' END AS kind FROM c WHERE n >= 2) SELECT * FROM k WHERE kind IS NOT NULL""")
def conflict_within_code(spark, sf):
    return G.conflict_within_code(view(spark, sf, "f_conflicts"))


@register("conflict_eligibility", with_views("f_conflicts") + " SELECT conflict_id, bool_and(coalesce(confidence > 0.8, false)) AS eligible FROM f_conflicts GROUP BY conflict_id")
def conflict_eligibility(spark, sf):
    return G.conflict_eligibility(view(spark, sf, "f_conflicts"))


@register("conflict_members", with_views("f_conflicts", "f_citations") + """, b AS (SELECT item_id, citation_id FROM (SELECT item_id, citation_id, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, citation_id DESC) AS n FROM f_citations) WHERE n = 1)
SELECT conflict_id, c.item_id, CASE WHEN row_number() OVER (PARTITION BY conflict_id ORDER BY c.item_id) = 1 THEN 'primary' ELSE 'contradictor' END AS role, citation_id FROM f_conflicts c LEFT JOIN b USING (item_id)""")
def conflict_members(spark, sf):
    return G.conflict_members(view(spark, sf, "f_conflicts"), view(spark, sf, "f_citations"))


_ARBITRATED = """, w AS (SELECT conflict_id, min(item_id) + CASE WHEN conflict_id % 5 = 0 THEN 1 ELSE 0 END AS winner FROM f_conflicts WHERE conflict_id % 3 <> 0 GROUP BY conflict_id),
v AS (SELECT w.*, c.value, c.unit FROM w JOIN f_conflicts c ON c.conflict_id = w.conflict_id AND c.item_id = w.winner),
ab AS (SELECT f.run_id, f.conflict_id, f.item_id, CASE WHEN winner IS NULL THEN 'open' ELSE 'resolved' END AS conflict_status, CASE WHEN winner IS NULL THEN 'deferred' WHEN winner = f.item_id THEN 'kept' ELSE 'rejected' END AS outcome, v.value AS winner_value, v.unit AS winner_unit FROM f_conflicts f LEFT JOIN v USING (conflict_id))"""


@register("apply_arbitration", with_views("f_conflicts") + _ARBITRATED + " SELECT * FROM ab")
def apply_arbitration(spark, sf):
    members = view(spark, sf, "f_conflicts")
    winners = members.where("conflict_id % 3 <> 0").groupBy("conflict_id").agg((F.min("item_id") + F.when(F.col("conflict_id") % 5 == 0, 1).otherwise(0)).alias("winner"))
    return G.apply_arbitration(members, winners)


@register("arbitration_counts", with_views("f_conflicts") + _ARBITRATED + " SELECT run_id, count(DISTINCT conflict_id) AS conflicts, count(DISTINCT conflict_id) FILTER (conflict_status = 'resolved') AS resolved, count(DISTINCT conflict_id) FILTER (conflict_status = 'open') AS deferred, count(*) FILTER (outcome = 'rejected') AS rejected_items FROM ab GROUP BY run_id")
def arbitration_counts(spark, sf):
    return G.arbitration_counts(apply_arbitration(spark, sf))


_RULES = "rules(division, package) AS (VALUES " + ", ".join(f"('{d}', '{k}')" for k, _, ds in P.PACKAGES for d in ds.split()) + ")"
_BUNDLED = f", {_RULES}, bundled AS (SELECT i.*, coalesce(package, 'unbundled-' || i.division) AS package FROM f_items i LEFT JOIN rules USING (division))"


def _bundled(spark, sf):
    return P.bundle_items(view(spark, sf, "f_items"), P.load_rule_dims(spark))


@register("load_rule_dims", f"WITH {_RULES} SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS division, package FROM nation JOIN rules ON division = lpad(CAST(n_nationkey AS VARCHAR), 2, '0')")
def load_rule_dims(spark, sf):
    divisions = view(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("division"))
    return divisions.join(F.broadcast(P.load_rule_dims(spark)), "division").select("division", "package")


@register("resolve_bundling", f"WITH {_RULES}, o AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS division, 'special' AS package FROM nation WHERE n_regionkey = 1) SELECT * FROM o UNION ALL SELECT * FROM rules WHERE division NOT IN (SELECT division FROM o)")
def resolve_bundling(spark, sf):
    overrides = view(spark, sf, "nation").where("n_regionkey = 1").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("division"), F.lit("special").alias("package"))
    return P.resolve_bundling(P.load_rule_dims(spark), overrides)


@register("bundle_items", with_views("f_items") + _BUNDLED + " SELECT run_id, package, count(*) AS item_count, count(*) FILTER (expected = 'bilateral') AS bilateral, round(avg(confidence), 6) AS avg_confidence FROM bundled GROUP BY ALL")
def bundle_items(spark, sf):
    return P.package_rollup(_bundled(spark, sf))


@register("package_list", with_views("f_items", "f_gaps") + _BUNDLED + """, g AS (SELECT run_id, coalesce(package, 'unbundled-' || g.division) AS package, count(*) AS open_gaps FROM f_gaps g LEFT JOIN rules USING (division) WHERE status = 'open' GROUP BY ALL)
SELECT run_id, package, count(*) AS item_count, count(*) FILTER (confidence < 0.6) AS low_confidence, coalesce(any_value(open_gaps), 0) AS open_gaps FROM bundled LEFT JOIN g USING (run_id, package) GROUP BY ALL""")
def package_list(spark, sf):
    return P.package_list(_bundled(spark, sf), view(spark, sf, "f_gaps"), P.load_rule_dims(spark))


@register("package_sections", with_views("f_items") + _BUNDLED + " SELECT run_id, package, code, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM bundled GROUP BY ALL")
def package_sections(spark, sf):
    return P.package_sections(_bundled(spark, sf))


@register("move_items", with_views("f_items") + _BUNDLED + ", m AS (SELECT *, CASE WHEN item_id % 10 = 0 THEN 'site' END AS target FROM bundled) SELECT run_id, coalesce(target, package) AS package, count(*) AS item_count, count(target) AS moved_in FROM m GROUP BY ALL")
def move_items(spark, sf):
    items = view(spark, sf, "f_items").where("item_id % 10 = 0")
    moves = items.select("item_id", F.lit(1).alias("seq"), F.lit("fire").alias("target")).unionByName(items.select("item_id", F.lit(2).alias("seq"), F.lit("site").alias("target")))
    return P.move_items(_bundled(spark, sf), moves)


_LINE = """, v AS (SELECT *, CASE WHEN regexp_matches(description, '^[A-Z][a-z]') THEN lower(substring(description, 1, 1)) || substring(description, 2) ELSE description END AS low, CASE WHEN ends_with(extraction_method, ':admin') THEN 'Submit ' WHEN ends_with(extraction_method, ':qc') THEN 'Perform ' ELSE 'Provide ' END AS verb FROM f_items),
l AS (SELECT *, CASE WHEN regexp_matches(description, '(?i)^(provide|install|furnish|supply|submit|perform|coordinate|remove|demolish|patch|paint|test)\\b') THEN description ELSE verb || low END AS line FROM v)"""


@register("ensure_action_verb", with_views("f_items") + _LINE + " SELECT item_id, line FROM l")
def ensure_action_verb(spark, sf):
    return P.ensure_action_verb(view(spark, sf, "f_items")).select("item_id", "line")


_SOW = _LINE + """, sh AS (SELECT item_id, nullif(array_to_string(list_sort(list_distinct(list(sheet) FILTER (evidence_type = 'drawing'))), ', '), '') AS sheets, bool_or(evidence_type = 'spec') AS spec FROM f_citations GROUP BY item_id),
lines AS (SELECT item_id, run_id, code, '- ' || line || CASE WHEN unit IS NOT NULL THEN ' (' || concat_ws(' ', quantity, unit) || ')' ELSE '' END || CASE WHEN concat_ws('; ', 'per ' || sheets, CASE WHEN spec THEN 'per spec section ' || code END) <> '' THEN ' ' || concat_ws('; ', 'per ' || sheets, CASE WHEN spec THEN 'per spec section ' || code END) ELSE '' END || '.' AS line FROM l LEFT JOIN sh USING (item_id))"""


@register("sow_lines", with_views("f_items", "f_citations") + _SOW + " SELECT * FROM lines")
def sow_lines(spark, sf):
    return P.sow_lines(view(spark, sf, "f_items"), view(spark, sf, "f_citations"))


def _statement_sql(key: str, items: str, gaps: str, conflicts: str, exclusions: str) -> str:
    """Lines of statements in order; the tables named have the key as column k."""
    standing = ", ".join(f"({n}, {k}, '{x}')" for n, k, x in [(n, -1, f"## {n}. {h}") for n, h in enumerate(D.HEADINGS, 1)] + [(n, k, x) for n, xs in D.STANDING.items() for k, x in enumerate(xs)])
    codes = ", ".join(f"'{c}'" for c in P.SCHEDULE_SECTIONS)
    return f""", it AS MATERIALIZED ({items}), ga AS ({gaps}), co AS ({conflicts}), ex AS ({exclusions}), std(n, i, x) AS (VALUES {standing}), ti AS (SELECT code, min_by(title, ord) AS title FROM f_taxonomy GROUP BY code),
sd AS (SELECT item_id, bool_or(evidence_type = 'drawing') AS d, bool_or(evidence_type = 'spec') AS s FROM f_citations GROUP BY item_id),
ks AS MATERIALIZED (SELECT k, min(project_id) AS p, count(*) AS n, count(DISTINCT division) AS dv, count(DISTINCT package) AS pk, count(*) FILTER (sd.d) AS d, count(*) FILTER (sd.s) AS s, count(*) FILTER (sd.d AND sd.s) AS b FROM it LEFT JOIN sd USING (item_id) GROUP BY k),
ln AS MATERIALIZED (SELECT k, it.item_id, division, it.code, coalesce(title, '—') AS title, line, coalesce(regexp_matches(extraction_method, '{P.ADMIN}'), false) AS admin FROM it JOIN lines USING (item_id) LEFT JOIN ti ON ti.code = it.code),
us AS (SELECT k, code, any_value(title) AS title, count(*) AS n FROM ln GROUP BY ALL), wa AS (SELECT k, gap_id, description, row_number() OVER (PARTITION BY k ORDER BY gap_id) AS r FROM ga WHERE severity IN ('blocker', 'warn') AND regexp_matches(description, '{P.SEQUENCING}')),
al(k, section, place, spot, text) AS (SELECT k, n, '', i, x FROM (SELECT k FROM ks) CROSS JOIN std UNION ALL SELECT k, 1, '', -2, '# Scope of work' FROM ks UNION ALL SELECT k, 1, 'a', 0, '- Project: ' || p FROM ks UNION ALL SELECT k, 1, 'a', 1, '- Statement: ' || k FROM ks
UNION ALL SELECT k, 2, 'a', 0, '- ' || n || ' items in ' || dv || ' divisions and ' || pk || ' packages.' FROM ks UNION ALL SELECT k, 2, 'a', 1, '- ' || d || ' cite drawings, ' || s || ' specifications, ' || b || ' both.' FROM ks
UNION ALL SELECT DISTINCT k, 3, division, -1, '### Division ' || division FROM ln WHERE NOT admin UNION ALL SELECT DISTINCT k, 3, division || '/' || code, -1, '**' || code || ' — ' || title || '**' FROM ln WHERE NOT admin UNION ALL SELECT k, 3, division || '/' || code, item_id, line FROM ln WHERE NOT admin
UNION ALL SELECT k, 4, 'a', 0, '- ' || n || ' more are named in bids.' FROM ex SEMI JOIN ks USING (k) UNION ALL SELECT k, 6, code, 0, '- **' || code || '** — ' || title || ' (' || n || ')' FROM us UNION ALL SELECT k, 7, 'a/' || code, 0, '- **' || code || '** — ' || title FROM us WHERE code IN ({codes})
UNION ALL SELECT k, 7, 'b', r, '- ' || description FROM wa SEMI JOIN ks USING (k) WHERE r <= 8 UNION ALL SELECT k, 7, 'c', 0, '- and ' || (count(*) - 8) || ' more' FROM wa SEMI JOIN ks USING (k) GROUP BY k HAVING count(*) > 8
UNION ALL SELECT DISTINCT k, 8, code, -1, '### ' || code || ' — ' || title FROM ln WHERE admin UNION ALL SELECT k, 8, code, item_id, line FROM ln WHERE admin UNION ALL SELECT k, 9, 'a', 0, '- ' || count(DISTINCT conflict_id) || ' open conflicts' FROM co SEMI JOIN ks USING (k) WHERE status = 'open' GROUP BY k
UNION ALL SELECT k, 9, 'a', 1, '- ' || count(*) || ' references without a sheet' FROM ga SEMI JOIN ks USING (k) WHERE gap_type = 'unresolved_cross_reference' GROUP BY k)
SELECT k AS sow_id, row_number() OVER (PARTITION BY k ORDER BY section, place, spot) AS n, text FROM al"""


def _stated(spark, sf, items, gaps, conflicts, exclusions, key):
    titles = view(spark, sf, "f_taxonomy").groupBy("code").agg(F.min_by("title", "ord").alias("title"))
    lines, path = D.statement_lines(items, view(spark, sf, "f_citations"), gaps, conflicts, exclusions, titles, key), folder(spark)
    D.write_statements(lines, path)
    return D.read_statements(spark, path)


_EXCLUDED = "SELECT CAST(run_id AS STRING) AS k, count(*) AS n FROM f_coverage WHERE status = 'excluded' GROUP BY run_id"


@register("sow_document", with_views("f_items", "f_citations", "f_gaps", "f_conflicts", "f_coverage", "f_taxonomy") + _SOW + _BUNDLED + _statement_sql("run_id", "SELECT CAST(run_id AS STRING) AS k, * FROM bundled", "SELECT CAST(run_id AS STRING) AS k, * FROM f_gaps", "SELECT CAST(run_id AS STRING) AS k, * FROM f_conflicts", _EXCLUDED))
def sow_document(spark, sf):
    excluded = view(spark, sf, "f_coverage").where("status = 'excluded'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return _stated(spark, sf, _bundled(spark, sf), view(spark, sf, "f_gaps"), view(spark, sf, "f_conflicts"), excluded, "run_id")


_PACKED = "CAST(run_id AS STRING) || '/' || coalesce(package, 'unbundled-' || {0}.division)"


@register("sow_packages", with_views("f_items", "f_citations", "f_gaps", "f_conflicts", "f_taxonomy") + _SOW + _BUNDLED + _statement_sql("k", "SELECT CAST(run_id AS STRING) || '/' || package AS k, * FROM bundled", f"SELECT {_PACKED.format('g')} AS k, g.* FROM f_gaps g LEFT JOIN rules USING (division)", "SELECT CAST(c.run_id AS STRING) || '/' || package AS k, c.* FROM f_conflicts c JOIN bundled USING (item_id)", "SELECT '' AS k, 0 AS n WHERE false"))
def sow_packages(spark, sf):
    named = lambda df: df.withColumn("k", F.concat(F.col("run_id").cast("string"), F.lit("/"), "package"))
    items = named(_bundled(spark, sf))
    gaps = named(P.bundle_items(view(spark, sf, "f_gaps"), P.load_rule_dims(spark)))
    conflicts = view(spark, sf, "f_conflicts").join(items.select("item_id", "k"), "item_id")
    return _stated(spark, sf, items, gaps, conflicts, spark.createDataFrame([], "k string, n bigint"), "k")


@register("sow_summary", with_views("f_items", "f_citations") + _BUNDLED + """, s AS (SELECT item_id, bool_or(evidence_type = 'drawing') AS d, bool_or(evidence_type = 'spec') AS s FROM f_citations GROUP BY item_id)
SELECT run_id, count(*) AS items, count(DISTINCT division) AS divisions, count(DISTINCT package) AS packages, count(*) FILTER (d) AS drawing_cited, count(*) FILTER (s.s) AS spec_cited, count(*) FILTER (d AND s.s) AS both_cited FROM bundled LEFT JOIN s USING (item_id) GROUP BY run_id""")
def sow_summary(spark, sf):
    return P.sow_summary(view(spark, sf, "f_items"), _bundled(spark, sf), view(spark, sf, "f_citations"))


@register("sow_sections", with_views("f_items") + f" SELECT run_id, division, code, count(*) FILTER (NOT regexp_matches(extraction_method, '{P.ADMIN}')) AS work_items, count(*) FILTER (regexp_matches(extraction_method, '{P.ADMIN}')) AS admin_items, count(*) AS used, code IN ({', '.join(repr(c) for c in P.SCHEDULE_SECTIONS)}) AS schedule FROM f_items GROUP BY ALL")
def sow_sections(spark, sf):
    return P.sow_sections(view(spark, sf, "f_items"))


@register("sow_coordination", with_views("f_conflicts", "f_gaps", "f_coverage") + f""", c AS (SELECT run_id, count(DISTINCT conflict_id) AS open_conflicts FROM f_conflicts WHERE status = 'open' GROUP BY run_id), w AS (SELECT run_id, description, row_number() OVER (PARTITION BY run_id ORDER BY gap_id) AS r FROM f_gaps WHERE severity IN ('blocker', 'warn') AND regexp_matches(description, '{P.SEQUENCING}')),
n AS (SELECT run_id, count(*) AS n, string_agg(description, ' | ' ORDER BY r) FILTER (r <= 8) AS sequencing FROM w GROUP BY run_id), g AS (SELECT run_id, count(*) FILTER (gap_type = 'unresolved_cross_reference') AS unresolved_refs FROM f_gaps GROUP BY run_id), x AS (SELECT run_id, count(*) AS exclusions FROM f_coverage WHERE status = 'excluded' GROUP BY run_id)
SELECT run_id, coalesce(open_conflicts, 0) AS open_conflicts, coalesce(unresolved_refs, 0) AS unresolved_refs, coalesce(exclusions, 0) AS exclusions, least(coalesce(n, 0), 8) AS shown, greatest(coalesce(n, 0) - 8, 0) AS more, coalesce(sequencing, '') AS sequencing FROM c FULL JOIN g USING (run_id) FULL JOIN x USING (run_id) LEFT JOIN n USING (run_id)""")
def sow_coordination(spark, sf):
    excluded = view(spark, sf, "f_coverage").where("status = 'excluded'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return P.sow_coordination(view(spark, sf, "f_conflicts"), view(spark, sf, "f_gaps"), excluded)


@register("gap_report_rows", with_views("f_items", "f_conflicts", "f_gaps") + """, g AS (SELECT run_id, 'gap' AS kind, row_number() OVER (PARTITION BY run_id ORDER BY severity, gap_id) AS rank, gap_id::VARCHAR AS subject, '[' || upper(severity) || '] ' || replace(gap_type, '_', ' ') || ': ' || substring(description, 1, 280) AS text FROM f_gaps QUALIFY rank <= 200),
i AS (SELECT run_id, 'item', row_number() OVER (PARTITION BY run_id ORDER BY item_id) AS rank, item_id::VARCHAR, code || ' · ' || CAST(round(confidence * 100) AS INT) || '%: ' || substring(description, 1, 280) FROM f_items WHERE confidence < 0.6 QUALIFY rank <= 60),
c AS (SELECT run_id, 'conflict', row_number() OVER (PARTITION BY run_id ORDER BY conflict_id) AS rank, conflict_id::VARCHAR, 'status=' || min(status) || ' members=' || count(*) FROM f_conflicts GROUP BY run_id, conflict_id) SELECT * FROM g UNION ALL SELECT * FROM i UNION ALL SELECT * FROM c""")
def gap_report_rows(spark, sf):
    return P.gap_report_rows(view(spark, sf, "f_gaps"), view(spark, sf, "f_items"), view(spark, sf, "f_conflicts"))


@register("gap_report", with_views("f_items", "f_conflicts", "f_gaps") + """, g AS (SELECT run_id, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warn') AS warns, least(count(*), 200) AS listed FROM f_gaps WHERE status = 'open' GROUP BY run_id),
c AS (SELECT run_id, count(DISTINCT conflict_id) AS open_conflicts FROM f_conflicts WHERE status = 'open' GROUP BY run_id), i AS (SELECT run_id, count(*) FILTER (confidence < 0.6) AS low_confidence FROM f_items GROUP BY run_id)
SELECT run_id, low_confidence, coalesce(blockers, 0) AS blockers, coalesce(warns, 0) AS warns, coalesce(listed, 0) AS listed, coalesce(open_conflicts, 0) AS open_conflicts FROM i LEFT JOIN g USING (run_id) LEFT JOIN c USING (run_id)""")
def gap_report(spark, sf):
    return P.gap_report(view(spark, sf, "f_gaps"), view(spark, sf, "f_conflicts"), view(spark, sf, "f_items"))
