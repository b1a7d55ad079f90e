"""Queries of the payload, rollup and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scopeloom.operators import gaps as G
from scopeloom.operators import grounding
from scopeloom.sources import ingest as I
from scopeloom.operators import packages as P
from scopeloom.operators import runs as R
from scopeloom.plans import more_queries as M
from scopeloom.plans import scope_queries as Q
from scopeloom.plans.fixtures import view, with_views
from scopeloom.plans.registry import register


@register("parse_sheet_index_payload", "SELECT page_id AS document_id, 0 AS pos, 'A' || page_id AS sheet_id, 'PLAN' AS title, 'architectural' AS discipline FROM pages UNION ALL SELECT page_id, 2, 'FP1', NULL, CASE WHEN page_id % 2 = 0 THEN 'fire' ELSE 'fire-protection' END FROM pages")
def parse_sheet_index_payload(spark, sf):
    text = F.expr("""concat('[{"sheet_id":" A', page_id, ' ","title":" PLAN "},{"title":"no id"},{"sheet_id":"FP1","discipline":"', CASE WHEN page_id % 2 = 0 THEN 'fire' ELSE '' END, '"}]')""")
    return I.parse_sheet_index_payload(view(spark, sf, "pages").select(F.col("page_id").alias("document_id"), text.alias("json")))


@register("parse_legend_payload", "SELECT page_id AS document_id, 'WC' AS glyph, 'water closet' AS meaning, '22 ' || page_id AS code FROM pages")
def parse_legend_payload(spark, sf):
    text = F.expr("""concat('[{"glyph":" WC","meaning":"water closet ","code":"22 ', page_id, '"},{"glyph":"","meaning":"x"},{"glyph":"LAV"}]')""")
    return I.parse_legend_payload(view(spark, sf, "pages").select(F.col("page_id").alias("document_id"), text.alias("json")))


@register("parse_typed_schedule_payload", "SELECT page_id, '[typed:door] Doors' AS name, CASE WHEN page_id % 2 = 0 THEN 'mark,width,finish' ELSE 'mark,width' END AS columns, 2 AS n_rows FROM pages")
def parse_typed_schedule_payload(spark, sf):
    text = F.expr("""concat('{"schedule_name_as_printed":"Doors","rows":[{"mark":"1","width":"3"},{"mark":"2","extra_fields":"x"', CASE WHEN page_id % 2 = 0 THEN ',"finish":"p"' ELSE '' END, '}]}')""")
    out = I.parse_typed_schedule_payload(view(spark, sf, "pages").select("page_id", F.lit("door").alias("type"), text.alias("json")))
    return out.withColumn("columns", F.array_join("columns", ","))


@register("drawing_chunks", """WITH e AS (SELECT event_id AS page_id, event_id AS k FROM events WHERE event_id % 23 <> 0) SELECT page_id, 'page_summary' AS chunk_type, 0 AS pos, 'Sheet A' || k % 9 || '.1: PLAN' AS text FROM e
UNION ALL SELECT page_id, 'schedule', 0, 'Schedule [typed:finish] room (room, base)' FROM e UNION ALL SELECT page_id, 'note', 0, 'Note: note ' || k % 7 FROM e UNION ALL SELECT page_id, 'note', 1, 'Note: second' FROM e UNION ALL SELECT page_id, 'entity', 0, 'equipment: v' || k % 5 FROM e""")
def drawing_chunks(spark, sf):
    return I.drawing_chunks(I.parse_page_payload(M._pages(spark, sf)))


@register("extraction_overview", "SELECT event_id AS page_id, CASE WHEN event_id % 23 = 0 THEN 0 ELSE 1 END AS schedules, CASE WHEN event_id % 23 = 0 THEN 0 ELSE 2 END AS notes, 0 AS cross_references, CASE WHEN event_id % 23 = 0 THEN 0 ELSE 1 END AS entities FROM events")
def extraction_overview(spark, sf):
    pages = M._pages(spark, sf)
    tables = I.parse_page_payload(pages)
    return R.extraction_overview(pages, {k: tables[k] for k in ("schedules", "notes", "cross_references", "entities")})


@register("discipline_gap_rows", "SELECT o_orderkey AS run_id, 'spec_only' AS side, 'unilateral_evidence' AS gap_type, '03 30 00' AS code, 'a' || o_custkey AS description FROM orders UNION ALL SELECT o_orderkey, 'contradictions', 'unilateral_evidence', NULL, 'c [see x]' FROM orders")
def discipline_gap_rows(spark, sf):
    text = F.expr("""concat('{"spec_only":[{"text":"a', o_custkey, '","section":"03 30 00"},{"text":" "}],"drawing_only":[],"contradictions":[{"text":"c","section":"see x"}]}')""")
    return G.discipline_gap_rows(view(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), text.alias("json")))


@register("discipline_of_division", "SELECT p_partkey, CASE " + " ".join(f"WHEN lpad(CAST(p_partkey % 34 AS VARCHAR), 2, '0') IN ({', '.join(repr(n) for n in ns.split())}) THEN '{d}'" for d, ns in grounding.DISCIPLINES.items()) + " END AS discipline FROM part")
def discipline_of_division(spark, sf):
    return view(spark, sf, "part").select("p_partkey", grounding.discipline_of_division((F.col("p_partkey") % 34).cast("string")).alias("discipline"))


@register("run_rollup", with_views("f_conflicts", "f_gaps", *Q._TRUST_VIEWS) + Q._BUNDLED + Q._TRUST + """, cc AS (SELECT run_id, count(DISTINCT conflict_id) AS conflicts FROM f_conflicts GROUP BY run_id), gg AS (SELECT run_id, count(*) AS gaps FROM f_gaps GROUP BY run_id), pp AS (SELECT run_id, count(DISTINCT package) AS packages FROM bundled GROUP BY run_id)
SELECT run_id, coalesce(conflicts, 0) AS conflicts, coalesce(gaps, 0) AS gaps, coalesce(packages, 0) AS packages, CAST(score AS DOUBLE) AS score FROM (SELECT DISTINCT run_id FROM f_items) u LEFT JOIN cc USING (run_id) LEFT JOIN gg USING (run_id) LEFT JOIN pp USING (run_id) LEFT JOIN t USING (run_id)""")
def run_rollup(spark, sf):
    items = view(spark, sf, "f_items")
    runs = items.select("run_id", F.col("run_id").alias("project_id"), F.lit(0).alias("started_at")).distinct()
    joined, _ = R.run_rollup(runs, view(spark, sf, "f_conflicts"), view(spark, sf, "f_gaps"), P.bundle_items(items, P.load_rule_dims(spark)), Q.trust_score(spark, sf))
    return joined.select("run_id", "conflicts", "gaps", "packages", "score")


@register("rfi_markdown", "SELECT conv_id AS run_id, md5(string_agg('### RFI ' || turn || ': ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def rfi_markdown(spark, sf):
    rfis = view(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("number"), F.col("role").alias("subject"), F.col("text").alias("question"))
    return R.rfi_markdown(rfis).select("run_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))
