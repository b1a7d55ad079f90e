"""Queries of the bid, run, audit and cost operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scopeloom.operators import quantities as Q
from scopeloom.operators import evidence as E
from scopeloom.operators import bids as B
from scopeloom.operators import review as V
from scopeloom.operators import runs as R
from scopeloom.plans.fixtures import view, with_views
from scopeloom.plans.grounding_queries import _RESOLVED
from scopeloom.plans.registry import register
from scopeloom.plans.scope_queries import _TIER


def _v(spark, sf, *names):
    return [view(spark, sf, n) for n in names]


@register("priced_bids", with_views("f_bids") + " SELECT bid_id, vendor FROM f_bids WHERE doc_type IN ('bid-quote', 'scope-letter') AND processing_status = 'ready'")
def priced_bids(spark, sf):
    return B.priced_bids(view(spark, sf, "f_bids")).select("bid_id", "vendor")


@register("coverage_pairs", with_views("f_items", "f_bids") + ", p AS (SELECT * FROM f_bids WHERE doc_type IN ('bid-quote', 'scope-letter') AND processing_status = 'ready') SELECT item_id, bid_id FROM f_items i JOIN p ON p.project_id = i.project_id AND (p.division = i.division OR p.division IS NULL)")
def coverage_pairs(spark, sf):
    items, bids = _v(spark, sf, "f_items", "f_bids")
    return B.coverage_pairs(items, B.priced_bids(bids))


@register("apply_coverage", with_views("f_coverage", "f_bid_lines") + """, n AS (SELECT bid_id, line_id, row_number() OVER (PARTITION BY bid_id ORDER BY page, line_id) - 1 AS i FROM f_bid_lines),
v AS (SELECT item_id, bid_id, CASE WHEN item_id % 4 = 0 THEN NULL ELSE status END AS status, CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id % 9 END AS i FROM f_coverage) SELECT item_id, v.bid_id, coalesce(status, 'not_covered') AS status, line_id FROM v LEFT JOIN n ON n.bid_id = v.bid_id AND n.i = v.i""")
def apply_coverage(spark, sf):
    coverage, lines = _v(spark, sf, "f_coverage", "f_bid_lines")
    verdicts = coverage.where("item_id % 4 <> 0").select("item_id", "bid_id", F.upper("status").alias("status"), (F.col("item_id") % 9).alias("line_index"))
    return B.apply_coverage(coverage.select("item_id", "bid_id"), verdicts, lines)


@register("coverage_counts", with_views("f_coverage") + " SELECT run_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in B.STATUSES) + " FROM f_coverage GROUP BY run_id")
def coverage_counts(spark, sf):
    return B.coverage_counts(view(spark, sf, "f_coverage"))


@register("uncovered_items", with_views("f_items", "f_bids", "f_coverage") + ", c AS (SELECT item_id, status FROM f_coverage c JOIN f_bids b USING (bid_id) JOIN f_items i USING (item_id) WHERE b.doc_type IN ('bid-quote', 'scope-letter') AND processing_status = 'ready' AND b.division = i.division) SELECT item_id FROM f_items WHERE item_id NOT IN (SELECT item_id FROM c WHERE status IN ('covered', 'partial'))")
def uncovered_items(spark, sf):
    items, bids, coverage = _v(spark, sf, "f_items", "f_bids", "f_coverage")
    scored = coverage.join(B.priced_bids(bids).select("bid_id", "division"), "bid_id").join(items.select("item_id", "division"), ["item_id", "division"])
    return B.uncovered_items(items, scored).select("item_id")


_PARTS = """, parts AS (SELECT bid_id, 'line' AS kind, line_id AS id, page, description AS text, CAST(total_price AS DECIMAL(18, 2)) AS amount FROM f_bid_lines UNION ALL SELECT bid_id, kind, term_id, page, text, NULL FROM f_bid_terms)"""


@register("bid_detail", with_views("f_bids", "f_bid_lines", "f_bid_terms") + _PARTS + " SELECT bid_id, kind, id, page, text, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY bid_id, kind ORDER BY page, id) AS place FROM parts SEMI JOIN f_bids USING (bid_id)")
def bid_detail(spark, sf):
    return B.bid_detail(*_v(spark, sf, "f_bids", "f_bid_lines", "f_bid_terms"))[0].withColumn("amount", F.col("amount").cast("double"))


@register("bid_summary", with_views("f_bids", "f_bid_lines", "f_bid_terms") + _PARTS + """, n AS (SELECT bid_id, count(*) FILTER (kind = 'line') AS lines, count(*) FILTER (kind = 'inclusion') AS inclusions, count(*) FILTER (kind = 'exclusion') AS exclusions, CAST(sum(amount) AS DOUBLE) AS line_total FROM parts GROUP BY bid_id)
SELECT bid_id, vendor_name, coalesce(lines, 0) AS lines, coalesce(inclusions, 0) AS inclusions, coalesce(exclusions, 0) AS exclusions, line_total FROM f_bids LEFT JOIN n USING (bid_id)""")
def bid_summary(spark, sf):
    return B.bid_detail(*_v(spark, sf, "f_bids", "f_bid_lines", "f_bid_terms"))[1].select("bid_id", "vendor_name", "lines", "inclusions", "exclusions", "line_total")


def _vendor_sql() -> str:
    s = r"trim(regexp_replace(lower(vendor_name), '\s+', ' ', 'g'))"
    for suffix in B.LEGAL_SUFFIXES:
        s = rf"regexp_replace({s}, '[,.]?\s+{suffix.replace('.', chr(92) + '.')}\.?$', '')"
    return rf"trim(regexp_replace({s}, '[,.]+$', ''))"


@register("normalize_vendor", with_views("f_bids") + f" SELECT bid_id, {_vendor_sql()} AS vendor FROM f_bids")
def normalize_vendor(spark, sf):
    return view(spark, sf, "f_bids").select("bid_id", B.normalize_vendor(F.col("vendor_name")).alias("vendor"))


@register("vendor_qualifications", with_views("f_bids") + " SELECT project_id, vendor, count(*) FILTER (doc_type = 'license') AS licenses, count(*) FILTER (doc_type = 'safety') AS safety, count(*) FILTER (doc_type = 'contractor-info') AS contractor, count(*) FILTER (doc_type = 'license') > 0 AND count(*) FILTER (doc_type = 'safety') > 0 AS complete FROM f_bids GROUP BY ALL")
def vendor_qualifications(spark, sf):
    return B.vendor_qualifications(view(spark, sf, "f_bids"))


_VENDOR = ("f_bids", "f_bid_runs", "f_bid_summaries", "f_bid_lines", "f_bid_terms", "f_coverage")
_ACTIVE = """, lr AS (SELECT project_id, max_by(bid_run_id, started_at * 1000000 + bid_run_id) AS bid_run_id FROM f_bid_runs GROUP BY project_id),
act AS MATERIALIZED (SELECT b.project_id, b.vendor, b.bid_id, b.bid_total, s.division FROM f_bids b JOIN lr USING (project_id) JOIN f_bid_summaries s ON s.bid_run_id = lr.bid_run_id AND s.bid_id = b.bid_id WHERE doc_type IN ('bid-quote', 'scope-letter'))"""


def _active(spark, sf):
    bids, runs, summaries, lines, terms, coverage = _v(spark, sf, *_VENDOR)
    return bids, B.active_bids(runs, summaries, bids), lines, terms, coverage


@register("vendor_summary", with_views(*_VENDOR) + _ACTIVE + f""", l AS (SELECT bid_id, count(*) AS lines FROM f_bid_lines GROUP BY bid_id), t AS (SELECT bid_id, count(*) FILTER (kind = 'inclusion') AS inclusions, count(*) FILTER (kind = 'exclusion') AS exclusions FROM f_bid_terms GROUP BY bid_id),
c AS (SELECT bid_id, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in B.STATUSES)} FROM f_coverage GROUP BY bid_id),
p AS (SELECT project_id, vendor, CAST(sum(CAST(bid_total AS DECIMAL(18, 2))) AS DOUBLE) AS bid_total, array_to_string(list_sort(list_distinct(list(division))), ',') AS divisions, sum(lines) AS lines, sum(inclusions) AS inclusions, sum(exclusions) AS exclusions, {", ".join(f"sum({s})::BIGINT AS {s}" for s in B.STATUSES)} FROM act LEFT JOIN l USING (bid_id) LEFT JOIN t USING (bid_id) LEFT JOIN c USING (bid_id) GROUP BY ALL),
h AS (SELECT project_id, vendor, count(*) AS documents, bool_or(doc_type IN ('bid-quote', 'scope-letter')) AS has_priced_bid, array_to_string(list_sort(list_distinct(list(vendor_name))), '|') AS aliases, count(*) FILTER (doc_type = 'license') AS licenses, count(*) FILTER (doc_type = 'safety') AS safety, count(*) FILTER (doc_type = 'contractor-info') AS contractor FROM f_bids GROUP BY ALL)
SELECT h.*, licenses > 0 AND safety > 0 AS complete, bid_total, coalesce(divisions, '') AS divisions, coalesce(lines, 0)::BIGINT AS lines, coalesce(inclusions, 0)::BIGINT AS inclusions, coalesce(exclusions, 0)::BIGINT AS exclusions, {", ".join(B.STATUSES)} FROM h LEFT JOIN p USING (project_id, vendor)""")
def vendor_summary(spark, sf):
    return B.vendor_summary(*_active(spark, sf))


@register("vendor_profile", with_views(*_VENDOR) + _ACTIVE + """, parts AS (SELECT bid_id, 'line' AS kind, line_id AS id, page, description AS text FROM f_bid_lines UNION ALL SELECT bid_id, kind, term_id, page, text FROM f_bid_terms),
every AS (SELECT project_id, vendor, 'document' AS kind, doc_type AS a, 0::BIGINT AS b, vendor_name AS c, bid_id::VARCHAR AS id, doc_type AS text FROM f_bids
UNION ALL SELECT project_id, vendor, kind, '', bid_id, lpad(page::VARCHAR, 6, '0') || '/' || id, id, text FROM parts JOIN act USING (bid_id)
UNION ALL SELECT DISTINCT project_id, vendor, status, '', item_id, '', item_id::VARCHAR, '' FROM f_coverage JOIN act USING (bid_id))
SELECT project_id, vendor, kind, id, text, row_number() OVER (PARTITION BY project_id, vendor, kind ORDER BY a, b, c, id) AS place FROM every""")
def vendor_profile(spark, sf):
    return B.vendor_profile(*_active(spark, sf))


_RANK = "CASE status WHEN 'covered' THEN 0 WHEN 'partial' THEN 1 WHEN 'excluded' THEN 2 ELSE 3 END"


_LEVELED = f""", latest AS (SELECT project_id, bid_run_id, scope_run_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, bid_run_id DESC) AS n FROM f_bid_runs) WHERE n = 1),
active AS MATERIALIZED (SELECT s.bid_id, s.bid_run_id, l.project_id, b.vendor FROM f_bid_summaries s JOIN latest l USING (bid_run_id) JOIN f_bids b USING (bid_id)), vendors AS MATERIALIZED (SELECT DISTINCT project_id, vendor FROM active),
cells AS MATERIALIZED (SELECT * FROM (SELECT a.project_id, item_id, vendor, status, confidence, line_id, row_number() OVER (PARTITION BY a.project_id, item_id, vendor ORDER BY {_RANK}, confidence DESC, line_id NULLS FIRST) AS n FROM f_coverage JOIN active a USING (bid_id)) WHERE n = 1),
scored AS MATERIALIZED (SELECT DISTINCT project_id, item_id FROM cells), rows AS MATERIALIZED (SELECT l.project_id, l.bid_run_id, i.item_id, i.code FROM f_items i JOIN latest l ON l.scope_run_id = i.run_id JOIN scored s ON s.project_id = l.project_id AND s.item_id = i.item_id),
lines AS MATERIALIZED (SELECT line_id, description, total_price FROM f_bid_lines),
leveled AS (SELECT r.project_id, r.bid_run_id, r.item_id, r.code, v.vendor, coalesce(c.status, 'not_applicable') AS status, coalesce(c.confidence, 0.0) AS confidence, description AS line_text, total_price AS line_total
FROM rows r JOIN vendors v ON v.project_id = r.project_id LEFT JOIN cells c ON c.project_id = r.project_id AND c.item_id = r.item_id AND c.vendor = v.vendor LEFT JOIN lines USING (line_id))"""
_LEVELING = ("f_items", "f_bids", "f_coverage", "f_bid_lines", "f_bid_runs", "f_bid_summaries")


@register("bid_leveling", with_views(*_LEVELING) + _LEVELED + " SELECT * FROM leveled")
def bid_leveling(spark, sf):
    items, bids, coverage, lines, runs, summaries = _v(spark, sf, *_LEVELING)
    return B.bid_leveling(runs, summaries, bids, coverage, lines, items)


@register("bid_leveling_wide", with_views(*_LEVELING) + _LEVELED + " SELECT project_id, bid_run_id, item_id, code, string_agg(vendor || '=' || status || coalesce(':' || line_text, ''), ', ' ORDER BY vendor) AS cells FROM leveled GROUP BY ALL")
def bid_leveling_wide(spark, sf):
    cell = lambda x: F.concat(x["vendor"], F.lit("="), x["status"], F.coalesce(F.concat(F.lit(":"), x["line_text"]), F.lit("")))
    items, bids, coverage, lines, runs, summaries = _v(spark, sf, *_LEVELING)
    return B.bid_leveling_nested(runs, summaries, bids, coverage, lines, items, show=cell).withColumn("cells", F.array_join("cells", ", "))


@register("latest_run", with_views("f_runs") + " SELECT project_id, max_by(run_id, struct_pack(a := started_at, b := run_id)) AS run_id FROM f_runs WHERE status = 'complete' GROUP BY project_id")
def latest_run(spark, sf):
    return R.latest_run(view(spark, sf, "f_runs"), "complete")


@register("project_overview", with_views("f_documents") + " SELECT project_id, count(*) FILTER (source_kind = 'bid_submission') AS bid_documents, count(*) FILTER (source_kind <> 'bid_submission') AS project_documents, count(DISTINCT doc_type) AS doc_types FROM f_documents GROUP BY project_id")
def project_overview(spark, sf):
    return R.project_overview(view(spark, sf, "f_documents"))


@register("review_queue", with_views("f_items", "f_gaps", "f_conflicts") + """ SELECT run_id, 'item' AS kind, CAST(item_id AS VARCHAR) AS subject, coalesce(review_status, '') AS status, 'low' AS severity, code || ': ' || description AS snapshot FROM f_items WHERE confidence < 0.6 AND (review_status IS NULL OR review_status <> 'rejected')
UNION ALL SELECT run_id, 'gap', CAST(gap_id AS VARCHAR), status, severity, gap_type || ': ' || description FROM f_gaps WHERE status IN ('open', 'acknowledged') AND severity = 'blocker' UNION ALL SELECT c.run_id, 'conflict', CAST(conflict_id AS VARCHAR), min(c.status), 'conflict', string_agg(item_id || '=' || i.code || ': ' || i.description, ' | ' ORDER BY item_id) FROM f_conflicts c JOIN f_items i USING (item_id) WHERE c.status = 'open' GROUP BY c.run_id, conflict_id""")
def review_queue(spark, sf):
    return R.review_queue(*_v(spark, sf, "f_items", "f_gaps", "f_conflicts"), gap_statuses=("open", "acknowledged"), severities=("blocker",))


#: Actions on conflicts, gaps and items, some of which do not exist; winners are members or not.
_ACTIONS = """SELECT event_id AS seq, user_id AS actor, CASE event_id % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'acknowledge' ELSE 'reclassify' END AS action,
CASE event_id % 3 WHEN 0 THEN event_id % 210 WHEN 1 THEN event_id % 999 ELSE event_id % 220 END AS entity_id, CASE WHEN event_id % 3 = 0 THEN event_id % 210 + 200 * (user_id % 3) END AS winner,
CASE WHEN event_id % 3 = 2 THEN lpad(CAST(event_id % 37 AS STRING), 2, '0') || '-' || lpad(CAST(user_id % 50 AS STRING), 2, '0') || '-' || CAST(user_id % 3 AS STRING) || '0' END AS new_code FROM events"""
_STATE = f""", actions AS MATERIALIZED ({_ACTIONS}), m AS (SELECT DISTINCT conflict_id AS entity_id, item_id AS winner FROM f_conflicts), k AS (SELECT DISTINCT conflict_id AS entity_id, status FROM f_conflicts),
rj AS (SELECT a.*, k.status, m.winner IS NOT NULL AS member, min(CASE WHEN k.status = 'open' AND m.winner IS NOT NULL THEN seq END) OVER (PARTITION BY a.entity_id) AS first FROM actions a LEFT JOIN k USING (entity_id) LEFT JOIN m ON m.entity_id = a.entity_id AND m.winner = a.winner WHERE action = 'resolve'),
rn AS (SELECT *, CASE WHEN seq > first THEN 'resolved' ELSE status END AS now FROM rj), ra AS (SELECT seq, 'conflict' AS entity_type, entity_id, CASE WHEN status IS NULL THEN 'not_found' WHEN now <> 'open' THEN 'already_' || now WHEN NOT member THEN 'not_a_member' ELSE 'applied' END AS outcome, now AS before, 'resolved:' || winner AS after FROM rn),
ga AS (SELECT seq, 'gap' AS entity_type, entity_id, CASE WHEN gap_id IS NULL THEN 'not_found' ELSE 'applied' END AS outcome, CASE WHEN gap_id IS NOT NULL AND row_number() OVER (PARTITION BY entity_id ORDER BY seq) > 1 THEN 'acknowledged' ELSE status END AS before, 'acknowledged' AS after FROM actions LEFT JOIN f_gaps ON gap_id = entity_id WHERE action = 'acknowledge'),
ti AS (SELECT code, min_by(title, ord) AS title FROM f_taxonomy GROUP BY code), want AS (SELECT *, regexp_replace(new_code, '[^0-9]', '', 'g') AS digits FROM actions WHERE action = 'reclassify'), wn AS (SELECT *, substring(digits, 1, 2) || ' ' || substring(digits, 3, 2) || ' ' || substring(digits, 5, 2) AS canonical FROM want),
near AS (SELECT canonical, t.code FROM (SELECT DISTINCT canonical FROM wn) w JOIN f_taxonomy t ON t.division = substring(canonical, 1, 2) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY t.code = canonical DESC, substring(t.code, 4, 2) = substring(canonical, 4, 2) DESC, abs(CAST(replace(t.code, ' ', '') AS INT) - CAST(replace(canonical, ' ', '') AS INT)), ord) = 1),
gr AS (SELECT wn.*, coalesce(near.code, wn.canonical) AS code, substring(wn.canonical, 1, 2) AS division FROM wn LEFT JOIN near USING (canonical)), its AS (SELECT item_id, code, division, ti.title AS section_title, review_status FROM f_items LEFT JOIN ti USING (code)),
ij AS (SELECT seq, entity_id, item_id, gr.code AS to_code, gr.division AS to_division, ti.title AS to_title, gr.code || '|' || gr.division || '|' || coalesce(ti.title, '') AS after, its.code || '|' || its.division || '|' || coalesce(its.section_title, '') AS was FROM gr LEFT JOIN ti ON ti.code = gr.code LEFT JOIN its ON item_id = entity_id),
ia AS (SELECT seq, 'scope_item' AS entity_type, entity_id, CASE WHEN item_id IS NULL THEN 'not_found' ELSE 'applied' END AS outcome, CASE WHEN item_id IS NOT NULL THEN coalesce(lag(after) OVER (PARTITION BY entity_id ORDER BY seq), was) END AS before, after FROM ij),
audit AS (SELECT seq, entity_type, entity_id, outcome, before, CASE WHEN outcome = 'applied' THEN after END AS after FROM (SELECT * FROM ra UNION ALL SELECT * FROM ga UNION ALL SELECT * FROM ia))"""


def _reviewed(spark, sf):
    c = view(spark, sf, "f_conflicts")
    titles = view(spark, sf, "f_taxonomy").groupBy("code").agg(F.min_by("title", "ord").alias("section_title"))
    items = view(spark, sf, "f_items").select("item_id", "code", "division", "review_status").join(titles, "code", "left")
    actions = spark.sql(_ACTIONS.replace("FROM events", "FROM {events}"), events=view(spark, sf, "events"))
    return V.apply_review_actions(c.select("conflict_id", "status").distinct(), c.select("conflict_id", "item_id"), view(spark, sf, "f_gaps").select("gap_id", "status"), items, actions, view(spark, sf, "f_taxonomy"))


@register("apply_review_actions", with_views("f_conflicts", "f_gaps", "f_items", "f_taxonomy") + _STATE + " SELECT * FROM audit")
def apply_review_actions(spark, sf):
    return _reviewed(spark, sf)["audit"].drop("actor", "action")


@register("reviewed_state", with_views("f_conflicts", "f_gaps", "f_items", "f_taxonomy") + _STATE + """, won AS (SELECT entity_id AS conflict_id, winner FROM rj WHERE seq = first), lost AS (SELECT DISTINCT item_id FROM f_conflicts JOIN won USING (conflict_id) WHERE item_id <> winner), last AS (SELECT item_id, max_by(struct_pack(c := to_code, d := to_division, t := to_title), seq) AS t FROM ij WHERE item_id IS NOT NULL GROUP BY item_id)
SELECT 'conflict' AS kind, conflict_id AS id, coalesce('resolved:' || winner, status) AS state FROM (SELECT DISTINCT conflict_id, status FROM f_conflicts) LEFT JOIN won USING (conflict_id)
UNION ALL SELECT 'gap', gap_id, CASE WHEN gap_id IN (SELECT entity_id FROM ga) THEN 'acknowledged' ELSE status END FROM f_gaps
UNION ALL SELECT 'item', item_id, concat_ws('|', coalesce(t.c, code), coalesce(t.d, division), coalesce(CASE WHEN t IS NULL THEN section_title ELSE t.t END, ''), coalesce(CASE WHEN lost.item_id IS NOT NULL THEN 'rejected' ELSE review_status END, '')) FROM its LEFT JOIN last USING (item_id) LEFT JOIN lost USING (item_id)""")
def reviewed_state(spark, sf):
    out = _reviewed(spark, sf)
    kind = lambda df, k, c, state: df.select(F.lit(k).alias("kind"), F.col(c).alias("id"), F.expr(state).alias("state"))
    items = kind(out["items"], "item", "item_id", "concat_ws('|', code, division, coalesce(section_title, ''), coalesce(review_status, ''))")
    conflicts = kind(out["conflicts"], "conflict", "conflict_id", "coalesce('resolved:' || winner_item, status)")
    return conflicts.unionByName(kind(out["gaps"], "gap", "gap_id", "status")).unionByName(items)


_STATES = "CASE event_id % 3 WHEN 0 THEN 'setup' WHEN 1 THEN 'open-for-bids' ELSE 'complete' END"


@register("lifecycle_check", f""" WITH e AS (SELECT user_id AS project_id, event_id AS seq, {_STATES} AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY project_id ORDER BY seq) AS before FROM e)
SELECT project_id, seq, state, before, CASE WHEN before IS NULL THEN 'first' WHEN before = state THEN 'no-op' WHEN before || '>' || state IN ('setup>open-for-bids', 'open-for-bids>setup', 'open-for-bids>complete', 'complete>open-for-bids') THEN 'allowed' ELSE 'rejected' END AS verdict FROM b""")
def lifecycle_check(spark, sf):
    e = view(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.expr(_STATES).alias("state"))
    return R.lifecycle_check(e)


@register("audit_log_query", with_views("f_audit") + """ SELECT project_id, audit_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, audit_id DESC) AS rank FROM f_audit
WHERE entity_type = 'citation' AND actor LIKE 'user:%' AND ts >= (SELECT min(ts) FROM f_audit) + INTERVAL 1 DAY) WHERE rank > 5 AND rank <= 30""")
def audit_log_query(spark, sf):
    audit = view(spark, sf, "f_audit")
    since = audit.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("since")).first()["since"]
    return R.audit_log_query(audit, entity_type="citation", actor="user:", since=since, limit=25, skip=5).select("project_id", "audit_id", "rank")


@register("supervised_examples", with_views("f_audit", "f_items") + " SELECT audit_id, description AS prompt, action || CASE WHEN json_extract_string(payload, '$.k') IS NULL THEN '' ELSE ': ' || json_extract_string(payload, '$.k') END AS answer FROM f_audit JOIN f_items ON item_id = entity_id WHERE actor LIKE 'user:%'")
def supervised_examples(spark, sf):
    return R.supervised_examples(*_v(spark, sf, "f_audit", "f_items"))


@register("activity_feed", with_views("f_llm_calls", "f_audit") + """, e AS (SELECT project_id, 'call-' || call_id AS event, CASE WHEN status = 'error' THEN 'error' ELSE 'cost' END AS kind, ts FROM f_llm_calls UNION ALL SELECT project_id, 'audit-' || audit_id, 'pipeline', ts FROM f_audit)
SELECT project_id, event, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event DESC) AS rank FROM e) WHERE rank <= 50""")
def activity_feed(spark, sf):
    return R.activity_feed(*_v(spark, sf, "f_llm_calls", "f_audit"), 50).select("project_id", "event", "kind", "rank")


_COST = ", r(m, i, o, w, c) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE, {i if w is None else w}::DOUBLE, {i if c is None else c}::DOUBLE)" for m, i, o, w, c in R.RATES) + "), costed AS (SELECT f.*, round((input_tokens * i + output_tokens * o + cache_write * w + cache_read * c) / 1e6, 8) AS cost FROM f_llm_calls f LEFT JOIN r ON starts_with(model, m))"


@register("llm_cost", with_views("f_llm_calls") + _COST + " SELECT call_id, cost FROM costed")
def llm_cost(spark, sf):
    return R.llm_cost(view(spark, sf, "f_llm_calls"), R.load_rates(spark)).select("call_id", "cost")


@register("cost_breakdown", with_views("f_llm_calls") + _COST + """, k AS (SELECT purpose AS key, count(*) AS calls, round(sum(cost), 6) AS cost FROM costed GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY coalesce(cost, 0) DESC, key) AS n FROM k)
SELECT CASE WHEN n <= 3 THEN key ELSE '(other)' END AS key, sum(calls)::BIGINT AS calls, round(coalesce(sum(cost), 0), 6) AS cost FROM n GROUP BY 1""")
def cost_breakdown(spark, sf):
    return R.cost_breakdown(R.llm_cost(view(spark, sf, "f_llm_calls"), R.load_rates(spark)), "purpose", 3)


@register("citation_summary", with_views("f_citations") + " SELECT coalesce(evidence_type, 'TOTAL') AS evidence_type, count(*) AS n, count(*) FILTER (link_pass) AS passed, count(*) FILTER (NOT link_pass) AS failed, count(*) FILTER (link_pass IS NULL) AS not_run FROM f_citations GROUP BY ROLLUP (evidence_type)")
def citation_summary(spark, sf):
    return R.citation_summary(view(spark, sf, "f_citations"))


_DOCS = ", d AS (SELECT DISTINCT document_id, CASE WHEN document_id % 3 = 0 THEN 'ready' ELSE 'extracting' END AS processing_status FROM f_pages)"


@register("processing_progress", with_views("f_pages") + _DOCS + ", c AS (SELECT document_id, count(*) AS total, count(*) FILTER (length(text) > 0) AS completed FROM f_pages GROUP BY document_id) SELECT document_id, CASE WHEN processing_status <> 'ready' THEN completed END AS completed, CASE WHEN processing_status <> 'ready' THEN total END AS total FROM d JOIN c USING (document_id)")
def processing_progress(spark, sf):
    pages = view(spark, sf, "f_pages")
    docs = pages.select("document_id").distinct().withColumn("processing_status", F.expr("CASE WHEN document_id % 3 = 0 THEN 'ready' ELSE 'extracting' END"))
    return R.processing_progress(docs, pages)


@register("readiness_check", with_views("f_pages") + ", c AS (SELECT document_id, count(*) - count(text) AS k FROM f_pages GROUP BY document_id) SELECT document_id, CASE WHEN k = 0 THEN 'ready' ELSE 'extracting' END AS status, CASE WHEN k > 0 THEN k || ' pages are not done' END AS message FROM c")
def readiness_check(spark, sf):
    return R.readiness_check(view(spark, sf, "f_pages"))


@register("system_status", with_views("f_llm_calls") + _COST + " SELECT 'orders' AS name, count(*) AS rows, NULL::DOUBLE AS cost FROM orders UNION ALL SELECT 'documents', count(*), NULL FROM documents UNION ALL SELECT 'llm_calls', count(*), round(sum(cost), 6) FROM costed")
def system_status(spark, sf):
    calls = R.llm_cost(view(spark, sf, "f_llm_calls"), R.load_rates(spark))
    return R.system_status({n: view(spark, sf, n) for n in ("orders", "documents")} | {"llm_calls": calls})


def _judged(spark, sf):
    """Items with their tier, quantity band, and whether both sides show them."""
    items, cits = _v(spark, sf, "f_items", "f_citations")
    has = lambda t: F.coalesce(F.array_contains("types", t), F.lit(False))
    tiered = E.evidence_tier(items, E.evidence_rollup(cits)).withColumn("bilateral", has("spec") & has("drawing"))
    return tiered.join(Q.resolve_quantity(items, cits).select("item_id", "qty_confidence"), "item_id")


@register("rfi_inputs", with_views("f_items", "f_citations", "f_gaps", "f_conflicts") + _TIER + """, g AS (SELECT run_id, 'gap' AS kind, CAST(gap_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY run_id ORDER BY gap_id) AS n, 50 AS cap FROM f_gaps WHERE status = 'open'),
c AS (SELECT run_id, 'conflict' AS kind, CAST(conflict_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY run_id ORDER BY conflict_id) AS n, 20 AS cap FROM (SELECT DISTINCT run_id, conflict_id FROM f_conflicts WHERE status = 'open')),
i AS (SELECT run_id, 'item' AS kind, CAST(item_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY run_id ORDER BY confidence NULLS LAST, item_id) AS n, 10 AS cap FROM tiered WHERE tier = 'INFERRED_LOW_CONFIDENCE' AND run_id IN (SELECT run_id FROM g UNION SELECT run_id FROM c))
SELECT run_id, kind, subject FROM (SELECT * FROM g UNION ALL SELECT * FROM c UNION ALL SELECT * FROM i) WHERE n <= cap""")
def rfi_inputs(spark, sf):
    gaps, conflicts = _v(spark, sf, "f_gaps", "f_conflicts")
    return R.rfi_inputs(gaps, conflicts, _judged(spark, sf))


@register("item_flags", with_views("f_items", "f_citations") + _TIER + _RESOLVED + """, fl AS (SELECT t.*, array_to_string([x FOR x IN [CASE WHEN qty_confidence <> 'high' THEN 'qty:' || qty_confidence END, CASE WHEN tier = 'INFERRED_LOW_CONFIDENCE' THEN 'evidence:low' END, CASE WHEN NOT coalesce(list_contains(r.types, 'spec') AND list_contains(r.types, 'drawing'), false) THEN 'one-sided' END] IF x IS NOT NULL], ', ') AS flags,
row_number() OVER (PARTITION BY run_id ORDER BY code, item_id) AS n, greatest(count(*) OVER (PARTITION BY run_id) - 60, 0) AS omitted FROM tiered t JOIN resolved USING (item_id) LEFT JOIN r USING (item_id))
SELECT run_id, item_id, '- ' || code || ': ' || description || coalesce(' — qty ' || quantity || coalesce(' ' || unit, ''), '') || CASE WHEN coalesce(flags, '') <> '' THEN ' [' || flags || ']' ELSE '' END AS line, omitted FROM fl WHERE n <= 60""")
def item_flags(spark, sf):
    return R.item_flags(_judged(spark, sf))
