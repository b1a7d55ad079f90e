"""Queries of the source, schedule, clustering, evaluation and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scopeloom.functions.graph import checkpointed
from scopeloom.operators import ann as A
from scopeloom.operators import clustering as C
from scopeloom.operators import evaluation as V
from scopeloom.operators import evidence as E
from scopeloom.operators import grounding as G
from scopeloom.operators import indexing as X
from scopeloom.sources import ingest as I
from scopeloom.operators import retrieval as R
from scopeloom.operators import schedules as S
from scopeloom.plans.fixtures import folder, view, with_views
from scopeloom.plans.registry import register
from scopeloom.plans.text_queries import _BM25, _TAGGED, TOKENS, _sparse, _vectors
from scopeloom.streaming import jobs


@register("ingest_documents", "SELECT doc_id AS id, coalesce(strlen(text), 0)::BIGINT AS size, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' WHEN strlen(text) > 8000 THEN 'too_large' END AS refused FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '%PDF' || text ELSE text END AS text FROM documents)")
def ingest_documents(spark, sf):
    files = view(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr("CAST(CASE WHEN doc_id % 5 = 0 THEN '%PDF' || text ELSE text END AS BINARY)").alias("content"), F.lit("text/plain").alias("declared"))
    return I.ingest_documents(files, 8000)


@register("input_fingerprint", with_views("f_documents") + " SELECT project_id, sha256(string_agg(h, chr(10) ORDER BY h) || chr(10)) AS fingerprint FROM (SELECT project_id, sha256(text) AS h FROM f_documents WHERE source_kind <> 'bid_submission') GROUP BY project_id")
def input_fingerprint(spark, sf):
    return I.input_fingerprint(view(spark, sf, "f_documents"))


_CELLS = "SELECT p_partkey AS row_idx, CASE WHEN p_partkey = 1 THEN 'Code' WHEN p_partkey % 50 = 2 THEN CAST(p_partkey % 34 AS STRING) || ' - ' || p_type ELSE lpad(CAST(p_partkey % 34 AS STRING), 2, '0') || ' ' || lpad(CAST(p_size AS STRING), 2, '0') || ' 00 ' || p_name END AS cell FROM part"


@register("load_taxonomy", f"""WITH c AS ({_CELLS}), h AS (SELECT lpad(regexp_extract(cell, '^(\\d{{1,2}}) - (.+)$', 1), 2, '0') AS division, min_by(regexp_extract(cell, '^(\\d{{1,2}}) - (.+)$', 2), row_idx) AS t FROM c WHERE regexp_matches(cell, '^\\d{{1,2}} - ') GROUP BY 1),
s AS (SELECT substring(cell, 1, 8) AS code, min(row_idx) AS ord, min_by(substring(cell, 10), row_idx) AS title FROM c WHERE regexp_matches(cell, '^\\d{{2}} \\d{{2}} \\d{{2}}') GROUP BY 1)
SELECT code, substring(code, 1, 2) AS division, title, ord, coalesce(t, 'Division ' || substring(code, 1, 2)) AS division_title FROM s LEFT JOIN h ON division = substring(code, 1, 2)""")
def load_taxonomy(spark, sf):
    return I.load_taxonomy(spark.sql(_CELLS.replace("FROM part", "FROM {part}"), part=view(spark, sf, "part")))


@register("profile_is_taxonomy", f"WITH c AS ({_CELLS}) SELECT row_idx // 60 AS document_id, count(*) FILTER (regexp_matches(cell, '^\\d{{2}} \\d{{2}} \\d{{2}}')) >= 40 AS is_trade_list, CASE WHEN count(*) FILTER (regexp_matches(cell, '^\\d{{2}} \\d{{2}} \\d{{2}}')) >= 40 THEN 0.99 ELSE 0 END::DOUBLE AS confidence FROM c WHERE row_idx % 60 <= 50 GROUP BY 1")
def profile_is_taxonomy(spark, sf):
    cells = spark.sql(_CELLS.replace("FROM part", "FROM {part}"), part=view(spark, sf, "part"))
    return I.profile_is_taxonomy(cells.select(F.floor(F.col("row_idx") / 60).alias("document_id"), (F.col("row_idx") % 60).alias("row_idx"), "cell"), 50, 40)


_K = "CAST(get_json_object(props, '$.k') AS INT)"


def _pages(spark, sf):
    """Page payloads from events: every 23rd is broken."""
    text = F.expr("""CASE WHEN event_id % 23 = 0 THEN '{broken' ELSE concat('{"sheet_metadata":{"sheet_number":"A', event_id % 9, '.1","sheet_title":"PLAN"},"schedules":[{"name":"[typed:finish] room","columns":["room","base"],"rows":[{"room":"', event_id, '","base":"b"},{"room":"","base":null}]}],"notes":[{"text":"note ', event_id % 7, '"},{"text":"second"}],"cross_references":[],"entities":[{"entity_type":"equipment","value":"v', event_id % 5, '"}]}') END""")
    return view(spark, sf, "events").select(F.col("event_id").alias("page_id"), text.alias("json"))


@register("parse_page_payload", "SELECT event_id AS page_id, 1 AS sheets, 1 AS schedules, 2 AS notes, 1 AS entities FROM events WHERE event_id % 23 <> 0")
def parse_page_payload(spark, sf):
    t = I.parse_page_payload(_pages(spark, sf))
    n = lambda name: t[name].groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    return n("sheets").join(n("schedules"), "page_id").join(n("notes"), "page_id").join(n("entities"), "page_id")


@register("clamp_box", "SELECT event_id, CASE WHEN value / 10 < 1 THEN round(value / 10, 6) END AS x, CASE WHEN value / 10 < 1 THEN round(least(0.5, 1 - value / 10), 6) END AS width FROM events")
def clamp_box(spark, sf):
    box = I.clamp_box(F.col("value") / 10, F.lit(-0.5), F.lit(0.5), F.lit(2.0))
    return view(spark, sf, "events").select("event_id", F.round(box["x"], 6).alias("x"), F.round(box["width"], 6).alias("width"))


@register("parse_bid_payload", "SELECT o_orderkey AS bid_id, CASE WHEN o_orderkey % 23 = 0 THEN 'doc vendor' ELSE 'V' || o_custkey END AS vendor, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey END::DOUBLE AS bid_total_usd, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 2 END AS lines, 0 AS inclusions, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 1 END AS exclusions FROM orders")
def parse_bid_payload(spark, sf):
    text = F.expr("""CASE WHEN o_orderkey % 23 = 0 THEN 'no json' ELSE concat('{"vendor_name":"V', o_custkey, '","bid_total_usd":', o_custkey, ',"line_items":[{"description":"a","total_price_usd":1.5},{"description":"b"}],"exclusions":[{"text":"x"}]}') END""")
    _, summary = I.parse_bid_payload(view(spark, sf, "orders").select(F.col("o_orderkey").alias("bid_id"), F.lit("doc vendor").alias("vendor"), text.alias("json")))
    return summary


@register("parse_revision_payload", "SELECT page_id AS sheet_id, i AS rev_order, CASE i WHEN 1 THEN 'A' ELSE CAST(page_id % 4 AS VARCHAR) END AS rev_number FROM pages, unnest([1, 2]) AS t(i)")
def parse_revision_payload(spark, sf):
    text = F.expr("""concat('[{"rev_number":" A "},{"rev_number":" "},{"date":"x"},{"rev_number":"', page_id % 4, '"}]')""")
    return I.parse_revision_payload(view(spark, sf, "pages").select(F.col("page_id").alias("sheet_id"), text.alias("json")))


@register("replace_partitions", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders")
def replace_partitions(spark, sf):
    orders, path = view(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), folder(spark)
    I.replace_partitions(orders.withColumn("version", F.lit(1)), path, ["o_orderstatus"])
    I.replace_partitions(orders.where("o_orderstatus = 'F'").withColumn("version", F.lit(2)), path, ["o_orderstatus"])
    return spark.read.parquet(path)


@register("copy_live_rows", "SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0))")
def copy_live_rows(spark, sf):
    out = I.copy_live_rows({"customer": (view(spark, sf, "customer").where("c_custkey % 7 <> 0"), []), "orders": (view(spark, sf, "orders"), [("o_custkey", "customer", "c_custkey")]), "lineitem": (view(spark, sf, "lineitem"), [("l_orderkey", "orders", "o_orderkey")])})
    return out["orders"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("orders").alias("name"), "rows").unionByName(out["lineitem"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("lineitem").alias("name"), "rows"))


@register("export_supervised_jsonl", "WITH p AS (SELECT conv_id % 4 AS project_id, role, text, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT project_id, count(*) AS total, count(*) FILTER (text IS NOT NULL AND r = 'assistant' AND a IS NOT NULL) AS written FROM p WHERE role = 'user' GROUP BY project_id")
def export_supervised_jsonl(spark, sf):
    return I.export_supervised_jsonl(I.conversation_pairs(view(spark, sf, "conversations")), folder(spark))


def _schedules(spark, sf):
    """Schedules from parts: name, columns and one or two rows."""
    return view(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        (F.col("p_partkey") % 300).alias("page"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN '[typed:finish] Room Finish' WHEN 1 THEN 'Room Finish' WHEN 2 THEN '[typed:panel] Panel LP' ELSE 'Door' END").alias("name"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN array('code', 'item') WHEN 1 THEN array('room', 'base-wall') WHEN 2 THEN array('load', 'room') ELSE array('x', 'y') END").alias("columns"),
        F.expr("array(map('code', p_name, 'item', p_type, 'load', CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, 'x', p_brand), map('y', ''))").alias("rows"),
    )


_KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'mapping' WHEN 2 THEN 'unknown' ELSE 'unknown' END"


@register("schedule_type", "SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'finish' WHEN 2 THEN 'panel' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'room finish' WHEN 1 THEN 'room finish' WHEN 2 THEN 'panel lp' ELSE 'door' END AS name FROM part")
def schedule_type(spark, sf):
    return _schedules(spark, sf).select("ord", S.schedule_type(F.col("name")).alias("type"), S.stripped_name(F.col("name")).alias("name"))


@register("schedule_kind", f"SELECT p_partkey AS ord, {_KINDS} AS kind FROM part")
def schedule_kind(spark, sf):
    return _schedules(spark, sf).select("ord", S.schedule_kind(F.col("columns")).alias("kind"))


@register("pick_schedule_pass", f"""WITH s AS (SELECT p_partkey AS ord, p_partkey % 300 AS page, {_KINDS} AS kind, CASE p_partkey % 4 WHEN 0 THEN 'room finish' WHEN 1 THEN 'room finish' WHEN 2 THEN 'panel lp' ELSE 'door' END AS stripped, p_partkey % 2 AS untyped FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY page, stripped ORDER BY CASE kind WHEN 'catalog' THEN 3 WHEN 'unknown' THEN 2 WHEN 'mixed' THEN 1 ELSE 0 END DESC, untyped, ord) AS n FROM s) SELECT ord, page, kind FROM r WHERE n = 1""")
def pick_schedule_pass(spark, sf):
    return S.pick_schedule_pass(_schedules(spark, sf)).select("ord", "page", "kind")


_ROWS = """WITH r AS (SELECT p_partkey AS ord, 0 AS row_index, CASE p_partkey % 4 WHEN 0 THEN 'From [typed:finish] Room Finish (row 1): code=' || p_name || '; item=' || p_type WHEN 1 THEN 'From Room Finish (row 1): ' WHEN 2 THEN 'From [typed:panel] Panel LP (row 1): ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'load=' || p_name END ELSE 'From Door (row 1): x=' || p_brand END AS text,
CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN p_size % 2 ELSE 1 END AS filled, CASE p_partkey % 4 WHEN 0 THEN 'finish' WHEN 2 THEN 'panel' END AS type, p_name FROM part
UNION ALL SELECT p_partkey, 1, 'From ' || CASE p_partkey % 4 WHEN 0 THEN '[typed:finish] Room Finish' WHEN 1 THEN 'Room Finish' WHEN 2 THEN '[typed:panel] Panel LP' ELSE 'Door' END || ' (row 2): ', 0, CASE p_partkey % 4 WHEN 0 THEN 'finish' WHEN 2 THEN 'panel' END, p_name FROM part)"""


@register("explode_schedule_rows", _ROWS + " SELECT ord, row_index, text, filled FROM r")
def explode_schedule_rows(spark, sf):
    return S.explode_schedule_rows(_schedules(spark, sf)).select("ord", "row_index", "text", "filled")


def _rows(spark, sf):
    types = _schedules(spark, sf).select("ord", S.schedule_type(F.col("name")).alias("type"))
    return S.explode_schedule_rows(_schedules(spark, sf)).join(types, "ord")


#: Rows of door, finish, room, panel and equipment schedules, with words that the unit and skip rules look for.
_TYPES = ("door", "finish", "room", "panel", "equipment")
_WORDS = ("LVT1 resilient", "TR2 Schluter edge", "Paint finish frame", "paint wall", "B3 wall base", "SPARE", "no  load", "refrigerant line", "exit sign", "act ceiling", "wood slats", "")
_RULE_ROWS = f"""SELECT p_partkey AS id, [{", ".join(repr(t) for t in _TYPES)}, NULL][p_partkey % 6 + 1] AS type, [{", ".join(repr(w) for w in _WORDS)}][p_partkey % {len(_WORDS)} + 1] AS description, CASE WHEN p_partkey % 7 = 0 THEN 'RESERVED' WHEN p_partkey % 7 < 4 THEN p_name END AS load, CASE WHEN p_partkey % 4 = 0 THEN 'SF' WHEN p_partkey % 4 = 1 THEN 'CY' END AS answered FROM part"""


def _rule_rows(spark, sf):
    part = view(spark, sf, "part")
    pick = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("p_partkey") % n)
    rows = part.select(F.col("p_partkey").alias("id"), pick([*_TYPES, None], 6).alias("type"), pick(_WORDS, len(_WORDS)).alias("description"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'RESERVED' WHEN p_partkey % 7 < 4 THEN p_name END").alias("load"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'SF' WHEN p_partkey % 4 = 1 THEN 'CY' END").alias("answered"))
    row = F.create_map(F.lit("Description"), "description", F.lit("LOAD"), "load")
    return rows.select("id", "type", "answered", row.alias("row"), F.concat_ws(" ", "description", "load").alias("text"), (F.length("description") + F.length(F.coalesce("load", F.lit("")))).alias("filled"))


@register("skip_rows", f"WITH r AS ({_RULE_ROWS}), t AS (SELECT *, trim(description || ' ' || coalesce(load, '')) AS said FROM r) SELECT id, CASE WHEN length(description) + length(coalesce(load, '')) = 0 THEN 'empty_row' WHEN type IN ('panel', 'equipment') AND (said = '' OR regexp_matches(said, '(?i){S.NO_LOAD}')) THEN 'circuit_no_load' END AS skip FROM t")
def skip_rows(spark, sf):
    return S.skip_rows(_rule_rows(spark, sf)).select("id", "skip")


# DuckDB's patterns can't look ahead: the phrases that rule bare paint out are taken away first
_BARE_PAINT = r"(regexp_matches(text, '(?i)\bP\d+\b|\b(?:SHERWIN|BENJAMIN MOORE)\b') OR regexp_matches(regexp_replace(text, '(?i)\bPAINT\b\s+(?:FINISH|FRAME|GRADE|TYPE|COAT|JOB)', '', 'g'), '(?i)\bPAINT\b'))"


def _unit_sql() -> str:
    test = lambda p: _BARE_PAINT if "(?!" in p else f"regexp_matches(text, '(?i){p}')"
    case = lambda kind: "CASE " + " ".join(f"WHEN {test(p)} THEN '{u}'" for t, p, u in S.UNIT_RULES if t == kind) + " END"
    default = "CASE WHEN type IN ('door', 'panel', 'equipment') THEN 'EA' END"
    return f"coalesce(CASE WHEN coalesce(type, 'finish') = 'finish' THEN {case('finish')} WHEN type = 'equipment' THEN {case('equipment')} END, answered, {default})"


@register("unit_override", f"WITH r AS ({_RULE_ROWS}), t AS (SELECT *, description || coalesce(' ' || load, '') AS text FROM r) SELECT id, {_unit_sql()} AS unit FROM t")
def unit_override(spark, sf):
    return S.unit_override(_rule_rows(spark, sf))


@register("row_overlap_guard", _ROWS + """, w AS (SELECT ord, list_distinct(regexp_extract_all(upper(p_name || ' EXTRA'), '[A-Z0-9]{2,}')) AS d, list_distinct(regexp_extract_all(upper(text), '[A-Z0-9]{2,}')) AS t FROM r WHERE row_index = 0) SELECT ord, round(len(list_intersect(d, t)) / len(d), 6) AS overlap FROM w""")
def row_overlap_guard(spark, sf):
    rows = _rows(spark, sf).where("row_index = 0").join(view(spark, sf, "part").select(F.col("p_partkey").alias("ord"), "p_name"), "ord")
    return rows.select("ord", S.row_overlap(F.concat("p_name", F.lit(" EXTRA")), F.col("text")).alias("overlap"))


#: Answers on whole schedules and on their rows: some can't be counted, some name a section, some units are missing.
_MINED_HEADS = "SELECT p_partkey AS ord, p_partkey % 11 <> 0 AS is_quantifiable, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE '09' END AS division, CASE WHEN p_partkey % 5 = 0 THEN '09 65 00' END AS section, CASE WHEN p_partkey % 2 = 0 THEN 'SF' ELSE '' END AS default_unit FROM part"
_MINED = "SELECT p_partkey AS ord, CAST(0 AS BIGINT) AS row_index, p_name || CASE WHEN p_partkey % 6 = 0 THEN ' wall base' ELSE ' ' END AS description, CASE WHEN p_partkey % 3 = 0 THEN '7' END AS quantity, CASE WHEN p_partkey % 7 = 0 THEN 'CY' END AS unit, p_type AS specification FROM part"


@register("mine_schedule_items", _ROWS + f""", h AS ({_MINED_HEADS}), a AS ({_MINED}), m AS (SELECT coalesce(section, '09 00 00') AS code, ord, row_index, trim(description) AS text, specification, coalesce(quantity, '1') AS quantity, type, coalesce(unit, nullif(default_unit, ''), 'EA') AS answered,
list_distinct(regexp_extract_all(upper(description), '[A-Z0-9]{{2,}}')) AS d, regexp_extract_all(upper(r.text), '[A-Z0-9]{{2,}}') AS t FROM r JOIN a USING (ord, row_index) JOIN h USING (ord) WHERE is_quantifiable AND division <> ' ' AND filled > 0)
SELECT '09' AS division, code, ord, row_index, text AS description, specification, quantity, 'schedule_miner' AS extraction_method, {_unit_sql()} AS unit FROM m WHERE round(len(list_intersect(d, t)) / len(d), 6) >= 0.2""")
def mine_schedule_items(spark, sf):
    part = view(spark, sf, "part")
    heads, answers = (spark.sql(q.replace("FROM part", "FROM {part}"), part=part) for q in (_MINED_HEADS, _MINED))
    return S.mine_schedule_items(S.skip_rows(_rows(spark, sf)), heads, answers)


_PATTERN = f"CASE WHEN regexp_matches(description, '(?i)\\b(?:{E.ADMIN_WORDS})\\b') THEN 'spec_only' WHEN code IN ({', '.join(repr(c) for c in E.DRAWING_ONLY)}) OR substring(code, 1, 5) || ' 00' IN ({', '.join(repr(c) for c in E.DRAWING_ONLY)}) THEN 'drawing_only' WHEN division = '01' THEN 'spec_only' ELSE 'bilateral' END"


@register("expected_pattern", with_views("f_items") + f", i AS (SELECT item_id, code, division, CASE WHEN item_id % 17 = 0 THEN description || ' warranty' ELSE description END AS description FROM f_items) SELECT item_id, {_PATTERN} AS expected FROM i")
def expected_pattern(spark, sf):
    items = view(spark, sf, "f_items").withColumn("description", F.expr("CASE WHEN item_id % 17 = 0 THEN description || ' warranty' ELSE description END"))
    return items.select("item_id", E.expected_pattern(F.col("code"), F.col("description")).alias("expected"))


_DISCIPLINE = "CASE WHEN starts_with(upper(trim(sheet_id)), 'FP') THEN 'fire-protection' ELSE CASE substring(upper(trim(sheet_id)), 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.PREFIX_DISCIPLINE.items() if len(k) == 1) + " END END"


@register("corpus_evidence", with_views("f_pages", "f_sheets") + rf""", c AS (SELECT document_id % 4 AS project_id, text FROM f_pages), k AS (SELECT project_id, lpad(unnest(regexp_extract_all(text, '(?:DIVISION|SECTION) (\d{{1,2}})', 1)), 2, '0') AS key FROM c
UNION SELECT project_id, {_DISCIPLINE} FROM f_sheets UNION SELECT DISTINCT project_id, 'general' FROM c) SELECT DISTINCT project_id, CASE WHEN key = 'landscape' THEN 'site' ELSE key END AS key FROM k WHERE key IS NOT NULL""")
def corpus_evidence(spark, sf):
    return E.corpus_evidence(view(spark, sf, "f_pages").select((F.col("document_id") % 4).alias("project_id"), "text"), view(spark, sf, "f_sheets"))


_DIVISION_DISCIPLINE = "CASE " + " ".join(f"WHEN division IN ({', '.join(repr(n) for n in ns.split())}) THEN '{'site' if d == 'landscape' else d}'" for d, ns in G.DISCIPLINES.items()) + " END"


@register("items_for_sheets", with_views("f_items", "f_sheets", "f_chunks") + f""", m AS (SELECT project_id, sheet_id, min(page * 100 + document_id) AS spot, replace(any_value({_DISCIPLINE}), 'landscape', 'site') AS discipline FROM f_sheets GROUP BY project_id, sheet_id),
b AS (SELECT document_id, page_number AS page, coalesce(min(chunk_id) FILTER (chunk_type = 'page_summary'), min(chunk_id)) AS chunk_id FROM f_chunks GROUP BY ALL),
i AS (SELECT item_id, project_id, {_DIVISION_DISCIPLINE} AS discipline FROM f_items WHERE extraction_method NOT IN ('eve:admin', 'eve:qc') AND NOT regexp_matches(description, '(?i)\\b(?:{E.ADMIN_WORDS})\\b')),
e AS (SELECT * FROM i UNION ALL SELECT item_id, project_id, CASE discipline WHEN 'architectural' THEN 'interior' WHEN 'interior' THEN 'architectural' ELSE 'site' END FROM i WHERE discipline IN ('architectural', 'interior', 'civil'))
SELECT item_id, sheet_id, spot // 100 AS page, chunk_id FROM e JOIN m USING (project_id, discipline) LEFT JOIN b ON b.document_id = spot % 100 AND b.page = spot // 100""")
def items_for_sheets(spark, sf):
    return E.items_for_sheets(view(spark, sf, "f_items"), view(spark, sf, "f_sheets"), view(spark, sf, "f_chunks"))


_SYMBOLS = "SELECT p_brand || '-' || CAST(p_size AS STRING) AS glyph, p_type AS code, CASE WHEN p_partkey % 3 = 0 THEN 'electrical' ELSE 'plumbing' END AS discipline FROM part"


@register("symbol_lookup", f"""WITH s AS ({_SYMBOLS}), m AS (SELECT p_partkey AS id, s.code, s.discipline = CASE WHEN p_partkey % 2 = 0 THEN 'electrical' ELSE 'plumbing' END AS same FROM part LEFT JOIN s ON upper(p_brand || '-' || p_size) = upper(s.glyph)),
g AS (SELECT id, list_distinct(list(code) FILTER (same)) AS near, list_distinct(list(code)) AS every FROM m GROUP BY id) SELECT id, CASE WHEN len(coalesce(near, [])) > 0 THEN CASE WHEN len(near) = 1 THEN near[1] END WHEN len(every) = 1 THEN every[1] END AS code FROM g""")
def symbol_lookup(spark, sf):
    part = view(spark, sf, "part")
    symbols = spark.sql(_SYMBOLS.replace("FROM part", "FROM {part}"), part=part)
    glyphs = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("glyph"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'electrical' ELSE 'plumbing' END").alias("discipline"))
    return E.symbol_lookup(glyphs, symbols)


@register("backfill_legend", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand END AS code FROM part")
def backfill_legend(spark, sf):
    part = view(spark, sf, "part")
    return E.backfill_legend(part.select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_type END").alias("code")), part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code")))


@register("legend_candidates", with_views("f_sheets") + r""", c AS (SELECT *, ord % 2 AS prio FROM f_sheets WHERE regexp_matches(coalesce(title, ''), '(?i)legend|symbol|abbreviation') OR regexp_matches(upper(sheet_id), '^G|-?00[12]$')),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, upper(regexp_replace(sheet_id, '[^A-Za-z0-9]', '', 'g')) ORDER BY prio, ord) AS n FROM c) SELECT document_id, sheet_id, prio, ord FROM r WHERE n = 1""")
def legend_candidates(spark, sf):
    s = view(spark, sf, "f_sheets")
    return E.legend_candidates(s.where("ord % 2 = 0"), s.where("ord % 2 = 1"))


@register("cosine_topk_ann")
def cosine_topk_ann(spark, sf):
    e, q = _vectors(spark, sf)
    return A.cosine_topk_ann(A.write_cells(e, folder(spark)), q, 10)


_PHRASES = " UNION ALL ".join(f"SELECT n_nationkey % 4 AS project_id, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS division, '{k}' AS kind, '{p} the and ' || n_name AS text FROM nation" for k, p in (("materials", "materials products"), ("quantities", "quantities sizes count"), ("specs", "specification requirements")))


@register("multi_query_retrieve", with_views("f_chunks") + f", asked AS ({_PHRASES}), f_queries AS (SELECT project_id, project_id || '~' || division || '~' || kind AS query_id, text FROM asked)" + _BM25 + " SELECT CAST(split_part(query_id, '~', 1) AS BIGINT) AS project_id, split_part(query_id, '~', 2) AS division, chunk_id, string_agg(split_part(query_id, '~', 3), '+' ORDER BY split_part(query_id, '~', 3)) AS found_by, min(rank) AS best_rank FROM sparse GROUP BY ALL")
def multi_query_retrieve(spark, sf):
    divisions = view(spark, sf, "nation").select((F.col("n_nationkey") % 4).cast("long").alias("project_id"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("division"), F.concat(F.lit("the and "), "n_name").alias("title"))

    def search(chunks, asked, k):
        path = folder(spark)
        X.write_index(X.index_blocks(chunks), path)
        return X.indexed_topk(spark, path, asked, k)

    return R.multi_query_retrieve(divisions, view(spark, sf, "f_indexed"), search=search)


@register("profile_pool", with_views("f_chunks", "f_queries") + _BM25 + """, u AS (SELECT project_id, chunk_id, 0 AS prio FROM f_chunks WHERE page_number = 1 UNION ALL SELECT project_id, chunk_id, 1 FROM f_chunks WHERE chunk_type = 'note' UNION ALL SELECT project_id, chunk_id, 2 FROM f_chunks WHERE chunk_id IN (SELECT chunk_id FROM sparse)),
b AS (SELECT project_id, chunk_id, min(prio) AS prio FROM u GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY prio, chunk_id) AS rank FROM b) WHERE rank <= 120""")
def profile_pool(spark, sf):
    return R.profile_pool(view(spark, sf, "f_chunks"), _sparse(spark, sf), F.col("chunk_type") == "note")


_TITLES = ("[typed:door] D", "[TYPED:Window] w", "[typed:finish] f", "[typed:room] r", "[typed:fixture] x", "[typed:panel] p", "[typed:equipment] q", "[typed:other] o", "[typed:unknown] u", "Door")
_READERS = ", ".join(f"('{kind}', '{d}')" for kind, ds in {**R.SCHEDULE_READERS, "other": tuple(G.DISCIPLINES)}.items() for d in ds)


@register("discipline_corpus", with_views("f_pages", "f_sheets") + rf""", c AS (SELECT document_id, page_number, document_id * 20 + page_number AS chunk_id, CASE WHEN page_number % 2 = 0 THEN 'spec_section' ELSE 'note' END AS chunk_type, text FROM f_pages),
s AS (SELECT DISTINCT document_id, {_DISCIPLINE} AS discipline FROM f_sheets), n AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(text, '\b(\d{{2}}) \d{{2}} \d{{2}}\b', 1))) AS division FROM c WHERE chunk_type = 'spec_section'),
k AS (SELECT p_partkey AS schedule_id, unnest([0, 1]) AS row_index, lower(regexp_extract([{", ".join(repr(t) for t in _TITLES)}][p_partkey % 10 + 1], '(?i)typed:([a-z]+)', 1)) AS kind FROM part), readers(kind, discipline) AS (VALUES {_READERS}),
u AS (SELECT DISTINCT discipline, 'drawing' AS side, chunk_id FROM c JOIN s USING (document_id) WHERE chunk_type <> 'spec_section' AND discipline IS NOT NULL UNION SELECT CASE WHEN CAST(division AS INT) % 2 = 0 THEN 'architectural' ELSE 'electrical' END, 'spec', chunk_id FROM n WHERE CAST(division AS INT) < 25)
SELECT discipline, side, chunk_id, NULL AS schedule_id, NULL AS row_index FROM u UNION ALL SELECT discipline, 'schedule', NULL, schedule_id, row_index FROM k JOIN readers USING (kind)""")
def discipline_corpus(spark, sf):
    chunks = view(spark, sf, "f_pages").select("document_id", (F.col("document_id") * 20 + F.col("page_number")).alias("chunk_id"), F.expr("CASE WHEN page_number % 2 = 0 THEN 'spec_section' ELSE 'note' END").alias("chunk_type"), "text")
    sheets = view(spark, sf, "f_sheets").select("document_id", G.discipline_of_sheet(F.col("sheet_id")).alias("discipline")).where("discipline IS NOT NULL")
    divisions = view(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("division"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'architectural' ELSE 'electrical' END").alias("discipline"))
    title = F.get(F.array(*[F.lit(t) for t in _TITLES]), F.col("ord") % 10)
    rows = S.explode_schedule_rows(_schedules(spark, sf)).select(F.col("ord").alias("schedule_id"), "row_index", title.alias("name"))
    return R.discipline_corpus(chunks, sheets, divisions, rows)


#: An item's vector is one of three of its run and division, which other divisions may have too, leaning a little to its own side.
_VECTOR = "(item_id % 136 * 3 + item_id {} 136 % 3) % 120"


def _described(spark, sf):
    vectors = view(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    items = view(spark, sf, "f_items").withColumn("v", F.expr(_VECTOR.format("DIV"))).join(vectors, "v").drop("v")
    leaning = "concat(array(CAST(embedding[0] AS DOUBLE) * (1 + CAST(item_id % 11 AS DOUBLE) / 10)), CAST(slice(embedding, 2, size(embedding)) AS ARRAY<DOUBLE>))"
    return items.withColumn("embedding", F.expr(leaning)).withColumn("group", F.concat(F.col("run_id").cast("string"), F.col("division")))


def _cluster_sql(group: str, least: float, id: str = "item_id", where: str = "true") -> str:
    """Greedy leaders in order of ids, one row of each group after the other."""
    return f""", e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), r AS MATERIALIZED (SELECT {id} AS id, {group} AS g, list_concat([x[1] * (1 + CAST(item_id % 11 AS DOUBLE) / 10)], x[2:]) AS x, row_number() OVER (PARTITION BY {group} ORDER BY {id}) AS n FROM f_items JOIN e ON vec_id = {_VECTOR.format("//")} WHERE {where}),
near AS MATERIALIZED (SELECT b.g, b.n, b.id, coalesce(list(a.id ORDER BY a.id) FILTER (a.id IS NOT NULL), []) AS near FROM r b LEFT JOIN r a ON a.g = b.g AND a.n < b.n AND list_dot_product(a.x, b.x) >= {least} * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)) GROUP BY ALL),
step AS (SELECT g, n, id, id AS leader, [id] AS leaders FROM near WHERE n = 1 UNION ALL
SELECT b.g, b.n, b.id, coalesce([y FOR y IN s.leaders IF list_contains(b.near, y)][1], b.id), CASE WHEN list_has_any(s.leaders, b.near) THEN s.leaders ELSE list_append(s.leaders, b.id) END FROM step s JOIN near b ON b.g = s.g AND b.n = s.n + 1),
clusters AS (SELECT id, leader FROM step)"""


def _recursive(*names: str) -> str:
    return with_views(*names).replace("WITH ", "WITH RECURSIVE ", 1)


_CODES = "CAST(run_id AS STRING) || division"


def _clusters(spark, sf):
    return C.cluster_by_similarity(_described(spark, sf).select(F.col("item_id").alias("id"), "group", "embedding"), C.WITHIN_CODE, "group")


@register("cluster_by_similarity", _recursive("f_items") + _cluster_sql(_CODES, C.WITHIN_CODE) + " SELECT id, leader FROM clusters")
def cluster_by_similarity(spark, sf):
    return _clusters(spark, sf)


@register("dedupe_items", _recursive("f_items", "f_citations") + _cluster_sql(_CODES, C.WITHIN_CODE) + """, m AS (SELECT coalesce(leader, item_id) AS leader, i.* FROM f_items i LEFT JOIN clusters ON id = item_id),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY leader ORDER BY length(description) DESC, coalesce(specification, '') DESC, item_id) = 1), u AS (SELECT leader, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS ids FROM (SELECT DISTINCT leader, chunk_id FROM m JOIN f_citations USING (item_id)) GROUP BY leader),
f AS (SELECT leader, min_by(specification, item_id) FILTER (specification <> '') AS specification, min_by(quantity, item_id) FILTER (quantity <> '') AS quantity, min_by(unit, item_id) FILTER (unit <> '') AS unit, max(confidence) AS confidence, count(*) AS members, string_agg(DISTINCT extraction_method, '+' ORDER BY extraction_method) AS found_by FROM m GROUP BY leader)
SELECT leader, b.description, coalesce(nullif(b.specification, ''), f.specification) AS specification, coalesce(nullif(b.quantity, ''), f.quantity) AS quantity, coalesce(nullif(b.unit, ''), f.unit) AS unit, f.confidence, members, found_by, md5(coalesce(ids, '')) AS chunks FROM f JOIN best b USING (leader) LEFT JOIN u USING (leader)""")
def dedupe_items(spark, sf):
    merged = C.dedupe_items(view(spark, sf, "f_items"), _clusters(spark, sf), view(spark, sf, "f_citations").select("item_id", "chunk_id"))
    return merged.withColumn("chunks", F.md5(F.array_join("chunk_ids", ",").cast("binary"))).drop("chunk_ids")


_LATER = f"item_id + CASE WHEN extraction_method = 'schedule_miner' THEN {C.LATER} ELSE 0 END"


@register("merge_extractors", _recursive("f_items") + _cluster_sql(_CODES, C.WITHIN_CODE, _LATER) + f""", p AS (SELECT id, leader, division FROM clusters JOIN f_items ON item_id = id % {C.LATER}), t AS (SELECT division, count(*) AS candidates, bool_or(id < {C.LATER}) AS emitted FROM p GROUP BY division)
SELECT leader % {C.LATER} AS item_id, division, CASE WHEN leader < {C.LATER} THEN 'extracted' WHEN emitted THEN 'appended' ELSE 'new_division' END AS origin, count(*) AS members, candidates FROM p JOIN t USING (division) GROUP BY ALL""")
def merge_extractors(spark, sf):
    items = _described(spark, sf)
    mined = F.col("extraction_method") == "schedule_miner"
    return C.merge_extractors(items.where(~mined), items.where(mined))


@register("conflict_cross_division", _recursive("f_items") + _cluster_sql("CAST(run_id AS STRING)", C.ACROSS_CODES, where=f"extraction_method NOT IN ('eve:admin', 'eve:qc') AND NOT regexp_matches(description, '(?i)\\b(?:{E.ADMIN_WORDS})\\b')") + " SELECT leader, count(*) AS members, count(DISTINCT division) AS divisions FROM clusters JOIN f_items ON item_id = id GROUP BY leader HAVING count(*) >= 2 AND count(DISTINCT division) >= 2")
def conflict_cross_division(spark, sf):
    return C.conflict_cross_division(_described(spark, sf).withColumn("group", F.col("run_id").cast("string")))


#: Three names of a project after another share a vector, of which each leans to its own side.
@register("canonicalize_vendors", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS MATERIALIZED (SELECT a.vec_id AS id, a.vec_id // 3 % 10 AS project_id, CASE WHEN a.vec_id % 5 = 0 THEN 'V' || a.vec_id % 100 ELSE 'Vendor ' || a.vec_id END AS name, list_concat([b.x[1] * (1 + CAST(a.vec_id % 3 AS DOUBLE) / 10)], b.x[2:]) AS x FROM v a JOIN v b ON b.vec_id = a.vec_id - a.vec_id % 3),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b USING (project_id) WHERE a.id <> b.id AND list_dot_product(a.x, b.x) >= {C.SAME_VENDOR} * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
reach AS (SELECT id AS a, id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), c AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a),
k AS (SELECT c.id, name, label, row_number() OVER (PARTITION BY label ORDER BY CAST(upper(name) = name AND length(replace(name, ' ', '')) <= 4 AS INT), length(name) DESC, name DESC) AS n FROM c JOIN e USING (id)) SELECT k.id, k.name, b.name AS canonical FROM k JOIN k b ON b.label = k.label AND b.n = 1""")
def canonicalize_vendors(spark, sf):
    own = view(spark, sf, "embeddings").selectExpr("vec_id AS id", "vec_id DIV 3 % 10 AS project_id", "CASE WHEN vec_id % 5 = 0 THEN 'V' || CAST(vec_id % 100 AS STRING) ELSE 'Vendor ' || CAST(vec_id AS STRING) END AS name", "vec_id - vec_id % 3 AS v")
    names = own.join(view(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "embedding"), "v").drop("v")
    return C.canonicalize_vendors(names.withColumn("embedding", F.expr("concat(array(CAST(embedding[0] AS DOUBLE) * (1 + CAST(id % 3 AS DOUBLE) / 10)), CAST(slice(embedding, 2, size(embedding)) AS ARRAY<DOUBLE>))")))


_VERDICTS = "WITH v AS (SELECT doc_id // 10 AS fixture_id, doc_id AS rank, quality = 1 AS relevant FROM labels)"


@register("context_precision", _VERDICTS + ", p AS (SELECT fixture_id, relevant, sum(CAST(relevant AS INT)) OVER w / count(*) OVER w AS p FROM v WINDOW w AS (PARTITION BY fixture_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) SELECT fixture_id, round(coalesce(sum(p * CAST(relevant AS INT)) / nullif(sum(CAST(relevant AS INT)), 0), 0), 6) AS context_precision FROM p GROUP BY fixture_id")
def context_precision(spark, sf):
    return V.context_precision(view(spark, sf, "labels").select(F.floor(F.col("doc_id") / 10).alias("fixture_id"), F.col("doc_id").alias("rank"), (F.col("quality") == 1).alias("relevant")))


_SUPPORT = "SELECT doc_id // 10 AS fixture_id, CASE WHEN avg(CASE WHEN {0} THEN quality END) IS NULL THEN 1 WHEN doc_id // 10 % 6 = 0 THEN 0 ELSE round(avg(CASE WHEN {0} THEN quality END), 6) END AS {1} FROM labels GROUP BY doc_id // 10"


def _support(spark, sf, held):
    labels = view(spark, sf, "labels").select(F.floor(F.col("doc_id") / 10).alias("fixture_id"), F.expr(f"CASE WHEN {held} THEN quality = 1 END").alias("supported"))
    return labels, labels.where("fixture_id % 6 <> 0")


@register("context_recall", _SUPPORT.format("doc_id % 4 <> 0", "context_recall"))
def context_recall(spark, sf):
    return V.context_recall(*_support(spark, sf, "doc_id % 4 <> 0"))


@register("faithfulness", _SUPPORT.format("doc_id % 50 > 9", "faithfulness"))
def faithfulness(spark, sf):
    return V.faithfulness(*_support(spark, sf, "doc_id % 50 > 9"))


@register("answer_relevancy", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), o AS (SELECT label, v AS q FROM e JOIN (SELECT min(vec_id) AS vec_id FROM e GROUP BY label) USING (vec_id)) SELECT label AS fixture_id, round(avg(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q))), 6) AS answer_relevancy FROM e JOIN o USING (label) GROUP BY label")
def answer_relevancy(spark, sf):
    e = view(spark, sf, "embeddings").select(F.col("label").alias("fixture_id"), "vec_id", F.col("embedding").alias("vector"))
    first = e.groupBy("fixture_id").agg(F.min_by("vector", "vec_id").alias("original"))
    return V.answer_relevancy(e.join(first, "fixture_id"))


@register("eval_run", "WITH m AS (SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels) SELECT quality, toxic, round(exp((CASE WHEN quality > 0 THEN ln(quality) ELSE 0 END + CASE WHEN toxic > 0 THEN ln(toxic) ELSE 0 END) / nullif(CAST(quality > 0 AS INT) + CAST(toxic > 0 AS INT), 0)), 6) AS overall FROM m")
def eval_run(spark, sf):
    return V.eval_run(view(spark, sf, "labels"), ["quality", "toxic"])


#: Every item is in one of two runs or in both.
_RUN_A, _RUN_B = "item_id % 3 <> 0", "item_id % 3 <> 1 AND (division <> '05' OR item_id % 3 = 0)"


@register("compare_runs", with_views("f_items", "f_citations", "f_gaps") + f""", i AS (SELECT 'a' AS side, item_id, division, code, substring(lower(trim(description)), 1, 120) AS text FROM f_items WHERE {_RUN_A} UNION ALL SELECT 'b', item_id, division, code, substring(lower(trim(description)), 1, 120) FROM f_items WHERE {_RUN_B}),
k AS (SELECT count(*) FILTER (n_b = 0) AS only_a, count(*) FILTER (n_a = 0) AS only_b FROM (SELECT count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM i GROUP BY code, text)),
t AS (SELECT count(*) FILTER (side = 'a') AS ia, count(*) FILTER (side = 'b') AS ib, count(DISTINCT division) FILTER (side = 'a') AS da, count(DISTINCT division) FILTER (side = 'b') AS db, count(DISTINCT code) FILTER (side = 'a') AS sa, count(DISTINCT code) FILTER (side = 'b') AS sb FROM i),
p AS (SELECT 'total' AS part, 'items' AS key, ia AS a, ib AS b FROM t UNION ALL SELECT 'total', 'divisions', da, db FROM t UNION ALL SELECT 'total', 'sections', sa, sb FROM t UNION ALL SELECT 'total', 'only', only_a, only_b FROM k
UNION ALL SELECT 'division', division, count(*) FILTER (side = 'a'), count(*) FILTER (side = 'b') FROM i GROUP BY division UNION ALL SELECT * FROM (SELECT 'section', code, count(*) FILTER (side = 'a'), count(*) FILTER (side = 'b') FROM i GROUP BY code ORDER BY count(*) DESC, code LIMIT 30)
UNION ALL SELECT 'citation', evidence_type, count(*) FILTER (side = 'a'), count(*) FILTER (side = 'b') FROM f_citations JOIN i USING (item_id) GROUP BY evidence_type UNION ALL SELECT 'gap', gap_type, count(*) FILTER (gap_id % 2 = 0), count(*) FILTER (gap_id % 2 = 1) FROM f_gaps GROUP BY gap_type)
SELECT part, key, a, b, CASE WHEN part = 'division' AND a = 0 THEN 'new_coverage' WHEN part = 'division' AND b * 2 < a THEN 'regression' ELSE '' END AS flag FROM p UNION ALL SELECT 'verdict', '', ia, ib, CASE WHEN ib < 0.85 * ia THEN 'fewer_items' WHEN only_a > 0.2 * ia THEN 'lost_items' ELSE 'no_major_drop' END FROM t, k""")
def compare_runs(spark, sf):
    items, gaps = view(spark, sf, "f_items"), view(spark, sf, "f_gaps")
    return V.compare_runs(items.where(_RUN_A), items.where(_RUN_B), view(spark, sf, "f_citations"), gaps.where("gap_id % 2 = 0"), gaps.where("gap_id % 2 = 1"))


#: Every item is found by one of two extractors or by both.
_OLD, _NEW = "item_id % 5 <> 0", "item_id % 5 <> 1"
_ITEM_TYPES = ("eve", "admin", "qc", "section")


@register("compare_extractors", with_views("f_items", "f_taxonomy") + f""", k AS (SELECT code, count(*) FILTER ({_OLD}) AS old_items, count(*) FILTER ({_NEW}) AS new_items, {', '.join(f"count(*) FILTER ({_NEW} AND split_part('eve:' || extraction_method, ':', -1) = '{t}') AS {t}" for t in _ITEM_TYPES)} FROM f_items GROUP BY code)
SELECT code, title, coalesce(old_items, 0) AS old_items, coalesce(new_items, 0) AS new_items, {', '.join(f"coalesce({t}, 0) AS {t}" for t in _ITEM_TYPES)} FROM f_taxonomy LEFT JOIN k USING (code)""")
def compare_extractors(spark, sf):
    items = view(spark, sf, "f_items")
    return V.compare_extractors(items.where(_OLD), items.where(_NEW), view(spark, sf, "f_taxonomy"), list(_ITEM_TYPES))


@register("spot_check", with_views("f_items", "f_citations") + """, d AS (SELECT code, item_id, description FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5('7:' || item_id), item_id) AS n FROM f_items) WHERE n <= 2),
c AS (SELECT * FROM (SELECT item_id, chunk_id, excerpt, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC NULLS LAST, citation_id) AS place FROM f_citations) WHERE place <= 2) SELECT code, item_id, description, place, chunk_id, excerpt FROM d LEFT JOIN c USING (item_id)""")
def spot_check(spark, sf):
    return V.spot_check(view(spark, sf, "f_items"), view(spark, sf, "f_citations"), 2, 7)


#: Every tenth event that is more than a day older than the newest comes late, after the watermark.
_LATE = "event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@register("stream_activity", f"""WITH e AS (SELECT * FROM events WHERE NOT ({_LATE})) SELECT date_trunc('hour', ts) AS start, user_id % 8 AS project_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 6) AS cost FROM e
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_activity(spark, sf):
    events, root = view(spark, sf, "events"), folder(spark)
    newest = events.agg(F.max("ts").alias("newest"))
    marked = events.join(F.broadcast(newest)).withColumn("late", F.expr("event_id % 10 = 0 AND ts < newest - INTERVAL 1 DAY"))
    rows = marked.select("late", "ts", (F.col("user_id") % 8).alias("project_id"), F.col("event_type").alias("status"), F.col("value").alias("cost"))
    for late in (False, True):
        rows.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("ts timestamp_ntz, project_id bigint, status string, cost double").parquet(f"{root}/in")
        jobs.stream_activity(source, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("start timestamp, project_id bigint, events bigint, errors bigint, cost double").parquet(f"{root}/out")


@register("stream_index", with_views("f_pages") + _TAGGED + r""", t AS (SELECT document_id, page_number, trim(text) AS text FROM f_pages WHERE length(trim(text)) > 0),
w AS (SELECT *, unnest(range(CASE WHEN length(text) <= 6000 THEN 1 ELSE CAST(ceil((length(text) - 6000) / 5600.0) AS BIGINT) + 1 END)) AS i FROM t),
c AS (SELECT document_id, csi_section, 'Document: file-' || document_id || '.pdf page ' || page_number || ' -> ' || CASE WHEN csi_section IS NULL THEN 'note' ELSE 'spec_section' END || chr(10) || substring(w.text, CAST(i * 5600 + 1 AS BIGINT), 6000) AS text FROM w JOIN tagged USING (document_id, page_number)),
k AS (SELECT document_id, csi_section, """ + TOKENS + """ AS tokens FROM c) SELECT document_id, count(*) AS chunks, count(DISTINCT csi_section) AS sections, sum(len(tokens))::BIGINT AS tokens, sum(len(list_distinct(tokens)))::BIGINT AS postings FROM k GROUP BY document_id""")
def stream_index(spark, sf):
    pages, root = view(spark, sf, "f_pages"), folder(spark)
    pages = pages.select((F.col("document_id") % 4).alias("project_id"), "document_id", F.concat(F.lit("file-"), F.col("document_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(0).cast("long").alias("version"), "page_number", "text")
    replaced = pages.where("document_id % 7 = 1")
    stale = replaced.withColumn("text", F.lit("SECTION 99 99 00 of an older issue"))
    # a first issue of some documents, the rest, and the issue that replaces the first
    for rows in (stale.unionByName(pages.where("document_id % 7 = 0")), pages.where("document_id % 7 > 1"), replaced.withColumn("version", F.lit(1).cast("long")).unionByName(stale)):
        rows.write.mode("append").parquet(f"{root}/in")
        jobs.stream_index(spark, f"{root}/in", f"{root}/index", f"{root}/checkpoint").awaitTermination()
    jobs.compact(spark, f"{root}/index")
    chunks = jobs.live(spark, f"{root}/index", jobs.CHUNKS).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("csi_section").alias("sections"), F.sum("length").alias("tokens"))
    return chunks.join(jobs.live(spark, f"{root}/index").groupBy("document_id").agg(F.count(F.lit(1)).alias("postings")), "document_id")
