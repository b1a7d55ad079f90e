"""Views that let the test tables stand in for the domain tables.

Each view is SQL that Spark and DuckDB both understand, over the test tables and other views. A query gets
its inputs with ``view(spark, sf_dir, name)``; its oracle starts with ``with_views(...)`` of the same text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.operators.grounding import PREFIX_DISCIPLINE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "f_documents": """
        SELECT doc_id AS document_id, doc_id % 4 AS project_id,
               CASE WHEN doc_id % 3 = 0 THEN 'bid_submission' ELSE 'project_document' END AS source_kind,
               CASE doc_id % 5 WHEN 0 THEN 'drawing-set' WHEN 1 THEN 'written-spec' WHEN 2 THEN 'bid-quote' WHEN 3 THEN 'scope-letter' ELSE 'other' END AS doc_type,
               'file-' || CAST(doc_id AS STRING) || '.pdf' AS filename, text FROM documents""",
    "f_pages": """
        SELECT CAST(floor(doc_id / 20) AS BIGINT) AS document_id, doc_id % 20 + 1 AS page_number,
               CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN ''
                    WHEN doc_id % 3 = 0 THEN 'SECTION ' || lpad(CAST(doc_id % 34 AS STRING), 2, '0') || ' ' || lpad(CAST(doc_id % 90 AS STRING), 2, '0') || ' 00 - PART ' || CAST(doc_id % 7 AS STRING) || chr(10) || text
                    ELSE text END AS text FROM documents""",
    "f_ocr": """
        SELECT doc_id AS page_id, 'a' AS provider, text FROM documents
        UNION ALL SELECT doc_id, 'b', CASE WHEN n_chars > 4000 THEN substring(text, 1, CAST(floor(n_chars * (60 + doc_id % 40) / 100.0) AS INT)) WHEN doc_id % 10 = 3 THEN reverse(text)
            ELSE 'scan ' || substring(text, 4, CAST(floor(n_chars * (30 + doc_id % 40) / 100.0) AS INT)) || ' ocr ' || substring(text, CAST(floor(n_chars * (34 + doc_id % 40) / 100.0) AS INT)) END FROM documents""",
    "f_queries": """
        SELECT item_id AS query_id, item_id % 4 AS project_id, text,
               CASE item_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'ambiguous' ELSE 'no_match' END AS difficulty FROM benchmark""",
    "f_taxonomy": """
        SELECT code, substring(code, 1, 2) AS division, min(p_partkey) AS ord, min(p_type) AS title FROM (
            SELECT lpad(CAST(p_partkey % 34 AS STRING), 2, '0') || ' ' || lpad(CAST(p_size AS STRING), 2, '0') || ' ' || CAST(p_partkey % 3 AS STRING) || '0' AS code, p_partkey, p_type FROM part) t
        GROUP BY code""",
    "f_items": """
        SELECT p_partkey AS item_id, p_partkey % 4 AS run_id, p_partkey % 4 AS project_id,
               lpad(CAST(p_partkey % 40 AS STRING), 2, '0') || '-' || lpad(CAST((p_size + p_partkey % 3) % 60 AS STRING), 2, '0') || '-' || CAST(p_partkey % 3 AS STRING) || '0' AS proposed,
               lpad(CAST(p_partkey % 34 AS STRING), 2, '0') || ' ' || lpad(CAST(p_size AS STRING), 2, '0') || ' ' || CAST(p_partkey % 3 AS STRING) || '0' AS code,
               lpad(CAST(p_partkey % 34 AS STRING), 2, '0') AS division, p_name || ' ' || p_brand || ' ' || p_type AS description, p_type AS specification,
               CASE p_partkey % 5 WHEN 0 THEN '1,200 SF' WHEN 1 THEN '12 EA' WHEN 2 THEN '45' WHEN 4 THEN 'approx 9 lf' END AS quantity,
               CASE p_partkey % 3 WHEN 0 THEN 'sq. ft.' WHEN 1 THEN 'ea' END AS unit,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS DOUBLE) / 100 END AS confidence,
               CASE p_partkey % 6 WHEN 0 THEN 'schedule_miner' WHEN 1 THEN 'eve' WHEN 2 THEN 'eve:admin' WHEN 3 THEN 'eve:qc' WHEN 4 THEN 'section' ELSE 'drawing' END AS extraction_method,
               CASE p_partkey % 3 WHEN 0 THEN 'bilateral' WHEN 1 THEN 'spec_only' ELSE 'drawing_only' END AS expected,
               CASE WHEN p_partkey % 13 = 0 THEN 'rejected' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'open' END AS review_status FROM part""",
    "f_citations": """
        SELECT citation_id, item_id, l_orderkey AS chunk_id, evidence_type, rerank, link_pass, excerpt, sheet FROM (
            SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS citation_id,
                   l_partkey AS item_id, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'drawing' WHEN 'N' THEN 'spec' ELSE 'bid' END AS evidence_type,
                   l_discount * 10 AS rerank, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus = 'F' END AS link_pass,
                   CAST(CAST(l_quantity AS INT) AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN ' SF, 3 EA' ELSE ' lin ft' END AS excerpt,
                   'A' || CAST(l_partkey % 9 AS STRING) || '.1' AS sheet,
                   row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) t WHERE n = 1""",
    "f_votes": """
        SELECT doc_id AS candidate_id, k, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (quality + k) % 2 = 1 END AS accept, CASE WHEN doc_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) + CAST(k AS DOUBLE) / 10 END AS confidence
        FROM labels CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) v""",
    "f_relevance": """
        SELECT (n_nationkey + n_regionkey) % 4 AS project_id, lpad(CAST(n_nationkey AS STRING), 2, '0') AS division, n_regionkey < 3 AS is_relevant,
               n_nationkey % 6 = 0 AS overridden, CASE WHEN n_nationkey % 6 = 0 THEN n_nationkey % 12 = 0 END AS override_value, n_nationkey % 3 = 0 AS has_evidence FROM nation""",
    "f_runs": """
        SELECT o_orderkey AS run_id, o_custkey % 50 AS project_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders""",
    "f_bids": """
        SELECT o_orderkey AS bid_id, o_custkey % 50 AS project_id, s_name || CASE o_orderkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN '  Company' ELSE '' END AS vendor_name, s_name AS vendor,
               CASE o_orderkey % 6 WHEN 0 THEN 'bid-quote' WHEN 1 THEN 'scope-letter' WHEN 2 THEN 'license' WHEN 3 THEN 'safety' WHEN 4 THEN 'contractor-info' ELSE 'other' END AS doc_type,
               CASE WHEN o_orderkey % 5 = 0 THEN 'extracting' ELSE 'ready' END AS processing_status,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(CAST(o_orderkey % 34 AS STRING), 2, '0') END AS division, o_totalprice AS bid_total
        FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier) + 1""",
    "f_bid_lines": """
        SELECT citation_id AS line_id, l.l_orderkey AS bid_id, p_name AS description, l.l_extendedprice AS total_price, l.l_linenumber AS page FROM (
            SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS citation_id,
                   row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) l
        JOIN part ON p_partkey = l.l_partkey WHERE n = 1""",
    "f_bid_terms": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS term_id, l_orderkey AS bid_id,
               CASE min(l_returnflag) WHEN 'A' THEN 'inclusion' ELSE 'exclusion' END AS kind, 'term ' || CAST(l_partkey AS STRING) AS text, l_linenumber AS page
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "f_coverage": """
        SELECT l_partkey AS item_id, l_orderkey AS bid_id, l_partkey % 4 AS run_id, CASE min(l_linenumber) % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' WHEN 2 THEN 'excluded' ELSE 'not_covered' END AS status,
               max(l_discount) * 10 AS confidence, CASE WHEN min(l_linenumber) % 4 < 3 THEN min(CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)) END AS line_id FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "f_revisions": """
        SELECT l_partkey % 4 AS project_id, 'A' || CAST(l_partkey % 50 AS STRING) AS sheet_id, l_suppkey % 5 AS document_id, CASE WHEN l_partkey % 50 < 20 AND l_suppkey % 5 = 3 THEN '8' ELSE CAST(l_linenumber AS STRING) END AS rev_number FROM lineitem""",
    "f_gaps": """
        SELECT l_orderkey AS gap_id, l_orderkey % 4 AS run_id, CASE l_orderkey % 3 WHEN 0 THEN 'missing_section' WHEN 1 THEN 'unresolved_cross_reference' ELSE 'qty_implausible' END AS gap_type,
               CASE l_orderkey % 5 WHEN 0 THEN 'blocker' ELSE 'warn' END AS severity, CASE l_orderkey % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'open' END AS status,
               lpad(CAST(l_orderkey % 34 AS STRING), 2, '0') AS division, min(l_comment_free) AS description
        FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'install before backfill' ELSE 'confirm scope' END AS l_comment_free FROM lineitem) g GROUP BY l_orderkey""",
    "f_conflicts": """
        SELECT p_partkey % 200 AS conflict_id, p_partkey AS item_id, p_partkey % 4 AS run_id, CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN p_partkey % 200 % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
               CAST(p_size AS DOUBLE) AS value, CASE WHEN p_partkey % 200 % 4 = 0 AND p_partkey % 400 < 200 THEN 'SF' ELSE 'EA' END AS unit FROM part""",
    "f_llm_calls": """
        SELECT event_id AS call_id, user_id % 8 AS project_id, event_type AS purpose, CASE user_id % 5 WHEN 0 THEN 'claude-sonnet-4-5-20250929' WHEN 1 THEN 'claude-haiku-4-5-20251001' WHEN 2 THEN 'claude-opus-4-5-20251101' WHEN 3 THEN 'voyage-3-large' ELSE 'other-model' END AS model,
               CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 5) AS BIGINT) ELSE 0 END AS cache_read, 0 AS cache_write,
               CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, ts FROM events""",
    "f_audit": """
        SELECT event_id AS audit_id, user_id % 8 AS project_id, CASE WHEN user_id % 3 = 0 THEN 'system:runner' ELSE 'user:' || CAST(user_id AS STRING) END AS actor,
               CASE event_id % 4 WHEN 0 THEN 'scope_item' WHEN 1 THEN 'citation' WHEN 2 THEN 'conflict' ELSE 'gap' END AS entity_type, event_id % 50 AS entity_id, event_type AS action, props AS payload, ts FROM events""",
    "f_sheets": """
        SELECT p_partkey AS ord, p_partkey % 4 AS project_id, p_partkey % 20 AS document_id, p_partkey % 30 + 1 AS page,
               CASE p_partkey % 8 WHEN 0 THEN 'G01' WHEN 1 THEN 'g-0' || CAST(p_size % 9 AS STRING) WHEN 2 THEN 'A' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 4 AS STRING) WHEN 3 THEN 'CVR' WHEN 4 THEN 'Structural   drawings'
                    WHEN 5 THEN 'FP0.' || CAST(p_size % 5 AS STRING) WHEN 6 THEN 'E-1' || CAST(p_size % 9 AS STRING) || ' plan' ELSE 'see sheet 4' END AS sheet_id, p_type AS title FROM part""",
}


#: Chunks are the windows of the pages' whole texts; the first window of a page keeps the page's number as its id.
_CHUNK = """document_id * 20 + page_number - 1 + CAST(chunk_index AS BIGINT) * 1000000000 AS chunk_id, (document_id * 20 + page_number - 1) % 4 AS project_id, document_id, page_number,
               CASE (document_id * 20 + page_number - 1) % 3 WHEN 0 THEN 'spec_section' WHEN 1 THEN 'note' ELSE 'page_summary' END AS chunk_type"""
VIEWS["f_chunks"] = f"""
        SELECT {_CHUNK}, substring(text, CAST(chunk_index * 5600 + 1 AS BIGINT), 6000) AS text FROM (
            SELECT *, unnest(range(CASE WHEN length(text) <= 6000 THEN 1 ELSE CAST(ceil((length(text) - 6000) / 5600.0) AS BIGINT) + 1 END)) AS chunk_index FROM (
                SELECT document_id, page_number, trim(text) AS text FROM ({VIEWS["f_pages"]}) p WHERE length(trim(text)) > 0) t) w"""
#: Discipline of a sheet id, by its first letters.
DISCIPLINE = "CASE WHEN starts_with(upper(trim(sheet_id)), 'FP') THEN 'fire-protection' ELSE CASE substring(upper(trim(sheet_id)), 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREFIX_DISCIPLINE.items() if len(k) == 1) + " END END"
#: Chunks with their sheet and the text that is indexed.
VIEWS["f_indexed"] = f"""
        SELECT chunk_id, project_id, document_id, page_number, chunk_type, text, sheet_id, sheet_title, discipline,
               concat_ws(' ', 'Document: file-' || document_id || '.pdf', 'page ' || page_number, 'sheet ' || sheet_id, CASE WHEN sheet_id IS NULL OR sheet_title <> sheet_id THEN '(' || sheet_title || ')' END,
                         '[' || discipline || ']', CASE WHEN chunk_type <> 'page_summary' THEN '-> ' || chunk_type END) || chr(10) || coalesce(text, '') AS contextualized_text
        FROM ({VIEWS["f_chunks"]}) c JOIN (SELECT doc_id AS document_id FROM documents) d USING (document_id)
        LEFT JOIN (SELECT document_id, page_number, s.sheet_id, s.sheet_title, s.discipline FROM (
            SELECT document_id, page AS page_number, min_by(struct_pack(sheet_id := nullif(sheet_id, ''), sheet_title := nullif(title, ''), discipline := {DISCIPLINE}), ord) AS s FROM ({VIEWS["f_sheets"]}) x GROUP BY ALL) y) z USING (document_id, page_number)"""
#: Bids of a project are extracted in two runs, the later of which is its latest.
VIEWS["f_bid_runs"] = """
        SELECT project_id * 10 + k AS bid_run_id, project_id, k AS started_at, project_id % 4 AS scope_run_id FROM (SELECT DISTINCT o_custkey % 50 AS project_id FROM orders) p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) v"""
VIEWS["f_bid_summaries"] = """
        SELECT o_orderkey AS bid_id, o_custkey % 50 * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS bid_run_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(CAST(o_orderkey % 34 AS STRING), 2, '0') END AS division FROM orders"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopeloom.operators.text import window_text

    windows = window_text(view(spark, sf_dir, "f_pages"))
    return windows.selectExpr(*[c.strip() for c in re.split(r",(?![^(]*\))", _CHUNK)], "chunk AS text")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopeloom.operators.grounding import discipline_of_sheet
    from scopeloom.operators.text import contextualize

    sheets = view(spark, sf_dir, "f_sheets").withColumn("discipline", discipline_of_sheet(F.col("sheet_id")))
    return contextualize(view(spark, sf_dir, "f_chunks"), view(spark, sf_dir, "f_documents"), sheets)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's SQL over lines that are dealt by item once, so that rows of equal keys, and then an item's, meet without a second sort or shuffle."""
    return spark.sql(re.sub(r"\bFROM lineitem\b", "FROM {lineitem}", VIEWS["f_citations"]), lineitem=table(spark, sf_dir, "lineitem").repartition("l_partkey"))


def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citation_id and item_id of ``f_citations``, which the keys alone decide: no line is ranked, and rows lie by citation_id."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    name = F.concat_ws("-", *keys)
    whole = F.when(~F.greatest(*[F.col(k).isNull() for k in keys]), name)
    # an id tells its keys, and its keys are looked at only where one of them is missing
    lines = table(spark, sf_dir, "lineitem").select(whole.alias("citation_id"), F.col("l_partkey").alias("item_id"), F.when(whole.isNull(), F.struct(*keys)).alias("odd"))
    # one sort drops copies and serves a join by citation
    copy = F.row_number().over(W.partitionBy("citation_id", "item_id", "odd").orderBy("citation_id"))
    return lines.repartition("citation_id").withColumn("copy", copy).where("copy = 1").select("citation_id", "item_id")


#: Views that Spark builds with the library's own operators; their SQL is the oracle's.
BUILT = {"f_chunks": _chunks, "f_indexed": _indexed, "f_citations": _citations}


def folder(spark: SparkSession) -> str:
    """A fresh folder below the session's shared one."""
    from scopeloom.functions.graph import checkpointed

    checkpointed(spark.range(1))  # sets one in a local session without
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _needs(sql: str) -> list[str]:
    return [n for n in (*VIEWS, *TABLES) if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    sql = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in _needs(re.sub(r"(?i)\bAS \w+", "", sql)) if re.search(rf"(?i)\b(FROM|JOIN) {n}\b", sql)}
    for n in inputs:
        sql = re.sub(rf"(?i)\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inputs)


def with_views(*names: str) -> str:
    """The WITH clause of an oracle, without a trailing comma."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
