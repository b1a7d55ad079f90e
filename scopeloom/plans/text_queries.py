"""Queries of the text and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scopeloom.functions.graph import checkpointed
from scopeloom.operators import indexing as X
from scopeloom.operators import judging as J
from scopeloom.operators import retrieval as R
from scopeloom.operators import text as T
from scopeloom.plans.fixtures import VIEWS, folder, view, with_views
from scopeloom.plans.registry import register

TOKENS = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)*')"
SECTIONS = r"regexp_extract_all(text, 'SECTION (\d{2} \d{2} \d{2})', 1)"


@register("pages_needing_text", with_views("f_pages") + " SELECT document_id, page_number FROM f_pages WHERE text IS NULL OR length(text) = 0")
def pages_needing_text(spark, sf):
    return T.pages_needing_text(view(spark, sf, "f_pages"))


@register("fuse_ocr", with_views("f_ocr") + """, o AS (SELECT page_id, provider, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM f_ocr), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CAST(length(trim(coalesce(text, ''))) = 0 AS INT), length(coalesce(text, '')) DESC, provider) AS n FROM o),
p AS (SELECT page_id, max(CASE WHEN n = 1 THEN provider END) AS provider, max(CASE WHEN n = 1 THEN coalesce(text, '') END) AS text, max(CASE WHEN n = 2 THEN coalesce(text, '') END) AS other FROM r GROUP BY page_id),
g AS (SELECT *, CASE WHEN other IS NULL THEN NULL WHEN greatest(length(text), length(other)) = 0 THEN 0.0 ELSE round(CASE WHEN starts_with(text, other) THEN length(text) - length(other) ELSE levenshtein(text, other) END / greatest(length(text), length(other)), 4) END AS d FROM p)
SELECT page_id, provider, text, CAST(d AS DOUBLE) AS disagreement, coalesce(d >= 0.2, false) AS flagged FROM g""")
def fuse_ocr(spark, sf):
    # the engines measure edits beyond ASCII in characters and in bytes, so such signs are evened out here
    return T.fuse_ocr(view(spark, sf, "f_ocr").withColumn("text", F.regexp_replace("text", "[^ -~]", "?")))


_WINDOWS = """, t AS (SELECT document_id, page_number, trim(text) AS text FROM f_pages WHERE length(trim(text)) > 0),
n AS (SELECT *, CASE WHEN length(text) <= 6000 THEN 1 ELSE CAST(ceil((length(text) - 6000) / 5600.0) AS INT) + 1 END AS total FROM t)
SELECT document_id, page_number, total AS chunk_total, i AS chunk_index, md5(substring(text, CAST(i * 5600 + 1 AS BIGINT), 6000)) AS digest FROM (SELECT *, unnest(range(total)) AS i FROM n)"""


@register("window_text", with_views("f_pages") + _WINDOWS)
def window_text(spark, sf):
    return T.window_text(view(spark, sf, "f_pages")).select("document_id", "page_number", "chunk_total", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@register("blank_page_chunks", with_views("f_pages") + " SELECT document_id, page_number, 'page_summary' AS chunk_type, 'Page ' || page_number || ' (no text)' AS chunk FROM f_pages WHERE coalesce(length(trim(text)), 0) = 0")
def blank_page_chunks(spark, sf):
    return T.blank_page_chunks(view(spark, sf, "f_pages"))


_TAGGED = f", s AS (SELECT document_id, page_number, {SECTIONS}[-1] AS own FROM f_pages), tagged AS (SELECT document_id, page_number, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS csi_section FROM s)"


@register("section_carry_forward", with_views("f_pages") + _TAGGED + " SELECT * FROM tagged")
def section_carry_forward(spark, sf):
    return T.section_carry_forward(view(spark, sf, "f_pages")).select("document_id", "page_number", "csi_section")


@register("detect_sections", with_views("f_pages") + r""", h AS (SELECT document_id, page_number, unnest(regexp_extract_all(text, 'SECTION (\d{2} \d{2} \d{2})[ \t]*[-:]?[ \t]*([^\n]*)', 0)) AS head FROM f_pages),
c AS (SELECT document_id, page_number, substring(head, 9, 8) AS code, nullif(trim(regexp_replace(head, '^SECTION \d{2} \d{2} \d{2}[ \t]*[-:]?[ \t]*', '')), '') AS title FROM h)
SELECT document_id, code, count(*) AS hits, min_by(title, CASE WHEN title IS NOT NULL THEN page_number END) AS title FROM c GROUP BY document_id, code""")
def detect_sections(spark, sf):
    return T.detect_sections(view(spark, sf, "f_pages"))


@register("reconcile_sections", with_views("f_pages", "f_taxonomy") + f", c AS (SELECT DISTINCT document_id, unnest({SECTIONS}) AS code FROM f_pages) SELECT document_id, code, CASE WHEN code IN (SELECT code FROM f_taxonomy) THEN 'confirmed' ELSE 'rejected' END AS status FROM c")
def reconcile_sections(spark, sf):
    return T.reconcile_sections(T.detect_sections(view(spark, sf, "f_pages")), view(spark, sf, "f_taxonomy")).select("document_id", "code", "status")


@register("section_page_ranges", with_views("f_pages") + f""", c AS (SELECT document_id, page_number, unnest({SECTIONS}) AS code FROM f_pages), f AS (SELECT document_id, code, min(page_number) AS first_page FROM c GROUP BY ALL),
e AS (SELECT document_id, max(page_number) AS pages FROM f_pages GROUP BY document_id)
SELECT document_id, code, first_page, greatest(first_page, coalesce(lead(first_page) OVER (PARTITION BY document_id ORDER BY first_page, code) - 1, pages)) AS last_page FROM f JOIN e USING (document_id)""")
def section_page_ranges(spark, sf):
    return T.section_page_ranges(view(spark, sf, "f_pages"))


@register("observed_sections", with_views("f_pages", "f_taxonomy", "f_relevance") + _TAGGED + """ SELECT DISTINCT csi_section AS code, substring(csi_section, 1, 2) AS division, coalesce(title, 'Section ' || csi_section) AS title
FROM tagged LEFT JOIN f_taxonomy ON code = csi_section WHERE substring(csi_section, 1, 2) IN (SELECT division FROM f_relevance WHERE is_relevant)""")
def observed_sections(spark, sf):
    return T.observed_sections(T.section_carry_forward(view(spark, sf, "f_pages")), view(spark, sf, "f_taxonomy"), view(spark, sf, "f_relevance").where("is_relevant"))


@register("contextualize", with_views("f_indexed") + " SELECT chunk_id, sheet_id, sheet_title, discipline, md5(contextualized_text) AS digest FROM f_indexed")
def contextualize(spark, sf):
    return view(spark, sf, "f_indexed").select("chunk_id", "sheet_id", "sheet_title", "discipline", F.md5(F.col("contextualized_text").cast("binary")).alias("digest"))


@register("assemble_doc_text", with_views("f_pages") + """, p AS (SELECT document_id, string_agg('[page ' || page_number || ']' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY page_number) AS t FROM f_pages GROUP BY document_id)
SELECT document_id, md5(CASE WHEN length(t) > 60000 THEN substring(t, 1, 60000) || chr(10) || '[truncated]' ELSE t END) AS digest, length(t) > 60000 AS truncated FROM p""")
def assemble_doc_text(spark, sf):
    return T.assemble_doc_text(view(spark, sf, "f_pages")).select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"), "truncated")


@register("truncate_to_width", with_views("f_items") + " SELECT item_id, CASE WHEN length(description) > 24 THEN substring(description, 1, 23) || '…' ELSE description END AS description FROM f_items")
def truncate_to_width(spark, sf):
    return T.truncate_to_width(view(spark, sf, "f_items").select("item_id", "description"), {"description": 24})


@register("item_chunk_stats", with_views("f_pages") + _TAGGED + ", r AS (SELECT document_id % 4 AS project_id, csi_section, row_number() OVER (PARTITION BY document_id % 4, csi_section ORDER BY document_id, page_number) AS n FROM tagged WHERE csi_section IS NOT NULL) SELECT project_id, csi_section, count(*) FILTER (n <= 50) AS kept, count(*) FILTER (n > 50) AS dropped FROM r GROUP BY ALL")
def item_chunk_stats(spark, sf):
    return T.item_chunk_stats(T.section_carry_forward(view(spark, sf, "f_pages")).withColumn("project_id", F.col("document_id") % 4))


@register("tokenize", f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def tokenize(spark, sf):
    t = R.tokenize(F.col("text"))
    return view(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


_BM25 = f""", f_indexed AS MATERIALIZED ({VIEWS["f_indexed"]}), tok AS MATERIALIZED (SELECT project_id, chunk_id, {TOKENS} AS tokens FROM (SELECT project_id, chunk_id, contextualized_text AS text FROM f_indexed)), t AS (SELECT project_id, chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM tok), tf AS MATERIALIZED (SELECT project_id, chunk_id, length, term, count(*) AS tf FROM t GROUP BY ALL),
corpus AS (SELECT project_id, count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok GROUP BY project_id), df AS (SELECT project_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT project_id, term, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN corpus USING (project_id)), mean AS (SELECT project_id, avg(raw) AS mean_idf FROM raw GROUP BY project_id),
idf AS (SELECT project_id, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw JOIN mean USING (project_id)),
q AS (SELECT project_id, query_id, term, count(*) AS times FROM (SELECT project_id, query_id, unnest({TOKENS}) AS term FROM f_queries) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM q JOIN idf USING (project_id, term) JOIN tf USING (project_id, term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20 AND score > 0)"""


@register("bm25_index", with_views("f_chunks", "f_queries") + _BM25 + " SELECT project_id, term, round(idf, 6) AS idf, count(*) AS postings, round(max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS most FROM idf JOIN tf USING (project_id, term) GROUP BY ALL")
def bm25_index(spark, sf):
    index = X.read_index(spark, _index(spark, sf))
    sums = index.blocks.groupBy("project_id", "term").agg(F.sum("n").alias("postings"), F.round(F.max("most"), 6).alias("most"))
    return sums.join(index.terms.select("project_id", "term", F.round("idf", 6).alias("idf")), ["project_id", "term"])


def _index(spark, sf) -> str:
    path = folder(spark)
    X.write_index(X.index_blocks(view(spark, sf, "f_indexed")), path)
    return path


def _sparse(spark, sf, k=20):
    return X.indexed_topk(spark, _index(spark, sf), view(spark, sf, "f_queries"), k)


@register("bm25_topk", with_views("f_chunks", "f_queries") + _BM25 + " SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_topk(spark, sf):
    return _sparse(spark, sf)


_VEC = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS score FROM e JOIN q USING (label)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10)"""


def _vectors(spark, sf):
    e = view(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("group_key"), "embedding")
    return e, e.where("chunk_id % 20 = 0").select("group_key", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


@register("cosine_topk", _VEC + " SELECT query_id, chunk_id, score, rank FROM dense")
def cosine_topk(spark, sf):
    return R.cosine_topk(*_vectors(spark, sf), 10)


@register("cosine_topk_filtered", _VEC.split("s AS (")[0] + """c AS (SELECT vec_id, label, v, vec_id % 6 AS document_id, CASE vec_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'spec_section' END AS chunk_type, vec_id % 7 AS page_number, vec_id % 4 AS source_id FROM e),
f AS (SELECT vec_id AS query_id, label, v, CASE WHEN vec_id % 3 = 0 THEN vec_id % 6 END AS document_id, CASE WHEN vec_id % 3 = 1 THEN 'note' END AS chunk_type, CASE WHEN vec_id % 8 = 4 THEN vec_id % 7 END AS page_number, CASE WHEN vec_id % 3 = 2 THEN 2 END AS source_id FROM q),
s AS (SELECT query_id, c.vec_id AS chunk_id, round(list_dot_product(c.v, f.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(f.v, f.v))), 6) AS score FROM c JOIN f USING (label) WHERE (f.document_id IS NULL OR f.document_id = c.document_id) AND (f.chunk_type IS NULL OR f.chunk_type = c.chunk_type) AND (f.page_number IS NULL OR f.page_number = c.page_number) AND (f.source_id IS NULL OR f.source_id = c.source_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk_filtered(spark, sf):
    e, q = _vectors(spark, sf)
    chunks = e.selectExpr("*", "chunk_id % 6 AS document_id", "CASE chunk_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'spec_section' END AS chunk_type", "chunk_id % 7 AS page_number", "chunk_id % 4 AS source_id")
    filters = q.selectExpr("query_id", "CASE WHEN query_id % 3 = 0 THEN query_id % 6 END AS document_id", "CASE WHEN query_id % 3 = 1 THEN 'note' END AS chunk_type", "CASE WHEN query_id % 8 = 4 THEN query_id % 7 END AS page_number", "CASE WHEN query_id % 3 = 2 THEN 2 END AS source_id")
    return R.cosine_topk(chunks, q, 10, filters=filters)


@register("upsert_embeddings", "SELECT vec_id AS chunk_id, vec_id % 3 <> 0 OR vec_id % 20 = 0 AS embedded FROM embeddings")
def upsert_embeddings(spark, sf):
    e, q = _vectors(spark, sf)
    held = e.withColumn("embedding", F.when(F.col("chunk_id") % 3 != 0, F.col("embedding")))
    return R.upsert_embeddings(held, q.withColumnRenamed("query_id", "chunk_id")).select("chunk_id", "embedded")


@register("clear_embeddings", "SELECT vec_id AS chunk_id, label NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS embedded FROM embeddings")
def clear_embeddings(spark, sf):
    chunks = view(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("project_id"), "embedding")
    return R.clear_embeddings(chunks, view(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("project_id"))).select("chunk_id", "embedded")


_DENSE = """, v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ds AS (SELECT query_id, chunk_id, round(list_dot_product(c.x, q.x) / (sqrt(list_dot_product(c.x, c.x)) * sqrt(list_dot_product(q.x, q.x))), 6) AS score FROM f_queries f JOIN v q ON q.vec_id = query_id JOIN f_indexed k USING (project_id) JOIN v c ON c.vec_id = chunk_id),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20)"""
_FUSED = _DENSE + ", u AS (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense), f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL), fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10)"


def _dense(spark, sf, k=20):
    """Chunks and queries whose number an embedding has, by cosine within the project."""
    vectors = view(spark, sf, "embeddings")
    chunks = view(spark, sf, "f_chunks").join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    asked = view(spark, sf, "f_queries").select("project_id", "query_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return R.cosine_topk(chunks, asked, k, "project_id")


def _lists(spark, sf, k=20):
    return checkpointed(_sparse(spark, sf, k)), checkpointed(_dense(spark, sf, k))


@register("rrf_fuse", with_views("f_chunks", "f_queries") + _BM25 + _FUSED + " SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, rank FROM fused")
def rrf_fuse(spark, sf):
    return R.rrf_fuse(list(_lists(spark, sf)), 10)


#: A third of the queries asks for notes, a third for one document; the last has no filter.
_FILTERS = "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'note' END AS chunk_type, CASE WHEN query_id % 3 = 1 THEN query_id % 5 END AS document_id FROM f_queries"
_KEPT = f", fl AS ({_FILTERS}), kept AS (SELECT s.query_id, s.chunk_id, s.score, s.rank FROM sparse s JOIN fl USING (query_id) JOIN f_indexed c USING (chunk_id) WHERE (fl.chunk_type IS NULL OR fl.chunk_type = c.chunk_type) AND (fl.document_id IS NULL OR fl.document_id = c.document_id) OR EXISTS (SELECT 1 FROM dense d WHERE d.query_id = s.query_id AND d.chunk_id = s.chunk_id))"


def _filters(spark, sf):
    return view(spark, sf, "f_queries").selectExpr("query_id", "CASE WHEN query_id % 3 = 0 THEN 'note' END AS chunk_type", "CASE WHEN query_id % 3 = 1 THEN query_id % 5 END AS document_id")


@register("filter_sparse", with_views("f_chunks", "f_queries") + _BM25 + _DENSE + _KEPT + " SELECT * FROM kept")
def filter_sparse(spark, sf):
    sparse, dense = _lists(spark, sf)
    return R.filter_sparse(sparse, dense, view(spark, sf, "f_chunks"), _filters(spark, sf))


_HYDRATED = "c.document_id, page_number, chunk_type, sheet_id, sheet_title, discipline, filename, coalesce(s.score, 0.0) AS sparse_score, coalesce(d.score, 0.0) AS dense_score"
_HYDRATE = "JOIN f_indexed c USING (chunk_id) LEFT JOIN f_documents o ON o.document_id = c.document_id LEFT JOIN dense d ON d.query_id = t.query_id AND d.chunk_id = t.chunk_id"


@register("hydrate_hits", with_views("f_chunks", "f_queries", "f_documents") + _BM25 + _FUSED + f" SELECT t.query_id, t.chunk_id, t.rank, CAST(t.score AS DOUBLE) AS rrf_score, {_HYDRATED} FROM fused t {_HYDRATE} LEFT JOIN sparse s ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id")
def hydrate_hits(spark, sf):
    sparse, dense = _lists(spark, sf)
    return R.hydrate_hits(R.rrf_fuse([sparse, dense], 10), view(spark, sf, "f_indexed"), view(spark, sf, "f_documents"), sparse, dense)


#: Where the text of a hit holds a term of its query, and what is shown of it.
_AROUND = r""", p AS (SELECT *, [i FOR i IN [instr(lower(text), t) FOR t IN string_split_regex(lower(query), '\s+') IF length(t) > 1] IF i > 0][1] AS a FROM h),
b AS (SELECT *, greatest(1, a - 80) AS s, least(length(text), a - 1 + 240) AS e FROM p)"""
_SNIPPET = "CASE WHEN a IS NULL THEN substring(text, 1, 240) ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || substring(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '…' ELSE '' END END"


_RERANKED = _KEPT + """, hu AS (SELECT query_id, chunk_id, rank FROM kept UNION ALL SELECT query_id, chunk_id, rank FROM dense), hf AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM hu GROUP BY ALL),
hfused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hf QUALIFY rank <= 50),
rr AS (SELECT query_id, chunk_id, hfused.score AS rrf_score, coalesce(quality * 0.6 + 0.2, hfused.score) AS score FROM hfused LEFT JOIN labels ON doc_id = chunk_id), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr QUALIFY rank <= 10)"""


@register("hybrid_search", with_views("f_chunks", "f_queries", "f_documents") + _BM25.replace("rank <= 20", "rank <= 50") + _DENSE.replace("rank <= 20", "rank <= 50") + _RERANKED + f", h AS (SELECT t.query_id, t.chunk_id, t.rank, CAST(t.score AS DOUBLE) AS score, CAST(t.rrf_score AS DOUBLE) AS rrf_score, {_HYDRATED}, length(c.text) AS n_chars, q.text AS query, c.text FROM best t {_HYDRATE} LEFT JOIN kept s ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id JOIN f_queries q ON q.query_id = t.query_id)" + _AROUND + f" SELECT * EXCLUDE (query, text, a, s, e), {_SNIPPET} AS snippet FROM b")
def hybrid_search(spark, sf):
    sparse, dense = _lists(spark, sf, 50)
    chunks = view(spark, sf, "f_indexed")
    relevance = view(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") * 0.6 + 0.2).alias("relevance"))
    hits = R.hybrid_search(sparse, dense, chunks, view(spark, sf, "f_documents"), view(spark, sf, "f_queries"), relevance, _filters(spark, sf))
    return hits.join(chunks.select("chunk_id", F.length("text").alias("n_chars")), "chunk_id")


@register("apply_rerank", with_views("f_chunks", "f_queries") + _BM25 + ", j AS (SELECT query_id, chunk_id, coalesce(quality * 0.6 + 0.2, score) AS score FROM sparse LEFT JOIN labels ON doc_id = chunk_id) SELECT * FROM (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM j) WHERE rank <= 5")
def apply_rerank(spark, sf):
    scores = view(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") * 0.6 + 0.2).alias("relevance"))
    return R.apply_rerank(_sparse(spark, sf), scores, 5)


_HITS = ", h AS (SELECT query_id, chunk_id, q.text AS query, c.text FROM sparse JOIN f_queries q USING (query_id) JOIN f_chunks c USING (chunk_id))"


@register("snippet", with_views("f_chunks", "f_queries") + _BM25 + _HITS + _AROUND + f"\nSELECT query_id, chunk_id, {_SNIPPET} AS snippet FROM b")
def snippet(spark, sf):
    hits = _sparse(spark, sf).select("query_id", "chunk_id").join(view(spark, sf, "f_queries").select("query_id", F.col("text").alias("query")), "query_id").join(view(spark, sf, "f_chunks").select("chunk_id", "text"), "chunk_id")
    return R.snippet(hits).select("query_id", "chunk_id", "snippet")


#: A query is judged on the document of its best hit. Its truth are the sections there whose first page fits its number; every third query is a control.
_JUDGED = f""", c AS (SELECT document_id, page_number, unnest({SECTIONS}) AS code FROM f_pages), fp AS (SELECT document_id, code, min(page_number) AS first_page FROM c GROUP BY ALL), ep AS (SELECT document_id, max(page_number) AS pages FROM f_pages GROUP BY document_id),
ranges AS (SELECT document_id, code, first_page, greatest(first_page, coalesce(lead(first_page) OVER (PARTITION BY document_id ORDER BY first_page, code) - 1, pages)) AS last_page FROM fp JOIN ep USING (document_id)),
hits AS (SELECT query_id, chunk_id, rank, document_id, page_number FROM sparse JOIN f_chunks USING (chunk_id)), asked AS (SELECT query_id, min_by(document_id, rank) AS document_id FROM hits GROUP BY query_id),
own AS (SELECT query_id, document_id, page_number, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits JOIN asked USING (query_id, document_id)),
truth AS (SELECT query_id, code AS key FROM asked JOIN ranges USING (document_id) WHERE query_id % 3 <> 2 AND (first_page + query_id) % 2 = 0),
keyed AS (SELECT query_id, code AS key, min(rank) AS rank FROM own JOIN ranges USING (document_id) WHERE page_number BETWEEN first_page AND last_page GROUP BY ALL),
judged AS (SELECT query_id, count(*) AS truth, count(rank) AS found, min(rank) AS first_rank, coalesce(string_agg(key, '|' ORDER BY key) FILTER (rank IS NOT NULL), '') AS covered, coalesce(string_agg(key, '|' ORDER BY key) FILTER (rank IS NULL), '') AS missing FROM truth LEFT JOIN keyed USING (query_id, key) GROUP BY query_id),
sizes AS (SELECT query_id, count(*) AS candidates, count(*) FILTER (hits.document_id = asked.document_id) AS in_document FROM hits JOIN asked USING (query_id) GROUP BY query_id),
ev AS (SELECT query_id, document_id, candidates, in_document, coalesce(truth, 0) AS truth, coalesce(found, 0) AS found, round(found / truth, 6) AS recall, first_rank, coalesce(covered, '') AS covered, coalesce(missing, '') AS missing FROM asked JOIN sizes USING (query_id) LEFT JOIN judged USING (query_id))"""


def _judged(spark, sf):
    pages = view(spark, sf, "f_pages")
    ranges = checkpointed(T.section_page_ranges(pages))
    hits = checkpointed(_sparse(spark, sf).join(view(spark, sf, "f_chunks").select("chunk_id", "document_id", "page_number"), "chunk_id"))
    asked = hits.groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    truth = asked.join(ranges, "document_id").where("query_id % 3 <> 2 AND (first_page + query_id) % 2 = 0").select("query_id", F.col("code").alias("key"))
    return J.retrieval_eval(asked, hits, J.keys_by_page(J.ranked_in_document(hits, asked), ranges), truth)


@register("retrieval_eval", with_views("f_chunks", "f_queries", "f_pages") + _BM25 + _JUDGED + " SELECT * FROM ev")
def retrieval_eval(spark, sf):
    return _judged(spark, sf)


@register("retrieval_eval_sheets", with_views("f_chunks", "f_queries") + _BM25 + """, hits AS (SELECT query_id, chunk_id, rank, document_id, sheet_id FROM sparse JOIN f_indexed USING (chunk_id)), asked AS (SELECT query_id, min_by(document_id, rank) AS document_id FROM hits GROUP BY query_id),
truth AS (SELECT DISTINCT query_id, sheet_id AS key FROM asked JOIN (SELECT DISTINCT document_id, page_number, sheet_id FROM f_indexed WHERE sheet_id IS NOT NULL) s USING (document_id) WHERE query_id % 3 <> 2 AND (page_number + query_id) % 2 = 0),
own AS (SELECT query_id, sheet_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits JOIN asked USING (query_id, document_id)), keyed AS (SELECT query_id, key, min(rank) AS rank FROM own WHERE key IS NOT NULL GROUP BY ALL)
SELECT query_id, count(*) AS truth, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, min(rank) AS first_rank, coalesce(string_agg(key, '|' ORDER BY key) FILTER (rank IS NULL), '') AS missing FROM truth LEFT JOIN keyed USING (query_id, key) GROUP BY query_id""")
def retrieval_eval_sheets(spark, sf):
    chunks = view(spark, sf, "f_indexed").select("chunk_id", "document_id", "page_number", "sheet_id")
    hits = checkpointed(_sparse(spark, sf).join(chunks, "chunk_id"))
    asked = hits.groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    named = chunks.where("sheet_id IS NOT NULL").select("document_id", "page_number", "sheet_id").distinct()
    truth = asked.join(named, "document_id").where("query_id % 3 <> 2 AND (page_number + query_id) % 2 = 0").select("query_id", F.col("sheet_id").alias("key"))
    keyed = J.keys_by_sheet(J.ranked_in_document(hits, asked).drop("sheet_id"), chunks)
    return J.retrieval_eval(asked, hits, keyed, truth).where("truth > 0").select("query_id", "truth", "found", "recall", "first_rank", "missing")


@register("retrieval_summary", with_views("f_chunks", "f_queries", "f_pages") + _BM25 + _JUDGED + """ SELECT coalesce(difficulty, 'OVERALL') AS difficulty, count(recall) AS n, count(*) - count(recall) AS controls, round(avg(recall), 6) AS recall, round(avg(CASE WHEN recall IS NOT NULL THEN CAST(found > 0 AS INT) END), 6) AS hit_rate, round(avg(CASE WHEN recall IS NOT NULL THEN coalesce(1.0 / first_rank, 0) END), 6) AS mrr
FROM ev JOIN f_queries USING (query_id) GROUP BY ROLLUP (difficulty)""")
def retrieval_summary(spark, sf):
    return J.retrieval_summary(_judged(spark, sf).join(view(spark, sf, "f_queries").select("query_id", "difficulty"), "query_id"))


@register("split_sentences", with_views("f_chunks") + r""", s AS (SELECT chunk_id, [y FOR y IN [trim(x) FOR x IN string_split_regex(regexp_replace(regexp_replace(text, '\n+|•', chr(1), 'g'), '([.!?]) +([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))] IF length(y) > 0] AS s FROM f_chunks)
SELECT chunk_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s""")
def split_sentences(spark, sf):
    return T.split_sentences(view(spark, sf, "f_chunks")).select("chunk_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|").cast("binary")).alias("digest"))
