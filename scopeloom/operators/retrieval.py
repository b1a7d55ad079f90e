"""Batch retrieval: BM25, cosine similarity, rank fusion and what follows them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeloom.functions.graph import written
from scopeloom.operators.grounding import DISCIPLINES

#: Okapi constants, and the share of the mean idf that stands in for a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Rows of a block of vectors, and queries of one product.
BLOCK, SLICE = 4096, 256


def tokenize(text: Column) -> Column:
    """Lower-case tokens; dotted numbers such as ``s1.1`` stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(\.[0-9]+)*"), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """The distinct terms of a list of tokens with how often each comes, (term, tf) by term: counted in the row, nothing is shuffled."""
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - a value that the lambda below uses often

    def counted(held: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(held)), lambda i: (i == F.size(held)) | (F.get(held, i) != F.get(held, i - 1)))
        run = lambda at: lambda end, j: F.struct(F.get(held, end - 1).alias("term"), (end - F.coalesce(F.get(at, j - 1), F.lit(0))).cast("long").alias("tf"))
        return once(ends, lambda at: F.transform(at, run(at)))

    return F.when(F.size(tokens) > 0, once(F.sort_array(tokens), counted)).otherwise(F.array().cast("array<struct<term: string, tf: bigint>>"))


def bm25_index(chunks: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, chunk_id, tf, length) and statistics (key, n_docs, avgdl, mean_idf), idf per posting.

    Terms are counted in the row of their chunk before anything is shuffled by term.
    """
    tokens = chunks.select(key, "chunk_id", tokenize(F.col("text")).alias("tokens"))
    lengths = tokens.select(key, "chunk_id", F.size("tokens").alias("length"))
    corpus = lengths.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
    tf = tokens.select(key, "chunk_id", F.size("tokens").alias("length"), F.inline(term_counts(F.col("tokens"))))
    df = tf.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df")).join(corpus, key)
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(key).agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(mean, key).select(key, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return tf, idf


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, key: str = "project_id") -> DataFrame:
    """Best ``k`` chunks of each query in its project: query_id, chunk_id, score, rank. Only positive scores.

    A query term that repeats counts again. Only postings of terms that some query has are scored.
    """
    tf, idf = bm25_index(chunks, key)
    terms = queries.select(key, "query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy(key, "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = terms.join(idf, [key, "term"]).join(tf, [key, "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, k).where(F.col("score") > 0)


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", ties: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each group, with their rank; ties by ``ties``."""
    order = W.partitionBy(by).orderBy(F.desc(score), ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Columns of a chunk that a query may be restricted by.
FILTERS = ("document_id", "chunk_type", "page_number", "source_id")


def passes(filters: list[str], chunk: str = "c", query: str = "f") -> Column:
    """Whether a chunk has all that a query's filters ask for; a null filter asks for nothing."""
    out = F.lit(True)
    for name in filters:
        asked = F.col(f"{query}.{name}")
        out = out & (asked.isNull() | F.coalesce(asked == F.col(f"{chunk}.{name}"), F.lit(False)))
    return out


def _nearest(chunks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """What may be among the best ``k`` of each query in a block of chunks: products single out rows, which are summed up again in order.

    Scores closer than rounding are all kept, but of exactly equal ones the ``k`` smallest ids only.
    """
    found = []
    if len(chunks) and len(queries):
        x, n, ids = np.stack(chunks["embedding"].to_list()).astype("float64"), chunks["norm"].to_numpy(), chunks["chunk_id"].to_numpy()
        for begin in range(0, len(queries), SLICE):
            part = queries.iloc[begin : begin + SLICE]
            y, m = np.stack(part["vector"].to_list()).astype("float64"), part["q_norm"].to_numpy()
            near = np.nan_to_num((y @ x.T) / (m[:, None] * n[None]), nan=-np.inf)
            bar = np.partition(near, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            i, j = np.nonzero(near >= bar[:, None] - 2e-6)
            total = np.zeros(len(i))
            for d in range(x.shape[1]):
                total += y[i, d] * x[j, d]
            score = total / (n[j] * m[i])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            begins = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(score) != 0)])
            kept = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) < k
            found.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[i[kept]], "chunk_id": ids[j[kept]], "score": score[kept]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})


def nearest_in_blocks(chunks: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """The best ``k`` of each query by cosine: chunks (key, chunk_id, embedding, norm) meet queries (key, query_id, vector, q_norm) of their key.

    Both are dealt to blocks of about ``BLOCK`` rows, and a task takes a block of each, so a large key is many tasks.
    """
    parts = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    deal = lambda id_, name, salt: F.pmod(F.xxhash64(F.lit(salt), id_), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    sizes = parts(chunks, "chunk_parts").join(parts(queries, "query_parts"), key)
    left = chunks.join(sizes, key).select(key, deal("chunk_id", "chunk_parts", "c").alias("cp"), every("query_parts").alias("qp"), "chunk_id", "embedding", "norm")
    right = queries.join(sizes, key).select(key, every("chunk_parts").alias("cp"), deal("query_id", "query_parts", "q").alias("qp"), "query_id", "vector", "q_norm")
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731 - columns of its own, also where both sides come from one table
    by = [key, "cp", "qp"]
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    met = own(left).groupBy(*by).cogroup(own(right).groupBy(*by)).applyInPandas(lambda held, asked: _nearest(held, asked, k), kinds)
    return top(met.withColumn("score", F.round("score", 6)), k)


def cosine_topk(chunks: DataFrame, queries: DataFrame, k: int, key: str = "group_key", filters: DataFrame | None = None) -> DataFrame:
    """Exact cosine: chunks (chunk_id, key, embedding) against queries (query_id, key, vector).

    Queries meet chunks of their own key only; chunks without an embedding are left out. ``filters`` (query_id and any of
    ``FILTERS``) restrict a query's chunks before anything is scored; other columns of it are ignored. Each task keeps
    its best ``k`` of a query, and only these are shuffled. Without filters blocks of both sides meet as products.
    """
    norm = lambda c: F.sqrt(dot(c, c))
    names = [c for c in FILTERS if filters is not None and c in filters.columns]
    left = chunks.where(F.col("embedding").isNotNull()).select(key, "chunk_id", "embedding", *names, norm("embedding").alias("norm")).alias("c")
    right = queries.where(F.col("vector").isNotNull()).select(key, "query_id", "vector", norm("vector").alias("q_norm"))
    if not names:
        return nearest_in_blocks(left, right, k, key)
    right = right.join(filters.select("query_id", *names), "query_id", "left")
    met = left.join(right.alias("f"), key).where(passes(names))
    score = F.round(dot("embedding", "vector") / (F.col("norm") * F.col("q_norm")), 6)
    return top(met.select("query_id", "chunk_id", score.alias("score")), k)


def rrf_fuse(rankings: list[DataFrame], top_k: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank) lists."""
    parts = [r.select("query_id", "chunk_id", (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(fused, top_k)


def filter_sparse(sparse: DataFrame, dense: DataFrame, chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """Keep sparse hits that the dense list has or whose chunk has what the query's filters ask for; after top-k.

    ``filters``: query_id and any of ``FILTERS``, null for no restriction. A query without filters keeps all its hits.
    """
    names = [c for c in FILTERS if c in filters.columns]
    also = dense.select("query_id", "chunk_id").distinct().withColumn("dense", F.lit(True))
    held = sparse.alias("s").join(chunks.select("chunk_id", *names).alias("c"), "chunk_id", "left").join(filters.select("query_id", *names).alias("f"), "query_id", "left")
    joined = held.join(also, ["query_id", "chunk_id"], "left")
    return joined.where(passes(names) | F.col("dense")).select("query_id", "chunk_id", *[c for c in sparse.columns if c not in ("query_id", "chunk_id")])


def hydrate_hits(fused: DataFrame, chunks: DataFrame, documents: DataFrame, sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Attach chunk, sheet and document columns and the scores of both lists (0 where absent); dead ids are dropped."""
    scores = lambda df, name: df.select("query_id", "chunk_id", F.col("score").alias(name))
    held = chunks.select("chunk_id", "document_id", "page_number", "chunk_type", "sheet_id", "sheet_title", "discipline")
    out = fused.withColumnRenamed("score", "rrf_score").join(held, "chunk_id").join(documents.select("document_id", "filename"), "document_id", "left")
    for df, name in ((sparse, "sparse_score"), (dense, "dense_score")):
        out = out.join(scores(df, name), ["query_id", "chunk_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def apply_rerank(hits: DataFrame, scores: DataFrame, n: int, own: str = "score") -> DataFrame:
    """Order hits by external relevance, else by their own score; the best ``n`` of each query. Other columns stay."""
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id", "rank", "score")]
    joined = hits.join(scores.select("chunk_id", "relevance"), "chunk_id", "left").select("query_id", "chunk_id", *others, F.coalesce("relevance", own).alias("score"))
    return top(joined, n)


def snippet(hits: DataFrame, max_len: int = 240) -> DataFrame:
    """Adds snippet: around the first query term (longer than one character) that the text holds, else its start."""
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda t: F.length(t) > 1)
    at = F.transform(terms, lambda t: F.expr("cast(0 as int)") + F.instr(F.lower("text"), t))
    found = F.try_element_at(F.filter(at, lambda i: i > 0), F.lit(1))
    begin = F.greatest(F.lit(1), found - 80)
    end = F.least(F.length("text"), found - 1 + max_len)
    around = F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), F.substring("text", begin, end - begin + 1), F.when(end < F.length("text"), F.lit("…")).otherwise(F.lit("")))
    return hits.withColumn("snippet", F.when(found.isNull(), F.substring("text", 1, max_len)).otherwise(around))


def upsert_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Set the vector of chunks that have a new one; ``embedded`` says which have any."""
    new = vectors.select("chunk_id", F.col("vector").alias("new"))
    out = chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("new", "embedding")).drop("new")
    return out.withColumn("embedded", F.col("embedding").isNotNull())


def clear_embeddings(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """Take the vectors off all chunks of the projects (project_id), before they are indexed anew."""
    gone = projects.select("project_id").distinct().withColumn("cleared", F.lit(True))
    out = chunks.join(gone, "project_id", "left").withColumn("embedding", F.when(F.col("cleared").isNull(), F.col("embedding"))).drop("cleared")
    return out.withColumn("embedded", F.col("embedding").isNotNull())


def hybrid_search(sparse: DataFrame, dense: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, relevance: DataFrame, filters: DataFrame | None = None, candidates: int = 50, final: int = 10) -> DataFrame:
    """Sparse and dense candidates, the former filtered, fused, hydrated, reranked, with snippets, for a table of queries."""
    kept = sparse if filters is None else filter_sparse(sparse, dense, chunks, filters)
    hits = hydrate_hits(rrf_fuse([kept, dense], candidates), chunks, documents, kept, dense)
    # the few hits are written, so that their size is known and Spark can take them to the texts
    ranked = written(apply_rerank(hits, relevance, final, "rrf_score").join(queries.select("query_id", F.col("text").alias("query")), "query_id"))
    return snippet(ranked.join(chunks.select("chunk_id", "text"), "chunk_id")).drop("text", "query")


def multi_query_retrieve(divisions: DataFrame, chunks: DataFrame, k: int = 20, search: Callable[[DataFrame, DataFrame, int], DataFrame] = bm25_topk) -> DataFrame:
    """Three phrasings per division (project_id, division, title), ``k`` hits each, one row per chunk with the phrasings that found it.

    ``search`` takes chunks, queries and k; that of a stored index will do.
    """
    phrasings = [("materials", "materials products {}"), ("quantities", "quantities sizes count {}"), ("specs", "specification requirements {}")]
    asked = None
    for name, phrase in phrasings:
        q = divisions.select("project_id", "division", F.concat_ws("~", F.col("project_id").cast("string"), "division", F.lit(name)).alias("query_id"), F.concat(F.lit(phrase.replace("{}", "")), "title").alias("text"))
        asked = q if asked is None else asked.unionByName(q)
    hits = search(chunks, asked, k).join(asked.select("query_id", "project_id", "division"), "query_id")
    return hits.groupBy("project_id", "division", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("query_id", "~"), 3))), "+").alias("found_by"), F.min("rank").alias("best_rank"))


def profile_pool(chunks: DataFrame, semantic: DataFrame, hint: Column, cap: int = 120) -> DataFrame:
    """Chunks that describe a project: first pages, then hinted ones, then semantic hits; the first pool wins, ``cap`` a project."""
    pools = [chunks.where("page_number = 1"), chunks.where(hint), chunks.join(semantic.select("chunk_id").distinct(), "chunk_id", "left_semi")]
    union = None
    for prio, pool in enumerate(pools):
        part = pool.select("project_id", "chunk_id", F.lit(prio).alias("prio"))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("project_id", "chunk_id").agg(F.min("prio").alias("prio"))
    order = W.partitionBy("project_id").orderBy("prio", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


# Disciplines that read schedules of a type; all read the type ``other``.
SCHEDULE_READERS = {
    "door": ("architectural", "interior"), "window": ("architectural", "interior"), "finish": ("interior",), "room": ("architectural", "interior"),
    "fixture": ("plumbing",), "panel": ("electrical",), "equipment": ("mechanical", "electrical", "plumbing"),
}


def discipline_corpus(chunks: DataFrame, sheets: DataFrame, divisions: DataFrame, schedule_rows: DataFrame) -> DataFrame:
    """Per discipline: chunks of its drawings, spec chunks that name one of its divisions, and rows of schedules it reads.

    ``sheets``: document_id, discipline; ``divisions``: division, discipline; ``schedule_rows``: schedule_id, name, row_index, of
    which those of typed schedules count. Rows: discipline, side, and chunk_id or schedule_id and row_index.
    """
    from scopeloom.operators.schedules import schedule_type

    none = F.lit(None).cast("long")
    of_chunk = lambda df, side: df.select("discipline", F.lit(side).alias("side"), "chunk_id", none.alias("schedule_id"), none.alias("row_index")).distinct()
    drawn = chunks.where("chunk_type <> 'spec_section'").join(sheets.select("document_id", "discipline").distinct(), "document_id")
    named = chunks.where("chunk_type = 'spec_section'").select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{2}) \d{2} \d{2}\b"), F.lit(1)))).alias("division"))
    every = sorted({*DISCIPLINES, *(d for readers in SCHEDULE_READERS.values() for d in readers)})
    readers = F.create_map(*[x for kind, names in {**SCHEDULE_READERS, "other": every}.items() for x in (F.lit(kind), F.array(*[F.lit(d) for d in names]))])
    typed = schedule_rows.select(F.explode(F.try_element_at(readers, schedule_type(F.col("name")))).alias("discipline"), F.lit("schedule").alias("side"), none.alias("chunk_id"), F.col("schedule_id").cast("long").alias("schedule_id"), F.col("row_index").cast("long").alias("row_index"))
    return of_chunk(drawn, "drawing").unionByName(of_chunk(named.join(divisions, "division"), "spec")).unionByName(typed)
