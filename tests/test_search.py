"""The stored index, filters, approximate search, judged retrieval and the pruned similarity join against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeloom.operators import ann, clustering, indexing, judging, retrieval, text


def scores(corpus, terms):
    avg = sum(map(len, corpus.values())) / len(corpus)
    df = {t: sum(t in w for w in corpus.values()) for w in corpus.values() for t in w}
    raw = {t: math.log(len(corpus) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return {i: round(sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in terms), 5) for i, w in corpus.items()}


def test_stored_index_skips_cells(spark, tmp_path):
    rng = random.Random(1)
    corpus = {i: rng.choices("abcdefghijklmnopqrst", [1 / (k + 1) ** 2 for k in range(20)], k=rng.randint(1, 12)) for i in range(400)}
    corpus[7] = ["s", "t", "s", "t"]
    chunks = spark.createDataFrame([(1, i, " ".join(w)) for i, w in corpus.items()] + [(2, 1, "other words"), (2, 2, None), (2, 3, "x y"), (2, 4, "z")], "project_id bigint, chunk_id bigint, contextualized_text string")
    asked = {0: ["s", "t", "s"], 1: ["a", "q"], 2: ["zz"]}
    queries = spark.createDataFrame([(1, q, " ".join(w)) for q, w in asked.items()] + [(2, 9, "words")], "project_id bigint, query_id bigint, text string")
    path = str(tmp_path / "index")
    indexing.write_index(indexing.index_blocks(chunks, cell_chunks=20), path)
    got = {}
    for r in indexing.indexed_topk(spark, path, queries, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 5)))
    for q, terms in asked.items():
        want = sorted(((-s, i) for i, s in scores(corpus, terms).items() if s > 0))[:3]
        assert got.get(q, []) == [(i, -s) for s, i in want]
    assert got[9] == [(1, got[9][0][1])]
    index = indexing.read_index(spark, path)
    read = indexing.search_cells(index, queries, 1)[1].where("query_id = 0").count()
    assert 0 < read < indexing.cell_bounds(index, queries).where("query_id = 0").count()


def test_only_buckets_of_asked_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = spark.createDataFrame([(p, i, f"w{i} w{i + 1}") for p in (1, 2) for i in range(50)], "project_id bigint, chunk_id bigint, contextualized_text string")
    indexing.write_index(indexing.index_blocks(chunks), path)
    asked = spark.createDataFrame([(1, 0, "w3")], "project_id bigint, query_id bigint, text string")
    plan = indexing.cell_bounds(indexing.read_index(spark, path), asked)._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "PartitionFilters" in plan


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    indexing.write_index(indexing.index_blocks(spark.createDataFrame([], "project_id bigint, chunk_id bigint, contextualized_text string")), path)
    assert indexing.indexed_topk(spark, path, spark.createDataFrame([(1, 1, "a")], "project_id bigint, query_id bigint, text string"), 3).count() == 0


def test_filters_come_before_the_limit(spark):
    chunks = spark.createDataFrame([(1, i, [1.0, i / 10], "note" if i % 2 else None, i % 3) for i in range(12)], "g int, chunk_id int, embedding array<double>, chunk_type string, page_number int")
    asked = spark.createDataFrame([(1, q, [1.0, 0.0]) for q in range(3)], "g int, query_id int, vector array<double>")
    filters = spark.createDataFrame([(0, "note", None, 5), (1, "note", 2, 5)], "query_id int, chunk_type string, page_number int, other int")
    found = retrieval.cosine_topk(chunks, asked, 2, "g", filters)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(0, 1), (0, 3), (1, 5), (1, 11), (2, 0), (2, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Window ")[-1] or plan.count("WindowGroupLimit") >= 2


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies of one vector, and rows without one."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 900)] + 0.25 * rng.normal(size=(900, 32))
    x[100:160] = x[50]
    return [(i, int(i % 2), v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 1, [0.0] * 32)]


def test_ann_recall_at_ten(spark, vectors, tmp_path):
    chunks = spark.createDataFrame([(1, i, v) for i, _, v in vectors], "g int, chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, i, v) for i, _, v in vectors[:900:30]], "g int, query_id bigint, vector array<float>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.cosine_topk(chunks.where("chunk_id < 901"), asked, 10, "g").collect()}
    index = ann.write_cells(chunks, str(tmp_path / "cells"))
    assert len(index.means) > 1 and index.probes < len(index.means)
    found = ann.cosine_topk_ann(index, asked, 10)
    assert len(exact & {(r.query_id, r.chunk_id) for r in found.collect()}) >= 0.9 * len(exact)
    everything = {(r.query_id, r.chunk_id) for r in ann.cosine_topk_ann(index, asked, 10, len(index.means)).collect()}
    assert everything == exact
    nothing = ann.write_cells(chunks.limit(0), str(tmp_path / "none"))
    assert ann.cosine_topk_ann(nothing, asked, 10).count() == 0


def test_ann_recall_on_loose_vectors(spark, tmp_path):
    """The test table's vectors have no clusters: many cells are probed, and recall holds."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.lit(1).alias("g"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.where("chunk_id % 20 = 0").select("g", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.chunk_id) for r in retrieval.cosine_topk(e, asked, 10, "g").collect()}
    found = {(r.query_id, r.chunk_id) for r in ann.cosine_topk_ann(ann.write_cells(e, str(tmp_path / "cells")), asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_pairs_are_pruned_but_none_is_lost(spark, vectors):
    least = 0.85
    df = spark.createDataFrame(vectors, "id bigint, g bigint, embedding array<double>")
    rows = clustering.representatives(df, "g").where("id = rep").select("id", "g", "embedding")
    held = {r.id: (r.g, np.array(r.embedding)) for r in rows.collect()}
    cos = lambda a, b: a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)
    ids = sorted(held)
    every = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if held[a][0] == held[b][0]]
    want = {(a, b) for a, b in every if cos(held[a][1], held[b][1]) >= least}
    for sizes in ({}, {"pivots": 3, "crowded": 5}):
        got = [(r.a, r.b) for r in clustering.similar_pairs(rows, least, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    compared = clustering.candidate_pairs(rows, least).count()
    assert len(want) <= compared < 0.5 * len(every)


def test_clusters_equal_the_loop(spark, vectors):
    df = spark.createDataFrame(vectors, "id bigint, g bigint, embedding array<double>")
    got = {r.id: r.leader for r in clustering.cluster_by_similarity(df, 0.9, "g").collect()}
    leaders, want = [], {}
    for i, g, v in vectors:
        found = next((j for j, h, u in leaders if h == g and v and any(v) and np.dot(u, v) >= 0.9 * np.linalg.norm(u) * np.linalg.norm(v)), None)
        want[i] = i if found is None else found
        if found is None and v and any(v):
            leaders.append((i, g, v))
    assert got == want
    old, new = df.where("id < 500"), df.where("id >= 500")
    grown = clustering.append_to_clusters(clustering.cluster_by_similarity(old, 0.9, "g"), old, new, 0.9, "g")
    assert {r.id: r.leader for r in grown.collect()} == want


def test_pages_meet_ranges_by_block(spark):
    rng = random.Random(4)
    ranges = [(d, f"c{k}", a := rng.randint(1, 60), a + rng.choice([0, 3, 40])) for d in (1, 2) for k in range(15)]
    pages = [(q, d, p, q) for q in range(40) for d, p in [(rng.choice([1, 2, 3]), rng.choice([None, *range(1, 100)]))]]
    df = spark.createDataFrame(pages, "query_id int, document_id int, page_number int, rank int")
    met = judging.keys_by_page(df, spark.createDataFrame(ranges, "document_id int, code string, first_page int, last_page int"), 8)
    want = sorted((q, c) for q, d, p, _ in pages for e, c, a, b in ranges if d == e and p is not None and a <= p <= b)
    assert sorted((r.query_id, r.key) for r in met.collect()) == want
    assert "CartesianProduct" not in (plan := met._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_controls_have_no_recall(spark):
    queries = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "b")], "query_id int, document_id int, difficulty string")
    hits = spark.createDataFrame([(1, 1, 4), (1, 2, 5), (1, 3, 5), (2, 1, 5)], "query_id int, rank int, document_id int")
    own = judging.ranked_in_document(hits, queries)
    assert sorted((r.query_id, r["rank"]) for r in own.collect()) == [(1, 1), (1, 2), (2, 1)]
    keyed = own.where("rank = 2").withColumn("key", F.lit("x"))
    truth = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (3, "z")], "query_id int, key string")
    out = {r.query_id: r for r in judging.retrieval_eval(queries, hits, keyed, truth).collect()}
    assert (out[1].candidates, out[1].in_document, out[1].recall, out[1].first_rank, out[1].covered, out[1].missing) == (3, 2, 0.5, 2, "x", "y")
    assert out[2].recall is None and (out[3].recall, out[3].candidates, out[3].missing) == (0.0, 0, "z")
    s = {r.difficulty: r for r in judging.retrieval_summary(judging.retrieval_eval(queries, hits, keyed, truth).join(queries.select("query_id", "difficulty"), "query_id")).collect()}
    assert (s["OVERALL"].n, s["OVERALL"].controls, s["OVERALL"].mrr) == (2, 1, 0.25) and (s["b"].n, s["b"].controls) == (1, 1)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_edit_distance(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("", "abc"), ("abc", "xabcx"), ("東京é", "東é京"), (None, "a")]
    for _ in range(60):
        a = "".join(rng.choices("abcé", k=rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            at = rng.randint(0, len(b))
            b[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "ab"])
        pairs.append((a, "".join(b)))
    pairs += [("ab" * 700, "ba" * 650 + "x" * 40), ("abc" * 900, "xyz" * 700)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in text.with_edit_distance(df, "a", "b", "d").collect():
        assert r.d == (None if r.a is None else text.bit_distance(r.a, r.b))
    for a, b in pairs[:-1]:
        assert a is None or text.bit_distance(a, b) == plain_distance(a, b)


def test_two_unlike_pages(spark):
    """Pages of 100,000 characters with nothing in common but their alphabet: bounded memory, exact."""
    rng = random.Random(7)
    a, b = ("".join(rng.choices("abcdefgh ", k=100_000)) for _ in range(2))
    rows = [(1, "x", a), (1, "y", b), (2, "x", a), (2, "y", a[:50_000] + "!" * 50 + a[50_030:]), (3, "x", a)]
    out = {r.page_id: r for r in text.fuse_ocr(spark.createDataFrame(rows, "page_id int, provider string, text string")).select("page_id", "disagreement", "flagged").collect()}
    assert out[1].flagged and out[1].disagreement == round(text.bit_distance(a, b) / 100_000, 4)
    assert out[2].disagreement == round(50 / 100_020, 4) and out[3].disagreement is None


def test_snippets_reach_the_hits(spark):
    """The last stage of the hybrid search is part of its rows, and hits go to the texts, not the texts to them."""
    from scopeloom.plans import catalog

    assert "AS snippet" in catalog.oracle_sql()["hybrid_search"]  # which test_oracle holds the query to
    n = 5000
    chunks = spark.range(n).selectExpr("id AS chunk_id", "id % 7 AS document_id", "1 AS page_number", "'note' AS chunk_type", "'A1' AS sheet_id", "'t' AS sheet_title", "'civil' AS discipline", "concat(repeat('x', 300), ' pump ', id) AS text")
    documents = spark.range(7).selectExpr("id AS document_id", "concat('f', id) AS filename")
    ranked = lambda first: spark.range(5).selectExpr("1L AS query_id", f"id + {first} AS chunk_id", "1.0D AS score", "CAST(id + 1 AS INT) AS rank")
    queries = spark.createDataFrame([(1, "the Pump")], "query_id long, text string")
    relevance = spark.createDataFrame([(3, 0.9)], "chunk_id long, relevance double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = retrieval.hybrid_search(ranked(0), ranked(3), chunks, documents, queries, relevance, final=2)
        got = {(r["rank"], r.chunk_id): r.snippet for r in out.collect()}
        assert got == {(1, 3): f"…{'x' * 79} pump 3", (2, 4): f"…{'x' * 79} pump 4"}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
