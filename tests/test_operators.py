"""Awkward rows, and the operators that SQL can't say against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scopeloom.functions.graph import connected_components, greedy_leaders
from scopeloom.operators import bids, clustering, evaluation, evidence, gaps, grounding, packages, quantities, retrieval, schedules, text
from scopeloom.sources import ingest
from scopeloom.streaming import jobs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("03-10-00", "03 10 00"), ("033000", "03 30 00"), ("03.30.00.13", "03 30 00"), ("3", None), ("", None), (None, None), ("é", None)])
def test_normalize_code(spark, raw, want):
    assert one(spark, raw, grounding.normalize_code) == want


@pytest.mark.parametrize(("raw", "want"), [("A1.1", True), ("FP0.1", True), ("STRUCTURAL DRAWINGS", False), ("see arch", False), ("CVR", True), (None, False), ("", False), ("T-101 sheet", True)])
def test_sheet_ids(spark, raw, want):
    assert one(spark, raw, grounding.is_valid_sheet_id) is want


@pytest.mark.parametrize(("raw", "want"), [("5,200 SF", (5200.0, "SF")), ("about 12.5 sq. ft. of tile", (12.5, "sq. ft.")), ("45", (45.0, None)), ("5 each", (None, None)), ("", (None, None)), (None, (None, None)), ("1234", (1234.0, None))])
def test_parse_quantity(spark, raw, want):
    assert tuple(one(spark, raw, quantities.parse_quantity)) == want


@pytest.mark.parametrize(("raw", "want"), [("Acme, Inc.", "acme"), ("ACME  Co", "acme"), ("Acme L.L.C.", "acme"), ("Inc", "inc"), (None, None)])
def test_vendor(spark, raw, want):
    assert one(spark, raw, bids.normalize_vendor) == want


@pytest.mark.parametrize(("raw", "want"), [("S1.1 - FOUNDATION PLAN", True), ("ROOF PLAN\nE1.0\nNOTES", True), ("Provide 3 doors", False), ("", True), (None, True), ("A1\nA2\nA3\nA4\nA5", False)])
def test_header_only(spark, raw, want):
    assert one(spark, raw, grounding.is_header_only) is want


def test_windows(spark):
    pages = spark.createDataFrame([(1, 1, " " + "abcdefghij" * 3 + " "), (1, 2, "abc"), (1, 3, "  "), (1, 4, None)], "document_id int, page_number int, text string")
    got = [(r.page_number, r.chunk_index, r.chunk_total, r.chunk) for r in text.window_text(pages, 12, 4).orderBy("page_number", "chunk_index").collect()]
    whole = "abcdefghij" * 3
    assert got == [(1, i, 4, whole[8 * i : 8 * i + 12]) for i in range(4)] + [(2, 0, 1, "abc")]
    with pytest.raises(ValueError):
        text.window_text(pages, 4, 4)


def test_unicode_truncation(spark):
    df = spark.createDataFrame([("żółw東京x",), ("abc",), (None,)], "t string")
    assert [r.t for r in text.truncate_to_width(df, {"t": 5}).collect()] == ["żółw…", "abc", None]


def test_bm25_matches_a_loop(spark):
    rng = random.Random(1)
    corpus = {i: [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 12))] for i in range(25)}
    asked = {0: ["aa", "bb", "aa"], 1: ["hh"], 2: ["zz"]}
    chunks = spark.createDataFrame([(1, i, " ".join(w)) for i, w in corpus.items()], "project_id int, chunk_id int, text string")
    queries = spark.createDataFrame([(1, q, " ".join(w)) for q, w in asked.items()], "project_id int, query_id int, text string")
    avg = sum(map(len, corpus.values())) / len(corpus)
    df = {t: sum(t in w for w in corpus.values()) for w in corpus.values() for t in w}
    raw = {t: math.log(len(corpus) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = {}
    for q, terms in asked.items():
        s = {i: sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in terms) for i, w in corpus.items()}
        want[q] = [(i, round(v, 5)) for i, v in sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5] if round(v, 6) > 0]
    got = {q: [] for q in asked}
    for r in retrieval.bm25_topk(chunks, queries, 5).orderBy("rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.score, 5)))
    assert got == want
    assert retrieval.bm25_topk(chunks.limit(0), queries, 5).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_greedy_leaders(spark):
    rng = random.Random(4)
    near = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12}
    want, leaders = {}, []
    for x in range(40):
        first = next((y for y in leaders if (y, x) in near), None)
        want[x] = x if first is None else first
        if first is None:
            leaders.append(x)
    rows = spark.createDataFrame([(i,) for i in range(40)], "id int")
    got = {r.id: r.leader for r in greedy_leaders(rows, spark.createDataFrame(sorted(near), "a int, b int")).collect()}
    assert got == want


def test_clusters_ignore_order_and_nulls(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.99, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [1.0, 0.0]), (5, "a", None)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "id int, g string, embedding array<double>")
        assert {r.id: r.leader for r in clustering.cluster_by_similarity(df, 0.92, "g").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_vendors(spark):
    rows = [(1, "ACM", 1, [1.0, 0.0]), (2, "Acme Builders", 1, [0.9, 0.1]), (3, "Acme", 1, [0.8, 0.3]), (4, "Other", 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, name string, project_id int, embedding array<double>")
    assert {r.name: r.canonical for r in clustering.canonicalize_vendors(df).collect()} == {"ACM": "Acme Builders", "Acme Builders": "Acme Builders", "Acme": "Acme Builders", "Other": "Other"}


def test_votes(spark):
    rows = [(1, True, 0.9), (1, True, None), (1, False, 0.8), (2, None, 0.0), (2, True, 0.6)]
    got = {r.candidate_id: (r.accepted, r.confidence) for r in grounding.vote_rollup(spark.createDataFrame(rows, "candidate_id int, accept boolean, confidence double")).collect()}
    assert got == {1: (True, round((0.9 + 0.5 + 0.2) / 3, 6)), 2: (False, 0.55)}


def test_tiers_keep_three_states(spark):
    items = spark.createDataFrame([(1, "spec_only", 0.9), (2, "spec_only", 0.9), (3, "bilateral", 0.9), (4, "bilateral", None)], "item_id int, expected string, confidence double")
    cits = spark.createDataFrame([(1, "spec", 0.1, None), (2, "spec", 0.1, False), (3, "spec", 0.7, True)], "item_id int, evidence_type string, rerank double, link_pass boolean")
    got = {r.item_id: r.tier for r in evidence.evidence_tier(items, evidence.evidence_rollup(cits)).collect()}
    assert got == {1: "EXPLICITLY_CITED", 2: "INFERRED_HIGH_CONFIDENCE", 3: "INFERRED_HIGH_CONFIDENCE", 4: "INFERRED_LOW_CONFIDENCE"}


def test_rules_refuse_overlaps(spark):
    with pytest.raises(ValueError):
        packages.load_rule_dims(spark, [("a", "A", "3 04"), ("b", "B", "03")])


def test_bad_payloads(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "{}"), (4, '{"notes":[{"text":"x"},{"text":null}]}')], "page_id int, json string")
    tables = ingest.parse_page_payload(df)
    assert [(r.page_id, r.text) for r in tables["notes"].collect()] == [(4, "x"), (4, None)]
    assert tables["schedules"].count() == tables["sheets"].count() == 0


def test_context_precision(spark):
    rows = [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)]
    got = {r.fixture_id: r.context_precision for r in evaluation.context_precision(spark.createDataFrame(rows, "fixture_id int, rank int, relevant boolean")).collect()}
    assert got == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}


def test_no_rows(spark):
    items = spark.createDataFrame([], "item_id int, run_id int, project_id int, division string, code string, quantity string, unit string, extraction_method string, confidence double, proposed string, description string")
    cits = spark.createDataFrame([], "citation_id string, item_id int, excerpt string")
    taxonomy = spark.createDataFrame([], "code string, division string, ord int")
    assert quantities.resolve_quantity(items, cits).count() == 0
    assert grounding.ground_code(items, taxonomy).count() == 0
    assert gaps.gap_missing_division(items.select("run_id", "project_id"), items.select("project_id", "division"), items).count() == 0
    assert schedules.unit_override(spark.createDataFrame([], "id int, type string, text string")).count() == 0


def test_stream_activity_drops_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp_ntz, project_id int, status string, cost double"
    stamp = lambda h, m: __import__("datetime").datetime(2024, 1, 1, h, m)
    run = lambda: jobs.stream_activity(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    spark.createDataFrame([(stamp(1, 5), 1, "ok", 1.0), (stamp(1, 10), 1, "error", 2.0), (stamp(9, 0), 1, "ok", 4.0)], schema).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame([(stamp(1, 30), 1, "ok", 8.0), (stamp(15, 0), 1, "ok", 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r.start.hour, r.events, r.errors, r.cost) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 2, 1, 3.0), (9, 1, 0, 4.0)}


def test_short_prose_is_no_header(spark, tmp_path):
    """Documents of a word or two that headers have too get the verdicts of the SQL, to which only the planted line is a header."""
    import duckdb

    from scopeloom.plans import catalog

    said = {1: "x", 5: "Floor.", 7: "For.", 8: "A1 key", 14: "Sheet\nE2", 16: "A1.1 - FLOOR PLAN", 23: "\t", 25: "roof", 26: "hot roof ring", 32: "For."}
    spark.createDataFrame([(k, v, "en", "s", len(v)) for k, v in said.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(k, "floor ring", "Brand#1", "ROOF" if k % 2 else "LARGE", 3, 1.0) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for name in ("documents", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("citation_verdict", "admit_candidates", "keep_known_citations"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name
    out = spark.createDataFrame([("roof", "ROOF PLAN", True), ("roof", "ROOF PLAN", False), ("roof", "ROOF PLAN", None), ("roof", "", True)], "description string, text string, prose boolean")
    assert sorted(r.reason for r in grounding.judge_citations(out).collect()) == ["", "EMPTY", "HEADER_ONLY", "HEADER_ONLY"]
