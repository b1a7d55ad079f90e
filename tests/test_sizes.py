"""Operators on hot keys and large groups: what they make and move, beside the right rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeloom.operators import bids as B
from scopeloom.operators import clustering, evidence, grounding, indexing, retrieval, text


def nodes(plan):
    """All operators of an executed plan, those of its finished stages too."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    yield plan
    for child in inner + [children.apply(i) for i in range(children.size())]:
        yield from nodes(child)


def metric(df, name, where=lambda _: True):
    """The largest value of a metric over the operators of a DataFrame that was collected."""
    found = [p.metrics().apply(name).value() for p in nodes(df._jdf.queryExecution().executedPlan()) if p.metrics().contains(name) and where(p.getClass().getSimpleName())]
    return max(found, default=0)


def test_symbols_of_a_hot_glyph_do_not_multiply(spark):
    n = 2000
    glyphs = spark.range(n).select("id", F.lit(" a-1").alias("glyph"), F.when(F.col("id") % 2 == 0, "electrical").otherwise("plumbing").alias("discipline"))
    symbols = spark.range(n).select(F.lit("A-1").alias("glyph"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), "id")).otherwise("p").alias("code"), F.when(F.col("id") % 3 == 0, "electrical").otherwise("plumbing").alias("discipline"))
    out = evidence.symbol_lookup(glyphs, symbols)
    assert {(r.id % 2, r.code) for r in out.collect()} == {(0, None), (1, "p")}
    assert metric(out, "numOutputRows") <= 2 * n
    odd = spark.createDataFrame([(1, "x", None), (2, None, "plumbing"), (3, "x", "civil"), (4, "y", "civil")], "id int, glyph string, discipline string")
    table = spark.createDataFrame([("X", "c", None), ("x", None, "civil"), ("Y", "c", "civil"), ("Y", "d", None)], "glyph string, code string, discipline string")
    assert {r.id: r.code for r in evidence.symbol_lookup(odd, table).collect()} == {1: "c", 2: None, 3: "c", 4: "c"}


@pytest.fixture
def shuffled(spark):
    """Joins as of tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def priced(spark, items, bids, divisions, projects=1):
    """Items of one project and bids of it and others; every third bid lists no division."""
    division = F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(divisions)))
    left = spark.range(items).select(F.lit(1).alias("project_id"), division.alias("division"), F.col("id").alias("item_id"))
    return left, spark.range(bids).select((F.col("id") % projects + 1).alias("project_id"), F.when(F.col("id") % 3 > 0, division).alias("division"), F.col("id").alias("bid_id"))


def test_written_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    items, bids = priced(spark, 20_000, 60_000, 30, 200)
    B.coverage_pairs(items, bids).write.parquet(str(tmp_path / "pairs"))
    out = spark.read.parquet(str(tmp_path / "pairs"))
    want = items.crossJoin(bids.withColumnsRenamed({"project_id": "p", "division": "d"})).where("p = project_id AND (d IS NULL OR d = division)")
    digest = ["count(*)", "sum(CAST(xxhash64(item_id, bid_id) AS DECIMAL(38, 0)))"]
    assert tuple(out.selectExpr(*digest).first()) == tuple(want.selectExpr(*digest).first())
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < out.count() / 4


def test_pairs_of_a_hot_project_are_made_in_many_tasks(spark, shuffled):
    items, bids = priced(spark, 4000, 600, 1)
    made = B.coverage_pairs(items, bids, items_a_tile=256, bids_a_tile=64, run=50).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 4000 * 600 and max(r["count"] for r in made) < 4000 * 600 / 3


def test_pairs_of_odd_rows(spark):
    kind = "project_id long, division string, {} long"
    items = [(1, "03", 1), (1, "03", 1), (1, None, 2), (1, "", 3), (1, "04", None), (None, "03", 5), (None, None, 6), (2, "03", 7), (3, "03", 8)] + [(4, "03", i) for i in range(100, 130)]
    bids = [(1, "03", 1), (1, "03", 1), (1, None, 2), (1, "", 3), (1, None, None), (None, None, 5), (None, "03", 6), (2, "04", 7), (9, None, 8)] + [(4, "03" if i % 2 else None, i) for i in range(20)]
    want = sorted(str((i, b)) for p, d, i in items for q, e, b in bids if p is not None and p == q and (e is None or d == e))
    left, right = spark.createDataFrame(items, kind.format("item_id")), spark.createDataFrame(bids, kind.format("bid_id"))
    for sizes in ({}, {"items_a_tile": 7, "bids_a_tile": 4, "run": 3}):
        out = B.coverage_pairs(left, right, **sizes)
        assert out.columns == ["item_id", "bid_id"] and sorted(str(tuple(r)) for r in out.collect()) == want
    assert B.coverage_pairs(left.where("false"), right).count() == 0


def test_leveling_shuffles_no_row_of_its_grid(spark, shuffled):
    vendors, scored = 300, 200
    runs = spark.createDataFrame([(1, 1, 0, 7), (2, 1, 1, 8), (3, 2, 0, None)], "bid_run_id long, project_id long, started_at long, scope_run_id long")
    bids = spark.range(vendors).select(F.col("id").alias("bid_id"), F.when(F.col("id") > 0, F.concat(F.lit("v"), "id")).alias("vendor"))
    summaries = bids.select(F.lit(2).cast("long").alias("bid_run_id"), "bid_id", F.lit("09").alias("division"))
    coverage = spark.range(scored).select(F.col("id").alias("item_id"), F.col("id").alias("bid_id"), F.lit("covered").alias("status"), F.lit(0.5).alias("confidence"), F.concat(F.lit("l"), F.col("id") % 5).alias("line_id"))
    lines = spark.range(5).select(F.concat(F.lit("l"), "id").alias("line_id"), F.concat(F.lit("t"), "id").alias("description"), F.lit(2.0).alias("total_price"))
    items = spark.range(2 * scored).select(F.lit(8).cast("long").alias("run_id"), F.col("id").alias("item_id"), F.lit("09 00 00").alias("code"), F.lit("09").alias("division"))
    items = items.unionByName(items.where("item_id = 3")).unionByName(items.where("item_id = 4").withColumn("run_id", F.lit(7).cast("long")))
    args = (runs, summaries, bids, coverage, lines, items)
    long = B.bid_leveling(*args)
    got = long.collect()
    assert len(got) == (scored + 1) * vendors and {r.bid_run_id for r in got} == {2}
    # the vendor without a name scored item 0, which nothing tells apart from others without one
    assert sorted((r.item_id, r.vendor, r.line_text, r.line_total) for r in got if r.status == "covered" and r.item_id < 5) == [(1, "v1", "t1", 2.0), (2, "v2", "t2", 2.0), (3, "v3", "t3", 2.0), (3, "v3", "t3", 2.0), (4, "v4", "t4", 2.0)]
    assert sum(r.item_id == 0 and r.status == "not_applicable" and r.confidence == 0 and r.line_text is None for r in got) == vendors
    assert metric(long, "shuffleRecordsWritten") <= 2 * scored + 2
    wide = {(r.item_id, r.code): r.cells for r in B.bid_leveling_nested(*args).collect()}
    assert wide == {(r.item_id, r.code): r.cells for r in B.bid_leveling_wide(long).collect()} and len(wide[3, "09 00 00"]) == 2 * vendors
    one = B.bid_leveling(*args, division="10")
    assert one.count() == 0


def test_short_texts_skip_the_bands(spark):
    """A band costs its width for each character, so texts not much longer than it are aligned whole; long ones are not."""
    df = spark.createDataFrame([("x" + "abc" * 500 + "y", "z" + "bca" * 480 + "w"), ("p" + "ab" * 3000 + "q", "r" + "ab" * 2990 + "s")], "a string, b string")
    out = text.with_edit_distance(df, "a", "b", "d")
    assert all(r.d == text.bit_distance(r.a, r.b) for r in out.collect())
    aligned = [p.toString() for p in nodes(out._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "ProjectExec" and "levenshtein" in p.toString().split("\n")[0]]
    assert aligned and all(p.split("\n")[0].count("levenshtein(") == 1 and ">= " in p for p in aligned)


def test_tokens_beside_letters_beyond_ascii(spark):
    """Tokens are those of the SQL's engine, whose word boundaries are ASCII and whose upper case maps letter by letter."""
    import duckdb

    from scopeloom.plans.grounding_queries import _tokens_sql

    said = ["Èhot bolt", "hotß red", "ringé-blue/7.", "ßsteel", "ﬁre 3a_ large", "a.b.-c é", "LARGEÉ -x1- ñ.ring", None]
    got = {r.id: sorted(r.t) for r in spark.createDataFrame(list(enumerate(said)), "id int, s string").select("id", grounding.specific_tokens(F.col("s")).alias("t")).collect()}
    con = duckdb.connect()
    assert got == {i: sorted(con.execute(f"SELECT {_tokens_sql('s')} FROM (SELECT $1::VARCHAR AS s)", [s]).fetchall()[0][0]) for i, s in enumerate(said)}
    assert "HOT" in got[0] and "HOT" in got[1]
    out = spark.createDataFrame([("hot ring", "Èhot élan of hotels and other things that have no end")], "description string, text string")
    assert [(r.reason, r.overlap) for r in grounding.judge_citations(out).collect()] == [("", 0.5)]


def test_counts_of_terms_are_not_shuffled(spark, tmp_path, shuffled):
    n, words = 300, 40
    tokens = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["a", "a"],)], "t array<string>").select(retrieval.term_counts(F.col("t")).alias("c"))
    assert [[tuple(x) for x in r.c] for r in tokens.collect()] == [[("a", 1), ("b", 2)], [], [], [("a", 2)]]
    chunks = spark.range(n).select(F.lit(1).cast("long").alias("project_id"), F.col("id").alias("chunk_id"), F.expr(f"array_join(transform(sequence(1, {words}), i -> concat('w', (i * (id + 1)) % 97)), ' ')").alias("contextualized_text"))
    index = indexing.index_blocks(chunks, cell_chunks=100)
    postings = sum(len(r.ids) for r in index.blocks.collect())
    assert postings > 20 * n and metric(index.blocks, "shuffleRecordsWritten") <= n
    indexing.write_index(index, str(tmp_path))
    queries = spark.range(5).select(F.lit(1).cast("long").alias("project_id"), F.col("id").alias("query_id"), F.expr("array_join(transform(sequence(1, 30), i -> concat('w', i + id)), ' ')").alias("text"))
    scored = indexing.search_cells(indexing.read_index(spark, str(tmp_path)), queries, 3)[0]
    assert scored.count() <= 5 * (3 + 3) * 3 and scored.groupBy("query_id").count().count() == 5
    plain = retrieval.bm25_topk(chunks.withColumnRenamed("contextualized_text", "text"), queries, 3)
    found = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in df.collect())
    assert found(retrieval.top(scored, 3)) == found(plain)


def test_unlike_pairs_are_no_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[1::50] = x[::50] * 1.5 + 0.01
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(np.repeat(x, 1, axis=0))], "id bigint, g bigint, embedding array<double>").withColumn("g", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.78, 1))))
    for sizes in ({}, {"pivots": 3, "crowded": 7}):
        out = clustering.similar_pairs(rows, 0.78, **sizes)
        assert sorted((r.a, r.b) for r in out.collect()) == want and len(want) >= 12
        if not sizes:
            assert metric(out, "numOutputRows") < 600 * 599 / 4


def test_scored_pairs_are_no_rows(spark):
    """Blocks hand on the best of each query: no pair of a query and a chunk is a row; copies and ties are settled by id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[100:700] = x[3]
    e = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)] + [(900, 2, [1.0] * 16), (901, 1, None)], "chunk_id bigint, g int, embedding array<double>")
    asked = spark.createDataFrame([(q, 1 if q < 200 else 3, (x[q] if q < 900 else x[0]).tolist()) for q in [3, *range(10, 60), 250]], "query_id bigint, g int, vector array<double>")
    out = retrieval.cosine_topk(e, asked, 5, "g")
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in got.items():
        want = sorted((-round(float(s), 6), i) for i, s in enumerate(unit @ unit[q]))[:5]
        assert [(c, -s) for _, c, s in sorted(found)] == [(i, s) for s, i in want]
    assert sorted(got) == [3, *range(10, 60)] and [c for _, c, _ in sorted(got[3])] == [3, 100, 101, 102, 103]
    assert metric(out, "numOutputRows") < 51 * 900 / 4


def lines_of(spark, path, rows):
    """A lineitem table of a few rows: order, part, supplier, number, quantity, discount, flag, status."""
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "0D AS l_extendedprice", "0D AS l_tax", "timestamp'2024-01-01' AS l_shipdate")
    df.write.parquet(f"{path}/lineitem.parquet")
    return str(path)


ODD_LINES = [(1, 2, 3, 1, 5.0, 0.1, "A", "F"), (1, 2, 3, 1, 4.0, 0.2, "N", "O"), (1, 2, 3, 2, 4.0, 0.3, "R", "F"), (1, 4, 3, 2, 4.0, 0.3, "R", "F"), (11, 2, 3, 1, 1.0, 0.1, "A", "F"), (None, 2, 3, 1, 2.0, 0.1, "A", "F"), (None, 2, 3, 1, 1.0, 0.2, "N", "F"), (None, 2, 4, 1, 1.0, 0.2, "N", "F"), (7, None, 4, 1, 1.0, 0.2, "N", "F")]


def test_verdicts_meet_citations_where_they_lie(spark, tmp_path, shuffled):
    """Keys alone make a citation, so no line is ranked by its values, and each side is shuffled once, in narrow rows."""
    from scopeloom.plans.catalog import queries
    from scopeloom.plans.fixtures import VIEWS, citation_keys

    sf = lines_of(spark, tmp_path, ODD_LINES)
    want = spark.sql(VIEWS["f_citations"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert sorted(map(repr, citation_keys(spark, sf).collect())) == sorted(map(repr, want.select("citation_id", "item_id").collect()))
    out = queries()["apply_link_verdicts"](spark, sf)
    assert sorted((r.citation_id, r.link_pass, r.link_score) for r in out.collect() if r.citation_id) == [("1-1-2-3", True, 0.75), ("1-2-2-3", True, 0.75), ("1-2-4-3", True, 0.75), ("11-1-2-3", True, 0.75)]
    moved = [p for p in nodes(out._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert len(moved) <= 2 and not any("l_quantity" in p.output().toString() for p in moved)


def test_trust_reads_citations_once_and_moves_no_text(spark, tmp_path, shuffled):
    from scopeloom.operators import trust
    from scopeloom.plans.fixtures import VIEWS, view

    sf = lines_of(spark, tmp_path, ODD_LINES)
    want = spark.sql(VIEWS["f_citations"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    cits = view(spark, sf, "f_citations")
    assert sorted(map(repr, cits.collect())) == sorted(map(repr, want.collect()))
    plain = want.groupBy("item_id").agg(F.array_sort(F.collect_set("evidence_type")).alias("types"), F.round(F.max("rerank"), 6).alias("rerank"), F.bool_and("link_pass").alias("link_pass"), F.count("link_pass").alias("judged"), F.count_if("link_pass").alias("passed"))
    rolled = evidence.evidence_rollup(cits, counts=True)
    assert sorted(map(repr, rolled.collect())) == sorted(map(repr, plain.collect()))
    assert sum(p.getClass().getSimpleName() == "ShuffleExchangeExec" for p in nodes(rolled._jdf.queryExecution().executedPlan())) == 1
    pages = spark.range(400).select((F.col("id") % 20).alias("document_id"), F.when(F.col("id") % 4 > 0, F.repeat(F.sha2(F.col("id").cast("string"), 512), 40)).alias("text"))
    documents = spark.range(20).selectExpr("id AS document_id", "id % 2 AS project_id", "CASE WHEN id < 15 THEN 'written-spec' ELSE 'drawing-set' END AS doc_type")
    out = trust.text_coverage(pages, documents.unionByName(documents.where("document_id = 4")))
    assert {r.project_id: round(r.ocr_text_coverage, 6) for r in out.collect()} == {0: round(4 / 9, 6), 1: 1.0}
    assert metric(out, "dataSize") < 400 * 100
    revisions = spark.range(4000).selectExpr("1 AS project_id", "'A' AS sheet_id", "id % 2 AS document_id", "CAST(id % 3 AS STRING) AS rev_number")
    agreed = evidence.version_consistency(revisions)
    assert [r.document_version_consistency for r in agreed.collect()] == [1.0]
    assert metric(agreed, "numOutputRows", lambda name: name == "SortExec") == 0 and sum(p.getClass().getSimpleName() == "HashAggregateExec" and "count(1)" in p.toString().split("\n")[0] for p in nodes(agreed._jdf.queryExecution().executedPlan())) >= 1


def grid(spark, vendors, scored):
    """A project with a run of its bids: each item is scored by one vendor, every tenth by two more; and one of a vendor without a name."""
    runs = spark.createDataFrame([(2, 1, 1, 8), (4, 2, 0, 9)], "bid_run_id long, project_id long, started_at long, scope_run_id long")
    bids = spark.range(vendors + 1).select(F.col("id").alias("bid_id"), F.when(F.col("id") > 0, F.concat(F.lit("v, "), "id")).alias("vendor"))
    summaries = bids.select(F.when(F.col("bid_id") < vendors, 2).otherwise(4).cast("long").alias("bid_run_id"), "bid_id", F.lit("09").alias("division"))
    by = F.explode(F.transform(F.when(F.col("id") % 10 == 0, F.array("id", F.col("id") + 7, F.col("id") * 3)).otherwise(F.array("id")), lambda x: x % vendors))
    coverage = spark.range(scored).select(F.col("id").alias("item_id"), by.alias("bid_id")).withColumns({"status": F.when(F.col("item_id") % 2 == 0, "covered").otherwise("partial"), "confidence": F.col("bid_id") / 1000, "line_id": F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("l"), F.col("item_id") % 5))})
    coverage = coverage.unionByName(spark.createDataFrame([(scored, vendors, "excluded", None, None)], coverage.schema))
    lines = spark.range(5).select(F.concat(F.lit("l"), "id").alias("line_id"), F.concat(F.lit("t"), "id").alias("description"), F.lit(2.0).alias("total_price"))
    items = spark.range(scored + 1).select(F.when(F.col("id") < scored, 8).otherwise(9).cast("long").alias("run_id"), F.col("id").alias("item_id"), F.lit("09 00 00").alias("code"), F.lit("09").alias("division"))
    return runs, summaries, bids, coverage, lines, items.unionByName(items.where("item_id % 50 = 3"))


def test_a_grid_of_one_project_is_many_tasks(spark, shuffled):
    vendors, scored = 150, 400
    args = grid(spark, vendors, scored)
    for made in (B.bid_leveling(*args), B.bid_leveling_nested(*args)):
        size = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(size) >= 16 and max(size) < sum(size) / 4


def test_grids_of_any_list_of_vendors(spark):
    """Lists of vendors of any size make the same rows, and stretches of unscored cells between own ones the same row of the grid."""
    args = grid(spark, 40, 90)
    runs, summaries, bids, coverage, lines, items = [[r.asDict() for r in df.collect()] for df in args]
    named = {b["bid_id"]: b["vendor"] for b in bids}
    own, text = {}, {x["line_id"]: x["description"] for x in lines}
    for c in sorted(coverage, key=lambda c: -(c["confidence"] or 0)):
        own.setdefault((c["item_id"], named[c["bid_id"]]), c)
    want = []
    for i in items:
        project, run = (1, 2) if i["run_id"] == 8 else (2, 4)
        for v in {named[s["bid_id"]] for s in summaries if s["bid_run_id"] == run}:
            c = own.get((i["item_id"], v), {}) if v is not None else {}
            want.append((project, i["item_id"], v, c.get("status", "not_applicable"), c.get("confidence") or 0.0, text.get(c.get("line_id"))))
    for sizes in ({}, {"listed": 7}):
        got = B.bid_leveling(*args, **sizes)
        assert sorted(repr(tuple(r)) for r in got.select("project_id", "item_id", "vendor", "status", "confidence", "line_text").collect()) == sorted(map(repr, want))
    plain = {(r.item_id, r.code): r.cells for r in B.bid_leveling_wide(got).collect()}
    assert plain == {(r.item_id, r.code): r.cells for r in B.bid_leveling_nested(*args).collect()} and len(plain[3, "09 00 00"]) == 80
    shown = B.bid_leveling_nested(*args, show=lambda c: F.concat(c["vendor"], F.lit("="), c["status"]))
    assert {(r.item_id, r.code): r.cells for r in shown.collect()} == {k: [x.vendor and f"{x.vendor}={x.status}" for x in v] for k, v in plain.items()}
