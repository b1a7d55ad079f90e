"""Sides, sheets, corpora, trust, gaps and comparison on small rows worked out by hand."""

import hashlib

import pytest

from scopeloom.operators import evaluation, evidence, gaps, quantities, retrieval, runs, schedules, trust
from scopeloom.sources import ingest

DOCS = "document_id long, project_id long, doc_type string"
ITEMS = "item_id long, project_id long, division string, expected string"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    # project 1 has both sides, 2 drawings only, 3 specs only, 4 neither
    return spark.createDataFrame([(1, 1, "written-spec"), (2, 1, "drawing-set"), (3, 2, "drawing-set"), (4, 3, "written-spec"), (5, 4, "bid-quote"), (6, 4, None)], DOCS)


@pytest.fixture(scope="module")
def specs(spark, documents):
    text = "Division 3 concrete\nSECTION 22 11 16 pipe, subsection 09 00 00, DIVISION 0026, SECTIONS 33 00 00"
    data = [(1, 1, "spec_section", text), (1, 1, "spec_section", None), (1, 1, "note", "SECTION 27 00 00"), (1, 2, "spec_section", "SECTION 28 00 00")]
    return evidence.spec_divisions(documents, spark.createDataFrame(data, "project_id long, document_id long, chunk_type string, text string"))


def test_spec_divisions(specs):
    assert rows(specs) == [(1, "03"), (1, "22"), (1, "26")]


@pytest.mark.parametrize(
    ("project", "division", "expected", "want"),
    [
        (1, "03", "bilateral", "bilateral"),  # both sides
        (1, "09", "bilateral", "drawing_only"),  # the specs are silent
        (1, "26", "bilateral", "spec_only"),  # not in the taxonomy
        (1, "77", "bilateral", "bilateral"),  # neither side
        (1, "09", "spec_only", "spec_only"),
        (1, None, "bilateral", "bilateral"),
        (2, "26", "bilateral", "drawing_only"),
        (3, "09", "bilateral", "spec_only"),
        (3, None, "bilateral", "spec_only"),
        (4, "03", "bilateral", "bilateral"),
        (None, "03", "bilateral", "bilateral"),
        (1, "03", None, None),
    ],
)
def test_downgrade(spark, documents, specs, project, division, expected, want):
    items = spark.createDataFrame([(1, project, division, expected)], ITEMS)
    taxonomy = spark.createDataFrame([("03",), ("09",), ("09",), ("22",)], "division string")
    out = evidence.downgrade_pattern(items, evidence.project_sides(documents), specs, taxonomy)
    assert out.columns == items.columns and rows(out) == [(1, project, division, want)]


def test_sheets_of_items(spark):
    sheets = spark.createDataFrame([(1, "A1", 7, 5), (1, "A1", 7, 3), (1, "I2", 7, 4), (1, "L1", 7, 6), (1, "C1", 8, 1), (1, "??", 7, 9), (2, "A9", 9, 1)], "project_id long, sheet_id string, document_id long, page long")
    chunks = spark.createDataFrame([(7, 3, 30, "note"), (7, 3, 31, "page_summary"), (7, 4, 41, "note"), (7, 4, 40, "note")], "document_id long, page_number long, chunk_id long, chunk_type string")
    items = spark.createDataFrame(
        [
            (1, 1, "08 11 00", "door", "eve"),  # architectural: interior too
            (2, 1, "09 65 00", "floor", None),  # interior: architectural too
            (3, 1, "31 00 00", "dig", "section"),  # civil: site too
            (4, 1, "32 90 00", "plants", "section"),  # landscape is site
            (5, 1, "08 11 00", "door", "eve:admin"),
            (6, 1, "08 11 00", "door warranty", "eve"),
            (7, 1, None, "door", "eve"),
            (8, 1, "26 00 00", "panel", "eve"),  # no such sheet
            (9, 2, "08 11 00", None, "eve/mech"),
        ],
        "item_id long, project_id long, code string, description string, extraction_method string",
    )
    assert rows(evidence.items_for_sheets(items, sheets, chunks)) == sorted(
        [(1, "A1", 3, 31), (1, "I2", 4, 40), (2, "A1", 3, 31), (2, "I2", 4, 40), (3, "C1", 1, None), (3, "L1", 6, None), (4, "L1", 6, None), (9, "A9", 1, None)], key=repr
    )


def test_schedules_in_the_corpus(spark):
    none = spark.createDataFrame([], "document_id long, chunk_id long, chunk_type string, text string")
    sheets = spark.createDataFrame([], "document_id long, discipline string")
    divisions = spark.createDataFrame([], "division string, discipline string")
    titles = ["[typed:finish] a", "[typed:equipment]", "[typed:other] b", "Door", "[typed:none] c", None]
    schedule_rows = spark.createDataFrame([(i, t, r) for i, t in enumerate(titles) for r in (0, 1)], "schedule_id long, name string, row_index long")
    out = retrieval.discipline_corpus(none, sheets, divisions, schedule_rows)
    got = {}
    for r in out.collect():
        assert r.side == "schedule" and r.chunk_id is None
        got.setdefault(r.schedule_id, set()).add((r.discipline, r.row_index))
    assert got[0] == {("interior", 0), ("interior", 1)}
    assert {d for d, _ in got[1]} == {"mechanical", "electrical", "plumbing"}
    assert {"structural", "civil", "general", "plumbing"} <= {d for d, _ in got[2]}
    assert got.keys() == {0, 1, 2}


def test_trust_components(spark):
    runs = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3)], "run_id long, project_id long")
    items = spark.createDataFrame(
        [(1, 10, "03 30 00", 0.5, True), (2, 10, "03 30 00", None, False), (3, 10, "03 00 00", 1.0, None), (4, 11, "09 65 00", 0.9, True), (5, 12, None, 0.8, True)],
        "item_id long, run_id long, code string, confidence double, pattern_match boolean",
    )
    citations = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None), (4, None), (5, False), (99, True)], "item_id long, link_pass boolean")
    relevant = spark.createDataFrame([(1, "03"), (1, "09"), (1, "09")], "project_id long, division string")
    taxonomy = spark.createDataFrame([("03", "03 30 00"), ("03", "03 00 00"), ("03", "03 10 00"), ("09", "09 65 00"), ("26", "26 05 00")], "division string, code string")
    documents = spark.createDataFrame([(1, 1, "written-spec"), (2, 1, "drawing-set"), (3, 2, "drawing-set")], DOCS)
    pages = spark.createDataFrame([(1, "a"), (1, None), (1, ""), (2, None), (3, None)], "document_id long, text string")
    schedules = spark.createDataFrame([(1, "[typed:door] x", 3), (1, "[typed:door] y", 0), (1, "z", 0), (1, "[typed:room]", None)], "project_id long, name string, n_rows long")
    revisions = spark.createDataFrame([(1, "A1", 1, "1"), (1, "A1", 2, "2"), (1, "A2", 1, "1")], "project_id long, sheet_id string, document_id long, rev_number string")
    out = trust.trust_components(runs, items, citations, relevant, taxonomy, pages, documents, schedules, revisions)
    got = {r.run_id: r for r in evidence.trust_score(out).collect()}
    r = got[10]
    assert (r.n_items, r.link_judge_pass_rate, r.extraction_confidence_avg) == (3, pytest.approx(2 / 3), 0.75)
    assert r.bilateral_coverage == pytest.approx(1 / 3)  # an unclassified item does not match
    assert r.spec_section_coverage == pytest.approx(1 / 3)  # of 03 30 00, 03 10 00 and 09 65 00; roots count on neither side
    assert r.ocr_text_coverage == pytest.approx(2 / 3) and r.schedule_extraction_validity == pytest.approx(1 / 3)
    assert r.document_version_consistency == 0.5
    assert r.score == pytest.approx(0.3333 * 0.30 + 0.75 * 0.15 + 0.6667 * 0.15 + 0.3333 * 0.15 + 0.6667 * 0.10 + 0.3333 * 0.05 + 0.5 * 0.10, abs=1e-4)
    assert got[11].link_judge_pass_rate is None and got[11].spec_section_coverage == pytest.approx(1 / 3)
    alone = got[12]  # nothing is known of project 2 but one item and one failed link
    assert (alone.spec_section_coverage, alone.ocr_text_coverage, alone.schedule_extraction_validity, alone.document_version_consistency) == (None,) * 4
    assert alone.score == pytest.approx(0.30 + 0.8 * 0.15 + 0.15 + 0.10 + 0.05 + 0.10)
    assert (got[13].n_items, got[13].score, got[13].tier) == (0, 0.0, "RED")


def test_provenance(spark):
    items = spark.createDataFrame(
        [(1, "100 SF", None, "schedule_miner"), (2, "100 SF", None, "eve"), (3, None, None, "eve"), (4, None, None, "eve"), (5, "7", "ea", "eve")],
        "item_id long, quantity string, unit string, extraction_method string",
    )
    cits = spark.createDataFrame([("b", 1, "98 SF or 3 EA"), ("c", 2, "about 120 sq. ft."), ("a", 4, "5 LF"), ("d", 4, "5.1 LF"), ("e", 4, None)], "citation_id string, item_id long, excerpt string")
    got = {r.item_id: (r.qty_value, r.qty_uom, r.qty_confidence, r.signals, r.qty_source, r.qty_detail, r.spread_pct) for r in quantities.resolve_quantity(items, cits).collect()}
    assert got == {
        1: (100.0, "SF", "high", 3, "schedule_miner_stated", "100 SF", None),
        2: (100.0, "SF", "conflicting", 2, "sonnet_stated", "100 SF", 20.0),
        3: (None, None, "unverified", 0, None, None, None),
        4: (5.0, "LF", "medium", 2, "excerpt_regex", "a", None),
        5: (7.0, "EA", "medium", 1, "sonnet_stated", "7", None),
    }
    assert quantities.quantity_signals(items, cits).count() == 8


def test_gaps_of_all_kinds(spark):
    items = spark.createDataFrame([(1, 10, "03", 5.0, "EA"), (2, 10, "03", 5.0, "CY"), (3, 11, "08", 9e9, "EA")], "item_id long, run_id long, division string, qty_value double, qty_uom string")
    odd = gaps.gap_quantities(items, quantities.quantity_sanity(items.drop("run_id")))
    answers = spark.createDataFrame([(10, '{"spec_only":[{"text":"x","section":"09 65 00"}],"contradictions":[{"text":"y","section":"see z"},{"text":" "}]}'), (11, None), (12, "no json")], "run_id long, json string")
    table = gaps.gap_table([odd, gaps.gap_one_sided(gaps.discipline_gap_rows(answers))])
    assert rows(table, "run_id", "gap_type", "severity", "division", "subject", "status") == [
        (10, "qty_implausible", "blocker", "03", "1", "open"),
        (10, "unilateral_evidence", "warn", "09", "x", "open"),
        (10, "unilateral_evidence", "warn", None, "y [see z]", "open"),
        (11, "qty_implausible", "warn", "08", "3", "open"),
    ]
    assert rows(gaps.gap_counts(table, ["qty_implausible", "missing_section"])) == [(10, 1, 0), (11, 1, 0)]


def test_extractors_by_section(spark):
    kind = "item_id long, code string, extraction_method string, description string"
    old = spark.createDataFrame([(1, "03 30 00", "eve", "a"), (2, "05 00 00", "eve", "b")], kind)
    new = spark.createDataFrame([(3, "03 30 00", "section/qc", "c"), (4, "03 30 00", "eve:qc", "d"), (5, "03 30 00", None, "e"), (6, None, "eve", "f")], kind)
    sections = spark.createDataFrame([("03 30 00", "Concrete"), ("04 00 00", None)], "code string, title string")
    out = evaluation.compare_extractors(old, new, sections, ["qc", "admin"])
    assert rows(out, "code", "title", "old_items", "new_items", "qc", "admin") == [("03 30 00", "Concrete", 1, 3, 2, 0), ("04 00 00", "(?)", 0, 0, 0, 0)]
    cits = spark.createDataFrame([(3, "p", 30, "low", 0.1), (3, "q", 31, "none", None), (3, "r", 32, "best", 0.9)], "item_id long, citation_id string, chunk_id long, excerpt string, rerank double")
    one = evaluation.spot_check(new, cits, 3, 1)
    assert rows(one, "item_id", "place", "excerpt") == [(3, 1, "best"), (3, 2, "low"), (4, None, None), (5, None, None), (6, None, None)]
    drawn = rows(evaluation.spot_check(new, cits, 1, 5).select("code", "item_id").distinct())
    assert drawn == rows(evaluation.spot_check(new.repartition(3), cits, 1, 5).select("code", "item_id").distinct()) and len(drawn) == 2


def test_fingerprints(spark):
    data = [(i % 3 if i % 2 else 0, f"text {i % 50}", "project_document" if i % 7 else "bid_submission") for i in range(300)]
    data += [(None, "x", "project_document"), (8, None, "project_document"), (9, "only a bid", "bid_submission"), (10, "", "project_document")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for key, text, kind in data:
        if kind != "bid_submission":
            want.setdefault(key, []).extend([] if text is None else [sha(text.encode())])
    got = ingest.input_fingerprint(spark.createDataFrame(data, "project_id int, text string, source_kind string").repartition(5)).collect()
    assert len(got) == len(want)
    assert {r.project_id: r.fingerprint for r in got} == {k: sha(("\n".join(sorted(v)) + "\n").encode()) for k, v in want.items()}
    assert ingest.input_fingerprint(spark.createDataFrame([], "project_id int, text string, source_kind string")).collect() == []


def test_mined_items(spark):
    rows_ = spark.createDataFrame(
        [(1, 0, "finish", "mark=B1 name=rubber base", None), (1, 1, "finish", "mark=X name=stone", None), (1, 2, "finish", "", "empty_row"), (2, 0, None, "a=door leaf", None), (3, 0, "door", "a=door leaf", None), (4, 0, "door", "a=door leaf", None)],
        "ord long, row_index long, type string, text string, skip string",
    )
    heads = spark.createDataFrame([(1, True, "09", " ", None), (2, True, "081", "08 11 13", "LF"), (3, False, "08", None, "EA"), (4, True, "8", None, "EA")], "ord long, is_quantifiable boolean, division string, section string, default_unit string")
    answers = spark.createDataFrame(
        [
            (1, 0, "Rubber base B1", None, "EA", "s"),  # the rule's unit
            (1, 1, "stone", "3", None, None),
            (1, 1, "teak veneer panel boards", None, None, None),  # not of this row
            (1, 2, "empty", None, None, None),
            (1, 9, "no such row", None, None, None),
            (2, 0, " door leaf ", "", "", None),
            (2, 0, " ", None, None, None),
            (3, 0, "door leaf", None, None, None),  # can't be counted
            (4, 0, "door leaf", None, None, None),  # no division
        ],
        "ord long, row_index long, description string, quantity string, unit string, specification string",
    )
    out = schedules.mine_schedule_items(rows_, heads, answers)
    assert rows(out, "division", "code", "ord", "row_index", "description", "quantity", "unit") == [
        ("08", "08 11 13", 2, 0, "door leaf", "1", "LF"),
        ("09", "09 00 00", 1, 0, "Rubber base B1", "1", "LF"),
        ("09", "09 00 00", 1, 1, "stone", "3", "EA"),
    ]
    assert {r.extraction_method for r in out.collect()} == {"schedule_miner"}


def test_flags_and_signals(spark):
    low = "INFERRED_LOW_CONFIDENCE"
    data = [(1, i, f"0{i % 3} 00 00", "d", None, None, "high", "EXPLICITLY_CITED", True, 0.5) for i in range(3, 6)]
    data += [(1, 1, "09 00 00", "tile", "5", "SF", "conflicting", low, False, None), (1, 2, None, None, "", "x", None, low, None, 0.1), (2, 7, "01 00 00", "x", "1", "", "medium", low, True, 0.2)]
    items = spark.createDataFrame(data, "run_id long, item_id long, code string, description string, quantity string, unit string, qty_confidence string, tier string, bilateral boolean, confidence double")
    got = {r.item_id: (r.line, r.omitted) for r in runs.item_flags(items).collect()}
    assert got[1] == ("- 09 00 00: tile — qty 5 SF [qty:conflicting, evidence:low, one-sided]", 0)
    assert got[3] == ("- 00 00 00: d", 0) and got[7] == ("- 01 00 00: x — qty 1 [qty:medium, evidence:low]", 0)
    assert got[2] == ("- :  [evidence:low]", 0)
    few = runs.item_flags(items, 2).collect()
    assert {(r.run_id, r.item_id, r.omitted) for r in few} == {(1, 2, 3), (1, 3, 3), (2, 7, 0)}
    gaps_ = spark.createDataFrame([(1, 10, "open"), (1, 11, "resolved")], "run_id long, gap_id long, status string")
    conflicts = spark.createDataFrame([], "run_id long, conflict_id long, status string")
    assert rows(runs.rfi_inputs(gaps_, conflicts, items)) == [(1, "gap", "10"), (1, "item", "1"), (1, "item", "2")]
