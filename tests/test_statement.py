"""Statements of work: the files put together are the lines in order, however they are cut."""

import pytest

from scopeloom.operators import packages, statement


@pytest.fixture(scope="module")
def inputs(spark):
    frame = spark.createDataFrame
    rows = [(i, i % 2, 1, "general", f"{d:02d}", f"{d:02d} 30 00", f"Item\n{i}", "2" if i % 3 else None, "EA" if i % 4 else None, m) for i, d, m in [(k, 1 + k % 3, ["eve", "eve:admin", None][k % 3]) for k in range(40)]]
    items = frame(rows, "item_id long, run_id int, project_id int, package string, division string, code string, description string, quantity string, unit string, extraction_method string")
    cits = frame([(0, "drawing", "A1"), (0, "spec", None), (1, "drawing", None)], "item_id long, evidence_type string, sheet string")
    gaps = frame([(k, 0, "warn" if k < 11 else "info", "unresolved_cross_reference", f"do {k} before") for k in range(14)] + [(99, 7, "warn", "x", "before")], "gap_id long, run_id int, severity string, gap_type string, description string")
    conflicts = frame([(1, 0, "open"), (1, 0, "open"), (2, 0, "resolved")], "conflict_id long, run_id int, status string")
    exclusions = frame([(0, 3), (9, 4)], "run_id int, n long")
    return items, cits, gaps, conflicts, exclusions, frame([("01 30 00", None), ("02 30 00", "Two")], "code string, title string")


@pytest.mark.parametrize("files", [1, 3, 40])
def test_files_put_together(spark, inputs, tmp_path, files):
    lines = statement.statement_lines(*inputs)
    want = {}
    for r in lines.orderBy("sow_id", "section", "place", "at").collect():
        want.setdefault(r.sow_id, []).append(r.text)
    statement.write_statements(lines, str(tmp_path), files)
    got = {}
    for r in statement.read_statements(spark, str(tmp_path)).orderBy("sow_id", "n").collect():
        got.setdefault(r.sow_id, []).append(r.text)
    assert got == want and set(got) == {"0", "1"}
    if files > 1:
        assert spark.read.parquet(f"{tmp_path}/manifest").where("sow_id = '0'").count() > 1


def test_sections(spark, inputs):
    lines = [r.text for r in statement.statement_lines(*inputs).where("sow_id = '0'").orderBy("section", "place", "at").collect()]
    assert [x for x in lines if x.startswith("## ")] == [f"## {n}. {h}" for n, h in enumerate(statement.HEADINGS, 1)]
    assert lines[0] == "# Scope of work" and "- 3 more are named in bids." in lines and "- and 3 more" in lines and "- 1 open conflicts" in lines
    assert "- Provide item 0 per A1; per spec section 01 30 00." in lines
    assert sum(x.startswith("- do ") for x in lines) == 8


def test_nothing(spark, inputs, tmp_path):
    lines = statement.statement_lines(inputs[0].limit(0), *inputs[1:])
    statement.write_statements(lines, str(tmp_path))
    assert lines.count() == 0 and statement.read_statements(spark, str(tmp_path)).count() == 0


def test_two_overrides_of_one_division(spark):
    rules = packages.load_rule_dims(spark)
    one = spark.createDataFrame([("03", "x")], "division string, package string")
    assert packages.resolve_bundling(rules, one).where("division = '03'").collect()[0].package == "x"
    with pytest.raises(Exception, match="two overrides of division 03"):
        packages.resolve_bundling(rules, one.unionByName(one.replace("x", "y"))).collect()
