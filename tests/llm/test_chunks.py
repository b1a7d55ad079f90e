"""Results that must not depend on how input is cut: chunks of a benchmark, numbers of record files."""

from scopeloom.llm import decontamination, records


def test_near_places_of_several_passes(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(0, "alpha beta gamma"), (0, "beta gamma delta"), (1, "gamma delta epsilon")], "item_id bigint, text string")
    found = []
    for size in (1 << 20, 30, 5):
        rows = decontamination.decontaminate(docs, items, chunk_bytes=size).collect()
        found.append(sorted((r.doc_id, str(r.spans), str(r["items"]), str(r.near)) for r in rows))
    assert found[0] == found[1] == found[2]
    assert [(p.item, p.start, p.end) for r in rows if r.doc_id == 1 for p in r.near] == [(0, 0, 5)]


def test_files_follow_by_number(spark):
    names = [f"file:/x/part-1/records/part-{n:05d}-a-c000.txt" for n in (99_999, 100_000, 10_001, 0, 100_001)]
    files = spark.createDataFrame([(name, 10 + k) for k, name in enumerate(names)], "file string, held bigint")
    before = {r.file: r.before for r in records.tokens_before(files).collect()}
    assert [before[names[k]] for k in (3, 2, 0, 1, 4)] == [0, 13, 25, 35, 46]
