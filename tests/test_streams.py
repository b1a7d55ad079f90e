"""The live index against a batch build, batch by batch, and what its files cost."""

import os

import pytest

from scopeloom.operators import review
from scopeloom.streaming import jobs

LONG = "SECTION 09 29 00 - BOARD\n" + "gypsum board " * 900


def pages(spark, rows):
    return spark.createDataFrame([(d % 2, d, f"f{d}.pdf", v, p, t) for d, v, p, t in rows], jobs.PAGES)


BATCHES = [
    [(1, 0, 1, "alpha beta"), (1, 0, 2, LONG), (2, 0, 1, "gone soon"), (2, 0, 2, "and this page")] + [(d, 0, 1, " ".join(f"w{d}x{k}" for k in range(40))) for d in range(10, 60)],
    [(3, 0, 1, "SECTION 03 30 00 concrete"), (3, 0, 2, None), (3, 0, 3, "more of it"), (3, 0, 3, "more of it")],
    [(2, 0, 1, "older issue in the same batch"), (2, 1, 1, "a new issue of one page"), (1, 2, 1, "omega")],
]
FINAL = [r for r in BATCHES[0] if r[0] not in (1, 2)] + BATCHES[1] + [(2, 1, 1, "a new issue of one page"), (1, 2, 1, "omega")]


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("compacted_after", [None, 0, 2])
def test_batches_equal_a_batch_build(spark, tmp_path, compacted_after):
    source, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    for k, batch in enumerate(BATCHES):
        pages(spark, batch).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_index(spark, source, index, checkpoint).awaitTermination()
        if k == compacted_after:
            assert jobs.compact(spark, index) == 1
    want = jobs.index_tables(pages(spark, FINAL))
    for name in (jobs.CHUNKS, jobs.POSTINGS, jobs.DOCUMENTS):
        assert rows(jobs.live(spark, index, name)) == rows(want[name]), name
    sections = {(r.document_id, r.page_number): r.csi_section for r in jobs.live(spark, index, jobs.CHUNKS).collect()}
    assert sections[3, 3] == "03 30 00" and sections[1, 1] is None
    if compacted_after is None:
        # what a batch writes follows the batch, not the index
        assert size(f"{index}/v0/postings/batch=3") < 0.3 * size(f"{index}/v0/postings/batch=1")


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    index = str(tmp_path / "index")
    for _ in range(2):
        jobs.write_segment(jobs.index_tables(pages(spark, BATCHES[0])), index, 0, 1)
    # a batch that failed before its list of documents does not count
    tables = jobs.index_tables(pages(spark, [(1, 5, 1, "half written")]))
    tables[jobs.POSTINGS].write.parquet(f"{index}/v0/postings/batch=2")
    assert rows(jobs.live(spark, index)) == rows(jobs.index_tables(pages(spark, BATCHES[0]))[jobs.POSTINGS])
    assert jobs.live(spark, str(tmp_path / "nothing")).count() == 0


def test_review_log(spark):
    """The second resolve is refused, and each reclassification starts from the one before."""
    frame = spark.createDataFrame
    conflicts = frame([(1, "open"), (2, "open"), (3, "deferred"), (4, None)], "conflict_id long, status string")
    members = frame([(1, 10), (1, 11), (1, 12), (2, 11), (2, 13), (3, 10)], "conflict_id long, item_id long")
    gaps = frame([(7, "open"), (8, "resolved")], "gap_id long, status string")
    items = frame([(i, "03 30 00", "03", "Concrete", None if i == 10 else "open") for i in (10, 11, 12, 13)], "item_id long, code string, division string, section_title string, review_status string")
    taxonomy = frame([("03 30 00", "03", 1, "Concrete"), ("09 29 00", "09", 2, "Board"), ("09 91 00", "09", 3, None)], "code string, division string, ord long, title string")
    log = [(1, "resolve", 1, 99, None), (2, "resolve", 1, 11, None), (3, "resolve", 1, 12, None), (4, "resolve", 3, 10, None), (5, "resolve", 9, 10, None), (6, "resolve", 4, 10, None),
           (7, "acknowledge", 8, None, None), (8, "acknowledge", 8, None, None), (9, "acknowledge", 99, None, None), (10, "reclassify", 13, None, "09-29-01"), (11, "reclassify", 13, None, "099100"), (12, "reclassify", 77, None, "099100")]
    actions = frame([(s, "u", a, e, w, c) for s, a, e, w, c in log], "seq long, actor string, action string, entity_id long, winner long, new_code string")
    out = review.apply_review_actions(conflicts, members, gaps, items, actions, taxonomy)
    audit = {r.seq: (r.outcome, r.before, r.after) for r in out["audit"].collect()}
    assert audit == {
        1: ("not_a_member", "open", None), 2: ("applied", "open", "resolved:11"), 3: ("already_resolved", "resolved", None), 4: ("already_deferred", "deferred", None), 5: ("not_found", None, None), 6: ("already_", "", None),
        7: ("applied", "resolved", "acknowledged"), 8: ("applied", "acknowledged", "acknowledged"), 9: ("not_found", None, None),
        10: ("applied", "03 30 00|03|Concrete", "09 29 00|09|Board"), 11: ("applied", "09 29 00|09|Board", "09 91 00|09|"), 12: ("not_found", None, None),
    }
    assert {r.conflict_id: (r.status, r.winner_item) for r in out["conflicts"].collect()} == {1: ("resolved", 11), 2: ("open", None), 3: ("deferred", None), 4: (None, None)}
    assert {r.item_id: (r.code, r.section_title, r.review_status) for r in out["items"].collect()} == {10: ("03 30 00", "Concrete", "rejected"), 11: ("03 30 00", "Concrete", "open"), 12: ("03 30 00", "Concrete", "rejected"), 13: ("09 91 00", None, "open")}
    assert {r.gap_id: r.status for r in out["gaps"].collect()} == {7: "open", 8: "acknowledged"}
    refused = review.apply_review_actions(conflicts, members, gaps, items, actions, taxonomy.limit(0))["audit"].where("action = 'reclassify'").collect()
    assert {r.outcome for r in refused} == {"no_taxonomy", "not_found"}
