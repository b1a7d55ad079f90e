"""Ranked search against plain scoring of every document, and the block bounds against exhaustive search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scopeloom.llm import ranked_search as R

from .conftest import SCHEMA, frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, top=50):
    """``docs``: (id, text); ``items``: (item, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted]
    big_n, big_l = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in counted:
            s = 0
            for t in wanted & set(c):
                m = 50 + 50 * n * big_n // big_l
                s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return out


def sorted_rows(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def asked(texts):
    rng = random.Random(5)
    own = [t for t in texts if t and len(t.split()) > 4]
    items = [(k, " ".join(rng.sample(own[k * 2].split(), 4)) + " " + words(rng, 5)) for k in range(12)]
    return [*items, (50, None), (51, ""), (52, "?? --"), (53, "É東京 password"), (None, own[3]), (0, own[5]), (3, items[3][1])]


def test_ranked_search(spark, docs, texts, asked):
    items = spark.createDataFrame([(*a, "clash", 1) for a in asked], "item_id bigint, text string, doc_id string, score int")
    want = sorted_rows(plain(list(enumerate(texts)), asked))
    for size in (R.CHUNK_BYTES, 200):  # one pass, then several
        got = R.ranked_search(docs, items, chunk_bytes=size)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted_rows(tuple(r) for r in got.collect()) == want


def test_null_and_repeated_ids(spark):
    texts = ["alpha beta", "alpha beta", "alpha beta", None, "", "gamma alpha alpha", "delta"]
    ids = [4, 4, None, 7, 8, None, 9]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "", 0, "") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    items = spark.createDataFrame([("a", "ALPHA alpha"), ("b", "beta gamma"), ("c", "nothing")], "item_id string, text string")
    got = [tuple(r) for r in R.ranked_search(docs, items).collect()]
    assert sorted_rows(got) == sorted_rows(plain(list(zip(ids, texts, strict=True)), [("a", "ALPHA alpha"), ("b", "beta gamma"), ("c", "nothing")]))


def test_nothing_to_search(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert R.ranked_search(no_docs, items).count() == 0
    assert R.ranked_search(docs, items.limit(0)).count() == 0
    assert R.ranked_search(docs, spark.createDataFrame([(1, None), (2, "?")], "item_id bigint, text string")).count() == 0


def test_packed_postings():
    import zstandard

    packer, reader = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for tf in (np.ones(3, np.int64), np.array([1, 255, 7]), np.array([1, 300, 70_000]), np.ones(500, np.int64)):
        at = np.sort(np.random.default_rng(1).choice(R.BLOCK, len(tf), replace=False))
        offsets, back = R.unpack(memoryview(R.pack(at, tf, packer)), len(tf), reader)
        assert offsets.tolist() == at.tolist() and back.tolist() == tf.tolist()


def test_blocks_are_rejected_unread(monkeypatch):
    """Many small blocks: the same heaps as plain scoring, while postings stay packed."""
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 40))) for _ in range(3000)]
    names = sorted(t.encode() for t in vocabulary)
    number = {t: k for k, t in enumerate(names)}
    found = [Counter(number[t.encode()] for t in x.split()) for x in texts]
    row = R.build_segment(list(range(3000)), [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in found], [len(x.split()) for x in texts], names)
    row["terms"] = [bytes(t) for t in row["terms"]]
    total = sum(len(x.split()) for x in texts)
    segment = R.Segment(row, number, 3000, total)
    df = Counter(t for c in found for t in c)
    items = [(k, " ".join(rng.sample(vocabulary, 6))) for k in range(20)]
    want = plain(list(enumerate(texts)), items, top=5)
    got, skipped = [], 0
    for item, text in items:
        heap = R.Heap(0, 5)
        segment.search([(number[t.encode()], R.weight(3000, df[number[t.encode()]])) for t in text.split()], heap)
        got += [(item, k + 1, key[2], s) for k, (key, s) in enumerate(heap.held)]
    assert got == want
    assert segment.skipped > 0 and segment.unpacked < (segment.entry >= 0).sum()


def test_norms_beyond_64_bits():
    assert R.norms(np.array([10**9, 5]), 10**10, 10**12).tolist() == [50 + 50 * 10**9 * 10**10 // 10**12, 50 + 50 * 5 * 10**10 // 10**12]
