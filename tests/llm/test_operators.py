"""Each operator against a plain version in Python, on a small table with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeloom.llm import decontamination, exact_dedup, langid, licenses, near_dedup, packing, records, secrets, substring_dedup, tokens, toxicity
from scopeloom.llm.common import words

from .conftest import SCHEMA, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def base_spans(text):
    text, out = text or "", []
    low = {c: c + 32 for c in range(65, 91)}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text.translate(low)) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(docs, texts):
    got = rows(secrets.secret_report(docs))
    for i, t in enumerate(texts):
        want = base_spans(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_trigram_queries():
    by = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert by["hex"] is None
    assert frozenset([b"aki", b"kia"]) in by["access"]
    assert all(any(g in s for s in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")) for conj in by["assign"] for g in conj if b'"' not in g and b"'" not in g)


def test_records_round_trip(spark, docs, texts, tmp_path):
    path = str(tmp_path)
    records.write_records(docs, path)
    records.write_index(spark, path)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    index = rows(records.read_index(spark, path).withColumn("doc_id", F.col("id").cast("long")))
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (index[i].start, index[i].n_tokens, index[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    some = records.read_index(spark, path).where("offset > 0").orderBy(F.rand(3)).limit(5)
    for r in records.fetch(spark, path, some).collect():
        assert r.ids[-1] == 0 and len(r.ids) == index[int(r.id)].n_tokens


def test_broken_record():
    data = bytearray(records.frame(1, np.array([5, 70_000, 0], "<u4")))
    name, ids, after = records.unframe(memoryview(data), 0)
    assert (name, ids.tolist(), after) == ("1", [5, 70_000, 0], len(data))
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)


def test_language(spark):
    rng = np.random.default_rng(1)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    a, b = ["th", "er", "wh"], ["çã", "ão", "és"]
    texts = [make(a) if i % 2 else make(b) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "pt") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "12 !", None), (902, "", "pt")], "doc_id bigint, text string, lang string")
    got = rows(langid.language_report(docs))
    held = [r for r in got.values() if r.held_out and r.doc_id < 200]
    assert held and all(r.lang_pred == ("en" if r.doc_id % 2 else "pt") and 0.5 < r.score <= 1 for r in held)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def brute_segments(scores):
    """All maximal-scoring segments by their definition: the best segment, then both sides of it."""
    best, span = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12:
                best, span = s, (i, j)
    if span is None:
        return []
    i, j = span
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        hit = rng.random(n) < 0.35
        scores = [float(rng.integers(1, 40)) / 7 + rng.random() / 1000 if h else -0.83 for h in hit]
        got = toxicity.segments([(i, s) for i, (h, s) in enumerate(zip(hit, scores, strict=True)) if h], -0.83)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = lambda: ["".join(rng.choice(["th", "er", "on", "an"], 2)) for _ in range(60)]
    data, labels = [], []
    for i in range(400):
        w = plain()
        if i % 4 == 0:
            w[10] = w[12] = "nasty"
            w[40] = "vile"
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    data += [(900, None), (901, ""), (902, "NASTY vile nasty")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = rows(toxicity.toxicity_report(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")))
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    none = toxicity.toxicity_report(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.predicted for r in none.collect()} == {0}


@pytest.mark.parametrize("last", [True, False])
def test_exact(docs, texts, last):
    got = rows(exact_dedup.exact_duplicates(docs, last=last))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        keep = (max if last else min)(g)
        assert tuple(got[i]) == (i, keep, len(g), keep == i, hashlib.sha256((t or "").encode()).hexdigest())


def test_trie(monkeypatch):
    trie = exact_dedup.PatriciaTrie(last=True)
    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(500)]
    for i, k in enumerate(keys):
        trie.insert(k, i, 1)
    want = {k: (max(i for i, x in enumerate(keys) if x == k), keys.count(k)) for k in keys}
    assert {k: (keep, n) for k, keep, n in trie.terminals()} == want


def test_exact_with_spill(docs, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUDGET", 2000)
    test_exact(docs, texts, True)


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("alphabet", [2, 5, 1000])
def test_similarity(alphabet):
    rng = np.random.default_rng(4)
    for k in range(600):
        a = rng.integers(0, alphabet, rng.integers(1, 25 if k % 3 else 120))
        b = np.array([x if rng.random() > 0.05 else rng.integers(0, alphabet) for x in a if rng.random() > 0.08] + list(rng.integers(0, alphabet, rng.integers(0, 3))))
        if not len(b):
            continue
        longest, edits = max(len(a), len(b)), edit_distance(a, b)
        want = 1 - edits / longest if edits <= int(0.2 * longest + 1e-9) else 0
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        assert abs(near_dedup.similarity(a, b) - want) < 1e-9
        assert near_dedup.similar(a, b) == (want > 0) and near_dedup._edits_along(a, b) >= edits


def near_classes(texts):
    codes = [near_dedup.word_codes(words(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(codes[i]) and len(codes[j]) and near_dedup.similarity(codes[j], codes[i]) > 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near(docs, texts):
    got = rows(near_dedup.near_duplicates(docs))
    want = near_classes(texts)
    # pairs at the threshold share few sketches, so classes may be finer there; copies and single edits must meet
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())


def edited(rng, words, edits, first=0):
    """The words with so many of them changed, none before ``first``."""
    out = list(words)
    for i in rng.sample(range(first, len(words)), edits):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def one_sketch(kind):
    """A leader and two similar texts that share none but one of its sketches: both unlike it, or the second like it."""
    sketches, codes = near_dedup.order_sketches, lambda w: near_dedup.word_codes([x.encode() for x in w])
    for seed in range(20000):
        rng = random.Random(seed)
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        if kind == "passage":
            leader = own[:24] + [f"w{rng.randrange(10**9)}" for _ in range(40)]
            x, y = own, edited(rng, own, 11, 24)
        else:
            leader = own
            y = edited(rng, own, 10)
            x = edited(rng, y, 10)
        a, b, c = (set(sketches(codes(w))) for w in (leader, x, y))
        if len(b & c) == 1 and b & c <= a and not near_dedup.similarity(codes(leader), codes(x)):
            return [" ".join(w) for w in (leader, x, y)]


@pytest.mark.parametrize("kind", ["passage", "settled"])
def test_near_with_one_shared_sketch(spark, kind):
    texts = one_sketch(kind)
    want = near_classes(texts)
    assert want == ([0, 1, 1] if kind == "passage" else [0, 0, 0])
    got = rows(near_dedup.near_duplicates(frame(spark, texts)))
    assert [got[i].class_id for i in range(3)] == want


def test_near_at_the_threshold(spark):
    rng, texts = random.Random(11), []
    for n in [5, 6, 7, 8, 9, 10, 14, 15, 20, 33, 47, 60, 100, 150, 200]:
        for share in (0.2, 0.15, 0.1, 0.05):
            base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(base), " ".join(edited(rng, base, int(share * n + 1e-9)))]
    want = near_classes(texts)
    assert want == [i - i % 2 for i in range(len(texts))]
    got = rows(near_dedup.near_duplicates(frame(spark, texts)))
    assert [got[i].class_id for i in range(len(texts))] == want


def brute_decontamination(texts, items, size=10):
    windows = {}
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owner := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owner
        names = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, texts):
    w = texts[45].split()
    items = [(2, " ".join(w[3:20])), (10, " ".join(w[8:25])), (3, "Ünï çødé 東京"), (4, None), (5, ""), (6, " ".join(w[3:20])), (7, "as as as")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_decontamination(texts, items)
    got = rows(decontamination.contamination_report(docs, benchmark))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == want
    assert sum(x[4] for x in want) >= 3
    chunked = rows(decontamination.decontaminate(docs, benchmark, chunk_bytes=60))
    whole = rows(decontamination.decontaminate(docs, benchmark))
    assert all(chunked[i] == whole[i] for i in range(len(texts)))
    for i in range(len(texts)):
        assert sum(s.end - s.start for s in chunked[i].spans) == want[i][1] and len(chunked[i]["items"]) == want[i][2]


def test_decontamination_in_chunks_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (1, "five six seven"), (None, "one two three four"), (None, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "two three"), (2, "six seven"), (3, "four")], "item_id bigint, text string")
    found = decontamination.decontaminate(docs, benchmark, chunk_bytes=5).collect()
    assert sorted((str(r.doc_id), r.n_words, r["items"]) for r in found) == [("1", 3, [2]), ("1", 4, [1, 3]), ("None", 0, []), ("None", 4, [1, 3])]


def brute_near(text, windows, size, slop):
    """Places where all words of a window stand near where a start puts them, and no exact hit does."""
    w, out = WORD.findall(lower(text)), []
    for item, terms in windows:
        exact = {s for s in range(len(w)) if w[s : s + len(terms)] == terms}
        for s in range(-slop - size, len(w)):
            ok = all(any(w[p] == t for p in range(max(0, s + j - slop), min(len(w), s + j + slop + 1))) for j, t in enumerate(terms))
            if ok and not any(x in exact for x in range(s - slop, s + slop + 1)):
                out.append((item, s))
    return out


def test_near_places(spark):
    rng = random.Random(12)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") + str(k) for _ in range(12))) for k in range(4)]
    texts = ["x alpha beta", "gamma y"]
    for _ in range(40):
        w = items[rng.randrange(4)][1].split()
        if rng.random() < 0.6:
            w.insert(rng.randrange(12), "extra")
        if rng.random() < 0.3:
            w[3], w[4] = w[4], w[3]
        if rng.random() < 0.2:
            w[5] = "other"
        texts.append(" ".join(["pad"] * rng.randrange(3) + w))
    items.append((9, "alpha beta gamma"))
    got = rows(decontamination.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")))
    windows = [(k, t.split()[i : i + 10]) for k, t in items for i in range(max(1, len(t.split()) - 9))]
    assert not got[0].near and not got[1].near and any(got[i].near for i in range(len(texts)))
    for i, t in enumerate(texts):
        want = brute_near(t, windows, 10, decontamination.SLOP)
        assert {x["item"] for x in got[i].near} <= {k for k, _ in want}
        # a start is one that the rarest term's own places give, so every item with such a start is found
        exact_words = {k for k, _ in want if any(s >= 0 for x, s in want if x == k)}
        assert {x["item"] for x in got[i].near} >= {k for k in exact_words if len([1 for x, _ in want if x == k]) > 2 * decontamination.SLOP}


def test_licenses_of_repeated_ids(spark):
    data = [(1, "under the mit license"), (1, "CC by nc and more words"), (None, "x"), (None, "x")]
    got = sorted((str(r.doc_id), r.n_words, r.base_labels) for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id bigint, text string")).collect())
    assert got == [("1", 4, "mit"), ("1", 6, "cc-by-nc"), ("None", 1, ""), ("None", 1, "")]


def test_many_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 20)}{chr(97 + i // 20)} " * 9, f"l{i}") for i in range(300)], "doc_id bigint, text string, lang string")
    model = langid.fit_language_model(docs)
    assert len(model.labels) == 300 and model.log_prob.size <= langid.CELLS
    got = rows(langid.predict_language(docs, model))
    assert sum(got[i].lang_pred == f"l{i}" for i in range(300)) >= 285


def test_location_fits_the_tail():
    """Best segments of random clean texts exceed a strength as often as the extreme-value law says."""
    rng = np.random.default_rng(4)
    share, scores = np.array([0.004, 0.002, 0.001]), [2.0, 3.0, 4.0]
    model = toxicity.ToxicityModel({bytes([97 + i]): s for i, s in enumerate(scores)}, drift=-0.1)
    model.lam = toxicity._lambda(np.r_[scores, model.drift], np.r_[share, 1 - share.sum()])
    model.log_k = toxicity._location(model, share)
    assert model.log_k != 0
    best = []
    for _ in range(600):
        n = 20_000
        drawn = rng.choice(4, n, p=np.r_[share, 1 - share.sum()])
        hits = [(i, scores[d]) for i, d in enumerate(drawn.tolist()) if d < 3]
        best.append(model.lam * max(s for *_, s in toxicity.segments(hits, model.drift)) - np.log(n) - model.log_k)
    for at in (0.0, 1.0, 2.0):
        assert abs((np.array(best) > at).mean() - (1 - np.exp(-np.exp(-at)))) < 0.12


def test_licenses(docs, texts):
    got = rows(licenses.scan_licenses(docs))
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        hits = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits)), t
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_with_edits(spark):
    text = "permission is hereby granted free of charge to any dear person obtaining a copy of this software and associated documentation files"
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert r.labels == "mit" and r.n_base == 0 and 0.7 <= r.score < 1


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def brute_substrings(texts, size=50):
    first, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first.setdefault(b[s : s + size], i) < i:
                gone[s : s + size] = b"\1" * size
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substrings(docs, texts):
    got = rows(substring_dedup.repeated_substrings(docs))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_substrings(texts)


def test_substrings_in_small_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 50)
    test_substrings(docs, texts)


def test_multikey_sort():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, (400, 20)).astype(np.uint8)
    order = substring_dedup.multikey_sort(substring_dedup.key_words(data))
    assert [bytes(x) for x in data[order]] == sorted(bytes(x) for x in data)


OPERATORS = {
    "secrets": lambda d, s: secrets.secret_report(d),
    "records": lambda d, s: records.record_report(d),
    "language": lambda d, s: langid.language_report(d),
    "toxicity": lambda d, s: toxicity.toxicity_report(d, s.createDataFrame([], "doc_id bigint, quality int, toxic int")),
    "exact": lambda d, s: exact_dedup.exact_duplicates(d),
    "near": lambda d, s: near_dedup.near_duplicates(d),
    "decontamination": lambda d, s: decontamination.contamination_report(d, s.createDataFrame([], "item_id bigint, text string")),
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "packing": lambda d, s: packing.pack(d),
    "substrings": lambda d, s: substring_dedup.repeated_substrings(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, no_docs, name):
    assert OPERATORS[name](no_docs, spark).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeats(spark, name):
    """All-null rows, a null id with a text, a row that repeats: each has its own result, that of its text alone."""
    blank = (None,) * 8
    text = "some words of a text, five of them and more"
    data = [(None, *blank), (None, text, *blank[1:]), (1, text, *blank[1:]), (1, text, *blank[1:]), (2, None, *blank[1:]), (3, "", *blank[1:])]
    out = OPERATORS[name](spark.createDataFrame(data, SCHEMA).repartition(3), spark).collect()
    if name == "packing":  # a document may lie in several pieces
        assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if not r.start)
        out = [r for r in out if not r.start]
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "2", "3", "None", "None"]
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "start", "sequence_id", "offset", "capacity", "step_group", "length" if name == "packing" else "", "ids_crc32" if name == "packing" else "")})
    assert by[1][0] == by[1][1]
    plain = lambda r: {k: v for k, v in r.items() if k not in ("held_out", "keep_id", "kept", "class_id")}
    alike = [plain(r) for r in by[None]]
    if name == "substrings":  # null ids are the smallest; of the equal texts theirs stays whole, and it is below a window
        assert {r["n_removed"] for rs in by.values() for r in rs} == {0}
    assert plain(by[2][0]) == plain(by[3][0]) and plain(by[2][0]) in alike and plain(by[1][0]) in alike


def test_frame_has_clashing_names(docs):
    assert {"id", "label", "part", "spans"} <= set(docs.columns) and frame is not None


def test_anchor_places():
    """Each anchor's bits are the windows whose least hash it holds, also in texts that repeat themselves."""
    rng = np.random.default_rng(9)
    for size, alphabet in ((3000, 2), (3000, 100), (900, 1)):
        data = rng.integers(0, alphabet, size).astype(np.uint8)
        data[200:1200 if size > 2000 else 400] = np.resize(data[200:217], len(data[200:1200 if size > 2000 else 400]))
        offsets = np.array([0, 40, 700, 700, size])
        at, own, bits = substring_dedup.anchors(offsets, data)
        h = substring_dedup.gram_hashes(data, substring_dedup.GRAM)
        want = {}
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            for s in range(lo, hi - substring_dedup.WINDOW + 1):
                window = h[s : s + substring_dedup.PLACES]
                for c in np.flatnonzero(window == window.min()) + s:
                    want[c] = want.get(c, 0) | 1 << (s - c + substring_dedup.SIDE)
        assert dict(zip(at.tolist(), bits.tolist(), strict=True)) == want


def test_substrings_with_equal_hashes(docs, texts, monkeypatch):
    """Windows that a weak hash mixes up are told apart by their bytes."""
    context = np.frombuffer(b"".join(bytes([65 + i % 3]) * substring_dedup.CONTEXT for i in range(9)), np.uint8).reshape(9, -1)
    bits, doc = np.full(9, 1, np.uint32), np.arange(9)
    hashes = substring_dedup.gram_hashes
    monkeypatch.setattr(substring_dedup, "gram_hashes", lambda data, size: hashes(data, size) % 2 + 1)
    out = np.zeros(9, np.uint32)
    substring_dedup._judge_windows(context, bits, doc, np.arange(9), out)
    assert out.tolist() == [0, 0, 0, 1, 1, 1, 1, 1, 1]


def test_pieces_are_looked_up_once():
    """A run's texts share their pieces: words with signs or across lines add no call of the model, odd texts take the library's path."""
    import random

    import pyarrow as pa

    path = tokens.default_vocabulary()
    coder = tokens.Encoder(path)
    said = [None, "", " ", "a  b", "\na b", "a\n b", "a b\n", "it's a b's", "a\x1cb c", "a\0b \0 c", "ÿ üÿ. é,\nÀ", "1a2 ²x aª b_c", "a <|endoftext|> b", "a b c", "x́ á."]
    rng = random.Random(3)
    said += ["".join(rng.choices(["a", "The", " ", " ", "\n", "'", "é", "\t", "\0", "1", ".", ",", "ª", "中", "_"], k=rng.randrange(1, 14))) for _ in range(3000)]
    got = tokens.encoded_column(pa.array(said), path)
    assert all(ids.tobytes() == (coder.whole(x) if x else b"") + bytes(4) for x, ids in zip(said, got, strict=True))
    calls, model = [], coder.tokenize
    coder.tokenize = lambda text: calls.append(text) or model(text)
    names = [f"{'abcdefghij'[i // 10]}x{'abcdefghij'[i % 10]}" for i in range(100)]
    signed = " ".join(f"{x}{s}" for s in ("", ".", ",", "***", ".\nThen") for x in names)
    assert coder.encode("so " + signed) == coder.whole("so " + signed) and len(calls) < 110
