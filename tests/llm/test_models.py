"""The fitted models against plain Python versions, and the tiers and step groups of packing."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scopeloom.llm import langid, packing, toxicity
from scopeloom.llm.common import mix

MASK = (1 << 64) - 1


def plain_grams(text):
    """Bucket numbers of a text's n-grams, one by one."""
    signs = [48 if 48 <= ord(c) <= 57 else ord(c) for c in f" {text.lower()} "]
    for n in langid.ORDERS:
        for i in range(len(signs) - n + 1):
            key = 0
            for c in signs[i : i + n]:
                key = ((key << 21) & MASK) ^ c
            yield int(mix(np.array([(key + (n << 56)) & MASK], np.uint64))[0]) % langid.BUCKETS


def plain_posteriors(train, text):
    """Posterior of each label by naive Bayes with dictionaries."""
    fit = {}
    for label in sorted({x for _, x in train}):
        counts = Counter(g for t, x in train if x == label for g in plain_grams(t))
        total = sum(counts.values()) + 0.5 * langid.BUCKETS
        fit[label] = sum(math.log((counts[g] + 0.5) / total) for g in plain_grams(text)) / len(langid.ORDERS)
    top = max(fit.values())
    mass = {k: math.exp(v - top) for k, v in fit.items()}
    return {k: v / sum(mass.values()) for k, v in mass.items()}


def test_language_against_plain_bayes(spark):
    rng = random.Random(3)
    # three languages that share most of their syllables, so that few texts are certain
    parts = {"aa": "ta re on is çe 12", "bb": "ta re on is ła 7", "cc": "ta re on mu ła 30"}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang].split(), k=2)) for _ in range(n))
    train = [(make(lang, rng.randint(2, 12)), lang) for lang in parts for _ in range(20)]
    asked = [make(rng.choice(list(parts)), rng.randint(1, 4)) for _ in range(30)] + ["Ta RE 99", "東京 ta", "a"]
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id bigint, text string, lang string")
    model = langid.fit_language_model(labelled)
    assert model.labels == sorted(parts)
    out = langid.predict_language(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model).collect()
    unsure = 0
    for r in out:
        if not any(c.isalpha() for c in asked[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        want = plain_posteriors(train, asked[r.doc_id])
        assert r.lang_pred == max(want, key=want.get)
        assert r.score == pytest.approx(want[r.lang_pred], abs=1e-4)
        unsure += r.score < 0.9
    assert unsure > 5  # the scores say more than the labels


def test_toxicity_against_plain_odds(spark):
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(300):
        toxic = i % 3 == 0
        words = rng.choices(clean, k=rng.randint(5, 40))
        if toxic and i % 9:  # some toxic texts hold nothing that tells
            words[2:2] = rng.choices(["nasty", "vile", "crude"], k=3)
        if not toxic and i % 50 == 1:
            words.append("crude")
        texts[i] = (" ".join(words), int(toxic))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()] + [(998, None), (999, texts[0][0])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in texts.items()] + [(998, 1), (999, 0), (1000, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)

    train = list(texts.values())  # 999 repeats a text, and the higher label counts
    seen = {y: Counter(w for t, x in train if x == y for w in set(t.split())) for y in (0, 1)}
    n = {y: sum(c.values()) for y, c in seen.items()}
    want = {}
    for w in seen[0].keys() | seen[1].keys():
        y1, y0 = seen[1][w], seen[0][w]
        prior = toxicity.LEAST_PRIOR + toxicity.PRIOR * (y1 + y0) / (n[0] + n[1])
        score = math.log((y1 + prior) / (n[1] + toxicity.PRIOR - y1 - prior)) - math.log((y0 + prior) / (n[0] + toxicity.PRIOR - y0 - prior))
        if score / math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)) >= toxicity.MIN_Z:
            want[w.encode()] = score
    assert model.scores.keys() == want.keys() and {b"nasty", b"vile"} <= want.keys()
    assert all(model.scores[w] == pytest.approx(s) for w, s in want.items())

    share = {w: (seen[0][w.decode()] + 0.5) / (n[0] + 1) for w in want}
    rest = 1 - sum(share.values())
    drift = math.log((1 - sum(seen[1][w.decode()] for w in want) / n[1]) / rest)
    assert model.drift == pytest.approx(min(toxicity.DRIFT, drift))
    assert sum(share[w] * math.exp(model.lam * s) for w, s in want.items()) + rest * math.exp(model.lam * model.drift) == pytest.approx(1, abs=1e-6)

    # the weights are where the penalised likelihood is flat
    x = np.array([(1.0, *toxicity.features(toxicity.passages(t, model)[1])) for t, _ in train])
    y = np.array([v for _, v in train])
    size = {1: 102, 0: 201}  # labelled rows of each class, those without a text and repeats included
    weight = np.where(y == 1, size[1] / y.sum(), size[0] / (1 - y).sum())
    weight /= weight.mean()
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights))))
    assert np.abs(x.T @ (weight * (y - p)) - 1e-2 * np.array(model.weights)).max() < 1e-5


def piece(n):
    return np.arange(n, dtype=np.uint32)


def lengths(window):
    return [len(ids) for _, _, ids in window]


def test_gaps_are_filled_from_shorter_tiers():
    packer = packing.Packer(1024, 128)
    for i, n in enumerate((600, 300, 200, 100, 90)):
        assert list(packer.take((i, n), piece(n))) == []
    assert {t: [n for n, *_ in pool] for t, pool in packer.pools.items()} == {1024: [600], 512: [300], 256: [200], 128: [90, 100]}
    assert lengths(packer._fill(1024)) == [600, 300, 100, 24]  # the longest that fits first; where none does, one is cut
    assert [n for n, *_ in packer.pools[128]] == [66]
    assert list(map(lengths, packer.finish())) == [[200, 56], [8], [2]]  # 266 is 256 + 8 + 2


def test_tiers_are_packed_by_themselves():
    rng = random.Random(9)
    packer, windows, taken = packing.Packer(1024, 128, waiting=40), [], 0
    for i in range(1500):
        n = rng.choice((rng.randint(1, 60), rng.randint(100, 400), rng.randint(500, 3000)))
        taken += n
        windows += packer.take((i, n), piece(n))
    running = len(windows)
    windows += packer.finish()
    assert sum(map(sum, map(lengths, windows))) == taken
    kinds = Counter()
    for k, window in enumerate(windows):
        held = lengths(window)
        assert sum(held) & (sum(held) - 1) == 0 and sum(held) <= 1024
        if k < running:
            assert sum(held) in packer.tiers
            kinds[sum(held)] += 1
            # the first piece is of the window's own tier, all others are shorter than the room it leaves
            assert packer.tier_of(held[0]) == sum(held) or sum(held) == 128
            assert all(n <= sum(held) - held[0] for n in held[1:])
    assert len(kinds) > 1
    by_doc = defaultdict(list)
    for window in windows:
        for (i, n), start, ids in window:
            by_doc[i, n].append((start, ids))
    for (_, n), parts in by_doc.items():
        assert np.concatenate([ids for _, ids in sorted(parts, key=lambda x: x[0])]).tolist() == list(range(n))


def test_groups_are_balanced():
    rng = random.Random(2)
    costs = [rng.randint(1, 1000) ** 2 for _ in range(64)]
    groups = packing.deal(costs, 8)
    totals, sizes = Counter(), Counter(groups)
    for g, c in zip(groups, costs, strict=True):
        totals[g] += c
    in_order = [sum(costs[i : i + 8]) for i in range(0, 64, 8)]
    assert set(sizes.values()) == {8}
    assert max(totals.values()) - min(totals.values()) < (max(in_order) - min(in_order)) / 4
    assert packing.deal([], 8) == [] and len(set(packing.deal([5] * 9, 8))) == 2


def test_step_groups(docs):
    of_group, at = defaultdict(set), {}
    for p in packing.pack(docs, step_tokens=2048).collect():
        of_group[p.step_group].add((p.sequence_id, p.capacity))
        at.setdefault(p.sequence_id, set()).add(p.step_group)
    assert all(len(g) == 1 for g in at.values())  # a sequence is in one group
    for held in of_group.values():
        assert len({c for _, c in held}) == 1
        assert sum(c for _, c in held) <= 2048
    assert any(sum(c for _, c in held) == 2048 for held in of_group.values())
