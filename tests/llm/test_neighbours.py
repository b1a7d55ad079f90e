"""Nearest neighbours against brute force: exact scores, order, and recall over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopeloom.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", 0) for i, v in rows], SCHEMA).repartition(5)


def usable(rows):
    held = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in held]
    usual = min(sizes, key=lambda n: (-sizes.count(n), n), default=0)
    return [(i, np.float32(v).astype(float)) for i, v in held if len(v) == usual]


def brute(rows, query_ids, top=10):
    held, out = usable(rows), {}
    for own, q in held:
        if own in query_ids:
            near = out.setdefault(own, {})
            for i, v in held:
                if i != own:
                    d = float(np.sqrt(((v - q) ** 2).sum()))
                    near[i] = min(d, near.get(i, d))
    return {q: sorted((d, i) for i, d in near.items())[:top] for q, near in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def rows():
    """Loose clusters, a vector that a third of the rows share, close copies, and rows that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    x = centres[rng.integers(0, 6, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    x[200:700] = x[100]
    x[700:720] = x[0] + 0.01 * rng.normal(size=(20, 24))
    out = [(int(i), v.tolist()) for i, v in enumerate(x)]
    out += [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] + [1.0] * 23), (2300, [float("inf")] * 24), (2400, [None] + [1.0] * 23), (2500, [1.0, 2.0]), (None, x[5].tolist()), (2600, [])]
    return [*out, out[0], out[300], (1, x[900].tolist())]


def test_recall_and_exact_scores(spark, rows):
    df = frame(spark, rows)
    want = brute(rows, set(range(0, 3000, 100)))
    got = found(N.neighbour_report(df))
    assert set(got) <= set(want) and recall(got, want) >= 0.9
    by = dict(usable(rows))
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 10 and q not in [i for _, i in near]
        for d, i in near:
            options = [v for k, v in usable(rows) if k == i]
            assert any(abs(d - math.sqrt(((v - by[q]) ** 2).sum())) < 1e-12 for v in options)
    # ties at distance 0 go to the smallest ids of the shared vector
    assert [i for _, i in got[400]] == [i for _, i in want[400]] == [100, *range(200, 209)]


def test_crowded_buckets_and_small_shards(spark, rows):
    """Many shards cut the crowded buckets; with all buckets visited the answer is brute force's."""
    df = frame(spark, rows)
    got = found(N.nearest(df, df.where(F.col("vec_id") % 100 == 0), success=1 - 1e-12, shard_rows=40))
    want = brute(rows, set(range(0, 3000, 100)))
    assert recall(got, want) >= 0.99


def test_few_rows(spark):
    few = [(0, [1.0, 0.0]), (100, [1.0, 0.1]), (3, [0.0, 1.0])]
    got = found(N.neighbour_report(frame(spark, few)))
    assert set(got) == {0, 100} and all(len(x) == 2 for x in got.values())
    assert N.neighbour_report(frame(spark, few[:1])).count() == 0
    assert N.neighbour_report(frame(spark, [])).count() == 0
    assert N.neighbour_report(frame(spark, [(0, None), (100, [0.0])])).count() == 0


def test_probes_come_in_success_order():
    rng = np.random.default_rng(2)
    model = N.fit(rng.normal(size=(500, 16)))
    p = model.project(rng.normal(size=(1, 16)))[0]
    few, many = N.probes(model, p, 0, 0.5), N.probes(model, p, 0, 0.9)
    assert len(few) < len(many) and len(set(many.tolist())) == len(many)
    home = N._number((model.cells(p)[: N.HASHES] - model.low[: N.HASHES].astype(int))[None])[0]
    assert few[0] == many[0] == home
    kept = [k for k in many.tolist() if k in set(few.tolist())]
    assert kept == few.tolist()


def test_clean_vectors_keep_the_usual_length(spark, rows):
    assert N.vectors(frame(spark, rows), "vec_id", "embedding").count() == len(usable(rows))
