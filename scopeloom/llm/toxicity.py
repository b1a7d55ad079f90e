"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and clean labelled documents under an informative Dirichlet prior (the
pooled word frequencies); words whose log-odds are significant score them, every other word scores a
small negative drift. A linear-time scan finds all maximal-scoring segments of a text: its toxic
passages. Their scores follow an extreme-value law on clean text, whose scale (lambda) comes from the
clean word distribution and whose location (ln K) from random texts of clean words. The
calibrated passages are summed up by a two-feature logistic fit into one score per document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import crc_bucket, sampled, stored, words

#: Labelled rows per class that the fit reads, the prior's weight and its least share of a word, the z-score
#: that makes a word significant, the drift of all other words, and the E-value of a significant passage.
ROWS_PER_CLASS, PRIOR, LEAST_PRIOR, MIN_Z, DRIFT, MAX_E = 8000, 500.0, 0.5, 3.5, -0.1, 0.05


@dataclass
class ToxicityModel:
    scores: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a word sequence, in order.

    ``hits`` are (position, positive score); every word between them scores ``drift``. Each open segment
    keeps the running sums at its two ends and a link to the nearest one on its left that starts lower;
    a hit joins the segments that it outgrows. Every link is followed once, so the scan is linear.
    """
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, link
    gained = 0.0
    for n, (at, score) in enumerate(hits):
        low = gained + drift * (at - n)
        gained += score
        high, start, j = low + score, at, len(held) - 1
        while j >= 0:
            if held[j][0] >= low:
                j = held[j][4]
            elif held[j][1] >= high:
                break
            else:  # the joined segment starts where held[j] does
                low, start, link = held[j][0], held[j][2], held[j][4]
                del held[j:]
                j = link
        held.append((low, high, start, at + 1, j))
    return [(a, b, high - low) for low, high, a, b, _ in held]


def passages(text: str | None, model: ToxicityModel) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of words, and (start, end, score, E-value) of each maximal-scoring segment."""
    found = words(text)
    score = model.scores.get
    hits = [(i, s) for i, w in enumerate(found) if (s := score(w)) is not None]
    if not hits:
        return len(found), []
    bits = math.log(len(found)) + model.log_k
    return len(found), [(a, b, s, math.exp(min(50.0, bits - model.lam * s))) for a, b, s in segments(hits, model.drift)]


def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """The best passage's calibrated strength, and the sum over significant passages, both squashed."""
    strength = [-math.log(max(e, 1e-300)) for *_, e in found]
    best = max(strength, default=-5.0)
    total = sum(x for x, (*_, e) in zip(strength, found, strict=True) if e <= MAX_E)
    return max(-5.0, min(best, 40.0)) / 5, math.log1p(total)


def probability(found: list[tuple[int, int, float, float]], model: ToxicityModel) -> float:
    a, b = features(found)
    w = model.weights
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b))))


def _lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; the mean score must be negative."""
    lo, hi = 1e-6, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if float((share * scores).sum()) >= 0:
        return 1e-3
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def _location(model: ToxicityModel, share: np.ndarray, texts: int = 400, hits: int = 40) -> float:
    """Location (ln K) of the extreme-value law of best segments in random clean words.

    Words are drawn with the clean shares, in texts so long that each has about ``hits`` of the vocabulary's; a
    Gumbel law with location ln K has the mean ln K + 0.5772.
    """
    rng = np.random.default_rng(1)
    rate, scores = float(share.sum()), np.array(list(model.scores.values()))
    best = []
    for _ in range(texts):
        n = max(1, int(hits / rate))
        at = np.cumsum(rng.geometric(min(1.0, rate), 2 * hits))
        at = at[at <= n]
        drawn = rng.choice(scores, len(at), p=share / share.sum())
        found = segments(list(zip((at - 1).tolist(), drawn.tolist(), strict=True)), model.drift)
        if found:
            best.append(model.lam * max(s for *_, s in found) - math.log(n))
    return float(np.mean(best) - 0.5772) if best else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps for a weighted logistic fit with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, min_z: float = MIN_Z) -> ToxicityModel:
    """Fit on about ``rows_per_class`` labelled rows of each class at most.

    ``labels`` (doc_id, toxic 0/1) and ``docs`` (doc_id, text) meet by a broadcast of the sampled label
    rows, whose number is bounded by the parameter. Without labels of both classes the model knows no
    word and calls every text clean.
    """
    rows = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = sampled(rows, "doc_id", "toxic", rows_per_class, "toxicity").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = stored(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[toxic].update(set(words(text)))
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([sums[1][w] for w in names], pa.int64()), pa.array([sums[0][w] for w in names], pa.int64())], ["word", "toxic", "clean"])

    counts = stored(train.mapInArrow(count, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n_toxic, n_clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n_toxic or not n_clean:
        return ToxicityModel()
    # words count once a document, so that a text that repeats one does not speak for the others
    prior = F.lit(LEAST_PRIOR) + (F.col("toxic") + F.col("clean")) * F.lit(PRIOR / (n_toxic + n_clean))
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y - prior))
    scored = counts.withColumn("score", odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean)).withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    vocabulary = scored.where(F.col("z") >= min_z).orderBy(F.desc("z"), "word").collect()  # no more words than the sample has
    model = ToxicityModel({bytes(r["word"]): float(r["score"]) for r in vocabulary})
    if not vocabulary:
        return model
    share = np.array([(r["clean"] + 0.5) / (n_clean + 1) for r in vocabulary])
    rest = max(1e-9, 1 - share.sum())
    model.drift = min(DRIFT, math.log(max(1e-9, 1 - sum(r["toxic"] for r in vocabulary) / n_toxic) / rest))
    model.lam = _lambda(np.r_[[r["score"] for r in vocabulary], model.drift], np.r_[share, rest])
    draft = model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strength = [[-math.log(max(e, 1e-300)) for *_, e in passages(t, draft)[1]] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(strength, pa.list_(pa.float64()))], ["toxic", "strength"])

    seen = train.mapInArrow(measure, "toxic int, strength array<double>").collect()  # bounded by the sample
    model.log_k = _location(model, share)
    x = np.array([features([(0, 0, 0.0, math.exp(min(50.0, model.log_k - s))) for s in r["strength"]]) for r in seen])
    y = np.array([r["toxic"] for r in seen], float)
    weight = np.where(y == 1, sizes.get(1, 1) / max(1.0, y.sum()), sizes.get(0, 1) / max(1.0, (1 - y).sum()))
    model.weights = tuple(_logistic(x, y, weight / weight.mean()))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1) and ``passages`` with E-values of at most ``MAX_E``.

    Null and empty texts get the score of a text without toxic words. Starts and ends count words.
    Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, kept = [], []
            for i in range(batch.num_rows):
                _, found = passages(batch.column(1)[i].as_py(), m)
                scores.append(probability(found, m))
                kept.append([{"start": a, "end": b, "score": s, "e_value": e} for a, b, s, e in found if e <= MAX_E])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(kept, pa.list_(passage))], ["id", "score", "passages"])

    schema = f"id {kind}, score double, passages array<struct<start:bigint,end:bigint,score:double,e_value:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with all their columns; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            clean = [probability(passages(x.as_py(), m)[1], m) < limit for x in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the folds that are not held out."""
    return fit_toxicity(docs, labels.where(crc_bucket("doc_id", 5) != 0))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    scored = score_toxicity(docs, toxicity_model(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
