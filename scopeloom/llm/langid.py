"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, one row per label and one column per hash bucket, fitted on
a bounded sample of labelled rows and broadcast (its size is labels x buckets, whatever the input).
Texts are scored in blocks: all n-grams of a block become bucket numbers in one numpy pass, and each
label's log-probabilities are gathered and summed by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import crc_bucket, mix, sampled

#: Hash buckets of the model at most, cells of its matrix, orders of the n-grams, labelled rows per language.
BUCKETS, CELLS, ORDERS, ROWS_PER_LABEL = 1 << 16, 1 << 24, (1, 2, 3), 2000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 18


@dataclass
class LanguageModel:
    labels: list[str]
    log_prob: np.ndarray  # (labels, buckets)
    log_prior: np.ndarray


def buckets_for(labels: int) -> int:
    """Buckets per label, a power of two, so that the matrix keeps its size however many labels there are."""
    return max(1 << 8, min(BUCKETS, 1 << (CELLS // max(1, labels)).bit_length() - 1))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between blanks, with digits as one sign; and the starts."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
    starts = np.cumsum([0] + [len(t) for t in padded])
    return codes, starts


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket numbers of all n-grams, and where each text's n-grams start (n + 1 values)."""
    codes, starts = _codes(texts)
    for n in ORDERS:
        if len(codes) < n:
            continue
        key = codes[: len(codes) - n + 1].copy()
        for i in range(1, n):
            key = (key << np.uint64(21)) ^ codes[i : len(codes) - n + 1 + i]
        bucket = (mix(key + np.uint64(n << 56)) & np.uint64(buckets - 1)).astype(np.int32)
        # n-grams that reach into the next text hold its opening blank twice; they are left out
        inside = np.ones(len(key), bool)
        for i in range(1, n):
            at = starts[1:] - i
            inside[at[(at >= 0) & (at < len(key))]] = False
        kept = np.concatenate([[0], np.cumsum(inside)])
        yield bucket[inside], kept[np.minimum(starts, len(key))]


def _cut(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > _BLOCK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_label: int = ROWS_PER_LABEL, smoothing: float = 0.5) -> LanguageModel:
    """Fit on about ``rows_per_label`` rows of each label at most (``sampled``); null labels are left out.

    Counts are summed by Spark; the driver receives one row of counts per label. Beyond ``CELLS / BUCKETS`` labels each
    has fewer buckets, so the model keeps its size. An empty table gives a model without labels, which calls every text
    unknown.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sample = sampled(rows.where(F.col("label").isNotNull() & F.col("text").isNotNull()), "id", "label", rows_per_label, "language")

    buckets = buckets_for(rows.where(F.col("label").isNotNull()).agg(F.count_distinct("label")).first()[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == label]
                total = sums.setdefault(label, np.zeros(buckets, np.int64))
                docs[label] = docs.get(label, 0) + len(own)
                for lo, hi in _cut(own):
                    for bucket, _ in ngram_buckets(own[lo:hi], buckets):
                        total += np.bincount(bucket, minlength=buckets)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[x] for x in names], pa.int64()), pa.array([sums[x].tobytes() for x in names], pa.binary())], ["label", "docs", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "docs": [int(pdf["docs"].sum())], "counts": [total.tobytes()]})

    schema = "label string, docs bigint, counts binary"
    parts = sample.select("label", "text").repartition(8).mapInArrow(count, schema)
    found = parts.groupBy("label").applyInPandas(add, schema).orderBy("label").collect()
    if not found:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in found], np.float64) + smoothing
    # a flat prior: the sample is balanced by design, and languages of a corpus drift
    return LanguageModel([r["label"] for r in found], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), np.zeros(len(found)))


def score_texts(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Log-likelihoods, (texts, labels), summed over all n-grams of all orders."""
    out = np.zeros((len(texts), len(model.labels)))
    for lo, hi in _cut(texts):
        for bucket, starts in ngram_buckets(texts[lo:hi], model.log_prob.shape[1]):
            some = np.flatnonzero(starts[1:] > starts[:-1])
            if len(some):
                for k in range(len(model.labels)):
                    out[lo + some, k] += np.add.reduceat(model.log_prob[k][bucket], starts[some], dtype=np.float64)
    return out


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``, the label's posterior probability.

    Null texts, texts without a letter, and any text under a model without labels get ``und`` and 0.
    Equal posteriors take the first label in order. The likelihood is divided by the number of orders,
    as n-grams of several orders count the same characters. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if m.labels and has_letter(t)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                fit = score_texts(m, [texts[i] for i in known]) / len(ORDERS) + m.log_prior
                best = fit.argmax(1)
                share = 1 / np.exp(fit - fit.max(1, keepdims=True)).sum(1)
                for i, k, s in zip(known, best, share, strict=True):
                    names[i], scores[i] = m.labels[k], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(apply, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on the folds that are not held out, predict all rows."""
    model = fit_language_model(docs.where(crc_bucket("doc_id", 4) != 2))
    return predict_language(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
