"""Benchmark decontamination with positional inverted indexes.

The index of the training text is partitioned by document: each task stores, for every block of
documents, the positions of the benchmark's terms, and each benchmark window intersects its terms'
offset-adjusted position lists, from the rarest term of the block on. So only positions of words that
the benchmark has are ever stored, nothing is shuffled, and no word or passage is hot. Benchmarks are
broadcast in chunks of bounded size; a larger benchmark takes several passes, each of which adds its hits
to the rows that the last one wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import runs, stored, utf8, words

#: Words of a window, bytes of benchmark text per pass, and how far terms of a proximity match may stray.
WINDOW, CHUNK_BYTES, SLOP = 10, 4 << 20, 3


@dataclass
class Windows:
    """Distinct windows of one chunk: terms by number (0 pads short ones), the items that hold each."""

    number: dict[bytes, int]
    terms: np.ndarray  # (windows, size)
    length: np.ndarray
    items: list[list]
    anchors: np.ndarray  # (windows, 3): slots of the three longest terms, whatever else the chunk holds


def build_windows(rows: list[tuple], size: int = WINDOW) -> Windows:
    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], list] = {}
    for item, text in rows:
        ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            held = owners.setdefault(tuple(ids[i : i + size]), [])
            if not held or held[-1] != item:
                held.append(item)
    terms = np.zeros((len(owners), size), np.int64)
    for k, w in enumerate(owners):
        terms[k, : len(w)] = w
    length = np.array([len(w) for w in owners], np.int64)
    place = np.zeros(len(number) + 1, np.int64)
    place[[number[w] for w in sorted(number, key=lambda w: (-len(w), w))]] = np.arange(len(number))
    rare = np.where(terms > 0, place[terms], np.iinfo(np.int64).max)
    return Windows(number, terms, length, list(owners.values()), np.argsort(rare, axis=1, kind="stable")[:, :3])


class BlockIndex:
    """Positions of each benchmark term in a block of documents; a gap stands between documents."""

    def __init__(self, docs: list[list[int]], n_terms: int):
        starts, at = [], 0
        for d in docs:
            starts.append(at)
            at += len(d) + 1
        self.starts = np.array([*starts, at], np.int64)
        flat = np.zeros(at, np.int64)
        for s, d in zip(starts, docs, strict=True):
            flat[s : s + len(d)] = d
        held = np.flatnonzero(flat)
        order = held[np.argsort(flat[held], kind="stable")]
        self.counts = np.bincount(flat[held], minlength=n_terms + 1)
        self.order, self.first = order, np.concatenate([[0], np.cumsum(self.counts)])

    def postings(self, term: int) -> np.ndarray:
        return self.order[self.first[term] : self.first[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of all exact occurrences: lists minus their offsets, intersected from the rarest."""
        slots = sorted(range(len(terms)), key=lambda j: self.counts[terms[j]])
        found = self.postings(terms[slots[0]]) - slots[0]
        for j in slots[1:]:
            if not len(found):
                break
            other = self.postings(terms[j]) - j
            at = np.minimum(np.searchsorted(other, found), len(other) - 1)
            found = found[other[at] == found]
        return found

    def near(self, terms: np.ndarray, slots: np.ndarray, slop: int) -> np.ndarray:
        """Starts around which all terms stand within ``slop`` words of their places in one document; ``slots`` are looked up first."""
        first = int(slots[0])
        found = self.postings(terms[first]) - first
        doc = np.searchsorted(self.starts, found + first, "right") - 1
        for j in [*slots[1:].tolist(), *(k for k in range(len(terms)) if k not in slots)]:
            other = self.postings(terms[j])
            if not len(other) or not len(found):
                return found[:0]
            low, high = np.maximum(found + j - slop, self.starts[doc]), np.minimum(found + j + slop, self.starts[doc + 1] - 2)
            held = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            found, doc = found[held], doc[held]
        return found


def match_block(index: BlockIndex, w: Windows, slop: int) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set], dict[int, dict]]:
    """By document of the block: hit intervals in words, items, and by item the intervals of windows that only match nearby."""
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set] = {}
    nearby: dict[int, dict] = {}
    if not len(w.terms):
        return hits, items, nearby
    rare = np.take_along_axis(w.terms, w.anchors, 1)
    some = np.flatnonzero(np.where(rare > 0, index.counts[rare] > 0, True).all(1))
    for k in some[((index.counts[w.terms[some]] > 0) | (w.terms[some] == 0)).all(1)].tolist():
        size = int(w.length[k])
        terms = w.terms[k, :size]
        exact = index.phrase(terms)
        doc = np.searchsorted(index.starts, exact, "right") - 1
        for d, s in zip(doc.tolist(), (exact - index.starts[doc]).tolist(), strict=True):
            hits.setdefault(d, []).append((s, s + size))
            items.setdefault(d, set()).update(w.items[k])
        if size < 3:
            continue
        slots = w.anchors[k]
        loose = index.near(terms, slots, slop)
        doc = np.searchsorted(index.starts, loose + int(slots[0]), "right") - 1
        own = set(exact.tolist())
        for d, s in zip(doc.tolist(), loose.tolist(), strict=True):
            if any(x in own for x in range(s - slop, s + slop + 1)):
                continue
            begin = max(0, s - int(index.starts[d]))
            end = min(s + size, int(index.starts[d + 1]) - 1) - int(index.starts[d])
            for item in w.items[k]:
                nearby.setdefault(d, {}).setdefault(item, []).append((begin, end))
    return hits, items, nearby


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = "array<struct<start:bigint,end:bigint>>"


def find_windows(rows: DataFrame, windows: Windows, item_type: str, keep_text: bool = False, slop: int = SLOP) -> DataFrame:
    """One pass over rows (id, text, and after a first pass its other columns): adds to n_words, spans, items and near.

    ``spans`` are merged hits, ``items`` those with exact hits, ``near`` the places (item, start, end) of items that
    stand there with some words moved.
    """
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    item_arrow = pa.string() if item_type == "string" else pa.int64()
    place = pa.struct([("item", item_arrow), ("start", pa.int64()), ("end", pa.int64())])
    again = "spans" in rows.columns

    names = ["id", "text", "n_words", "spans", "items", "near"] if keep_text else ["id", "n_words", "spans", "items", "near"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        get = w.number.get
        for batch in batches:
            column = batch.column(1)
            offsets, _ = utf8(column)
            n_words, spans, items, near = [], [], [], []
            held = [batch.column(c).to_pylist() for c in (3, 4, 5)] if again else None
            for lo, hi in runs(offsets):
                found = [[get(x, 0) for x in words(t)] for t in column.slice(lo, hi - lo).to_pylist()]
                hit, own, close = match_block(BlockIndex(found, len(w.number)), w, slop)
                for i, d in enumerate(found):
                    before = [x[lo + i] for x in held] if again else ([], [], [])
                    n_words.append(len(d))
                    spans.append([{"start": a, "end": b} for a, b in _merged(hit.get(i, []) + [(x["start"], x["end"]) for x in before[0]])])
                    items.append(sorted(own.get(i, set()) | set(before[1])))
                    places = {x: list(at) for x, at in close.get(i, {}).items()}
                    for x in before[2]:
                        places.setdefault(x["item"], []).append((x["start"], x["end"]))
                    near.append([{"item": x, "start": a, "end": b} for x in sorted(places) for a, b in _merged(places[x])])
            columns = [batch.column(0), column, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(item_arrow)), pa.array(near, pa.list_(place))]
            yield pa.RecordBatch.from_arrays(columns if keep_text else [columns[0], *columns[2:]], names)

    kinds = {"id": kind, "text": "string", "n_words": "bigint", "spans": SPAN, "items": f"array<{item_type}>", "near": f"array<struct<item:{item_type},start:bigint,end:bigint>>"}
    return rows.mapInArrow(apply, ", ".join(f"{n} {kinds[n]}" for n in names))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: id, n_words, ``spans`` of hit words, ``items`` found, ``near`` places (item, start, end).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words, on either side; items may repeat, and so may ids. The benchmark's
    size is measured: ``chunk_bytes`` of text go out in one broadcast, more in as many passes as needed over rows
    that are written in between. A place is near where every word of a window stands in one document, each within
    ``SLOP`` words of where the window would have it, and no exact hit of that window does.
    """
    item_type = "string" if benchmark.schema[item_col].dataType.simpleString() == "string" else "bigint"
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast(item_type).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for c in range(chunks):
        own = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == c)
        held = [(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()]
        rows = find_windows(rows if c == 0 else stored(rows), build_windows(held, window), item_type, c < chunks - 1)
    return rows.withColumnRenamed("id", id_col)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_TEN = "string_agg(t, ' ') OVER ten AS s, count(*) OVER ten AS n"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, t, i, {_SQL_TEN} FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d)
       WINDOW ten AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
bw AS (SELECT DISTINCT item_id, n, s, w1 FROM (
         SELECT item_id, i, len(w) AS size, w[1] AS w1, {_SQL_TEN}
         FROM (SELECT item_id, w, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM b)
         WINDOW ten AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10 OR i = 1 AND size < 10),
hits AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw USING (s) WHERE bw.n = 10
         UNION SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON bw.n < 10 AND t = w1 AND starts_with(dw.s || ' ', bw.s || ' ')),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
