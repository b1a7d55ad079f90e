"""Ranked lexical search with Block-Max MaxScore over an inverted index that is partitioned by document.

Each task cuts its documents into segments and a segment into blocks of ``BLOCK`` documents. A term's postings in one
block are packed by themselves, next to the pairs (tf, document length) that no other posting of the block beats in
both; from these the block's largest score follows exactly once the corpus statistics are known. So the index is
written in one pass over the texts and shuffles nothing but document frequencies.

A search keeps, for every item, the 50 best so far and their last score, the bar. Terms are ordered by their largest
score in the segment: those that cannot pass the bar even together are non-essential, and only documents of an essential
term are candidates. Blocks are visited from the highest bound on; a candidate whose score so far, with the block maxima
of the non-essential terms still unread, stays below the bar goes before those postings are unpacked. A first share of
the segments is searched alone and gives all others their bars, since the 50th best of some documents is never above
the 50th best of all. Every task hands on its heaps, which are merged by a window with a limit per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeloom.llm.common import stored, words

#: Documents of a block and of a segment, bytes of text of a segment, bytes of items that one broadcast holds.
BLOCK, SEGMENT_DOCS, SEGMENT_BYTES, CHUNK_BYTES = 512, 4096, 8 << 20, 4 << 20
#: Documents returned per item, and one in so many segments searched first.
TOP, FIRST_SHARE = 50, 16
#: Payloads shorter than this stay as they are.
SMALL = 64
_DIRECTORY = ("lengths", "block_term", "block_no", "block_size", "sky_start", "sky_tf", "sky_length", "payload_start", "payload")


# ---- index -------------------------------------------------------------------------------------------------------


def pack(offsets: np.ndarray, tf: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """Postings of one term in one block: gaps of two bytes, then frequencies of one or four, or none if all are 1."""
    width = 0 if tf.max() == 1 else 1 if tf.max() < 256 else 4
    raw = np.diff(offsets, prepend=0).astype("<u2").tobytes() + (b"" if not width else tf.astype(f"<u{width}").tobytes())
    small = packer.compress(raw) if len(raw) >= SMALL else raw
    return bytes([width]) + (b"\1" + small if len(small) < len(raw) else b"\0" + raw)


def unpack(payload: memoryview, n: int, reader: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    width, raw = payload[0], bytes(payload[2:])
    if payload[1]:
        raw = reader.decompress(raw, max_output_size=n * (2 + width))
    offsets = np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.int64)
    return offsets, np.frombuffer(raw, f"<u{width}", n, 2 * n).astype(np.int64) if width else np.ones(n, np.int64)


def build_segment(ids: list, terms_of: list[tuple[np.ndarray, np.ndarray]], lengths: list[int], names: list[bytes]) -> dict:
    """One row of the index. ``terms_of``: per document its asked terms by number, and their frequencies."""
    doc = np.repeat(np.arange(len(ids)), [len(t) for t, _ in terms_of])
    term = np.concatenate([t for t, _ in terms_of]) if len(doc) else np.zeros(0, np.int64)
    tf = np.concatenate([f for _, f in terms_of]) if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    length = np.asarray(lengths, np.int64)
    held, term = np.unique(term, return_inverse=True)
    n_blocks = len(ids) // BLOCK + 1
    group = term * n_blocks + doc // BLOCK
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(group))[: len(starts)]
    number = np.repeat(np.arange(len(starts)), ends - starts)
    # a posting is kept in the skyline when it is shorter than all of its block with at least its frequency
    order = np.lexsort((length[doc], -tf, number))
    level = length[doc][order] - number[order] * (int(length.max(initial=0)) + 1)
    lowest = np.minimum.accumulate(level) if len(level) else level
    sky = order[np.flatnonzero(np.append(True, level[1:] < lowest[:-1]))] if len(level) else order
    packer, parts = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(pack(doc[a:b] % BLOCK, tf[a:b], packer))
    arrays = (length, term[starts], doc[starts] // BLOCK, ends - starts, np.searchsorted(number[sky], np.arange(len(starts) + 1)), tf[sky], length[doc[sky]], np.cumsum([0, *map(len, parts)]))
    row = {"ids": ids, "documents": int((length > 0).sum()), "total": int(length.sum()), "terms": [names[t] for t in held.tolist()], "df": np.bincount(term, minlength=len(held)).tolist()}
    return row | {k: a.astype("<i8").tobytes() for k, a in zip(_DIRECTORY, arrays, strict=False)} | {"payload": b"".join(parts)}


def build_index(docs: DataFrame, asked: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of ``docs`` for the terms ``asked``: ids, statistics, block directory and packed postings.

    Every row is a document of its own, also where ids repeat; null and empty texts have no terms.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    form = f"ids array<{kind}>, documents bigint, total bigint, terms array<binary>, df array<bigint>, " + ", ".join(f"{k} binary" for k in _DIRECTORY)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        get = {t: k for k, t in enumerate(names)}.get
        ids, terms, lengths, size, id_type = [], [], [], 0, None

        def row() -> pa.RecordBatch:
            made = build_segment(ids, terms, lengths, names)
            kinds = [pa.list_(id_type), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())] + [pa.binary()] * len(_DIRECTORY)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made.values(), kinds, strict=True)], list(made))

        for batch in batches:
            id_type = batch.column(0).type
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = words(text)
                numbers = np.fromiter((k for k in map(get, found) if k is not None), np.int64)
                ids.append(batch.column(0)[i].as_py())
                terms.append(np.unique(numbers, return_counts=True))
                lengths.append(len(found))
                size += len(text or "")
                if len(ids) == SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield row()
                    ids, terms, lengths, size = [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(build, form)


# ---- search ------------------------------------------------------------------------------------------------------


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document length; whole numbers also where 64 bits are too few for the product."""
    if len(lengths) and 50 * int(lengths.max()) * n >= 1 << 63:
        return np.array([50 + 50 * x * n // total for x in lengths.tolist()], np.int64)
    return 50 + 50 * lengths * n // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Heap:
    """The best documents of one item: highest score first, then the smallest id (null last)."""

    def __init__(self, bar: int, top: int):
        self.held: list[tuple] = []
        self.bar, self.top, self.full = bar, top, False

    def add(self, ids: list, scores: list[int]) -> None:
        self.held += [((-s, i is None, i), s) for s, i in zip(scores, ids, strict=True)]
        self.held = sorted(self.held, key=lambda x: x[0][:2] + ((x[0][2],) if x[0][2] is not None else ()))[: self.top]
        if len(self.held) == self.top:
            self.bar = max(self.bar, self.held[-1][1])


class Segment:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, number: dict[bytes, int], n: int, total: int):
        a = {k: np.frombuffer(row[k], "<i8") for k in _DIRECTORY[:-1]}
        self.ids, self.payload, self.at, self.size = row["ids"], memoryview(row["payload"]), a["payload_start"], a["block_size"]
        self.norms = norms(a["lengths"], n, total)
        self.blocks = len(self.ids) // BLOCK + 1
        own = [number.get(t) for t in row["terms"]]
        self.place = {t: k for k, t in enumerate(own) if t is not None}
        # largest impact and position in the directory of each (term, block)
        best = impacts(a["sky_tf"], norms(a["sky_length"], n, total))
        self.most = np.zeros((len(own), self.blocks), np.int64)
        self.entry = np.full((len(own), self.blocks), -1, np.int64)
        if len(best):
            self.most[a["block_term"], a["block_no"]] = np.maximum.reduceat(best, a["sky_start"][:-1])
            self.entry[a["block_term"], a["block_no"]] = np.arange(len(a["block_term"]))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.reader, self.unpacked, self.skipped = zstandard.ZstdDecompressor(), 0, 0

    def postings(self, entry: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that hold the term, and the term's impact there; kept while the segment is searched."""
        if entry not in self.open:
            offsets, tf = unpack(self.payload[self.at[entry] : self.at[entry + 1]], int(self.size[entry]), self.reader)
            self.open[entry] = offsets, impacts(tf, self.norms[block * BLOCK + offsets])
            self.unpacked += 1
        return self.open[entry]

    def search(self, terms: list[tuple[int, int]], heap: Heap) -> None:
        """``terms``: (number, weight). Adds to the heap what may be among its best."""
        mine = [(self.place[t], w) for t, w in terms if t in self.place and w > 0]
        if not mine:
            return
        rows, weights = np.array([p for p, _ in mine]), np.array([w for _, w in mine], np.int64)
        most = self.most[rows] * weights[:, None]
        order = np.argsort(most.max(1), kind="stable")
        rows, weights, most = rows[order], weights[order], most[order]
        ceiling, bound = np.cumsum(most.max(1)), most.sum(0)
        for block in np.argsort(-bound, kind="stable").tolist():
            bar = max(heap.bar, 1)
            if bound[block] < bar:
                break
            first = int(np.searchsorted(ceiling, bar))  # the terms before it cannot reach the bar together
            score, entries, high = np.zeros(BLOCK, np.int64), self.entry[rows, block], most[:, block]
            seen = np.zeros(BLOCK, bool)
            for k in range(first, len(rows)):
                if entries[k] >= 0:
                    at, impact = self.postings(int(entries[k]), block)
                    score[at] += weights[k] * impact
                    seen[at] = True
            left = int(high[:first].sum())
            for k in range(first - 1, -1, -1):
                if entries[k] < 0:
                    continue
                seen &= score + left >= bar
                if not seen.any():
                    self.skipped += int((entries[: k + 1] >= 0).sum())
                    break
                at, impact = self.postings(int(entries[k]), block)
                score[at] += weights[k] * impact
                left -= int(high[k])
            found = np.flatnonzero(seen & (score >= bar))
            if len(found) > heap.top:  # ties with the last are kept for the ids to settle
                found = found[score[found] >= np.partition(score[found], -heap.top)[-heap.top]]
            if len(found):
                heap.add([self.ids[block * BLOCK + x] for x in found.tolist()], score[found].tolist())


def search_index(index: DataFrame, items: list[tuple[int, list[tuple[int, int]]]], number: dict[bytes, int], n: int, total: int, bars: list[int], top: int = TOP) -> DataFrame:
    """Heaps of all tasks: item (place in ``items``), doc, score."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((items, number, bars))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, numbers, least = shared.value
        heaps, id_type = [Heap(b, top) for b in least], None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], numbers, n, total)
                for heap, (_, terms) in zip(heaps, asked, strict=True):
                    segment.search(terms, heap)
        if id_type is not None:
            out = [(k, key[2], s) for k, heap in enumerate(heaps) for key, s in heap.held]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], id_type), pa.array([x[2] for x in out], pa.int64())], ["item", "doc", "score"])

    return index.select("ids", "terms", *_DIRECTORY).mapInArrow(search, f"item bigint, doc {kind}, score bigint")


def _ranked(heaps: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: item id, rank, document id, score.

    Terms are runs of digits, letters and signs beyond ASCII, A-Z lower-cased; null texts have none. Rows of ``items``
    that share an id, null among them, are one item with the terms of all. Every row of ``docs`` is a document; equal
    scores go by ascending id, null last. No documents, or no items with terms, give no rows. The size of the items is
    measured; ``chunk_bytes`` of them go out in one broadcast, more in as many passes as needed.
    """
    kind, id_kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    texts = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, out = max(1, -(-size // chunk_bytes)), []
    for c in range(chunks):
        asked: dict = {}
        for r in (texts if chunks == 1 else texts.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c)).orderBy("item", "text").toLocalIterator():
            asked.setdefault(r["item"], set()).update(words(r["text"]))
        number = {t: k for k, t in enumerate(sorted(set().union(*asked.values())))}
        if not number:
            continue
        index = stored(build_index(docs, list(number), id_col, text_col))
        n, total = index.agg(F.sum("documents"), F.sum("total")).first()
        if not total:
            continue
        df = {bytes(r[0]): r[1] for r in index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df")).collect()}
        weights = {number[t]: weight(n, k) for t, k in df.items()}
        order = list(asked)
        wanted = [(k, sorted((number[t], weights[number[t]]) for t in asked[item] if number[t] in weights)) for k, item in enumerate(order)]
        first = F.pmod(F.xxhash64("payload", "lengths"), F.lit(FIRST_SHARE)) == 0
        early = stored(_ranked(search_index(index.where(first), wanted, number, n, total, [0] * len(order), top), top).drop("rank"))
        bars = {r[0]: r[1] for r in early.groupBy("item").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") >= top).collect()}
        rest = search_index(index.where(~first), wanted, number, n, total, [bars.get(k, 0) for k in range(len(order))], top)
        names = spark.createDataFrame(list(enumerate(order)), f"item bigint, {item_col} {kind}")
        out.append(_ranked(early.unionByName(rest), top).join(F.broadcast(names), "item").select(item_col, "rank", F.col("doc").alias(id_col), "score"))
    if not out:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} {id_kind}, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_SQL_TERMS} AS w FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
asked AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT row_id, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf
       FROM (SELECT row_id, doc_id, w, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, stats GROUP BY term),
scores AS (SELECT item_id, doc_id, row_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term), stats GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
