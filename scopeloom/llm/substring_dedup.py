"""Repeated substrings across documents with a sparse, range-partitioned suffix array.

A byte is removed when a ``WINDOW``-byte string that covers it also starts in an earlier document. Not all
suffixes are sorted: of every window's ``GRAM``-byte grams the one with the least hash is its anchor, so
equal windows have equal anchors at equal places, and about one suffix in 15 is an anchor. Windows are
judged through their anchors:

1. Splitters are sampled from the anchors' leading bytes; they cut the suffixes into ranges (buckets).
2. Every task sends the fingerprints of its anchors' leading bytes to their buckets, packed; buckets
   answer which of them occur in two or more documents. Most do not and are never sent again.
3. The anchors left are sent to their buckets with the bytes around them. A task first settles equal
   contexts among its own documents, so a passage with any number of copies arrives once per task.
4. Buckets sort the suffixes by multikey quicksort; suffixes that agree in their leading bytes lie side by
   side, and each window's smallest document is found among them. Equal windows meet in one bucket, as
   their anchors do, so no run crosses a boundary.
5. The windows found go back to their documents, whose bytes are cut.

Texts travel compressed, by a hash of the document's id, and are read one packed block at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeloom.llm import packed
from scopeloom.llm.common import BLOCK_BYTES, mix, runs, shuffle_partitions, utf8
from scopeloom.llm.packed import Spans, freeze, thaw

#: Bytes of a repeated string and of an anchor's gram; grams of a window; bytes of context on each side.
WINDOW, GRAM = 50, 20
PLACES = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
CONTEXT = 2 * SIDE + GRAM
#: Documents whose anchors give the splitters, anchors that a task packs at once.
SAMPLE_DOCS, FLUSH = 2000, 400_000

PACKED = "part int, kind int, blob binary"
SENT = "bucket int, kind int, part int, blob binary"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` (8 or more) consecutive bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.empty(len(data), np.uint64)
    for i in range(8):  # the eight bytes from every eighth place on
        k = (len(data) - i + 7) // 8
        word[i::8] = padded[i : i + 8 * k].view("<u8")
    h, at = word[:n] + np.uint64(1), 8
    while at < size:
        s = min(at, size - 8)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word[s : s + n]
        at += 8
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1), out=h)


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over every ``size`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= size:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return op(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all anchors, their gram's hash, and the places (bits) of the windows that chose them.

    Bit j stands for the window that starts ``SIDE - j`` bytes before the anchor. Windows never leave
    their document. Equal least hashes in a window all become anchors.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if len(data) < WINDOW:
        return none
    h = gram_hashes(data, GRAM)
    least = _slide(h, PLACES, np.minimum)
    beyond = (offsets[1:, None] - np.arange(1, WINDOW)).ravel()
    least[beyond[(beyond >= 0) & (beyond < len(least))]] = 0  # these windows would leave their document
    edge = np.zeros(PLACES - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), PLACES, np.maximum) == h)
    own = h[chosen]
    bits = _places(least, chosen, own)
    return chosen, own, bits


def _places(least: np.ndarray, chosen: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Bits of the windows that chose each anchor.

    Neighbouring windows with one least hash form a run, which mostly has one anchor; the rest is looked up bit by bit.
    """
    bits = np.zeros(len(chosen), np.uint32)
    if not len(chosen):
        return bits
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[begin[1:], len(least)]
    held = least[begin] > 0
    begin, end = begin[held], end[held]
    value, first = least[begin], np.searchsorted(chosen, begin)
    found, only = np.full(len(begin), -1), np.ones(len(begin), bool)
    for k in range(6):
        at = np.minimum(first + k, len(chosen) - 1)
        inside = (first + k < len(chosen)) & (chosen[at] < end + SIDE)
        hit = inside & (own[at] == value)
        only &= ~(hit & (found >= 0))
        found[hit] = at[hit]
        if k == 5:
            only &= ~inside
        elif not inside.any():
            break
    only &= found >= 0
    only[only] &= (chosen[found[only]] >= end[only] - 1) & (chosen[found[only]] <= begin[only] + SIDE)
    at = found[only]
    low = (begin[only] - chosen[at] + SIDE).astype(np.uint64)
    bits[at] = (((np.uint64(1) << (end - begin)[only].astype(np.uint64)) - np.uint64(1)) << low).astype(np.uint32)
    open_ = np.flatnonzero(bits == 0)
    at, mine = chosen[open_], own[open_]
    more = np.zeros(len(open_), np.uint32)
    for j in range(PLACES if len(open_) else 0):
        start = at - SIDE + j
        inside = (start >= 0) & (start < len(least))
        more |= (inside & (least[np.where(inside, start, 0)] == mine)).astype(np.uint32) << np.uint32(j)
    bits[open_] = more
    return bits


def pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a run of texts: row numbers, where each begins in its text, and (begin, end) in the data.

    A text longer than a block is cut into pieces that overlap by less than a window.
    """
    for lo, hi in runs(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * BLOCK_BYTES:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), offsets[lo : hi + 1]
            continue
        for s in range(a, max(a + 1, b - WINDOW + 1), BLOCK_BYTES):
            yield np.array([lo]), np.array([s - a]), np.array([s, min(b, s + BLOCK_BYTES + WINDOW - 1)])


def key_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of big-endian 64-bit words, zero-filled."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows by multikey quicksort: sort by a word, then each run of equal words by the next.

    The runs of one depth are sorted together, by (run, word).
    """
    order = np.argsort(words[:, 0], kind="stable")
    run = np.concatenate([[0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])]) if len(order) else np.zeros(0, np.int64)
    for depth in range(1, words.shape[1]):
        tied = np.zeros(len(order), bool)
        if len(order):
            same = run[1:] == run[:-1]
            tied[1:] |= same
            tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        inner = np.lexsort((words[rows, depth], run[at]))
        order[at] = rows[inner]
        new = (run[1:] != run[:-1]) | (words[order[1:], depth] != words[order[:-1], depth])
        run = np.concatenate([[0], np.cumsum(new)])
    return order


def _buckets(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Range of each row of leading bytes."""
    return np.searchsorted(splitters, np.ascontiguousarray(keys).view(f"S{GRAM}").ravel(), "right")


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at[:, None] + np.arange(GRAM)]


def sample_splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """Quantiles of the anchors' leading bytes over about ``SAMPLE_DOCS`` documents."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for _, _, cut in pieces(offsets):
                block = data[cut[0] : cut[-1]]
                at, _, _ = anchors(cut - cut[0], block)
                yield pa.RecordBatch.from_arrays([pa.array([_leading(block, at[::8]).tobytes()], pa.binary())], ["keys"])

    found = docs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text").mapInArrow(apply, "keys binary").collect()
    held = b"".join(bytes(r["keys"]) for r in found)
    keys = np.sort(np.frombuffer(held, f"S{GRAM}")) if held else np.zeros(0, f"S{GRAM}")
    return np.unique(keys[(np.arange(1, buckets) * len(keys)) // buckets]) if len(keys) else keys


def _fingerprints(docs: DataFrame, splitters) -> DataFrame:
    """Step 2, sent: per task and bucket the fingerprints with the parts that hold them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return packed.sent(*columns)

        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
            offsets, data = utf8(batch.column(1))
            for rows, _, cut in pieces(offsets):
                block = data[cut[0] : cut[-1]]
                at, h, _ = anchors(cut - cut[0], block)
                row = rows[np.searchsorted(cut - cut[0], at, "right") - 1]
                held.append((_buckets(_leading(block, at), cuts).astype(np.int32), h, parts[row], ids[row]))
                count += len(at)
                if count >= 2 * FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return docs.select("id", "text", "part").mapInArrow(apply, packed.SENT)


def _pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of documents by part: ids, lengths, bytes."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, data = utf8(batch.column(1))
        order = np.argsort(parts, kind="stable")
        rows = []
        for a, b in Spans(parts[order]):
            own, lo = order[a:b], 0
            sizes = offsets[own + 1] - offsets[own]
            for lo, hi in runs(np.r_[0, np.cumsum(sizes)], 4 * BLOCK_BYTES):
                texts = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in own[lo:hi]])
                rows.append((int(parts[own[0]]), freeze(ids[own[lo:hi]], sizes[lo:hi], texts)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "kind", "blob"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for part, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            yield part, kind, blob.as_py()


def _crc(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint32)


def _contexts(splitters):
    """Step 3: the shared anchors with their context, equal contexts of a task settled already."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush(part: int) -> pa.RecordBatch:
            context, bits, doc, crc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # equal (context, bits) side by side, smallest document first
            h = mix(bits.astype(np.uint64) + np.uint64(7))
            for w in key_words(context).T:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            order = np.lexsort((at, doc, h))
            context, bits, doc, crc, at, h = (x[order] for x in (context, bits, doc, crc, at, h))
            new = np.r_[True, (h[1:] != h[:-1]) | (bits[1:] != bits[:-1]) | (context[1:] != context[:-1]).any(1)]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            later = doc != doc[first][group]  # an earlier document of this task holds the same windows
            sent = []
            if later.any():
                sent.append((part % max(1, len(cuts) + 1), 0, freeze(doc[later], crc[later], at[later], bits[later])))
            lead = first
            own = ~later
            counts = np.bincount(group[own], minlength=len(first))
            places = at[own]
            place_begin = np.r_[0, np.cumsum(counts)]
            bucket = _buckets(context[lead][:, SIDE : SIDE + GRAM], cuts)
            by = np.argsort(bucket, kind="stable")
            for a, b in Spans(bucket[by]):
                rows = by[a:b]
                index = lead[rows]
                inner = np.concatenate([places[place_begin[r] : place_begin[r + 1]] for r in rows])
                sent.append((int(bucket[rows[0]]), 1, freeze(context[index], bits[index], doc[index], crc[index], counts[rows].astype(np.int64), inner)))
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in sent], pa.int32()), pa.array([s[1] for s in sent], pa.int32()), pa.array([part] * len(sent), pa.int32()), pa.array([s[2] for s in sent], pa.binary())], ["bucket", "kind", "part", "blob"])

        current, blobs, known, count = None, [], None, 0
        for part, kind, blob in _by_part(batches):
            if part != current:
                if held:
                    yield flush(current)
                current, blobs, known, count = part, [], None, 0
            if kind == 0:
                blobs.append(blob)
                continue
            if not blobs:
                continue
            known = known or packed.Answers(blobs)
            ids, sizes, data = thaw(blob)
            offsets = np.r_[0, np.cumsum(sizes)]
            crcs = _crc(offsets, data)
            for rows, skip, cut in pieces(offsets):
                block = data[cut[0] : cut[-1]]
                inner = cut - cut[0]
                at, h, bits = anchors(inner, block)
                kept, _ = known.find(h)
                at, bits = at[kept], bits[kept]
                which = np.searchsorted(inner, at, "right") - 1
                for lo in range(0, len(at), 1 << 16):
                    a, k = at[lo : lo + (1 << 16)], which[lo : lo + (1 << 16)]
                    spot = a[:, None] + np.arange(-SIDE, GRAM + SIDE)
                    own = bits[lo : lo + (1 << 16)]
                    # bytes of no window that chose this anchor say nothing and are blanked
                    first, last = np.log2(own & (~own + np.uint32(1))).astype(np.int64), np.log2(own).astype(np.int64)
                    column = np.arange(CONTEXT)
                    told = (column >= first[:, None]) & (column < last[:, None] + WINDOW)
                    context = np.where(told, block[np.clip(spot, 0, len(block) - 1)], 0).astype(np.uint8)
                    held.append((context, own, ids[rows[k]], crcs[rows[k]], a - inner[k] + skip[k]))
                    count += len(a)
                if count >= FLUSH:
                    yield flush(current)
                    count = 0
        if held:
            yield flush(current)

    return apply


def judge(context: np.ndarray, bits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each row's windows (bits) those that also stand in a smaller document of the bucket."""
    order = multikey_sort(key_words(context[:, SIDE : SIDE + GRAM]))
    lead = context[order, SIDE : SIDE + GRAM]
    run = np.r_[0, np.cumsum((lead[1:] != lead[:-1]).any(1))]
    spans = Spans(run)
    mixed = np.minimum.reduceat(doc[order], spans.begin) != np.maximum.reduceat(doc[order], spans.begin)
    out = np.zeros(len(bits), np.uint32)
    batch: list[np.ndarray] = []
    size = 0
    for (a, b), several in zip(spans, mixed.tolist(), strict=True):
        if several:
            batch.append(order[a:b])
            size += b - a
        if size >= 1 << 15:
            _judge_windows(context, bits, doc, np.concatenate(batch), out)
            batch, size = [], 0
    if batch:
        _judge_windows(context, bits, doc, np.concatenate(batch), out)
    return out


def _judge_windows(context: np.ndarray, bits: np.ndarray, doc: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    flat = context[rows].ravel()
    h = gram_hashes(flat, WINDOW)
    at = (np.arange(len(rows)) * CONTEXT)[:, None] + np.arange(PLACES)
    wanted = (bits[rows][:, None] >> np.arange(PLACES, dtype=np.uint32)) & np.uint32(1) > 0
    row, place = np.nonzero(wanted)
    value, owner = h[at[row, place]], doc[rows[row]]
    order = np.lexsort((owner, value))
    row, place, value, owner = row[order], place[order], value[order], owner[order]
    spans = Spans(value)
    first = np.repeat(spans.begin, spans.end - spans.begin)
    later = owner != owner[first]
    # the hash brings windows together, their bytes decide and tell apart what the hash has mixed up
    hit = np.flatnonzero(later)
    if len(hit):
        span = np.arange(WINDOW)
        same = np.ones(len(hit), bool)
        for lo in range(0, len(hit), 1 << 16):
            x = hit[lo : lo + (1 << 16)]
            mine = flat[at[row[x], place[x]][:, None] + span]
            theirs = flat[at[row[first[x]], place[first[x]]][:, None] + span]
            same[lo : lo + (1 << 16)] = (mine == theirs).all(1)
        for group in np.unique(first[hit[~same]]).tolist():
            members = np.flatnonzero(first == group)
            least: dict[bytes, int] = {}
            texts = [flat[at[row[k], place[k]] + span].tobytes() for k in members.tolist()]
            for k, text in zip(members.tolist(), texts, strict=True):  # by document
                least.setdefault(text, int(owner[k]))
            later[members] = [least[text] != int(owner[k]) for k, text in zip(members.tolist(), texts, strict=True)]
        hit = np.flatnonzero(later)
        np.bitwise_or.at(out, rows[row[hit]], np.uint32(1) << place[hit].astype(np.uint32))


def _judged():
    """Step 4: the windows to remove, by part."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            found = [(part, thaw(b)) for part, b in blobs]
            context, bits, doc, crc, counts, places = (np.concatenate([f[i] for _, f in found]) for i in range(6))
            part = np.concatenate([np.full(len(f[1]), p, np.int32) for p, f in found])
            hits = judge(context, bits, doc)
            each = np.repeat(np.arange(len(bits)), counts)
            kept = hits[each] > 0
            each, places = each[kept], places[kept]
            order = np.lexsort((places, doc[each], part[each]))
            each, places = each[order], places[order]
            rows = [(int(part[each[a]]), freeze(doc[each[a:b]], crc[each[a:b]], places[a:b], hits[each[a:b]])) for a, b in Spans(part[each])]
            yield from emit(rows)

        def emit(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "kind", "blob"])

        held, current = [], None
        for batch in batches:
            for bucket, kind, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if bucket != current and held:
                    yield from answer(held)
                    held = []
                current = bucket
                if kind == 0:
                    yield from emit([(part, blob.as_py())])
                else:
                    held.append((part, blob.as_py()))
        if held:
            yield from answer(held)

    return apply


def _cut():
    """Step 5: remove the covered bytes of each document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        found: dict[tuple[int, int], list] = defaultdict(list)
        for part, kind, blob in _by_part(batches):
            if part != current:
                current = part
                found = defaultdict(list)
            if kind == 0:
                doc, crc, at, bits = thaw(blob)
                order = np.lexsort((crc, doc))
                doc, crc, at, bits = doc[order], crc[order], at[order], bits[order]
                begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])])
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=True):
                    found[int(doc[a]), int(crc[a])].append((at[a:b], bits[a:b]))
                continue
            ids, sizes, data = thaw(blob)
            offsets = np.r_[0, np.cumsum(sizes)]
            crcs = _crc(offsets, data)
            rows = []
            for i, doc_id in enumerate(ids.tolist()):
                text = data[offsets[i] : offsets[i + 1]]
                windows = found.get((doc_id, int(crcs[i])))
                if not windows:
                    rows.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                change = np.zeros(len(text) + 1, np.int32)
                for at, bits in windows:
                    which, place = np.nonzero((bits[:, None] >> np.arange(PLACES, dtype=np.uint32)) & np.uint32(1))
                    start = at[which] - SIDE + place
                    np.add.at(change, start, 1)
                    np.add.at(change, start + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(text) else 0
                rows.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return apply


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Ids are whole numbers and order the documents; a null id counts as the smallest and comes back as null.
    Null texts are empty. Texts shorter than ``WINDOW`` bytes are kept whole. Rows that repeat an id with an
    equal text are one document and are reported each; strings that repeat within a document only, stay.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    none = -(1 << 63)
    ident: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(none))
    rows = docs.select(ident.alias("id"), F.col(text_col).alias("text")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    splitters = spark.sparkContext.broadcast(sample_splitters(rows, n))
    blocks = rows.mapInArrow(_pack_documents, PACKED)
    gathered = lambda df: df.repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")
    shared = _fingerprints(rows, splitters).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(packed.shared, packed.ANSWERED)
    contexts = gathered(shared.select("part", F.lit(0).alias("kind"), "blob").unionByName(blocks)).mapInArrow(_contexts(splitters), SENT)
    removed = contexts.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(_judged(), PACKED)
    out = gathered(removed.unionByName(blocks)).mapInArrow(_cut(), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.select(F.when(F.col("id") != none, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
