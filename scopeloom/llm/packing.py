"""Hierarchical packing of documents into sequences of several lengths.

Lengths are powers of two, the tiers. A document gives whole windows of the longest tier; the rest of it goes
to the shortest tier that holds it. Each tier is packed by itself: a window takes the tier's longest waiting
piece, and what is left of it is filled with pieces of shorter tiers, the longest that fits first, one being cut
where none does, so windows have no gaps. What remains of a task's pieces at its end is split by powers of
two, which need no padding. Finished sequences of one length are dealt to step groups of equal token counts,
so that the groups' attention costs (squared piece lengths) come out even.

Every task packs its own documents: nothing is shuffled, hot sources do not matter, and the pools of
pieces are bounded.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.tokens import default_vocabulary, encoded, ids_crc32

#: Tokens of the longest window and of the shortest tier, pieces that wait at most, tokens of a step group, and
#: groups that are balanced against each other.
LONGEST, SHORTEST, WAITING, STEP_TOKENS, GROUPS = 1024, 128, 4096, 1 << 16, 8
#: Sequences of one task are numbered from its number times this.
STRIDE = 1 << 33

COLUMNS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "capacity", "step_group")


class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` give finished sequences.

    A sequence is a list of pieces (document, start, ids); a document is (id, number of its tokens).
    """

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST, waiting: int = WAITING):
        if longest & (longest - 1) or shortest & (shortest - 1) or not 0 < shortest <= longest:
            raise ValueError("tiers are powers of two")
        self.longest, self.shortest, self.waiting = longest, shortest, waiting
        self.tiers = [longest >> i for i in range((longest // shortest).bit_length())]
        self.pools: dict[int, list[tuple[int, int, tuple]]] = {t: [] for t in self.tiers}  # (length, order, piece), by length
        self.tokens, self.order = dict.fromkeys(self.tiers, 0), 0

    def tier_of(self, length: int) -> int:
        return max(self.shortest, 1 << (length - 1).bit_length())

    def take(self, doc: tuple, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Route a document: whole windows at once, the rest to its tier."""
        at = 0
        while len(ids) - at >= self.longest:
            yield [(doc, at, ids[at : at + self.longest])]
            at += self.longest
        if at < len(ids):
            self._wait((doc, at, ids[at:]))
        while sum(map(len, self.pools.values())) > self.waiting:
            yield self._fill(max(self.tiers, key=self.tokens.__getitem__))

    def _wait(self, piece: tuple) -> None:
        self.order += 1
        tier = self.tier_of(len(piece[2]))
        self.tokens[tier] += len(piece[2])
        insort(self.pools[tier], (len(piece[2]), self.order, piece))

    def _pop(self, tier: int, k: int) -> tuple:
        length, _, piece = self.pools[tier].pop(k)
        self.tokens[tier] -= length
        return piece

    def _fitting(self, room: int) -> tuple:
        """The longest waiting piece that fits, else the beginning of the shortest one, whose end waits again."""
        held = [t for t in self.tiers if self.pools[t]]
        for tier in held:
            k = bisect_right(self.pools[tier], (room, self.order + 1))
            if k:
                return self._pop(tier, k - 1)
        doc, start, ids = self._pop(held[-1], 0)
        self._wait((doc, start + room, ids[room:]))
        return doc, start, ids[:room]

    def _fill(self, tier: int) -> list[tuple]:
        """A full window of the tier; as many tokens wait at least."""
        window = [self._pop(tier, -1)]
        room = tier - len(window[0][2])
        while room:
            window.append(self._fitting(room))
            room -= len(window[-1][2])
        return window

    def finish(self) -> Iterator[list[tuple]]:
        """Pack what waits, tier by tier; the last pieces are split into sequences of powers of two."""
        for tier in self.tiers:
            while self.pools[tier] and sum(self.tokens.values()) >= tier:
                yield self._fill(tier)
        pieces, left, size = [x[2] for t in self.tiers for x in reversed(self.pools[t])], sum(self.tokens.values()), self.longest
        while pieces:
            size //= 2
            if left < size:
                continue
            window, room = [], size
            while room:
                doc, start, ids = pieces.pop(0)
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:]))
                room -= len(window[-1][2])
            left -= size
            yield window


def deal(costs: list[int], each: int) -> list[int]:
    """Group of each sequence: groups of at most ``each``, the dearest first to the cheapest open group."""
    n = -(-len(costs) // each)
    open_groups = [(0, g, 0) for g in range(n)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g, held = heappop(open_groups)
        out[i] = g
        if held + 1 < each:
            heappush(open_groups, (cost + costs[i], g, held + 1))
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, capacity, step_group.

    Null and empty texts are the end id alone; repeated rows are packed each on its own. ``capacity`` is
    the sequence's length with padding: its tokens where they are a power of two, else ``longest``.
    A step group holds sequences of one capacity and ``step_tokens`` tokens (the last ones of a task
    may hold fewer); ``GROUPS`` of them at a time are balanced by cost.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * STRIDE
        packer, rows, n = Packer(longest, shortest), [], 0
        waiting: dict[int, list[tuple[int, list[tuple]]]] = defaultdict(list)
        n_groups = 0
        id_type = None

        def add(sequence: list[tuple]) -> None:
            nonlocal n
            held = sum(len(p[2]) for p in sequence)
            capacity, offset, pieces, cost = held if held & (held - 1) == 0 else longest, 0, [], 0
            for (doc_id, tokens), start, ids in sequence:
                pieces.append((doc_id, start, len(ids), ids_crc32(ids), tokens, first + n, offset, capacity))
                offset += len(ids)
                cost += len(ids) ** 2
            n += 1
            waiting[capacity].append((cost, pieces))
            if len(waiting[capacity]) >= GROUPS * max(1, step_tokens // capacity):
                group(capacity)

        def group(capacity: int) -> None:
            nonlocal n_groups
            own = waiting.pop(capacity)
            groups = deal([cost for cost, _ in own], max(1, step_tokens // capacity))
            for g, (_, pieces) in zip(groups, own, strict=True):
                rows.extend((*piece, first + n_groups + g) for piece in pieces)
            n_groups += max(groups) + 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), id_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], list(COLUMNS))

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded((x.as_py() for x in batch.column(1)), vocabulary), strict=True):
                for sequence in packer.take((doc_id, len(ids)), ids):
                    add(sequence)
                if len(rows) >= 20_000:
                    yield flush()
        if id_type is not None:
            for sequence in packer.finish():
                add(sequence)
            for capacity in list(waiting):
                group(capacity)
            yield flush()

    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS[1:])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def packing_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return pack(docs, vocabulary)
