"""Exact duplicates with Patricia tries.

Texts are dealt out by length and content hash to owner partitions. An owner inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the id that stays and the group's size,
so equality is decided by bytes, not by the hash. Before the shuffle every task runs the same trie over
its own rows, so a text with any number of copies is sent once per task. Owners read their rows sorted
by (length, hash): a finished subtree is handed on and leaves memory; the tasks' own tries hand on their
largest subtree whenever they outgrow their budget.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import shuffle_partitions

#: Bytes that a task's trie may hold before it hands on a subtree, and bytes of one output batch.
BUDGET, BATCH_BYTES = 16 << 20, 4 << 20


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix; a few C-level comparisons by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class _Node:
    __slots__ = ("label", "children", "keep", "size")

    def __init__(self, label: bytes):
        self.label, self.children, self.keep, self.size = label, {}, None, 0


class PatriciaTrie:
    """Compressed radix trie over byte strings. ``last``: the largest id stays, else the smallest."""

    def __init__(self, last: bool):
        self.root, self.last, self.held = _Node(b""), last, 0

    def _better(self, a: Any, b: Any) -> Any:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.last else min(a, b)

    def insert(self, key: bytes, keep: Any, size: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.held += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = _common(key[at : at + len(child.label)], child.label)
                upper = node.children[key[at]] = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.held += 200
                node, at = upper, at + n
        node.keep = self._better(node.keep, keep) if node.size else keep
        node.size += size

    def terminals(self, top: int | None = None) -> Iterator[tuple[bytes, Any, int]]:
        """(key, keep, size) of one subtree, or of all."""
        stack = [(b"", self.root)] if top is None else [(b"", self.root.children[top])]
        while stack:
            prefix, node = stack.pop()
            prefix += node.label
            if node.size:
                yield prefix, node.keep, node.size
            stack += [(prefix, c) for c in node.children.values()]

    def drop(self, top: int) -> None:
        del self.root.children[top]


def _key(n: int, h: int, text: bytes) -> bytes:
    """Hash, length, text: keys of one (length, hash) pair share a subtree."""
    return h.to_bytes(8, "big", signed=True) + n.to_bytes(8, "big") + text


def _rows(found: Iterator[tuple[bytes, Any, int]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    keys, keeps, sizes, held = [], [], [], 0
    for key, keep, size in found:
        keys.append(key)
        keeps.append(keep)
        sizes.append(size)
        held += len(key)
        if held >= BATCH_BYTES:
            yield _batch(keys, keeps, sizes, id_type)
            keys, keeps, sizes, held = [], [], [], 0
    if keys:
        yield _batch(keys, keeps, sizes, id_type)


def _batch(keys: list[bytes], keeps: list, sizes: list[int], id_type: pa.DataType) -> pa.RecordBatch:
    n = [int.from_bytes(k[8:16], "big") for k in keys]
    h = [int.from_bytes(k[:8], "big", signed=True) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array([k[16:] for k in keys], pa.binary()), pa.array(keeps, id_type), pa.array(sizes, pa.int64())], ["n", "h", "body", "keep_id", "group_size"])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", last: bool = False) -> DataFrame:
    """Texts that occur more than once: text_sha256, keep_id, group_size."""
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("keep_id"), F.octet_length(body).cast("long").alias("n"), F.xxhash64(body).alias("h"), body.cast("binary").alias("body"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = PatriciaTrie(last), None
        weight: dict[int, int] = {}
        for batch in batches:
            id_type = batch.column(0).type
            ids, ns, hs = (batch.column(i).to_pylist() for i in range(3))
            for i, body in enumerate(batch.column(3)):
                key = _key(ns[i], hs[i], body.as_py())
                held = trie.held
                trie.insert(key, ids[i], 1)
                weight[key[0]] = weight.get(key[0], 0) + trie.held - held
                if trie.held > BUDGET:
                    top = max(weight, key=weight.get)
                    yield from _rows(trie.terminals(top), id_type)
                    trie.drop(top)
                    trie.held -= weight.pop(top)
        if id_type is not None:
            yield from _rows(trie.terminals(), id_type)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, open_key = PatriciaTrie(last), None
        done: list[tuple[str, Any, int]] = []

        def flush(id_type):
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], id_type), pa.array([x[2] for x in done], pa.int64())], ["text_sha256", "keep_id", "group_size"])
            done.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch.column(3).type
            ns, hs, keeps, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, body in enumerate(batch.column(2)):
                if (ns[i], hs[i]) != open_key:
                    done += [(hashlib.sha256(k).hexdigest(), keep, size) for k, keep, size in trie.terminals() if size > 1]
                    trie, open_key = PatriciaTrie(last), (ns[i], hs[i])
                trie.insert(body.as_py(), keeps[i], sizes[i])
            if len(done) >= 10_000:
                yield flush(id_type)
        done += [(hashlib.sha256(k).hexdigest(), keep, size) for k, keep, size in trie.terminals() if size > 1]
        if done:
            yield flush(id_type)

    sent = rows.mapInArrow(combine, f"n bigint, h bigint, body binary, keep_id {kind}, group_size bigint")
    dealt = sent.repartition(shuffle_partitions(docs.sparkSession), "n", "h").sortWithinPartitions("n", "h")
    return dealt.mapInArrow(own, f"text_sha256 string, keep_id {kind}, group_size bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", last: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the UTF-8 text).

    Null counts as the empty text. Texts are equal when their bytes are. The smallest id of a group
    stays, or the largest with ``last``; a null id only stays where all are null. Rows that repeat an id
    and its text are one row repeated: each is reported, with the same answer. Only groups of two or more
    reach the join, which has narrow rows and which AQE splits where one text has very many copies.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(duplicate_groups(docs, id_col, text_col, last), "text_sha256", "left")
    out = joined.select(id_col, F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
