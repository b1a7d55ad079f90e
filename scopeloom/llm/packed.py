"""Which keys do several texts hold? Keys travel packed, as sorted fingerprints in a few compressed blobs per task.

A task sends its keys' fingerprints to buckets with the part (a range of texts) that each comes from; a bucket
answers every part with those of its fingerprints that stand in two texts or more. All else never travels again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FINGERPRINT = np.uint64((1 << 40) - 1)
SENT = "bucket int, blob binary"
ANSWERED = "part int, blob binary"


def freeze(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def thaw(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


class Spans:
    """Groups of equal values in a sorted array: (begin, end)."""

    def __init__(self, values: np.ndarray):
        self.begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        self.end = np.r_[self.begin[1:], len(values)].astype(np.int64) if len(values) else self.begin

    def __iter__(self):
        return zip(self.begin.tolist(), self.end.tolist(), strict=True)


def buckets_of(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key by its upper bits, rising with the key."""
    return ((key >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def sent(bucket: np.ndarray, key: np.ndarray, part: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One blob per bucket: its fingerprints, the part of each, and whether several texts of the task hold it.

    Equal keys have equal buckets. ``doc`` tells the texts of the task apart.
    """
    order = np.argsort(key)
    key, part, doc = key[order], part[order], doc[order]
    same = key[1:] == key[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(key) else np.zeros(0, np.int64)
    several = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    several[group[1:][same & (doc[1:] != doc[:-1])]] = True
    kept = np.r_[True, ~same | several[group[1:]] & (part[1:] != part[:-1])] if len(key) else same
    bucket, finger, part, several = bucket[order][kept], key[kept] & FINGERPRINT, part[kept], several[group[kept]]
    if len(bucket) and (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        bucket, finger, part, several = bucket[order], finger[order], part[order], several[order]
    width = np.uint16 if not len(part) or part.max() < 1 << 16 else np.uint32
    low, high, part = finger.astype(np.uint32), (finger >> np.uint64(32)).astype(np.uint8), part.astype(width)
    rows = [(int(bucket[a]), freeze(low[a:b], high[a:b], part[a:b], several[a:b])) for a, b in Spans(bucket)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of buckets (rows sorted by bucket): per part the sorted fingerprints that two texts or more hold.

    Each comes with its level, the logarithm of how many tasks and parts have sent it.
    """

    def answer(blobs: list[bytes]) -> pa.RecordBatch:
        low, high, part, several = (np.concatenate(x) for x in zip(*(thaw(b) for b in blobs), strict=True))
        finger = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        order = np.argsort(finger)
        finger, part, several = finger[order], part[order], several[order]
        spans = Spans(finger)
        size = spans.end - spans.begin
        some = np.maximum.reduceat(several, spans.begin) if len(size) else several
        kept = np.repeat((size > 1) | some, size)
        level = np.repeat(np.minimum(255, 8 * np.log2(size + some)).astype(np.uint8), size)[kept]
        finger, part = finger[kept], part[kept]
        order = np.argsort(part, kind="stable")
        finger, part, level = finger[order], part[order], level[order]
        rows = []
        for a, b in Spans(part):
            own, at = np.unique(finger[a:b], return_index=True)
            rows.append((int(part[a]), freeze(own, level[a:b][at])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    held, current = [], None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != current and held:
                yield answer(held)
                held = []
            current = bucket
            held.append(blob.as_py())
    if held:
        yield answer(held)


class Answers:
    """What a part has been answered: its shared fingerprints and their levels."""

    def __init__(self, blobs: list[bytes]):
        found = [thaw(b) for b in blobs]
        self.fingers, at = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        self.levels = np.concatenate([f[1] for f in found])[at]
        # most keys asked for are not shared: a table by their lowest bits rules these out
        self.mask = np.uint64((1 << min(24, (8 * len(self.fingers)).bit_length())) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)
        self.some[self.fingers & self.mask] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are shared, and the levels of those."""
        hit = self.some[keys & self.mask]
        finger = keys[hit] & FINGERPRINT
        at = np.minimum(np.searchsorted(self.fingers, finger), len(self.fingers) - 1)
        same = self.fingers[at] == finger
        hit[hit] = same
        return hit, self.levels[at[same]]
