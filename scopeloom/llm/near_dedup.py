"""Near duplicates by order MinHash.

A text is its sequence of five-word shingles, each labelled with its occurrence number. Every hash
function picks the few labelled shingles with the least hashes and keeps them in text order; that ordered
tuple is a sketch, so two texts tend to share sketches when one can be edited into the other. A banded
alignment of their words decides: the edit similarity ``1 - edits / words of the longer text`` must reach 0.8.

Texts with equal words are one class representative from the start, so any number of copies costs one text.
An edit changes three runs of three words, so similar texts share many of theirs; a text that shares fewer
with all others together is alone. The other texts are sketched, and a sketch's texts are compared with a
leader, not with each other; that joins most of what belongs together. Sketches alone would miss pairs, so texts
of two classes that have one of their rarest shared runs in common are aligned too, as far as lengths and word
counts allow. No similar pair is lost there, however common its sketches or short its texts (pairs with a text of
up to 24 words go by runs of two words).
Links are joined into classes by minimum labels with pointer jumping, on written tables.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm import packed
from scopeloom.llm.common import mix, shuffle_partitions, stored, words

#: Words of a shingle, sketches, shingles of a sketch, and least similarity.
SHINGLE, SKETCHES, PICKED, SIMILARITY = 5, 16, 3, 0.8
#: Words of a short text, keys that a task packs at once, slots of a text's word counts, rows of a key up to which
#: these are not sent, rows of a key that meet in one task, and heads of a text.
SHORT, FLUSH, BINS, PLAIN, BLOCK, HEADS = 24, 1 << 20, 1024, 16, 1024, 3
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_codes(found: list[bytes]) -> np.ndarray:
    """A 32-bit number for each word; equal words have equal numbers."""
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") for w in found], np.uint32)


class _Codes(dict):
    """Remembers the codes of frequent words."""

    def __missing__(self, word: bytes) -> int:
        code = int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little")
        if len(self) < 1 << 18:
            self[word] = code
        return code


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one run."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(codes))
    h = np.full(len(codes) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - size + 1 + i])
    return h


def order_sketches(codes: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> list[int]:
    """One number per hash function: its least labelled shingles, in text order."""
    h = shingles(codes)
    if not len(h):
        return []
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    begin = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
    at = np.arange(len(h))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(begin, at, 0))
    labelled = mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93))
    n = min(picked, len(h))
    out: list[int] = []
    step = max(1, (1 << 19) // len(h))
    for lo in range(0, sketches, step):
        seeds = _SEEDS[lo : min(sketches, lo + step)]
        least = mix(labelled[None, :] ^ seeds[:, None])
        pick = np.sort(np.argpartition(least, n - 1, axis=1)[:, :n], axis=1) if len(h) > n else np.tile(at, (len(seeds), 1))
        value = seeds.copy()
        for i in range(n):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[pick[:, i]])
        out += value.view(np.int64).tolist()
    return out


def allowed_edits(longer: int, least: float) -> int:
    """Most edits between two texts, the longer of so many words, that are similar."""
    return int((1 - least) * longer + 1e-9)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Edit similarity of two word sequences, or 0 where it is below ``least``.

    Pairs that counts of words and of word pairs rule out are not aligned.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    allowed = allowed_edits(longer, least)
    if _ruled_out(a, b, allowed):
        return 0.0
    edits = _banded_edits(a, b, allowed)
    return 0.0 if edits is None else 1 - edits / longer


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity reaches ``least``.

    An alignment along shingles that both texts have once often shows it at once; what it leaves open is aligned.
    """
    allowed = allowed_edits(max(len(a), len(b)), least)
    if abs(len(a) - len(b)) > allowed or not len(a) or not len(b):
        return False
    return _edits_along(a, b) <= allowed or similarity(a, b, least) > 0


def _ruled_out(a: np.ndarray, b: np.ndarray, allowed: int) -> bool:
    if abs(len(a) - len(b)) > allowed:
        return True
    # words that one side has too few of need an edit each
    both, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = np.bincount(inverse[: len(a)], minlength=len(both)) - np.bincount(inverse[len(a) :], minlength=len(both))
    if max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > allowed:
        return True
    # so do pairs of neighbouring words, two for each edit
    if min(len(a), len(b)) > 1:
        pairs = [x[:-1].astype(np.uint64) << np.uint64(32) | x[1:].astype(np.uint64) for x in (a, b)]
        both, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        counts = np.bincount(inverse[: len(pairs[0])], minlength=len(both)) - np.bincount(inverse[len(pairs[0]) :], minlength=len(both))
        return max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > 2 * allowed
    return False


def _edits_along(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of one alignment, so never fewer than the edit distance: shingles that both have once, in order, and replacements between."""
    if min(len(a), len(b)) < SHINGLE:
        return max(len(a), len(b))
    once = []
    for codes in (a, b):
        value, at, n = np.unique(shingles(codes), return_index=True, return_counts=True)
        once.append((value[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    x, y = once[0][1][i], once[1][1][j]
    order = np.argsort(x)
    x, y = x[order], y[order]
    if len(y) > 1 and (np.diff(y) < 0).any():
        kept = _rising(y.tolist())
        x, y = x[kept], y[kept]
    x, y = np.r_[-SHINGLE, x, len(a)], np.r_[-SHINGLE, y, len(b)]
    gaps = np.stack([np.diff(x), np.diff(y)]) - SHINGLE
    return int((gaps.max(0) - np.minimum(gaps.min(0), 0)).sum())


def _rising(values: list[int]) -> list[int]:
    """Positions of a longest rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before[i] = at[k - 1] if k else -1
        ends[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _banded_edits(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance up to ``limit``, column by column in a band of that many diagonals on each side.

    The differences between neighbouring cells of a column are bits of whole numbers, ``rises`` and ``falls``, so
    a column takes a few operations on numbers as wide as the band. Bit t of column j is row j - limit + t.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    m, n = len(a), len(b)
    width = 2 * limit + 1
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    rises, falls = full >> limit << limit, 0
    edits = min(m, limit)
    for j, word in enumerate(b.tolist(), 1):
        equal = where.get(word, 0)
        equal = (equal >> (j - limit - 1) if j > limit else equal << (limit + 1 - j)) & full
        flat = ((((equal & rises) + rises) ^ rises) | equal | falls) & full  # no step along the diagonal
        up, down = (falls | ~(flat | rises)) & full, flat & rises  # steps along the row
        if j + limit <= m:
            edits += not flat & lowest
        else:  # the band has reached the last row
            row = m - j + limit
            edits += (up >> row & 1) - (down >> row & 1)
            if edits - (n - j) > limit:
                return None
        shifted = flat >> 1
        rises, falls = (down | ~(shifted | up)) & full, shifted & up
    return edits if edits <= limit else None


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the words (null without words), codes (the word codes as packed 32-bit numbers), row (its number)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            digests, lists = [], []
            for text in batch.column(1):
                found = words(text.as_py())
                digests.append(hashlib.blake2b(b" ".join(found), digest_size=16).hexdigest() if found else None)
                lists.append(array("I", map(known.__getitem__, found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(lists, pa.binary())], ["id", "digest", "codes"])

    signed = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(apply, f"id {kind}, digest string, codes binary")
    return signed.withColumn("row", F.monotonically_increasing_id())


def word_lists(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, codes of the texts in the pairs (a, b), each once."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    return stored(texts.select("rep", "codes").join(ids, "rep", "left_semi").groupBy(F.col("rep").alias("id")).agg(F.first("codes").alias("codes")))


def run_lengths(n: int, least: float) -> list[int]:
    """Words of the runs that a text of so many words is matched by.

    Long texts take the longest runs, up to three words, of which the allowed edits leave enough; pairs with a text of
    at most ``SHORT`` words take one word less, so texts that are little longer have both.
    """
    size = min(3, max(1, int(0.7 / (1 - least))))
    if size < 3 or n > SHORT / least + 1:
        return [size]
    return [2] if n <= SHORT else [2, 3]


def needed(n: int, size: int, least: float) -> int:
    """Runs of ``size`` words that a text of so many words shares at least with each text similar to it.

    Of a pair's runs all but ``size`` for each allowed edit stay; the fewest for any length of the longer text.
    """
    steps = int(1 / (1 - least)) + 2
    return min(m - size + 1 - size * allowed_edits(m, least) for m in range(n, n + steps))


def run_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    h = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)])
    return h


def rare_runs(codes: np.ndarray, known: packed.Answers, least: float = SIMILARITY) -> np.ndarray:
    """The rarest runs of a text among those that another text has.

    All texts use one order: by level, hash, occurrence. A text may lose all runs but those ``needed``, and has lost
    those that no other text has; so among one more of its rarest than it may still lose is a run of each similar text.
    """
    found = []
    for size in run_lengths(len(codes), least):
        h = run_hashes(codes, size)
        hit, level = known.find(h)
        take = int(hit.sum()) - needed(len(codes), size, least) + 1
        if take < 1:
            continue
        h = h[hit]
        # equal runs lie side by side in the order, so that they can be numbered
        h = h[np.argsort(h >> np.uint64(8) | level.astype(np.uint64) << np.uint64(56))[:take]]
        at = np.arange(len(h))
        occurrence = at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0))
        found.append(mix(h + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def common_runs(texts: DataFrame, least: float) -> DataFrame:
    """rep, n, keys, bins, sketches, codes of each text that shares as many runs with others as similar texts must.

    All other texts are alone in their classes. ``keys`` are the rarest runs (``rare_runs``), ``bins`` the words
    counted in ``BINS`` slots. Which runs others have is asked with packed fingerprints; the texts wait in parts, by a
    hash of the id.
    """
    n = shuffle_partitions(texts.sparkSession)
    kind = texts.schema["rep"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, doc = [], 0, 0

        def flush() -> pa.RecordBatch:
            key, part, of = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return packed.sent(packed.buckets_of(key, n), key, part, of)

        for batch in batches:
            for part, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer(codes.as_py(), "<u4")
                key = np.concatenate([run_hashes(codes, size) for size in run_lengths(len(codes), least)])
                held.append((key, np.full(len(key), part, np.uint32), np.full(len(key), doc, np.uint32)))
                count, doc = count + len(key), doc + 1
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, known = None, [], None
        for batch in batches:
            taken, keys, bins, sketches = [], [], [], []
            for i, (part, what) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if part != current:
                    current, blobs, known = part, [], None
                if what == 0:
                    blobs.append(batch.column(3)[i].as_py())
                elif blobs:
                    known = known or packed.Answers(blobs)
                    codes = np.frombuffer(batch.column(3)[i].as_py(), "<u4")
                    key = rare_runs(codes, known, least)
                    if len(key):
                        taken.append(i)
                        keys.append(key.view(np.int64))
                        bins.append(word_bins(codes).tobytes())
                        sketches.append(order_sketches(codes))
            rows = batch.take(pa.array(taken, pa.int32()))
            lengths = pa.array([len(x.as_py()) // 4 for x in rows.column(3)], pa.int32())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, sketches)]
            yield pa.RecordBatch.from_arrays([rows.column(2), lengths, lists[0], pa.array(bins, pa.binary()), lists[1], rows.column(3)], ["rep", "n", "keys", "bins", "sketches", "codes"])

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("part")
    own = texts.select(part("rep"), "rep", "codes")
    answers = own.select("part", "codes").mapInArrow(send, packed.SENT).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(packed.shared, packed.ANSWERED)
    rows = stored(answers).select("part", F.lit(0).alias("what"), F.lit(None).cast(kind).alias("rep"), "blob")
    rows = rows.unionByName(own.select("part", F.lit(1).alias("what"), "rep", F.col("codes").alias("blob")))
    schema = f"rep {kind}, n int, keys array<bigint>, bins binary, sketches array<bigint>, codes binary"
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "what").mapInArrow(receive, schema)


def word_bins(codes: np.ndarray) -> np.ndarray:
    """How many of the words fall into each slot; all full where a count does not fit."""
    counts = np.bincount(codes & np.uint32(BINS - 1), minlength=BINS)
    return np.minimum(counts, 0xFFFF).astype("<u2") if counts.max() < 1 << 16 else np.full(BINS, 0xFFFF, "<u2")


def _met(table: pa.Table, least: float) -> pa.RecordBatch:
    """a, b: texts of two classes that share a key of the rows (key, rep, label, n, heads, bins, block, own, other), sorted by key.

    Lengths and, where the rows have them, word counts rule pairs out. Texts that share a head meet there.
    """
    ids = table.column("rep").combine_chunks().dictionary_encode()
    rep, label = (np.asarray(x) for x in (ids.indices, table.column("label").combine_chunks().dictionary_encode().indices))
    key, n, block, own, other = (table.column(c).to_numpy() for c in ("key", "n", "block", "own", "other"))
    heads = [table.column(f"head{i}") for i in range(HEADS)]
    heads = [(h.fill_null(0).to_numpy(), h.is_valid().to_numpy()) for h in heads]
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (other[1:] != other[:-1])])
    length = np.diff(np.r_[begin, len(key)])
    bins = table.column("bins")
    found = [np.zeros(0, np.int64)]
    for size in np.unique(length[length > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        starts = begin[length == size]
        for part in np.array_split(starts, max(1, len(starts) * len(i) >> 21)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            longer = np.maximum(n[x], n[y])
            allowed = ((1 - least) * longer + 1e-9).astype(np.int64)
            near = (label[x] != label[y]) & (np.abs(n[x] - n[y]) <= allowed)
            near &= (block[x] != block[y]) | (own[x] == other[x])  # texts of one block meet where it is alone
            x, y, allowed, longer = x[near], y[near], allowed[near], longer[near]
            near = np.ones(len(x), bool)
            for one, has in heads:
                for two, also in heads:
                    near &= ~(has[x] & also[y] & (one[x] == two[y]))
            x, y, allowed, longer = x[near], y[near], allowed[near], longer[near]
            if len(x) and bins[int(part[0])].is_valid:
                at, back = np.unique(np.r_[x, y], return_inverse=True)
                held = np.stack([np.frombuffer(bins[k].as_py(), "<u2") for k in at.tolist()])
                one, two = back[: len(x)], back[len(x) :]
                same = np.concatenate([np.minimum(held[one[k : k + 2048]], held[two[k : k + 2048]]).sum(1, dtype=np.int64) for k in range(0, len(x), 2048)])
                near = longer - same <= allowed
                x, y = x[near], y[near]
            found.append(np.minimum(rep[x], rep[y]).astype(np.int64) * len(ids.dictionary) + np.maximum(rep[x], rep[y]))
    a, b = np.divmod(np.unique(np.concatenate(found)), max(1, len(ids.dictionary)))
    return pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(x)) for x in (a, b)], ["a", "b"])


def across(live: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts of two classes that have a rare run in common and may be similar.

    A text's heads are those of its keys with most rows; texts that share a head meet there and not at keys with fewer
    rows, and keys whose rows all share one are left out. Rows of larger keys bring their word counts, which rule out
    most pairs. A key with many rows is cut into blocks, and every two of its blocks meet in a task of their own.
    """
    spark = live.sparkSession
    n, kind = shuffle_partitions(spark), live.schema["rep"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            last = [held.column(c)[-1].as_py() for c in ("key", "own", "other")]
            same = np.logical_and.reduce([held.column(c).to_numpy() == x for c, x in zip(("key", "own", "other"), last, strict=True)])
            cut = held.num_rows - int(same.sum())  # the last group may go on in the next batch
            if cut:
                yield _met(held.slice(0, cut), least)
                held = held.slice(cut)
        if held is not None:
            yield _met(held, least)

    facts = live.select("rep", "n", "keys", "bins").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    flat = facts.select("rep", "label", F.explode("keys").alias("key"))
    spread = flat.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows")).where("low != high").select("key", "rows")
    named = stored(flat.join(spread, "key").select("key", "rep", "rows"))
    mine = F.struct("rows", "key")
    heads = named.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(mine), False), 1, HEADS).alias("heads"))
    above = F.transform(F.filter("heads", lambda h: h > mine), lambda h: h["key"])
    headed = stored(named.join(heads, "rep").select("key", "rep", "rows", above.alias("heads")))
    met = headed.select("key", "rows", F.explode("heads").alias("head")).groupBy("key", "head").agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows")).where("n = rows")
    facts = facts.select("rep", "label", "n", "bins")
    dealt = headed.join(met.select("key").distinct(), "key", "left_anti").join(facts, "rep").withColumn("bins", F.when(F.col("rows") > PLAIN, F.col("bins")))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tops = [F.get("heads", F.lit(i)).alias(f"head{i}") for i in range(HEADS)]
    dealt = dealt.select("key", "rep", "label", "n", *tops, "bins", "block", F.least("block", "with").alias("own"), F.greatest("block", "with").alias("other"))
    dealt = dealt.repartition(n, "key", "own", "other").sortWithinPartitions("key", "own", "other")
    pairs = dealt.mapInArrow(apply, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts align well enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_py(), "<u4") for x in batch.column(i)] for i in (2, 3)]
            kept = np.array([similar(x, y, least) for x, y in zip(*sides, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept)) for i in (0, 1)], ["a", "b"])

    left, right = (lists.select(F.col("id").alias(n), F.col("codes").alias(f"codes_{n}")) for n in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "codes_a", "codes_b")
    # alignments cost more than their bytes tell: spread them by pair
    return met.repartition(shuffle_partitions(pairs.sparkSession), "a", "b").mapInArrow(apply, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id that the links (a, b) reach, for every id in a link."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = stored(lower.join(jump, "label", "left").select("id", "was", F.coalesce("far", "label").alias("label")))
        labels = new.select("id", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links (a, b): these are few between classes, however many between texts."""
    for end in "ab":
        links = links.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    between = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b").distinct()
    more = components(stored(between)).withColumnRenamed("label", "far")
    moved = labels.join(more.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("far", "label").alias("label"))
    new = more.select("id", F.col("far").alias("label")).join(labels.select("id"), "id", "left_anti")
    return stored(moved.unionByName(new))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are not of one class yet."""
    for end in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), kept (whether it is that id).

    Texts without words (null, empty, signs only) are classes of their own. Texts with the same words in
    order are of one class, whatever their case and signs. Rows that repeat an id are reported each; a row
    with a null id has a null class and is kept.
    """
    signed = stored(signatures(docs, id_col, text_col))
    named = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    reps = stored(named.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first")).select("digest", F.col("first.id").alias("rep"), F.col("first.row").alias("row")))
    texts = stored(signed.select("row", "codes").join(reps.select("row", "rep"), "row").select("rep", "codes"))
    live = stored(common_runs(texts, least))
    keys = live.select("rep", F.explode(F.array_distinct("sketches")).alias("key"))
    led = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1").drop("n")
    pairs = keys.join(led, "key").where("rep != leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = stored(pairs)
    lists = word_lists(live, pairs)
    # each text meets the leader with which it shares most; the others only where that leaves two classes
    closest = pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), F.col("a"))).alias("a"))
    labels = components(stored(verified(closest.select("a", "b"), lists, least)))
    rest = stored(apart(pairs.select("a", "b").join(closest, ["a", "b"], "left_anti"), labels))
    labels = joined(labels, verified(rest, lists, least))
    # what sketches have not brought together meets by its rare runs: every pair of two classes that can be similar
    more = stored(across(live, labels, least).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    labels = joined(labels, verified(more, word_lists(live, more), least))
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
    out = signed.select("id", "digest").join(classes, "digest", "left")
    out = out.select("id", F.coalesce("class_id", "id").alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
