"""Secret scan with a trigram index.

Each rule is a regular expression. From its parse tree a Boolean trigram query is derived: strings that
every match must contain, as an OR of ANDs of trigrams. Every block of documents gets an inverted index
of the trigrams that some query names (a document-partitioned index, so no shuffle and no skew);
postings are intersected from the rarest, and only candidate documents meet the expression itself. A
rule without mandatory trigrams, such as a run of one character class, scans every text fully.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeloom.llm.common import runs, utf8

#: Alternatives that a query may hold before it is given up as "any text".
MAX_ALTERNATIVES = 64
#: Characters of a class that are expanded into alternatives.
MAX_CLASS = 8

Query = frozenset[frozenset[bytes]] | None  # an OR of ANDs; None: any text


@dataclass(frozen=True)
class Rule:
    """``group`` must hold ``least`` characters, else the match is dropped; ``base`` marks contract kinds."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # a run of 24 or more: the same spans as [0-9a-f]+ cut off at 24
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", True),
)


def _all_of(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= MAX_ALTERNATIVES else min(a, b, key=len)


def _any_of(queries: Iterable[Query]) -> Query:
    out: frozenset[frozenset[bytes]] = frozenset()
    for q in queries:
        if q is None:
            return None
        out |= q
    return out if len(out) <= MAX_ALTERNATIVES else None


def _holding(strings: set[bytes]) -> Query:
    """Texts that hold one of the strings."""
    return _any_of(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) if len(s) > 2 else None for s in strings)


def _atom(op, arg) -> tuple[set[bytes] | None, Query]:
    """All strings that a node matches, if they are few, and what any text with a match must hold."""
    if op is K.LITERAL:
        return {chr(arg).encode().lower()}, None
    if op is K.IN:
        if arg and all(kind is K.LITERAL for kind, _ in arg) and len(arg) <= MAX_CLASS:
            return {chr(c).encode().lower() for _, c in arg}, None
        return None, None
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(x is not None for x, _ in found) and sum(len(x) for x, _ in found) <= MAX_ALTERNATIVES:
            return set().union(*(x for x, _ in found)), None
        return None, _any_of(_all_of(q, _holding(x) if x is not None else None) for x, q in found)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (1, 1):
            return strings, query
        if (low, high) == (0, 1) and strings is not None and query is None:
            return strings | {b""}, None
        if low == 0:
            return None, None
        return None, _all_of(query, _holding(strings) if strings is not None else None)
    return (set([b""]), None) if op is K.AT else (None, None)


def _sequence(nodes) -> tuple[set[bytes] | None, Query]:
    strings: set[bytes] = {b""}
    query: Query = None
    exact = True
    for op, arg in nodes:
        more, needs = _atom(op, arg)
        query = _all_of(query, needs)
        if more is None or needs is not None or len(strings) * len(more) > MAX_ALTERNATIVES:
            query = _all_of(query, _holding(strings))
            strings, exact = (more if more is not None and needs is None else {b""}), False
        else:
            strings = {a + b for a in strings for b in more}
    return (strings, query) if exact else (None, _all_of(query, _holding(strings)))


def trigram_query(rule: Rule) -> Query:
    """Case-folded trigrams that a text with a match must hold; None where the rule has none."""
    strings, query = _sequence(sre.parse(rule.pattern, re.ASCII))
    return _all_of(query, _holding(strings)) if strings is not None else query


class Scanner:
    """The rules' queries, and a table from trigram to its number among those that some query names."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        grams = sorted({g for _, _, q in self.rules if q for conj in q for g in conj})
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.slots = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.slots[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, offsets: np.ndarray, data: np.ndarray) -> dict[int, np.ndarray]:
        """Sorted documents of each indexed trigram."""
        if len(data) < 3:
            return {}
        folded = self.fold[data]
        found = self.slots[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[doc + 1]
        keys = np.unique(found[at[inside]].astype(np.int64) << 32 | doc[inside])
        grams, docs = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(keys) else np.zeros(0, int)
        return dict(zip(grams[first].tolist(), np.split(docs, first[1:]), strict=False)) if len(keys) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray]) -> set[int]:
        out: set[int] = set()
        for conj in query or ():
            lists = sorted((postings.get(self.number[g], np.zeros(0, np.int64)) for g in conj), key=len)
            hits = lists[0]
            for other in lists[1:]:
                if not len(hits):
                    break
                hits = np.intersect1d(hits, other, assume_unique=True)
            out.update(hits.tolist())
        return out

    def scan(self, texts: list[str], offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every match, by text, in code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(offsets, data)
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else self.candidates(query, postings):
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if len(m[rule.group]) >= rule.least]
        for spans in out:
            spans.sort()
        return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, ordered by start and then by the rules' order.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are ignored.
    Starts and ends count code points, the end is exclusive. Matches of one kind never overlap.
    """
    kinds = [r.kind for r in rules]
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            offsets, data = utf8(column)
            spans = []
            for lo, hi in runs(offsets):
                texts = [x or "" for x in column.slice(lo, hi - lo).to_pylist()]
                found = scanner.scan(texts, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                spans += [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind_t)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(apply, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(listed(of(base)).cast("binary"), 256)
    return scan_secrets(docs, rules).select("doc_id", *counts, digest.alias("base_sha256"), listed(F.col("spans")).alias("spans"))
