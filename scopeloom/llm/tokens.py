"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scopeloom.llm.common import runs, utf8

#: Pieces of text whose ids a worker remembers, and the id that ends a document.
REMEMBERED, END_ID = 1 << 18, 0
# Runs of white space, white space at the end, and signs on which the vocabulary's own splitter and Python may differ.
_ODD = re.compile(r"\s(?:\s|\Z)|[\x1c-\x1f\x85]")
_ODD_PIECE = re.compile(r"\A(?:\s|\Z)|" + _ODD.pattern)
_APOSTROPHE = "'"
# Letters and signs (no apostrophe) of which the splitter's classes are certain: a word, its signs, and both again on the next line.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ſ", r"!-&(-/:-@\[-`{-~"
_WORD = re.compile(rf"([{_LETTER}]+)([{_SIGN}]*)(?:\n([{_LETTER}]+)([{_SIGN}]*))?")
#: Bytes of text whose pieces are looked up together.
RUN_BYTES = 4 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 signs stand for themselves, others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit values.

    A space that no white space precedes or follows always opens a new word of the vocabulary's splitter,
    so a text falls into pieces there that are encoded alone; the ids of frequent pieces are kept. BPE
    merges never cross the splitter's classes, so a piece without apostrophe and runs of white space goes
    to the model at once. Everything else, and a text that holds one of the vocabulary's added tokens, takes
    the tokenizer's usual path.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.signs = _byte_signs()
        self.space = self.signs[ord(" ")]
        self.bare = {"": b""}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        if _APOSTROPHE in text:
            return self.whole(text)
        return array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(self.signs))]).tobytes()

    def follows(self, text: str) -> bytes:
        """Ids of what no space precedes."""
        ids = self.bare.get(text)
        if ids is None:
            ids = self.piece(text)
            if len(self.bare) < REMEMBERED // 4:
                self.bare[text] = ids
        return ids

    def __missing__(self, rest: str) -> bytes:
        parts = None if rest.isalpha() else _WORD.fullmatch(rest)
        if rest.isalpha() and rest.isascii():
            ids = array("I", [t.id for t in self.tokenize(self.space + rest)]).tobytes()
        elif parts is None:
            ids = self.piece(" " + rest)
        else:
            # made of words that are remembered, so not remembered itself
            word, signs, below, more = parts.groups()
            ids = self[word] + self.follows(signs)
            return ids + self.follows("\n") + self.follows(below) + self.follows(more) if below else ids
        if len(self) < REMEMBERED:
            self[rest] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.piece(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def encoded(texts: Iterator[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text with the end id; null is empty."""
    coder = encoder(path)
    end = np.array([END_ID], "<u4").tobytes()
    for text in texts:
        yield np.frombuffer((coder.encode(text) if text else b"") + end, "<u4")


def encoded_column(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """As ``encoded``, of a column of texts: the pieces of some megabytes of texts are looked up once each, and dealt to their places by Arrow."""
    offsets = utf8(column)[0]
    for lo, hi in runs(offsets, RUN_BYTES):
        yield from _encoded_run(pc.fill_null(column.slice(lo, hi - lo), "").cast(pa.large_string()), path)


def _encoded_run(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    coder, end = encoder(path), np.array([END_ID], "<u4")
    odd = np.zeros(len(texts), bool)
    for token in coder.added:
        odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    pieces = pc.split_pattern(texts, " ")
    ends = np.cumsum(pc.list_value_length(pieces).to_numpy())
    flat, heads = pieces.flatten(), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    later = np.ones(len(flat), bool)
    later[heads] = False
    rest = flat.filter(pa.array(later)).dictionary_encode()
    known = [coder[x] if x.isalpha() or x in coder or not _ODD_PIECE.search(x) else None for x in rest.dictionary.to_pylist()]
    sizes = np.array([0 if x is None else len(x) >> 2 for x in known], np.int64)
    ids = np.frombuffer(b"".join(x for x in known if x is not None), "<u4")
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    places = rest.indices.to_numpy()
    dealt = pa.LargeListArray.from_arrays(starts, pa.array(ids)).take(rest.indices)
    values = dealt.flatten().to_numpy()
    # a text's pieces but its first: their number, and where their ids end
    stops = ends - np.arange(1, len(texts) + 1)
    upto = np.concatenate([[0], np.cumsum(sizes[places])])
    strange = np.concatenate([[0], np.cumsum(np.array([x is None for x in known], bool)[places])])
    begins = np.concatenate([[0], stops[:-1]])
    odd |= strange[stops] > strange[begins]
    for i, first in enumerate(flat.take(pa.array(heads)).to_pylist()):
        if odd[i] or first and _ODD.search(first):
            yield np.concatenate([np.frombuffer(coder.whole(texts[i].as_py()), "<u4"), end])
        else:
            yield np.concatenate([np.frombuffer(coder.piece(first) if first else b"", "<u4"), values[upto[begins[i]] : upto[stops[i]]], end])


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
