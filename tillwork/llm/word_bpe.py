"""BPE with word ends over a contiguous rank array: normalise, cut into words, merge, and decode.

A word is one row of part boundaries and the ranks of its adjacent parts. The least rank is looked for, the boundary
between its two parts is deleted, and the ranks on both sides are looked up anew, until no pair of parts has a rank.
Frequent words are remembered. Scanning is quadratic in a word's length, so words beyond ``SHORT`` symbols find the
least rank with a heap over the same boundaries.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwork.llm.common import batches

#: Symbols of a word whose ranks are scanned.
SHORT = 64
#: Words that a worker remembers at most, and the longest of them.
CACHE, LONGEST = 400_000, 48
#: Code points that are worked on at a time, from one space to another.
BLOCK = 1 << 18

NONE = sys.maxsize
#: Below this code point letters, numbers and cases are the same everywhere, but for the separators 1C to 1F and
#: letters whose small form lies above.
PLAIN_END = 0x558
_ABOVE = "".join(chr(c) for c in range(PLAIN_END) if max(chr(c).lower()) >= chr(PLAIN_END))
_UNSURE = re.compile(rf"[\x1c-\x1f{_ABOVE}{chr(PLAIN_END)}-{chr(sys.maxunicode)}]")


def _ranges(kind: str) -> str:
    """Code points below ``PLAIN_END`` whose category begins with ``kind``, for a character class."""
    return "".join(rf"\u{c:04x}" for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


_WORD = re.compile(rf"[{_ranges('L')}]+|'(?:[stmd]|re|ve|ll)|[{_ranges('N')}]|[^\s{_ranges('L')}{_ranges('N')}]+")


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge(word: str, ends: int, order: dict[tuple[str, str], int]) -> list[int]:
    """Boundaries of the parts of ``word`` that are left when all merges are done.

    ``word`` has ``ends`` symbols of one character; the last one also holds the word's end mark.
    """
    bounds = [*range(ends), len(word)]
    if ends > SHORT:
        return _merge_long(word, bounds, order)
    rank = order.get
    ranks = [rank((word[a:b], word[b:c]), NONE) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        del bounds[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), NONE)
        if i < len(ranks):
            ranks[i] = rank((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NONE)
    return bounds


def _merge_long(word: str, bounds: list[int], order: dict[tuple[str, str], int]) -> list[int]:
    """The same with a heap of ranks; ``after`` and ``before`` lead from boundary to boundary."""
    n = len(bounds) - 1
    after, before = [*range(1, n + 1), n], [-1, *range(n)]
    current = [NONE] * (n + 1)
    heap: list[tuple[int, int]] = []

    def look(i: int) -> None:
        j = after[i]
        pair = (word[bounds[i] : bounds[j]], word[bounds[j] : bounds[after[j]]])
        current[i] = order.get(pair, NONE) if j < n else NONE
        if current[i] != NONE:
            heapq.heappush(heap, (current[i], i))

    for i in range(n):
        look(i)
    while heap:
        least, i = heapq.heappop(heap)
        if current[i] != least:
            continue
        j = after[i]
        current[j] = NONE
        after[i] = after[j]
        before[after[j]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    left, i = [0], 0
    while i < n:
        i = after[i]
        left.append(bounds[i])
    return left


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of words, made when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.order = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.specials = {t["content"]: struct.pack("<I", t["id"]) for t in described["added_tokens"]}
        marks = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer

    def shown(self, word: str) -> bytes:
        """Ids of a word written in visible characters."""
        whole = word + self.suffix
        bounds = merge(whole, len(word), self.order)
        ids = [self.vocabulary.get(whole[a:b], -1) for a, b in zip(bounds, bounds[1:], strict=False)]
        if -1 in ids:  # a symbol that the vocabulary lacks gets no id
            ids = [i for i in ids if i >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        found = self.shown("".join([self.symbols[b] for b in word.encode()]))
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. What isn't surely plain is cut into words by the library."""
        if _UNSURE.search(text):
            return b"".join([self.plain(t) if not _UNSURE.search(t) else self.rare(t) for t in text.split(" ")])
        # A capital sigma gets one small form wherever it stands.
        lower = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return b"".join(map(self.__getitem__, _WORD.findall(lower)))

    def rare(self, text: str) -> bytes:
        return b"".join([self.shown(w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def text(self, text: str) -> bytes:
        """Ids of a whole text, block by block: no word and no special token goes across a space."""
        out, start = [], 0
        while start < len(text):
            stop = text.find(" ", start + BLOCK) if len(text) - start > BLOCK else -1
            block = text[start : stop if stop >= 0 else len(text)]
            start += len(block)
            parts = self.special.split(block) if self.special else [block]
            out += [self.specials[p] if i % 2 else self.plain(p) for i, p in enumerate(parts)]
        return b"".join(out)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[str]:
    known = words(path)
    by_id = {i: t for t, i in known.vocabulary.items()}
    by_id |= {int(np.frombuffer(i, "<u4")[0]): t for t, i in known.specials.items()}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _encode_rows(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = words(path)
    for batch in batches(rows, 2 << 20):
        ids = pa.array([known.text(t) for t in batch["text"].to_pylist()], pa.binary())
        yield pa.record_batch([batch["doc_id"], ids], names=["doc_id", "ids"])


def _decode_rows(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    for batch in batches(rows, 2 << 20):
        text = [" ".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch["ids"].to_pylist()]
        yield pa.record_batch([batch["doc_id"], batch["ids"], pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    ``ids`` are little-endian unsigned 32-bit integers, as the tokenizers library gives them for the file at ``path``
    without special tokens at the ends; the strings of special tokens within a text are those tokens. A null or empty
    text has no ids. Rows that repeat, or have no id, are encoded each. A very long text is worked on in blocks from
    space to space; only a text without spaces is held as one block. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        partial(_encode_rows, path=path), "doc_id long, ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` with ``decoded``: the tokens' strings with a space between, as the file names no decoder."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode_rows, path=path), "doc_id long, ids binary, decoded string"
    )
