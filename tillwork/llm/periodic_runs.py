"""Periodic runs of words by block convolution, and texts with their repetitions collapsed.

A run is a maximal stretch of words with smallest period ``q`` that is at least ``max(12, 2 * q)`` words long. At each
dyadic scale ``B`` the words are cut into blocks of ``B``. A run whose period lies in ``[2B - 1, 4B - 2]`` contains a
whole block within its first period (from 1 on at the first scale, ``B = 2``, as 12 words leave room there), so this
block stands again one period later. Where a block stands again in the window behind it is where the sum of squared
differences is zero. That sum is a convolution, done exactly with a number theoretic transform. Each distance found is
a seed: it is compared word by word to both sides, as far as words that far apart are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import batches

#: The least length of a run in words, whatever its period. The first scale relies on it.
LEAST = 12
#: A prime with roots of unity of every order up to 2 to the 30th, and a generator of its residues.
PRIME, GENERATOR = np.uint64(3 * 2**30 + 1), 5
#: Numbers in a transformed matrix, and in one of compared words.
CELLS = 1 << 19

U64 = np.uint64


@lru_cache(maxsize=64)
def _powers(order: int, inverse: bool) -> np.ndarray:
    """The first ``order / 2`` powers of a root of unity of that order (or of its inverse)."""
    prime = int(PRIME)
    root = pow(GENERATOR, (prime - 1) // order, prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(1, U64)
    while len(out) < order // 2:
        out = np.concatenate([out, out * U64(pow(root, len(out), prime)) % PRIME])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row, in place; the result's order is bit-reversed."""
    rows, n = x.shape
    half = n // 2
    while half:
        pairs = x.reshape(rows, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        difference = (a + (PRIME - b)) % PRIME * _powers(2 * half, False) % PRIME
        a[...] = (a + b) % PRIME
        b[...] = difference
        half //= 2
    return x


def back(x: np.ndarray) -> np.ndarray:
    """The rows that :func:`transform` made ``x`` of, in place."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        turned = b * _powers(2 * half, True) % PRIME
        b[...] = (a + (PRIME - turned)) % PRIME
        a[...] = (a + turned) % PRIME
        half *= 2
    x *= U64(pow(n, -1, int(PRIME)))
    x %= PRIME
    return x


def _again(codes: np.ndarray, blocks: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the distances from ``least`` to ``4 * size - 2`` at which all their codes stand again.

    All sums stay below the prime, so they are exact. ``codes`` go on far enough behind the last block.
    """
    n, most = 4 * size, 4 * size - 2
    count = most - least + 1
    found_at, found = [], []
    for first in range(0, len(blocks), max(1, CELLS // n)):
        at = blocks[first : first + max(1, CELLS // n)]
        own = np.zeros((len(at), n), U64)
        block = codes[at[:, None] + np.arange(size)]
        own[:, 0] = block[:, 0]
        own[:, n - size + 1 :] = block[:, :0:-1]  # turned round, so that the product is a correlation
        window = np.zeros((len(at), n), U64)
        window[:, : count + size - 1] = codes[at[:, None] + np.arange(least, most + size)]
        sums = np.zeros((len(at), n + 1), U64)
        np.cumsum(window * window, axis=1, out=sums[:, 1:])
        squares = (block * block).sum(axis=1)[:, None] + sums[:, size : size + count] - sums[:, :count]
        products = back(transform(own) * transform(window) % PRIME)[:, :count]
        row, shift = np.nonzero(squares == products * U64(2))  # the squared differences add up to nothing
        found_at.append(at[row])
        found.append(shift + least)
    return np.concatenate(found_at), np.concatenate(found)


def _same(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """For how many words from ``at`` on (or back from it) the word ``distance`` further is the same."""
    out = np.zeros(len(at), np.int64)
    active, width = np.arange(len(at)), 8
    while active.size:
        open_ = []
        for first in range(0, len(active), max(1, CELLS // width)):
            part = active[first : first + max(1, CELLS // width)]
            place = at[part, None] + step * (out[part, None] + np.arange(width))
            far = np.clip(place + distance[part, None], 0, len(words) - 1)
            differ = words[np.clip(place, 0, len(words) - 1)] != words[far]
            some = differ.any(axis=1)
            out[part] += np.where(some, differ.argmax(axis=1), width)
            open_.append(part[~some])
        active, width = np.concatenate(open_), min(2 * width, CELLS)
    return out


def runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of ``words``, by start and then period.

    ``words`` are numbers from 0 on. ``longest`` bounds the length of a run (of texts that lie one after the other and
    share no number, the length of the longest).
    """
    n = len(words)
    scales, size = [], 2
    while n and (size == 2 or 2 * (2 * size - 1) <= longest):
        scales.append(size)
        size *= 2
    if longest < LEAST:
        scales = []
    order = np.argsort(words, kind="stable")
    same = words[order][1:] == words[order][:-1]
    gap = np.full(n, n + 1, np.int64)  # to the next place of the same word
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    behind = 5 * scales[-1] if scales else 0
    # One number before and others behind that no word has.
    padded = np.concatenate([[-2], words, np.full(behind, -1)]).astype(np.int64)
    mixed = padded.astype(U64) * U64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> U64(29)
    mixed *= U64(0xBF58476D1CE4E5B9)
    known = np.empty((0, 3), np.int64)  # first and last word's end in padded places, and the period
    for size in scales:
        least, most = (1 if size == 2 else 2 * size - 1), 4 * size - 2
        gap = gap[: len(gap) // 2 * 2].reshape(-1, 2).max(axis=1)
        blocks = np.flatnonzero(gap <= most) * size + 1  # every word stands again near enough
        # Where a block and its copies lie in a run of a period up to its size, they are multiples of that apart.
        reach = np.zeros(len(padded) + 1, np.int64)
        small = known[known[:, 2] <= size]
        np.maximum.at(reach, small[:, 0], small[:, 1])
        reach = np.maximum.accumulate(reach)
        blocks = blocks[reach[blocks] < blocks + most + size]
        if not blocks.size:
            continue
        bits = (31 - (size.bit_length() - 1)) // 2
        at, distance = _again(mixed >> U64(64 - bits), blocks, size, least)
        fresh = reach[at] < at + distance + size
        at, distance = at[fresh], distance[fresh]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        new = np.ones(len(at), bool)  # blocks side by side with one distance are one seed
        new[1:] = (np.diff(at) != size) | (np.diff(distance) != 0)
        at, distance = at[new], distance[new]
        start = at - _same(padded, at - 1, distance, -1)
        end = at + _same(padded, at, distance, 1) + distance
        long = end - start >= np.maximum(LEAST, 2 * distance)
        known = np.concatenate([known, np.stack([start, end, distance], axis=1)[long]])
        # A stretch that has a smaller period, too, was found with that one as well.
        known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
        known = known[np.concatenate([[True], (np.diff(known[:, :2], axis=0) != 0).any(axis=1)])] if len(known) else known
    known = known[np.lexsort((known[:, 2], known[:, 0]))]
    return known[:, 0] - 1, known[:, 1] - known[:, 0], known[:, 2]


def _run_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a batch lie one after the other; each has word numbers of its own, so nothing matches across."""
    for batch in batches(rows, 1 << 20):
        texts = [t.encode().split() for t in batch["text"].to_pylist()]  # at ASCII white space
        numbers, ends, used = [], [0], 0
        for text in texts:
            known: dict[bytes, int] = {}
            numbers.append(np.array([known.setdefault(w, len(known)) for w in text], np.int64) + used)
            used += len(known)
            ends.append(ends[-1] + len(text))
        flat = np.concatenate(numbers)
        start, length, period = runs(flat, max(map(len, texts)))
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        first = np.searchsorted(start, ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        collapsed = []
        for k, text in enumerate(texts):
            if first[k] < first[k + 1]:
                text = [text[i] for i in np.flatnonzero(kept[ends[k] : ends[k + 1]])]
            collapsed.append(b" ".join(text).decode())
        found = pa.StructArray.from_arrays(
            [pa.array(start - np.array(ends)[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"]
        )
        yield pa.record_batch(
            [
                batch["doc_id"],
                pa.array(list(map(len, texts)), pa.int64()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), found),
                pa.array(collapsed, pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    Words are what stands between ASCII white space. ``runs`` has start, length and period of every run by start and
    then period, all in words. ``collapsed`` has the words that no run has after its first period, with one space
    between. A null or empty text has no words, no runs and an empty ``collapsed``. Rows that repeat, or have no id, are
    worked on each. A very long text is worked on whole, with some numbers per word. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _run_rows, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def longest(runs: Column) -> Column:
    """The longest run (of equal ones the first, then the one of the smallest period) as length, -start and -period."""
    return F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )


def listed(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line break."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which the words of every tenth document repeat from some word on.

    With ``h`` the CRC-32 of the id's decimal text (of the empty text for a null id) and ``g = h // 10``, these are the
    documents with ``h % 10 = 0``. Of ``n`` words, those from ``a = g % n`` on become the ``p = 1 + (n - a) // (3 + g % 8)``
    words from there, again and again. Other texts, and texts without words, stay as they are; a null text becomes empty.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    edited = (
        picked.withColumn("words", F.when(F.col("h") % 10 == 0, words))
        .withColumn("n", F.size("words"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    )
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    return edited.select(
        "doc_id",
        F.expr(f"case when n > 0 then array_join(concat(slice(words, 1, a), {tail}), ' ') else text end").alias("text"),
    )
