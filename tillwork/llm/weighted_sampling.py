"""Document fingerprints by consistent weighted sampling.

The terms of a text are its lower-case words, weighted by how often they stand in it. For each coordinate a term
has two gamma variables r and c and a uniform b, all from a hash of the term. With t = floor(ln w / r + b), the
sample is the term with the least ln c - r (t - b) - r, together with its t. Two texts agree
in a coordinate with a probability equal to their generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tillwork.llm.common import U64, batches, mix64, stage

#: Coordinates, and bits that are kept of each; two different samples look alike in one of 65,536 cases.
COORDINATES = 128
#: Terms whose variables a worker remembers, at most; they take 2 KiB each.
CACHE = 50_000
#: Terms whose variables are made at once, so that they stay in a core's cache.
BLOCK = 128
_SPREAD = mix64(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0xD1342543DE82EF95))
_PLACES = (_SPREAD >> U64(32)).astype(np.uint32)
#: Tells the five uniform numbers of a term and coordinate apart.
_KINDS = (mix64(np.arange(1, 6, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def _mixed(seed: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """32 bits for each term and coordinate from both halves of the term's hash, into ``x``; ``y`` is scratch."""
    np.bitwise_xor(seed.astype(np.uint32)[:, None], _PLACES, out=x)
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=y)
    np.bitwise_xor(x, y, out=x)
    np.add(x, (seed >> U64(32)).astype(np.uint32)[:, None], out=x)


def _uniform(mixed: np.ndarray, kind: int, x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, in steps of 2^-23; ``x, y`` are scratch."""
    np.bitwise_xor(mixed, _KINDS[kind], out=x)
    np.multiply(x, np.uint32(0x846CA68B), out=x)
    np.right_shift(x, np.uint32(16), out=y)
    np.bitwise_xor(x, y, out=x)
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(9), out=x)
    np.bitwise_or(x, np.uint32(0x3F800000), out=x)  # the bits of a float from 1 to 2
    return np.subtract(x.view(np.float32), np.float32(1 - 2**-24), out=out)


def variables(seed: np.ndarray, out: np.ndarray) -> None:
    """``[r, b, ln c, ln a at weight 1]`` x terms x coordinates, into ``out``."""
    mixed, x, y = np.empty((3, min(BLOCK, len(seed)), COORDINATES), np.uint32)
    z = np.empty(x.shape, np.float32)
    for start in range(0, len(seed), BLOCK):
        n = min(BLOCK, len(seed) - start)
        r, b, c, a = (out[i, start : start + n] for i in range(4))
        _mixed(seed[start : start + n], mixed[:n], y[:n])
        for to, kind in ((r, 0), (c, 2)):
            _uniform(mixed[:n], kind, x[:n], y[:n], to)
            np.multiply(to, _uniform(mixed[:n], kind + 1, x[:n], y[:n], z[:n]), out=to)
            np.negative(np.log(to, out=to), out=to)
        np.log(c, out=c)
        _uniform(mixed[:n], 4, x[:n], y[:n], b)
        np.multiply(r, np.subtract(1, b, out=a), out=a)
        np.subtract(c, a, out=a)


class Sampler:
    """Fingerprints of weighted terms; the variables of frequent terms are remembered."""

    def __init__(self, cache: int = CACHE):
        self.cache = cache
        self.place: dict[bytes, int] = {}
        self.seeds = np.empty(cache, U64)
        self.uses = np.zeros(cache, np.int64)
        self.free = np.arange(cache)
        self.made = np.empty((4, BLOCK, COORDINATES), np.float32)
        self.known = np.empty((4, cache, COORDINATES), np.float32)

    def _make_room(self, wanted: int) -> None:
        """Forget the half of the terms that was used least, or all where that half is too small for ``wanted`` terms."""
        if self.cache // 2 + wanted > self.cache:
            self.place, self.free = {}, np.arange(self.cache)
            return
        held = np.fromiter(self.place.values(), np.int64, len(self.place))
        drop = held[np.argsort(self.uses[held], kind="stable")[: max(0, len(held) - self.cache // 2)]]
        gone = np.zeros(self.cache, bool)
        gone[drop] = True
        self.place = dict(compress(self.place.items(), (~gone[held]).tolist()))
        self.free = np.concatenate((self.free, np.sort(drop)))
        self.uses >>= 1

    def _variables(self, terms: list[bytes]) -> np.ndarray:
        """Where the variables of ``terms`` are. No more terms than the cache holds."""
        at = list(map(self.place.get, terms))
        if None in at:
            new = [t for t, i in zip(terms, at, strict=True) if i is None]
            if len(new) > len(self.free):
                self._make_room(len(terms))
                new = [t for t in terms if t not in self.place]
            slots, self.free = self.free[: len(new)], self.free[len(new) :]
            seeds = np.fromiter(map(xxh3_64_intdigest, new), U64, len(new))
            self.seeds[slots] = seeds
            self.uses[slots] = 0
            for start in range(0, len(new), BLOCK):
                some = slots[start : start + BLOCK]
                made = self.made[:, : len(some)]
                variables(seeds[start : start + BLOCK], made)
                for kind, values in zip(self.known, made, strict=True):
                    kind[some] = values
            self.place.update(zip(new, slots.tolist(), strict=True))
            at = list(map(self.place.get, terms))
        at = np.array(at)
        self.uses[at] += 1
        return at

    def _least(self, weights: dict[bytes, int], before: tuple | None = None) -> tuple:
        """For each coordinate the least value, its term's hash and its t, of ``weights`` and what ``before`` found."""
        if before is None:
            before = np.full(COORDINATES, np.inf, np.float32), np.zeros(COORDINATES, U64), np.zeros(COORDINATES, np.int64)
        least, chosen, scale = before
        terms, counts = list(weights), np.fromiter(weights.values(), np.float32, len(weights))
        for start in range(0, len(terms), min(2048, self.cache)):
            part = terms[start : start + min(2048, self.cache)]
            at = self._variables(part)
            weight = counts[start : start + len(part)]
            for some in (np.flatnonzero(weight == 1), np.flatnonzero(weight != 1)):
                if not len(some):
                    continue
                rows = at[some]
                if weight[some[0]] == 1:
                    value, t = self.known[3].take(rows, 0), None
                else:
                    r, b, value = (self.known[i].take(rows, 0) for i in range(3))
                    t = np.floor(np.log(weight[some])[:, None] / r + b)
                    value -= r * (t - b)
                    value -= r
                best = value.argmin(0)
                found = value[best, np.arange(COORDINATES)]
                seeds = self.seeds[rows[best]]
                # Equal values go to the smaller seed, in whichever order terms come.
                better = (found < least) | ((found == least) & (seeds < chosen))
                least = np.where(better, found, least)
                chosen = np.where(better, seeds, chosen)
                scale = np.where(better, 0 if t is None else t[best, np.arange(COORDINATES)].astype(np.int64), scale)
        return least, chosen, scale

    def sample(self, weights: dict[bytes, int]) -> np.ndarray:
        """Sixteen bits for each coordinate; all zero without terms."""
        return _bits(self._least(weights)) if weights else np.zeros(COORDINATES, np.uint16)

    def sample_both(self, one: dict[bytes, int], two: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`sample` of each; terms of equal weight in both are looked through once."""
        both = {t: w for t, w in one.items() if two.get(t) == w}
        if not both:
            return self.sample(one), self.sample(two)
        shared = self._least(both)
        rest = ({t: w for t, w in x.items() if t not in both} for x in (one, two))
        return tuple(_bits(self._least(x, shared)) for x in rest)


def _bits(found: tuple) -> np.ndarray:
    _, chosen, scale = found
    mixed = mix64(chosen + scale.astype(U64) * U64(0x9E3779B97F4A7C15) + _SPREAD)
    return (mixed >> U64(48)).astype(np.uint16)


def terms(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of coordinates that agree: the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of ``following`` (or all of it)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


#: Results (edge null), and for each task its first (edge 1) and last row (edge 2) with their texts.
_ROWS = (
    "doc_id long, n_chars long, edited_digest binary, own binary, other binary, near_edited double, "
    "near_next double, edge int, part int, text string"
)
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_digest", pa.binary()),
        ("own", pa.binary()),
        ("other", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("edge", pa.int32()),
        ("part", pa.int32()),
        ("text", pa.string()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _finished(doc_id, text: str, digest: bytes, own: np.ndarray, other: np.ndarray, mark: np.ndarray) -> tuple:
    near = likeness(own, other), likeness(own, mark)
    return (doc_id, len(text), digest, own.tobytes(), other.tobytes(), *near, None, None, None)


def _sorted_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in order, each finished with the one behind it; the ends are for :func:`_edge_rows`.

    A row is sampled with its edited text once the next text is there, and finished once that one is sampled.
    """
    sampler, part = Sampler(), TaskContext.get().partitionId()
    before = waiting = None
    for batch in batches(rows):
        out = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if before is not None:
                changed = edited(before[1], text)
                own, other = sampler.sample_both(terms(before[1]), terms(changed))
                if waiting is None:
                    out.append((before[0], None, None, own.tobytes(), None, None, None, 1, part, before[1]))
                else:
                    out.append(_finished(*waiting, own))
                waiting = (*before, _digest(changed), own, other)
            before = doc_id, text
        if out:
            yield _batch(out)
    if before is not None:
        doc_id, text = before
        own = sampler.sample(terms(text))
        first = (doc_id, None, None, own.tobytes(), None, None, None, 1, part, text)
        last = (doc_id, None, None, own.tobytes(), None, None, None, 2, part, text)
        yield _batch([first if waiting is None else _finished(*waiting, own), last])


def _edge_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(2048)
    for batch in batches(rows):
        columns = (batch[c].to_pylist() for c in ("doc_id", "text", "own", "next_text", "next_own"))
        out = []
        for doc_id, text, own, after, mark in zip(*columns, strict=True):
            changed = edited(text, after)
            marks = np.frombuffer(own, np.uint16), sampler.sample(terms(changed)), np.frombuffer(mark, np.uint16)
            out.append(_finished(doc_id, text, _digest(changed), *marks))
        yield _batch(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs(doc_id, text)``, and of its edited text; other columns are ignored.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the one that follows by descending id (after the last, the first). Rows without an id come
    last; equal ids go by the hash of their text, and a single row follows itself. A null text is empty. A text
    without words has a fingerprint of zeros, which is like another such text and hardly like any other. An empty
    table gives no rows.

    Rows are sorted by range, so each text moves once. What follows a task's last row is the first row
    of the next task: these few rows, one of each kind a task, are put together afterwards.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    done = stage(
        docs.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_sorted_rows, _ROWS)
    )
    firsts = done.where("edge = 1").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("own").alias("next_own")
    )
    # One number for each task that had rows.
    by_part = Window.orderBy("part")
    least = F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follows = done.where("edge = 1").select("part", F.coalesce(F.lead("part").over(by_part), least).alias("next_part"))
    edges = (
        done.where("edge = 2")
        .select("doc_id", "text", "own", "part")
        .join(follows, "part")
        .join(firsts, "next_part")
        .mapInArrow(_edge_rows, _ROWS)
    )
    return (
        done.where("edge is null")
        .unionByName(edges)
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("edited_digest")).alias("edited_sha256"),
            F.lower(F.hex("own")).alias("fingerprint"),
            F.lower(F.hex("other")).alias("edited_fingerprint"),
            "near_edited",
            "near_next",
        )
    )
