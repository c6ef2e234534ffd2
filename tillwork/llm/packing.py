"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document is cut into full sequences and a rest. Rests fall into classes of ``GRAIN`` tokens. A
linear program over patterns of classes uses as few sequences as can be; new patterns come from its prices by
a knapsack over the classes. Patterns are rounded down, what is left over is placed first-fit, and the
documents of a class take the places of its patterns by their rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwork.llm.byte_bpe import Segments, _segments
from tillwork.llm.common import batches, stage
from tillwork.operators.skew import own_shuffle

SEQUENCE, GRAIN, END = 2048, 8, 1
#: Column generation stops when no pattern could save more than this share of the sequences.
GAP = 1e-3
SPECIAL = "<|endoftext|>"
#: Segments that a worker remembers, and as many older ones.
ROOM = 300_000
#: Characters that both libraries see alike: line ends, printable ones up to U+024F.
_PLAIN = re.compile("[\n -~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch


@lru_cache(maxsize=4)
def token_segments(path: str, rank_path: str, pattern: str) -> Segments:
    """Ids as the tokenizers library gives them for the file at ``path`` without added special tokens.

    Segments of plain letters and signs are encoded from the same vocabulary's rank file, which takes a fraction
    of the time; whatever the two libraries might see differently goes through tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    quick = _segments(rank_path, pattern).encode

    def ids(segment: str) -> list[int]:
        if _PLAIN(segment) and SPECIAL not in segment:
            return quick(segment)
        return tokenizer.encode(segment, add_special_tokens=False).ids

    return Segments(ids, ROOM)


def solve(counts: np.ndarray, room: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """The linear program: ``counts[c]`` items of size ``c`` into bins of ``room``; patterns and how often.

    Revised simplex with generated columns. It starts with patterns of one class; prices of classes are the
    duals, and the dearest pattern by them enters while it beats the price of a bin by more than ``gap``.
    """
    sizes = np.flatnonzero(counts)
    m = len(sizes)
    if not m:
        return []
    patterns = [{int(c): room // int(c)} for c in sizes]
    inverse = np.diag(1.0 / (room // sizes))
    level = inverse @ counts[sizes].astype(float)
    at = {int(c): i for i, c in enumerate(sizes)}
    enough = (1 + gap) * float(sizes @ counts[sizes]) / room  # no solution can use fewer than all items fill
    for _ in range(50 * m + 100):
        if level.sum() <= enough:
            break
        prices = np.maximum(inverse.sum(0), 0)
        best = np.zeros(room + 1)
        taken = np.full(room + 1, -1)
        for c in range(1, room + 1):
            upto = np.searchsorted(sizes, c, "right")
            best[c] = best[c - 1]
            if upto:
                worth = prices[:upto] + best[c - sizes[:upto]]
                i = int(worth.argmax())
                if worth[i] > best[c]:
                    best[c], taken[c] = worth[i], i
        if best[room] <= 1 + gap:
            break
        pattern: dict[int, int] = {}
        c = room
        while c > 0:
            if taken[c] < 0:
                c -= 1
                continue
            size = int(sizes[taken[c]])
            pattern[size] = pattern.get(size, 0) + 1
            c -= size
        column = np.zeros(m)
        for size, n in pattern.items():
            column[at[size]] = n
        direction = inverse @ column
        ratio = np.full(m, np.inf)
        up = direction > 1e-9
        ratio[up] = level[up] / direction[up]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= direction[out]
        step = level[out] / direction[out]
        others = direction.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        level = np.maximum(level - step * direction, 0)
        level[out] = step
        patterns[out] = pattern
    return list(zip(patterns, level.tolist(), strict=True))


def plan(counts: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and whole numbers of sequences that use up ``counts`` exactly."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []
    if left[room]:  # full sequences need no pattern of others
        out.append(({room: 1}, int(left[room])))
        left[room] = 0
    for pattern, often in sorted(solve(left, room), key=lambda p: p[1] % 1):
        whole = min([int(often + 1e-6)] + [int(left[c]) // n for c, n in pattern.items()])
        if whole:
            out.append((pattern, whole))
            for c, n in pattern.items():
                left[c] -= whole * n
    # What rounding leaves is less than a sequence for each class: first fit, large ones first.
    open_: list[tuple[int, dict[int, int]]] = []
    for c in np.flatnonzero(left)[::-1].tolist():
        for _ in range(int(left[c])):
            i = next((i for i, (free, _) in enumerate(open_) if free >= c), None)
            if i is None:
                open_.append((room - c, {c: 1}))
            else:
                free, pattern = open_[i]
                pattern[c] = pattern.get(c, 0) + 1
                open_[i] = (free - c, pattern)
    return out + [(pattern, 1) for _, pattern in open_]


def places(planned: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by class with the sequences they go to, sorted by (class, first rank)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, often in planned:
        for c in sorted(pattern, reverse=True):
            rows.append((c, used.get(c, 0), first, pattern[c]))
            used[c] = used.get(c, 0) + often * pattern[c]
        first += often
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("size", "rank", "first", "each"))}


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, class long, k long"
)


def _piece_rows(rows: Iterator[pa.RecordBatch], files: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    segments = token_segments(*files)
    part = TaskContext.get().partitionId()
    seen = np.zeros(SEQUENCE // GRAIN + 1, np.int64)  # pieces of each class in this task so far
    end = np.array([END], "<u4").tobytes()
    for batch in batches(rows, 2 << 20):
        out: list[tuple] = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids = segments.text(text) + end
            n = len(ids) // 4
            for start in range(0, n, SEQUENCE):
                piece = ids[4 * start : 4 * (start + SEQUENCE)]
                size = -(-len(piece) // (4 * GRAIN))
                out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, part, size, int(seen[size])))
                seen[size] += 1
        names = [x.split()[0] for x in _PIECES.split(", ")]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)


def _place_rows(rows: Iterator[pa.RecordBatch], where: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    key = where["size"] << 48 | where["rank"]
    for batch in rows:
        size, rank = batch["class"].to_numpy(), batch["rank"].to_numpy()
        i = np.searchsorted(key, size << 48 | rank, "right") - 1
        over = rank - where["rank"][i]
        sequence = where["first"][i] + over // where["each"][i]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.record_batch(
            [*[batch[n] for n in names], pa.array(sequence), pa.array(-size << 20 | over % where["each"][i])],
            names=[*names, "sequence_id", "slot"],
        )


def pack(docs: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their places: one row for each piece.

    ``files`` are the paths of the tokenizer and of the same vocabulary's ranks, and the pattern of the latter.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document's last id is ``END``,
    so a null or empty text is one piece of one token. Documents are cut at multiples of ``SEQUENCE`` only. Rows that
    repeat or have no id are documents of their own. An empty table gives no rows. The driver gets the number
    of pieces by class (``SEQUENCE / GRAIN`` numbers) and nothing else.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stage(texts.mapInArrow(partial(_piece_rows, files=files), _PIECES))
    per_part = stage(pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(SEQUENCE // GRAIN + 1, np.int64)
    for row in per_part.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[row["class"]] = row["n"]
    where = places(plan(counts, SEQUENCE // GRAIN))
    # A piece's rank in its class: those of the tasks before it, and its number in its own task.
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")
    ranked = pieces.join(
        own_shuffle(per_part.select("part", "class", before.alias("before"))), ["part", "class"]
    ).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.mapInArrow(
        partial(_place_rows, where=where),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long",
    )
    earlier = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", earlier).drop("slot")
