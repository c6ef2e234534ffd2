"""Byte-level BPE over overlapping chunks: pre-tokenise, stitch, encode the pieces, and decode.

A pre-token always begins where a space follows something that is no white space, so a text splits into
segments there and each segment is encoded by itself; frequent ones are remembered. A long text is first
cut into chunks that overlap, which are pre-tokenised in parallel. A chunk that begins in the middle of a
pre-token goes wrong at first. Where one of its boundaries in the overlap is also one of the
chunk before, both go on alike, and the pieces between these places are encoded in parallel.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import batches, stage

#: Code points of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 32768, 1024
#: Segments that a worker remembers at most, and the longest of them.
CACHE, LONGEST = 300_000, 48

_SPACED = re.compile(r"\s ")
_SEGMENT = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Segments(dict):
    """Ids (little-endian unsigned 32-bit) of `" " + segment`, made when first asked for.

    Where ``room`` segments are held, they become the older ones and those before them are forgotten; an older one
    that is asked for again is held anew. So a segment that comes often is made once.
    """

    def __init__(self, encode: Callable[[str], list[int]], room: int = CACHE // 2):
        self.encode, self.room = encode, room
        self.older: dict[str, bytes] = {}

    def ids(self, segment: str) -> bytes:
        ids = self.encode(segment)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, segment: str) -> bytes:
        found = self.older.get(segment)
        if found is None:
            found = self.ids(" " + segment)
        if len(segment) <= LONGEST:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[segment] = found
        return found

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if _SPACED.search(text):
            parts = _SEGMENT.split(text)
            return b"".join([self[p[1:]] if p[:1] == " " else self.ids(p) for p in parts])
        first, *parts = text.split(" ")
        return (self.ids(first) if first else b"") + b"".join(map(self.__getitem__, parts))


@lru_cache(maxsize=4)
def _segments(path: str, pattern: str) -> Segments:
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return Segments(encoding.encode_ordinary)


@lru_cache(maxsize=4)
def _tokens(path: str) -> list[bytes]:
    by_rank = {rank: token for token, rank in ranks(path).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Where pre-tokens begin if ``text`` begins with one."""
    return np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)


def _encode_rows(rows: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    segments = _segments(path, pattern)
    for batch in batches(rows, 2 << 20):
        ids = pa.array([segments.text(t) for t in batch["text"].to_pylist()], pa.binary())
        yield pa.record_batch([*[c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "text"], ids],
                              names=[*[f.name for f in batch.schema if f.name != "text"], "ids"])


def _chunk_rows(rows: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for first in range(0, len(text), 64 * chunk):  # some chunks at a time
                starts = range(first, min(len(text), first + 64 * chunk), chunk)
                yield pa.record_batch(
                    [
                        pa.array([row] * len(starts), pa.int64()),
                        pa.array([s // chunk for s in starts], pa.int64()),
                        pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()),
                    ],
                    names=["row", "no", "text"],
                )


def _boundary_rows(rows: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks with their boundaries in the overlap with the chunk before (head) and the one after (tail)."""
    for batch in batches(rows, 2 << 20):
        head, tail = [], []
        for no, text in zip(batch["no"].to_pylist(), batch["text"].to_pylist(), strict=True):
            at = boundaries(text, pattern)
            head.append(at[at < overlap] + no * chunk if no else np.empty(0, np.int64))
            tail.append(at[(at >= chunk) & (at > 0)] + no * chunk)
        kind = pa.list_(pa.int64())
        yield pa.record_batch(
            [batch["row"], batch["no"], batch["text"], pa.array(head, kind), pa.array(tail, kind)],
            names=["row", "no", "text", "head", "tail"],
        )


def _join_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = [b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["no"])) for parts in batch["parts"].to_pylist()]
        yield pa.record_batch([batch["row"], pa.array(ids, pa.binary())], names=["row", "ids"])


def _encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``row, ids`` of ``texts(row, text)`` by chunks."""
    chunks = stage(
        texts.mapInArrow(partial(_chunk_rows, chunk=chunk, overlap=overlap), "row long, no long, text string")
        .repartition("row", "no")
        .mapInArrow(
            partial(_boundary_rows, pattern=pattern, chunk=chunk, overlap=overlap),
            "row long, no long, text string, head array<long>, tail array<long>",
        )
    )
    # A text's chunks come together as small rows: their boundaries in the overlaps.
    by_text = Window.partitionBy("row").orderBy("no")
    met = chunks.select("row", "no", "head", "tail").withColumn("next", F.lead("head").over(by_text))
    cuts = met.select(
        "row",
        "no",
        F.array_min(F.array_intersect("tail", "next")).alias("stop"),
        F.col("next").isNull().alias("last"),
    )
    torn = cuts.groupBy("row").agg(F.max(F.col("stop").isNull() & ~F.col("last")).alias("torn"))
    placed = cuts.withColumn("start", F.coalesce(F.lag("stop").over(by_text), F.lit(0))).join(torn, "row")
    pieces = (
        chunks.select("row", "no", "text")
        .join(placed.where("not torn"), ["row", "no"])
        .select(
            "row",
            "no",
            F.expr(
                f"substring(text, cast(start - no * {chunk} + 1 as int), "
                "cast(coalesce(stop - start, length(text)) as int))"
            ).alias("text"),
        )
    )
    encode = partial(_encode_rows, path=path, pattern=pattern)
    stitched = (
        pieces.mapInArrow(encode, "row long, no long, ids binary")
        .groupBy("row")
        .agg(F.collect_list(F.struct("no", "ids")).alias("parts"))
        .mapInArrow(_join_rows, "row long, ids binary")
    )
    # Chunks that never agree, as in a text without any boundary: such a text is encoded whole.
    whole = texts.join(torn.where("torn").select("row"), "row", "left_semi").mapInArrow(encode, "row long, ids binary")
    return stitched.unionByName(whole)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    ``ids`` are little-endian unsigned 32-bit integers, as the tiktoken library gives them for the rank file at
    ``path``, without special tokens: their strings are ordinary text. A null or empty text has no ids. Rows that
    repeat, or have no id, are encoded each. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= chunk).mapInArrow(
        partial(_encode_rows, path=path, pattern=pattern), "doc_id long, ids binary"
    )
    long = stage(docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    if long.isEmpty():
        return short
    ids = _encode_long(long.select("row", "text"), path, pattern, chunk, overlap)
    return short.unionByName(long.select("doc_id", "row").join(ids, "row").select("doc_id", "ids"))


def _decode_rows(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    for batch in batches(rows, 2 << 20):
        raw = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch["ids"].to_pylist()]
        yield pa.record_batch([batch["doc_id"], batch["ids"], pa.array(raw, pa.binary())], names=["doc_id", "ids", "raw"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` with ``raw``, the bytes of the ids, one after the other."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode_rows, path=path), "doc_id long, ids binary, raw binary"
    )
