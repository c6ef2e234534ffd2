"""Removal of repeated passages: anchors cut the work into shards, induced sorting finds the repeats.

Every window of ``LENGTH`` bytes has an anchor: the ``GRAM`` bytes in it with the least hash, the
leftmost of equal ones. Equal windows have equal anchors at equal places, so windows whose anchor occurs
only once are settled by a count. Neighbouring windows with the same anchor form a context. Equal
contexts are counted, not moved. Anchors with different contexts are dealt to shards by their hash; a
shard is the concatenation of its contexts, whose suffixes are sorted by :mod:`induced_sort`, and windows
that agree for ``LENGTH`` bytes stand next to each other there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tillwork.llm.common import U64, batches, mix64, signed, stage
from tillwork.llm.induced_sort import sorted_suffixes
from tillwork.operators.skew import own_shuffle

LENGTH, GRAM = 200, 40
SPREAD = LENGTH - GRAM + 1
#: Bytes of text that are scanned at a time; longer texts are scanned in pieces that overlap.
PIECE = 1 << 20
#: Bytes of contexts a shard is meant to hold. It sets the number of shards, not what is done.
SHARD = 2 << 20
#: Contexts of one anchor beyond which they are cut up and dealt out by their bytes, not sorted in one shard.
CROWD = 1000
#: Distances of window and anchor whose windows are asked together whether another context has some of them.
NEAR = 16
#: Distances of window and anchor that a part of such a context spans, from one cut to the next.
WIDTHS = (64, 16, 4, 1)

_BASE = U64(0x5851F42D4C957F2D)
_INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_SYMBOL = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Hashes:
    """Hashes of any part of a text from sums over its beginnings (modulo 2**64)."""

    def __init__(self, text: np.ndarray):
        ones = np.ones(len(text) + 1, U64)
        ones[1:] = _BASE
        power = np.multiply.accumulate(ones)
        ones[1:] = _INVERSE
        self.inverse = np.multiply.accumulate(ones)
        self.sums = np.zeros(len(text) + 1, U64)
        np.cumsum(_SYMBOL[text] * power[:-1], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start])


def contexts(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of a concatenation of texts that end at ``ends``, grouped by anchor.

    Returns for each context the first window, the number of windows, how far the anchor is from the first one,
    the anchor's hash and the hash of all its bytes.
    """
    if len(text) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    hashes = _Hashes(text)
    gram = mix64((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.inverse[: len(text) - GRAM + 1])
    value = (gram >> U64(32)).astype(np.uint32)
    place = np.arange(len(value), dtype=np.int32)
    width = 1
    while width < SPREAD:  # least of a doubled width from two of the width before
        by = min(width, SPREAD - width)
        smaller = value[by:] < value[:-by]
        # Where both parts overlap, the left one wins ties, so the leftmost place stays.
        value = np.where(smaller, value[by:], value[:-by])
        place = np.where(smaller, place[by:], place[:-by])
        width += by
    place = place[: len(text) - LENGTH + 1]
    whole = np.ones(len(place), bool)
    for end in ends[:-1].tolist():  # windows that reach into the next text
        whole[max(0, end - LENGTH + 1) : end] = False
    windows = np.flatnonzero(whole)
    if not len(windows):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    anchor = place[windows].astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1))
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(windows)))
    first, anchor = windows[heads], anchor[heads]
    left = anchor - first
    digest = hashes.part(first, first + count + LENGTH - 1) ^ (left.astype(U64) * U64(0x9E3779B97F4A7C15))
    return first, count, left, gram[anchor], digest


_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("anchor", pa.int64()),
        ("digest", pa.int64()),
        ("first", pa.int32()),
        ("n", pa.int32()),
        ("left", pa.int32()),
        ("again", pa.list_(pa.int32())),
    ]
)
_ROWS_SQL = "doc_id long, text_hash long, anchor long, digest long, first int, n int, left int, again array<int>"


def _once(owner: np.ndarray, anchor: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in an order that has equal ones together, where each kind begins in it, and how many it has."""
    key = digest + owner.astype(U64) * _BASE
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    same = key[order][1:] == key[order][:-1]
    for column in (owner, anchor, digest):
        same &= column[order][1:] == column[order][:-1]
    new[1:] = ~same
    heads = np.flatnonzero(new)
    return order, heads, np.diff(np.append(heads, len(order)))


def _anchor_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their contexts; one that a piece of a text holds at several places is one row with all of them."""
    for batch in batches(rows, PIECE):
        ids, hashes = batch["doc_id"], batch["text_hash"]
        pieces, owner, offset = [], [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            raw = text.encode("utf-8")
            for start in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                if len(raw) - start >= LENGTH:
                    pieces.append(np.frombuffer(raw, np.uint8)[start : start + PIECE + LENGTH - 1])
                    owner.append(i)
                    offset.append(start)
        done = 0
        while done < len(pieces):
            upto, size = done, 0
            while upto < len(pieces) and (upto == done or size + len(pieces[upto]) <= 2 * PIECE):
                size += len(pieces[upto])
                upto += 1
            ends = np.cumsum([len(p) for p in pieces[done:upto]])
            first, count, left, anchor, digest = contexts(np.concatenate(pieces[done:upto]), ends)
            piece = np.searchsorted(ends, first, "right")
            begins = np.append(0, ends[:-1])
            place = (first - begins[piece] + np.array(offset[done:upto])[piece]).astype(np.int32)
            order, heads, times = _once(piece, anchor, digest)
            one = order[heads]
            row = pa.array(np.array(owner[done:upto])[piece[one]], pa.int64())
            others = pa.array(np.append(0, np.cumsum(times - 1)).astype(np.int32))
            again = pa.ListArray.from_arrays(others, pa.array(place[np.delete(order, heads)]), mask=pa.array(times == 1))
            yield pa.record_batch(
                [
                    ids.take(row),
                    hashes.take(row),
                    pa.array(signed(anchor[one])),
                    pa.array(signed(digest[one])),
                    pa.array(place[one]),
                    pa.array(count[one].astype(np.int32)),
                    pa.array(left[one].astype(np.int32)),
                    again,
                ],
                schema=_ROWS,
            )
            done = upto


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the contexts wanted of them to rows with the contexts' bytes."""
    for batch in batches(rows, PIECE):
        out: dict[str, list] = {k: [] for k in ("anchor", "digest", "n", "left", "copies", "bytes")}
        for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            raw = text.encode("utf-8")
            for w in wanted:
                for k in ("anchor", "digest", "n", "left", "copies"):
                    out[k].append(w[k])
                out["bytes"].append(raw[w["first"] : w["first"] + w["n"] + LENGTH - 1])
        yield pa.record_batch(
            [
                pa.array(out["anchor"], pa.int64()),
                pa.array(out["digest"], pa.int64()),
                pa.array(out["n"], pa.int32()),
                pa.array(out["left"], pa.int32()),
                pa.array(out["copies"], pa.int64()),
                pa.array(out["bytes"], pa.binary()),
            ],
            names=list(out),
        )


def repeated_windows(parts: list[bytes], windows: np.ndarray, copies: np.ndarray, **limits) -> np.ndarray:
    """For each first byte of the concatenated ``parts``: does a window begin there that occurs twice?

    ``windows[i]`` windows of part ``i`` count, each ``copies[i]`` times; ``limits`` go to the sorter.
    """
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts), np.uint8).astype(np.uint16) + 2
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    text[starts[1:] - 1] = 1
    counts = np.zeros(len(text) + 1, np.int32)  # 0: no window begins here
    for s, n, c in zip(starts.tolist(), windows.tolist(), copies.tolist(), strict=True):
        counts[s : s + n] = min(c, 2)
    out = np.zeros(len(text) + 1, bool)
    kept: list[np.ndarray] = []  # a class of equal windows that may go on in the next block

    def settle(members: np.ndarray) -> None:
        if len(members) and counts[members].sum() >= 2:
            out[members[counts[members] > 0]] = True

    for suffixes, common in sorted_suffixes(text, LENGTH, **limits):
        breaks = np.flatnonzero(common < LENGTH)
        if not len(breaks):
            kept.append(suffixes)
            continue
        kept.append(suffixes[: breaks[0]])
        settle(np.concatenate(kept))
        inner = suffixes[breaks[0] : breaks[-1]]
        if len(inner):
            heads = breaks[:-1] - breaks[0]
            total = np.add.reduceat(counts[inner], heads)
            twice = np.repeat(total >= 2, np.diff(np.append(heads, len(inner))))
            out[inner[twice & (counts[inner] > 0)]] = True
        kept = [suffixes[breaks[-1] :]]
    settle(np.concatenate(kept))
    return out


def shared_windows(
    parts: list[bytes], anchors: np.ndarray, windows: np.ndarray, left: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """From and up to which window each part may share some with another one; equal if it shares none.

    Windows are taken together by their distance to the anchor, ``NEAR`` distances at a time. Those have some bytes
    in common, their core, and a window of another part that equals one of them lies in a block with the same anchor,
    distances and core. So only blocks whose core another part has too need to be sorted; equal hashes of cores that differ
    make some more of them.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    windows, left = windows.astype(np.int64), left.astype(np.int64)
    hashes = _Hashes(np.frombuffer(b"".join(parts), np.uint8))
    anchor_at = np.cumsum(sizes) - sizes + left
    nearest = left - windows + 1
    blocks = left // NEAR - nearest // NEAR + 1
    part = np.repeat(np.arange(len(parts)), blocks)
    first = np.cumsum(blocks) - blocks
    block = np.arange(len(part)) - first[part] + (nearest // NEAR)[part]
    start = anchor_at[part] - block * NEAR
    core = hashes.part(start, start + LENGTH - NEAR + 1)
    core += mix64(anchors.astype(np.int64).view(U64)[part] + block.astype(U64))
    order = np.argsort(core)
    equal = core[order][1:] == core[order][:-1]
    shared = np.zeros(len(core), bool)
    shared[order[1:][equal]] = shared[order[:-1][equal]] = True
    farthest = np.full(len(parts), -1)
    np.maximum.at(farthest, part[shared], block[shared])
    closest = np.full(len(parts), SPREAD)
    np.minimum.at(closest, part[shared], block[shared])
    begin = left - np.minimum(left, farthest * NEAR + NEAR - 1)
    stop = left - np.maximum(nearest, closest * NEAR) + 1
    none = farthest < 0
    begin[none] = stop[none] = 0
    return begin, stop


def _runs(marks: np.ndarray, offset: int = 0) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [{"s": offset + int(a), "n": int(b - a)} for a, b in edges.reshape(-1, 2)]


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))
_FOUND_SQL = "anchor long, digest long, runs array<struct<s int, n int>>"


def _sort_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's shard to the windows of its contexts that occur twice in it."""
    held = [b for b in rows if b.num_rows]
    if not held:
        return
    columns = {k: np.concatenate([b[k].to_numpy() for b in held]) for k in ("anchor", "digest", "n", "left", "copies")}
    parts = [x for b in held for x in b["bytes"].to_pylist()]
    del held
    windows, copies = columns["n"], columns["copies"]
    begin, stop = shared_windows(parts, columns["anchor"], windows, columns["left"])
    runs = [[{"s": 0, "n": n}] if c > 1 else [] for n, c in zip(windows.tolist(), copies.tolist(), strict=True)]
    sorted_ = np.flatnonzero(begin < stop)
    if len(sorted_):
        cut = [parts[i][begin[i] : stop[i] + LENGTH - 1] for i in sorted_.tolist()]
        found = repeated_windows(cut, (stop - begin)[sorted_], copies[sorted_])
        at = 0
        for i, part in zip(sorted_.tolist(), cut, strict=True):
            if copies[i] == 1:  # every window of the others occurs twice anyway
                runs[i] = _runs(found[at : at + len(part) - LENGTH + 1], int(begin[i]))
            at += len(part) + 1
    keep = np.array([bool(r) for r in runs])
    yield pa.record_batch(
        [
            pa.array(columns["anchor"][keep]),
            pa.array(columns["digest"][keep]),
            pa.array([r for r in runs if r], _RUNS),
        ],
        names=["anchor", "digest", "runs"],
    )


_PARTS_SQL = (
    "from_core long, from_whole long, shift int, core long, whole long, lo int, hi int, copies long, bytes binary"
)


def _split(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of contexts to smaller ones, cut where the distance of window and anchor is a multiple of ``width``.

    A part holds the windows whose anchor is ``lo`` to ``hi`` bytes from their start, and their bytes. Its core is what
    all windows at such distances have in common, so equal windows lie in parts with equal cores.
    """
    for batch in batches(rows, 1 << 20):
        out: dict[str, list] = {k: [] for k in ("row", "shift", "core", "whole", "lo", "hi", "bytes")}
        columns = [batch[k].to_pylist() for k in ("core", "lo", "hi", "bytes")]
        for row, (core, low, high, raw) in enumerate(zip(*columns, strict=True)):
            for block in range(low // width, high // width + 1):
                lo, hi = max(low, block * width), min(high, block * width + width - 1)
                part = raw[high - hi : high - lo + LENGTH]
                middle = part[hi - block * width :][: LENGTH - width + 1]
                out["row"].append(row)
                out["shift"].append(high - hi)
                out["core"].append(xxh3_64_intdigest(middle + block.to_bytes(2, "little"), core % (1 << 64)))
                out["whole"].append(xxh3_64_intdigest(part + lo.to_bytes(2, "little") + hi.to_bytes(2, "little")))
                out["lo"].append(lo)
                out["hi"].append(hi)
                out["bytes"].append(part)
        take = pa.array(out["row"], pa.int64())
        yield pa.record_batch(
            [
                batch["core"].take(take),
                batch["whole"].take(take),
                pa.array(out["shift"], pa.int32()),
                pa.array(signed(np.array(out["core"], U64))),
                pa.array(signed(np.array(out["whole"], U64))),
                pa.array(out["lo"], pa.int32()),
                pa.array(out["hi"], pa.int32()),
                batch["copies"].take(take),
                pa.array(out["bytes"], pa.binary()),
            ],
            names=["from_core", "from_whole", "shift", "core", "whole", "lo", "hi", "copies", "bytes"],
        )


def _crowded_repeats(parts: DataFrame) -> DataFrame:
    """``core, whole, runs`` of those ``parts(core, whole, lo, hi, copies, bytes)`` that hold repeated windows.

    Parts are cut into four, again and again. Equal ones become one with the sum of their copies; one that has
    its core to itself is settled by that sum, and only the others are cut further. So a part costs
    a few rows where it begins to differ from the others, instead of one row for each of its windows.
    """
    links, settled = [], []
    for width in WIDTHS:
        if parts.isEmpty():
            break
        cut = stage(parts.select("core", "whole", "lo", "hi", "copies", "bytes").mapInArrow(partial(_split, width=width), _PARTS_SQL))
        links.append(cut.select("from_core", "from_whole", "shift", "core", "whole"))
        equal = stage(
            cut.groupBy("core", "whole", "lo", "hi").agg(F.sum("copies").alias("copies"), F.any_value("bytes").alias("bytes"))
        )
        cores = equal.groupBy("core").agg((F.min("whole") != F.max("whole")).alias("mixed"))
        known = stage(equal.join(own_shuffle(cores), "core"))
        once = F.array(F.struct(F.lit(0).alias("s"), (F.col("hi") - F.col("lo") + 1).alias("n")))
        settled.append(known.where("not mixed and copies > 1").select("core", "whole", once.alias("runs")))
        parts = known.where("mixed")
    found = parts.sparkSession.createDataFrame([], "core long, whole long, runs array<struct<s int, n int>>")
    for link, here in zip(reversed(links), reversed(settled), strict=True):
        moved = F.transform("runs", lambda r: F.struct((r["s"] + F.col("shift")).alias("s"), r["n"].alias("n")))
        found = (
            link.join(own_shuffle(here.unionByName(found)), ["core", "whole"])
            .select(F.col("from_core").alias("core"), F.col("from_whole").alias("whole"), moved.alias("runs"))
            .groupBy("core", "whole")
            .agg(F.flatten(F.collect_list("runs")).alias("runs"))
        )
    return found


def _strip(rows: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts with their contexts' repeated windows to the bytes that are left."""
    for batch in batches(rows, PIECE):
        size, gone, spans, kept = [], [], [], []
        for text, hits in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int64)
            for hit in hits or ():
                for run in hit["runs"]:
                    for first in (hit["first"], *(hit["again"] or ())):
                        edge[first + run["s"]] += 1
                        edge[first + run["s"] + run["n"] + LENGTH - 1] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            size.append(len(raw))
            gone.append(int(covered.sum()))
            spans.append(_runs(covered))
            kept.append(raw[~covered].tobytes())
        if as_text:  # a character that lost some of its bytes goes altogether
            rest = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        else:
            rest = pa.array(kept, pa.binary())
        yield pa.record_batch(
            [
                batch["doc_id"],
                pa.array(size, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(spans, _RUNS),
                rest,
                *[batch[name] for name in batch.schema.names if name.startswith("_with_")],
            ],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept_text" if as_text else "kept_bytes"]
            + [name for name in batch.schema.names if name.startswith("_with_")],
        )


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_bytes`` for each row of ``docs(doc_id, text)``.

    Removed is each byte covered by a string of ``LENGTH`` bytes that starts anywhere else too, in this or
    another row; strings are judged on the input. ``spans`` are the maximal removed runs (start, length).
    A null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; rows that repeat, also with the
    same or no id, repeat each other's text. ``carry`` names further columns to hand through as ``_with_<name>``.
    With ``as_text``, ``kept_text`` stands in the place of ``kept_bytes``, without characters that lost bytes. An empty
    table gives no rows.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(f"_with_{c}") for c in carry],
    ).withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    rows = stage(docs.select(*key, "text").mapInArrow(_anchor_rows, _ROWS_SQL))
    # A text that holds a context often has one row for it, so the joins grow with the texts that hold one.
    places = 1 + F.coalesce(F.size("again"), F.lit(0))
    anchors = rows.groupBy("anchor").agg(
        F.sum(places).alias("places"), (F.min("digest") != F.max("digest")).alias("differ")
    )
    repeated = stage(rows.join(own_shuffle(anchors.where("places > 1").select("anchor", "differ")), "anchor"))
    differing = (
        repeated.where("differ")
        .groupBy("anchor", "digest", "n")
        .agg(F.sum(places).alias("copies"), F.min(F.struct(*key, "first", "left")).alias("at"))
    )
    differing = stage(differing)
    crowds = differing.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > CROWD)
    wanted = (
        differing.join(own_shuffle(crowds.select("anchor", F.lit(True).alias("crowded"))), "anchor", "left")
        .groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"))
        .agg(F.collect_list(F.struct("anchor", "digest", "n", "copies", "at.first", "at.left")).alias("wanted"))
    )
    holders = docs.select(*key, "text").join(
        wanted.withColumnRenamed("doc_id", "id"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (docs["text_hash"] == wanted["text_hash"]),
    )
    # Equal rows hold the same contexts; each context is cut from one of them only.
    cut = stage(
        holders.select("text", "wanted")
        .mapInArrow(_cut, "anchor long, digest long, n int, left int, copies long, bytes binary")
        .dropDuplicates(["anchor", "digest"])
        .join(own_shuffle(crowds.select("anchor", F.lit(True).alias("crowded"))), "anchor", "left")
    )
    size = cut.where("crowded is null").agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    sorted_ = (
        cut.where("crowded is null")
        .drop("crowded")
        .repartition(shards, "anchor")
        .mapInArrow(_sort_shard, _FOUND_SQL)
    )
    crowded = cut.where("crowded").select(
        F.col("anchor").alias("core"),
        F.col("digest").alias("whole"),
        (F.col("left") - F.col("n") + 1).alias("lo"),
        F.col("left").alias("hi"),
        "copies",
        "bytes",
    )
    counted = _crowded_repeats(crowded).toDF("anchor", "digest", "runs")
    found = stage(sorted_.unionByName(counted))
    hits = (
        repeated.where("differ")
        .join(own_shuffle(found), ["anchor", "digest"])
        .select(*key, F.struct("first", "again", "runs").alias("hit"))
        .unionByName(
            repeated.where("not differ").select(
                *key, F.struct("first", "again", F.array(F.struct(F.lit(0).alias("s"), "n")).alias("runs")).alias("hit")
            )
        )
    )
    # Rows with one id and text bring the same hits; each is gathered once.
    gathered = hits.groupBy(*key).agg(F.collect_set("hit").alias("hits"))
    both = docs.join(
        gathered.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "hits"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")),
        "left",
    ).drop("id", "hash", "text_hash")
    given = "".join(f", `_with_{c}` {docs.schema[f'_with_{c}'].dataType.simpleString()}" for c in carry)
    return both.mapInArrow(
        partial(_strip, as_text=as_text),
        "doc_id long, n_bytes long, n_removed long, spans array<struct<s int, n int>>, "
        + ("kept_text string" if as_text else "kept_bytes binary")
        + given,
    )
