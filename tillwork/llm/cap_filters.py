"""Near-duplicate vectors by spherical-cap filters from random product codes.

A vector's coordinates fall into two blocks, and each block has ``CODES`` random directions. A filter is one
direction from each block; its centre is their sum. A vector's cap is as high as lets it reach
``LIST`` filters. List decoding sorts each block's scores and adds up only the combinations of leading ones, among
which these filters must be, so the others are never tried. Vectors that share a filter are compared in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import batches, stage
from tillwork.llm.components import components
from tillwork.operators.skew import own_shuffle

COSINE = 0.93
#: 256 directions in each of two blocks make 65,536 filters. At a cosine of 0.93 a pair of vectors of 64 random
#: coordinates shares about 20 of its 48 filters each, and none of them in less than one case of a thousand.
CODES, LIST, SEED = 256, 48, 20240229
#: Members of a filter that are compared in one go; more are dealt out as pairs of such blocks.
BLOCK = 512


@lru_cache(maxsize=8)
def codes(dimension: int) -> list[np.ndarray]:
    """Unit directions of each block of the coordinates."""
    out = []
    for block, part in enumerate(np.array_split(np.arange(dimension), 2)):
        directions = np.random.default_rng([SEED, dimension, block]).standard_normal((CODES, max(1, len(part))))
        out.append((directions / np.linalg.norm(directions, axis=1, keepdims=True))[:, : len(part)])
    return out


@lru_cache(maxsize=1)
def _leading() -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) that can be among the ``LIST`` largest sums: (i + 1)(j + 1) combinations are at least as large."""
    i, j = np.divmod(np.arange(min(CODES, LIST) ** 2), min(CODES, LIST))
    inside = (i + 1) * (j + 1) <= LIST
    return i[inside], j[inside]


def filters(units: np.ndarray) -> np.ndarray:
    """The filters of unit vectors, one ascending row of ``LIST`` for each."""
    i, j = _leading()
    ranks, best = [], []
    for code, part in zip(codes(units.shape[1]), np.array_split(units, 2, axis=1), strict=True):
        scores = part @ code.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :LIST]
        ranks.append(order)
        best.append(np.take_along_axis(scores, order, 1))
    sums = best[0][:, i] + best[1][:, j]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :LIST]
    return np.sort(np.take_along_axis(ranks[0][:, i] * CODES + ranks[1][:, j], top, 1), axis=1)


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None where it links with nothing."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    most = np.abs(x).max(initial=0)
    if not np.isfinite(x).all() or most == 0:
        return None
    x = x / most
    return x / np.sqrt((x * x).sum())


def _vector_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, with a digest of label and vector."""
    for batch in batches(rows):
        kind = "<f4" if batch["embedding"].type.value_type == pa.float32() else "<f8"
        raw, digest = [], []
        for label, vector in zip(batch["label"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            usable = label is not None and unit(vector) is not None
            raw.append(np.array(vector, kind).tobytes() if usable else None)
            digest.append(hashlib.md5(f"{label} {kind} ".encode() + raw[-1]).digest() if usable else None)
        width = pa.array([int(kind[-1])] * batch.num_rows, pa.int32())
        yield pa.record_batch(
            [batch["vec_id"], batch["label"], pa.array(raw, pa.binary()), width, pa.array(digest, pa.binary())],
            names=["vec_id", "label", "vector", "width", "digest"],
        )


def _units(raw: list[bytes], width: np.ndarray) -> np.ndarray:
    return np.stack([unit(np.frombuffer(x, f"<f{w}").tolist()) for x, w in zip(raw, width.tolist(), strict=True)])


def _filter_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 1 << 20):
        raw, width = batch["vector"].to_pylist(), batch["width"].to_numpy()
        size = np.array([len(x) for x in raw]) // width
        for dimension in np.unique(size).tolist():
            at = np.flatnonzero(size == dimension)
            own = filters(_units([raw[k] for k in at.tolist()], width[at]))
            take = pa.array(np.repeat(at, own.shape[1]))
            yield pa.record_batch(
                [
                    batch["node"].take(take),
                    batch["label"].take(take),
                    pa.array(np.full(own.size, dimension, np.int32)),
                    pa.array(own.ravel().astype(np.int32)),
                ],
                names=["node", "label", "dimension", "filter"],
            )


def _group(held: list[dict], low: float) -> Iterator[tuple[int, int, int]]:
    """Links of one filter: (node, copies of the others, root among the linked ones).

    A pair with several filters in common counts at the least of them only; a pair of blocks counts what lies
    between them, and what lies within a block where both are the same.
    """
    at, left, right = held[0]["filter"], held[0]["left"], held[0]["right"]
    node = np.array([h["node"] for h in held])
    copies = np.array([h["copies"] for h in held])
    side = np.array([h["side"] for h in held])
    x = _units([h["vector"] for h in held], np.array([h["width"] for h in held]))
    near = np.triu(x @ x.T >= low, 1)
    if left != right:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return
    linked = np.unique(np.append(i, j))
    own = np.zeros((len(node), LIST), np.int64)
    own[linked] = filters(x[linked])
    first = np.empty(len(i), bool)
    for k in range(0, len(i), 1024):  # no filter below this one is in both lists
        a, b = own[i[k : k + 1024]], own[j[k : k + 1024]]
        first[k : k + 1024] = ~((a[:, :, None] == b[:, None, :]) & (a < at)[:, :, None]).any((1, 2))
    i, j = i[first], j[first]
    if not len(i):
        return
    add = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    root = node.copy()
    while True:  # smallest linked node, again and again
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == root).all():
            break
        root = new
    for k in np.flatnonzero(add).tolist():
        yield int(node[k]), int(add[k]), int(root[k])


def _link_rows(rows: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group to links; one group is held at a time, and it has two blocks at most."""
    key, held, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.record_batch(columns, names=["node", "add", "root"])

    for batch in batches(rows, 2 << 20):
        for row in batch.to_pylist():
            this = tuple(row[c] for c in ("label", "dimension", "filter", "left", "right"))
            if this != key:
                if len(held) > 1:
                    out.extend(_group(held, low))
                key, held = this, []
            held.append(row)
        if out:
            yield flush()
    if len(held) > 1:
        out.extend(_group(held, low))
    if out:
        yield flush()


def near_vectors(vectors: DataFrame, low: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Linked are rows with the same label and number of coordinates whose cosine is ``low`` at least. Rows whose label
    or vector is null, or whose vector is empty, zero or holds null, NaN or infinite coordinates, are linked with
    nothing. Equal vectors of a label are one class with a count, so copies aren't compared. Rows may repeat:
    each counts, and ``component_id`` is the smallest id that is not null. A filter with many members is dealt out
    as pairs of blocks. An empty table gives no rows.
    """
    rows = stage(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
        .mapInArrow(_vector_rows, "vec_id long, label long, vector binary, width int, digest binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    classes = stage(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"),
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("least_id"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
            F.first("width").alias("width"),
        )
    )
    filtered = stage(
        classes.repartition("node")
        .select("node", "label", "vector", "width")
        .mapInArrow(_filter_rows, "node long, label long, dimension int, filter int")
    )
    place = ["label", "dimension", "filter"]
    loads = filtered.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = (
        filtered.join(own_shuffle(loads), place)
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("side", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("left", F.least("side", "other"))
        .withColumn("right", F.greatest("side", "other"))
        .drop("members", "blocks", "other")
    )
    met = dealt.join(classes.select("node", "copies", "vector", "width"), "node")
    group = [*place, "left", "right"]
    links = stage(
        met.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(partial(_link_rows, low=low), "node long, add long, root long")
    )
    counts = links.groupBy("node").agg(F.sum("add").alias("linked"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = stage(
        classes.select("digest", "node", "copies", "least_id")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select(
            "digest",
            "least_id",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = placed.join(own_shuffle(smallest), "root").select("digest", "n_links", "component_id")
    return (
        rows.select("vec_id", "digest")
        .join(own_shuffle(known), "digest", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
