"""Near duplicates by circulant MinHash: banding, then exact Jaccard on whole shingle sets.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two permutations make all
signature coordinates: ``sigma`` spreads the shingles over 32 bits, and coordinate ``k`` is the least
``pi(sigma(shingle) + k)``, which is ``pi`` shifted round by ``k`` places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tillwork.llm.common import U64, batches, mix64, signed, stage
from tillwork.llm.components import components
from tillwork.operators.skew import own_shuffle

WORDS, SIMILAR = 5, 75
#: At similarity 0.75 a pair shares none of 48 bands of 5 rows in 2 of a million cases.
BANDS, ROWS = 48, 5
BLOCK = 1 << 15
#: Leaders of each kind that a class is compared with at first. It decides what is tried early, not what is tried.
LEADERS = 8
#: Coordinates of the long signatures, one bit each, and how many may differ in a pair that is compared in full. At
#: similarity 0.75 240 are expected; more than 315 differ in 2 of ten million cases.
LONG, DIFFER = 1920, 315


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    each = np.fromiter(map(xxh3_64_intdigest, words), U64, len(words))
    last = max(1, len(words) - WORDS + 1)
    mixed = np.full(last, min(len(words), WORDS), U64)
    for i in range(min(len(words), WORDS)):
        mixed = mix64(mixed * U64(0x9E3779B97F4A7C15) + each[i : i + last])
    return np.unique(mixed)


def _least(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures, one row per set; no set may be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        stop = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), BLOCK, "right")) + first)
        spread = (mix64(np.concatenate(sets[first:stop])) >> U64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes[first : stop - 1])))
        x, y = np.empty_like(spread), np.empty_like(spread)
        for k in range(coordinates):
            np.add(spread, np.uint32(k), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x7FEB352D), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            out[first:stop, k] = np.minimum.reduceat(x, starts)
        first = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(rows), BANDS)).copy()
    for r in range(ROWS):
        keys = mix64(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys


def _long_signatures(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, text`` to ``node, bits``: the lowest bit of each coordinate of a long signature."""
    for batch in batches(rows):
        sets = [shingles(t) for t in batch["text"].to_pylist()]
        bits = (_least(sets, LONG) & np.uint32(1)).astype(np.uint8)
        packed = signed(np.packbits(bits, axis=1).view(U64))
        yield pa.record_batch([batch["node"], pa.array(list(packed), pa.list_(pa.int64()))], names=["node", "bits"])


_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def _sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        sets = [shingles(t) for t in batch["text"].to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        if full:
            signature = _least([sets[i] for i in full], BANDS * ROWS)
            for i, keys in zip(full, signed(band_keys(signature)), strict=True):
                bands[i] = keys
        yield pa.record_batch(
            [
                batch["doc_id"],
                batch["text_key"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            schema=_SKETCH,
        )


def _similar(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts to the pairs that are similar enough, by integers."""
    for batch in batches(rows):
        a, b, keep, last, own = batch["a"], batch["b"], [], None, None
        for left, right in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
            if right != last:  # rows of one leader often follow each other
                last, own = right, shingles(right)
            x = shingles(left)
            both = len(np.intersect1d(x, own, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(own) - both))
        yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of each wanted class, by the document that stands for it."""
    wanted = nodes.distinct().join(classes, "node").select("node", "doc_id", "text_key")
    on = wanted["doc_id"].eqNullSafe(docs["doc_id"]) & (wanted["text_key"] == docs["text_key"])
    return wanted.join(docs, on).groupBy("node").agg(F.min("text").alias("text"))


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that reach the similarity on their full sets. Texts of ``a`` move once per pair."""
    sides = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = stage(_texts(docs, classes, sides))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(partial(_similar, percent=SIMILAR), "a long, b long")


def _rest(docs: DataFrame, classes: DataFrame, sketches: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that share a band, lie in different components so far, and may still be similar.

    In each band, the classes outside the component that most of it belongs to meet all others, so a band that
    is one component but for a few classes costs these few times its size. Sizes and long signatures are compared
    inside the join, and only pairs that pass both become rows, in the first band that they share.
    """
    known = members.select("key", "node", "n_shingles").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    parts = known.groupBy("key", "root").count().groupBy("key").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")
    )
    met = stage(known.join(own_shuffle(parts.where("roots > 1").select("key", "main")), "key"))
    # Small texts, much work: a number of tasks of its own, as partitions would be merged by their bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, classes, met.select("node")).repartition(tasks, "node")
    bits = texts.mapInArrow(_long_signatures, "node long, bits array<long>")
    signatures = stage(bits.join(sketches.select(F.col("row").alias("node"), "bands"), "node"))
    open_ = met.join(own_shuffle(signatures), "node")
    x, y = open_.where("root <> main").alias("x"), open_.alias("y")
    shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True).cast("int")
    apart = F.aggregate(
        F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d
    )
    return (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.root") != F.col("y.root"))
            & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
            & (100 * F.least("x.n_shingles", "y.n_shingles") >= SIMILAR * F.greatest("x.n_shingles", "y.n_shingles"))
            & (F.try_element_at("x.bands", shared) == F.col("x.key"))
            & (apart <= DIFFER),
        )
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )


def _resolved(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, root, component_id`` of each row; root is null for empty sets."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    sketches = stage(
        docs.mapInArrow(
            _sketch,
            "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    classes = stage(
        sketches.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"),
            F.min_by(F.struct("doc_id", "text_key", "n_shingles"), "row").alias("first"),
            F.min("doc_id").alias("least_id"),
        )
        .select("node", "digest", "first.*", "least_id")
    )
    in_bands = sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), "n_shingles", F.explode("bands").alias("key")
    )
    # Each band has a leader of its own, so in a large group the leaders of a class differ.
    shared = in_bands.groupBy("key").agg(
        F.min_by("node", F.xxhash64("node", "key")).alias("leader"), F.count(F.lit(1)).alias("members")
    )
    members = stage(in_bands.join(own_shuffle(shared.where("members > 1")), "key"))
    # A second one is the class that meets most others: the text that a group's copies were made of, if it is there.
    met = members.groupBy("node").agg(F.sum("members").alias("met"))
    central = (
        members.select("key", "node")
        .join(own_shuffle(met), "node")
        .groupBy("key")
        .agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    )
    by_chance = members.select("key", "node", "leader", F.lit(False).alias("central"))
    by_meeting = members.select("key", "node").join(own_shuffle(central), "key")
    votes = Window.partitionBy("node", "central").orderBy(F.desc("count"), "leader")
    led = (
        by_chance.unionByName(by_meeting.withColumn("central", F.lit(True)))
        .where("node <> leader")
        .groupBy("node", "leader", "central")
        .count()
        .withColumn("choice", F.row_number().over(votes))
        .where(F.col("choice") <= LEADERS)
        .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        .distinct()
    )
    first = stage(_confirm(docs, classes, stage(led)))
    roots = stage(components(first))

    rest = stage(_rest(docs, classes, sketches, members, roots))
    second = _confirm(docs, classes, rest)
    # The roots of the first round stand for their components.
    joined = second.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
    )
    final = components(first.unionByName(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    placed = stage(
        classes.join(final, "node", "left").select(
            "digest", "least_id", F.coalesce("root", "node").alias("root")
        )
    )
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known_id = placed.join(own_shuffle(smallest), "root").select("digest", "root", "component_id")
    return (
        sketches.select("doc_id", "text_key", "n_shingles", "digest")
        .join(own_shuffle(known_id), "digest", "left")
        .withColumn(
            "component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        )
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing.
    Equal sets are one class before anything is compared, so a group of copies costs one row. A class
    is first compared with some of its bands' leaders; then every pair that shares a band, could still
    be similar by the sizes of its sets and by its signatures and isn't connected yet is compared. A link
    between components is lost only with the odds that ``BANDS`` and ``DIFFER`` state. Rows may repeat: ``component_id`` is the smallest id that is not null
    in the component. A row without an id has that of its component too (null if there is none), and is
    kept only if there is none. An empty table gives no rows.
    """
    return (
        _resolved(docs)
        .select("doc_id", "n_shingles", "component_id")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group does: that of the smallest id.

    Rows without words are groups of their own; of rows with equal id and text, one stays. Rows without an id give
    way to those with one.
    """
    found = _resolved(docs)
    chosen = (
        found.where("digest is not null")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
        .select("first.doc_id", "first.text_key")
        .unionByName(found.where("digest is null").select("doc_id", "text_key"))
        .distinct()
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__chosen"))
    )
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = keyed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__chosen"))
    return keyed.join(own_shuffle(chosen), on, "left_semi").dropDuplicates(["doc_id", "__key"]).drop("__key")
