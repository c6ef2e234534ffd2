"""Parcels for an order: one per unit, or packed into boxes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.operators.skew import own_shuffle

# The packing function travels to the executors as it is, so that they need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What stands in for a missing measure.
DEFAULT_WEIGHT, DEFAULT_HEIGHT, DEFAULT_LENGTH, DEFAULT_WIDTH = 1, 4, 4, 4
SIZE = "decimal(18,2)"


def measured_lines(lines: DataFrame, products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Lines of things that are not virtual, with their measures and attribute weights."""
    extra = attributes.groupBy("PRODUCT_ID").agg(F.sum("WEIGHT").alias("_extra"))
    measures = products.where(~F.col("PRODUCT_VIRTUAL")).join(extra, "PRODUCT_ID", "left").select(
        "PRODUCT_ID",
        (F.coalesce("WEIGHT", F.lit(DEFAULT_WEIGHT)) + F.coalesce("_extra", F.lit(0))).cast(SIZE).alias("WEIGHT"),
        F.coalesce("HEIGHT", F.lit(DEFAULT_HEIGHT)).cast(SIZE).alias("HEIGHT"),
        F.coalesce("LENGTH", F.lit(DEFAULT_LENGTH)).cast(SIZE).alias("LENGTH"),
        F.coalesce("WIDTH", F.lit(DEFAULT_WIDTH)).cast(SIZE).alias("WIDTH"),
    )
    return lines.select("ORDER_ID", "PRODUCT_ID", "QUANTITY").join(own_shuffle(measures), "PRODUCT_ID")


def parcels_per_item(measured: DataFrame) -> DataFrame:
    """One parcel per unit."""
    units = F.explode(F.sequence(F.lit(1), F.col("QUANTITY").cast("int"))).alias("UNIT")
    return measured.where("QUANTITY >= 1").select("ORDER_ID", "PRODUCT_ID", units, "WEIGHT", "HEIGHT", "LENGTH", "WIDTH")


@dataclass(frozen=True)
class Box:
    """The shop's box: its sides, its own weight and the most it may carry."""

    length: float
    width: float
    height: float
    weight: float
    max_weight: float


TOO_BIG, TOO_HEAVY, NO_VOLUME = "larger than the box", "heavier than the box allows", "no volume"

_PACKED = "ORDER_ID BIGINT, BOX_NO INT, ITEMS BIGINT, WEIGHT DOUBLE"
# Volumes and weights are compared in whole millionths, so nothing depends on
# how a fraction is stored.
_MILLION = 1_000_000
# Boxes held before they are looked through or given out.
_MANY = 10_000


def packing_errors(measured: DataFrame, box: Box) -> DataFrame:
    """Orders that cannot be packed, with the reason of the first line at fault."""
    too_big = (F.col("WIDTH") > box.width) | (F.col("HEIGHT") > box.height) | (F.col("LENGTH") > box.length)
    empty = F.col("WIDTH") * F.col("HEIGHT") * F.col("LENGTH") == 0
    reason = F.when(too_big, TOO_BIG).when(F.col("WEIGHT") > box.max_weight, TOO_HEAVY).when(empty, NO_VOLUME)
    return (
        measured.withColumn("ERROR", reason)
        .where("ERROR IS NOT NULL")
        .groupBy("ORDER_ID")
        .agg(F.min_by("ERROR", "PRODUCT_ID").alias("ERROR"))
    )


def _units_that_fit(volume_left: int, weight_left: int, volume: int, weight: int) -> int:
    """Units a box takes, each needing no more than three quarters of what is free."""
    if 3 * volume_left < 4 * volume or weight_left < weight:
        return 0
    by_volume = (3 * volume_left - 4 * volume) // (3 * volume) + 1
    return by_volume if weight == 0 else min(by_volume, weight_left // weight)


class _Packing:
    """The boxes of the order at hand. Boxes nothing fits into any more are let go."""

    def __init__(self, order: int, box: Box, least_volume: int, least_weight: int, done: list[tuple]):
        self.order = order
        self.box = box
        self.full = (round(box.length * box.width * box.height * _MILLION), round(box.max_weight * _MILLION))
        self.least = (least_volume, least_weight)
        self.made = 0
        self.open: list[list[int]] = []  # number, volume left, weight left, items
        self.done = done
        self.sweep_at = _MANY
        self._new()

    def _new(self) -> list[int]:
        self.made += 1
        entry = [self.made, *self.full, 0]
        self.open.append(entry)
        return entry

    def _close(self, entry: list[int]) -> None:
        weight = self.box.weight + (self.full[1] - entry[2]) / _MILLION
        self.done.append((self.order, entry[0], entry[3], weight))

    def put(self, units: int, volume: int, weight: int) -> Iterator[pd.DataFrame]:
        """Pack equal units; gives out finished boxes whenever many have come together."""
        for entry in self.open:
            taken = min(units, _units_that_fit(entry[1], entry[2], volume, weight))
            self._load(entry, taken, volume, weight)
            units -= taken
            if not units:
                break
        while units:
            entry = self._new()
            # The first unit needs no quarter to spare in a box of its own.
            taken = 1 + _units_that_fit(entry[1] - volume, entry[2] - weight, volume, weight)
            taken = min(units, taken)
            self._load(entry, taken, volume, weight)
            units -= taken
            if len(self.open) >= self.sweep_at:
                self._sweep()
                self.sweep_at = max(_MANY, 2 * len(self.open))
            if len(self.done) >= _MANY:
                yield _boxes(self.done)
        self._sweep()

    @staticmethod
    def _load(entry: list[int], taken: int, volume: int, weight: int) -> None:
        entry[1] -= taken * volume
        entry[2] -= taken * weight
        entry[3] += taken

    def _sweep(self) -> None:
        still = []
        for entry in self.open:
            if _units_that_fit(entry[1], entry[2], *self.least):
                still.append(entry)
            else:
                self._close(entry)
        self.open = still

    def finish(self) -> None:
        for entry in self.open:
            self._close(entry)
        self.open = []


def _boxes(done: list[tuple]) -> pd.DataFrame:
    """The finished boxes as a frame; empties the list."""
    frame = pd.DataFrame(done, columns=["ORDER_ID", "BOX_NO", "ITEMS", "WEIGHT"])
    done.clear()
    return frame


def _pack(box: Box):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        current: _Packing | None = None
        for batch in batches:
            for line in batch.itertuples(index=False):
                if current is None or current.order != line.ORDER_ID:
                    if current is not None:
                        current.finish()
                    current = _Packing(line.ORDER_ID, box, line.least_volume, line.least_weight, done)
                yield from current.put(line.units, line.volume, line.weight)
                if len(done) >= _MANY:
                    yield _boxes(done)
        if current is not None:
            current.finish()
            yield _boxes(done)

    return run


def parcels_in_boxes(measured: DataFrame, box: Box) -> DataFrame:
    """Boxes per order, filled first-fit in the order of the product ids.

    A unit goes into the first box in which it needs at most three quarters of the
    free volume and whose weight limit it keeps; else into a new box. The first
    box is there from the start. Orders with a line that fits no box are left out,
    see :func:`packing_errors`.

    What fits depends on everything packed before, so an order is worked off in
    sequence; but as a stream of sorted lines, never gathered. Equal units of a
    line are placed by arithmetic, and a box that can take nothing more is given
    out at once, so only boxes still open are held.
    """
    if box.length * box.width * box.height <= 0 or box.max_weight <= 0:
        raise ValueError("the box needs a volume and a maximum weight above 0")
    volume = F.col("WIDTH") * F.col("HEIGHT") * F.col("LENGTH")
    lines = measured.join(packing_errors(measured, box).select("ORDER_ID"), "ORDER_ID", "left_anti").select(
        "ORDER_ID",
        "PRODUCT_ID",
        F.greatest(F.col("QUANTITY").cast("bigint"), F.lit(1)).alias("units"),
        (volume * _MILLION).cast("bigint").alias("volume"),
        (F.col("WEIGHT") * _MILLION).cast("bigint").alias("weight"),
    )
    # Equal units of a product lie next to each other anyway: added up before the
    # shuffle, an order has no more rows than there are different products.
    lines = lines.groupBy("ORDER_ID", "PRODUCT_ID", "volume", "weight").agg(F.sum("units").alias("units"))
    least = lines.groupBy("ORDER_ID").agg(F.min("volume").alias("least_volume"), F.min("weight").alias("least_weight"))
    ordered = lines.join(least, "ORDER_ID").repartition("ORDER_ID").sortWithinPartitions("ORDER_ID", "PRODUCT_ID")
    return ordered.mapInPandas(_pack(box), _PACKED)
