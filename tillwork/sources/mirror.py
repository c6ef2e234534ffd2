"""Keeping copies of the shop's operational tables up to date."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillwork.sources.commits import CommitConflict, CommitLog, VersionTaken

# Key and cursor of each mirrored table.
PRIMARY_KEYS = {
    "customer": "CUSTOMER_ID",
    "product": "PRODUCT_ID",
    "product_availability": "PRODUCT_AVAIL_ID",
    "product_description": "DESCRIPTION_ID",
    "product_price": "PRODUCT_PRICE_ID",
    "shopping_cart": "SHP_CART_ID",
    "shopping_cart_item": "SHP_CART_ITEM_ID",
}
CURSORS = {
    "customer": "CUSTOMER_ID",
    "product": "DATE_MODIFIED",
    "product_availability": "PRODUCT_AVAIL_ID",
    "product_description": "DESCRIPTION_ID",
    "product_price": "PRODUCT_PRICE_ID",
    "shopping_cart": "DATE_MODIFIED",
    "shopping_cart_item": "DATE_MODIFIED",
}


# -------------------------------------------------------------------- reading


class Source(Protocol):
    def load(self, spark: SparkSession, table: str) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetSource:
    """Tables as parquet files ``<folder>/<table>.parquet``."""

    folder: str

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder.rstrip('/')}/{table}.parquet")


@dataclass(frozen=True)
class SplitBy:
    """How a table is read in parallel: ranges of a numeric or date column."""

    column: str
    lower: int | str
    upper: int | str
    partitions: int


@dataclass(frozen=True)
class JdbcSource:
    """Tables of a SQL database.

    Filters, column choices and limits put on the result are pushed to the
    database by Spark. A table named in ``splits`` is read by several tasks at
    once; one that is not is read by a single task.
    """

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)
    splits: Mapping[str, SplitBy] = field(default_factory=dict)
    fetch_size: int = 10_000

    def options(self, table: str) -> dict[str, str]:
        options = {"url": self.url, "dbtable": table, "fetchsize": str(self.fetch_size), **self.properties}
        split = self.splits.get(table)
        if split:
            options |= {
                "partitionColumn": split.column,
                "lowerBound": str(split.lower),
                "upperBound": str(split.upper),
                "numPartitions": str(split.partitions),
            }
        return options

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(table)).load()


def read_table(spark: SparkSession, source: Source, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = source.load(spark, table)
    return df.select(*columns) if columns else df


# --------------------------------------------------------------------- slicing


def incremental_slice(df: DataFrame, cursor: str, last_value=None, null_cursors: str = "fail") -> DataFrame:
    """Rows at or past the stored cursor; everything on the first run.

    Rows equal to the cursor come again: the merge makes that harmless, and no
    row written in the same instant is missed. A row without a cursor can't be told
    from an old one: ``null_cursors`` says whether it makes the run ``"fail"`` or comes
    along every time (``"take"``). It is never left out. Both reach the source as pushed filters: ``"fail"`` first
    looks for one row without a cursor, when this is called, and then compares only.
    """
    if null_cursors not in ("fail", "take"):
        raise ValueError(f"null_cursors is 'fail' or 'take', not {null_cursors!r}")
    if last_value is None:
        return df
    column = F.col(cursor)
    if null_cursors == "take":
        return df.where((column >= F.lit(last_value)) | column.isNull())
    if not df.where(column.isNull()).isEmpty():
        raise ValueError(f"a row has no {cursor}; pass null_cursors='take' to take such rows each time")
    return df.where(column >= F.lit(last_value))


def next_cursor(df: DataFrame, cursor: str) -> DataFrame:
    return df.agg(F.max(cursor).alias("cursor_value"))


def range_slice(
    df: DataFrame, cursor: str, start, end, descending: bool = True, limit: int | None = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``, ordered, optionally cut."""
    column = F.col(cursor)
    rows = df.where((column >= F.lit(start)) & (column < F.lit(end)))
    rows = rows.orderBy(column.desc() if descending else column.asc(), *tie_break)
    return rows if limit is None else rows.limit(limit)


# -------------------------------------------------------------------- changing


def latest_per_key(df: DataFrame, key: str, cursor: str) -> DataFrame:
    """The row with the greatest cursor of each key.

    ``row_number() = 1`` is cut down on the map side before the shuffle, so a key
    with very many versions costs one row per map task.
    """
    rest = [c for c in df.columns if c not in (key, cursor)]
    order = Window.partitionBy(key).orderBy(F.col(cursor).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def merge_upsert(target: DataFrame, batch: DataFrame, key: str, cursor: str) -> DataFrame:
    """``target`` with ``batch`` merged in by key.

    The row with the greater cursor stays, whatever the order of arrival; at equal
    cursors the batch wins, and a null cursor loses. The target is only joined
    with the keys of the batch: while the batch is small that join is a broadcast
    and the target is read without being shuffled.
    """
    newest = latest_per_key(batch, key, cursor).select(*target.columns)
    arrived = newest.select(key, F.col(cursor).alias("_arrived"))
    # Keys whose stored row is newer than what came in.
    stale = (
        target.select(key, cursor)
        .join(arrived, key)
        .where(F.col(cursor).isNotNull() & (F.col("_arrived").isNull() | (F.col(cursor) > F.col("_arrived"))))
        .select(key)
    )
    winners = newest.join(stale, key, "left_anti").select(*target.columns)
    kept = target.join(winners.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(winners)


def adapt_types(df: DataFrame, float_as_decimal: tuple[int, int] | None = (38, 9), array_as_json: bool = True) -> DataFrame:
    """Doubles stay doubles, floats become decimals, arrays become JSON text.

    A float that no such decimal is (not a number, infinite, too large) becomes null.
    """
    columns = []
    for item in df.schema.fields:
        column = F.col(item.name)
        if isinstance(item.dataType, T.FloatType) and float_as_decimal:
            # By way of text: the decimal is the number as printed.
            column = column.cast("string").try_cast(T.DecimalType(*float_as_decimal))
        elif isinstance(item.dataType, T.ArrayType) and array_as_json:
            column = F.to_json(column)
        columns.append(column.alias(item.name))
    return df.select(*columns)


# -------------------------------------------------------------------- writing


class MirroredTable:
    """A table as parquet files in buckets of its key, with a log that names the files of the current version.

    ``<path>/data/commit=<id>/_bucket=<n>`` holds the rows that a commit wrote for a bucket. A version in ``<path>/log``
    lists the commits and which of their buckets still count, the cursor reached, and the stream batches taken in. It
    counts once it is published, so readers see whole versions, and a crash before leaves files that nothing names and
    the old cursor: the next run repeats the work. A merge reads and rewrites only the buckets that its batch has keys of.
    Writers don't wait: if another commit came first, an append goes on top of it, and a merge does so where none of its
    buckets was touched; else it fails with :class:`CommitConflict`, and nothing of it is seen.

    ``buckets`` is the number of buckets, chosen so that one has some hundred MB; by default the size that Spark expects
    of the first keyed write decides. A table without a key has one bucket. ``by`` names columns whose values get folders
    of their own within a bucket. The log has a number for each live bucket of each commit, so :meth:`compact` bounds it.
    Where a table format with ``MERGE INTO`` is available, that is the better choice.
    """

    #: Bytes of a bucket that the default number of buckets aims at, and the bounds of that number.
    BUCKET_BYTES, FEWEST, MOST = 256 << 20, 16, 1 << 16
    #: Batches of a stream that the log remembers by their content.
    REMEMBERED = 1000
    BUCKET = "_bucket"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, by: Sequence[str] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.by = list(by)
        self._commits = CommitLog(spark, f"{self.path}/log")

    # -- state

    def _state(self) -> dict | None:
        return self._commits.read()

    def _next(self, state: dict | None, **changes) -> dict:
        empty = {"version": 0, "cursor_value": None, "key": None, "buckets": 1, "schema": None, "parts": [], "batches": {}}
        state = state or empty
        return {**state, "version": state["version"] + 1, **changes}

    def _log(self, state: dict) -> None:
        self._commits.write(state)

    def cursor(self) -> str | None:
        state = self._state()
        return state["cursor_value"] if state else None

    def exists(self) -> bool:
        return self._state() is not None

    # -- files

    def _folder(self, part: str) -> str:
        return f"{self.path}/data/commit={part}"

    def _files(self, state: dict, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [
            f"{self._folder(part['id'])}/{self.BUCKET}={n}"
            for part in state["parts"]
            for n in part["buckets"]
            if wanted is None or n in wanted
        ]

    def _rows(self, state: dict, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*files).select(*schema.names)

    def _bucket_of(self, key: str | None, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)

    def _write(self, df: DataFrame, key: str | None, buckets: int) -> dict:
        """Write a part; a keyed one has each bucket from one task, but for what ``by`` separates."""
        if self.BUCKET in df.columns:
            raise ValueError(f"a mirrored table can't have a column {self.BUCKET}")
        part = uuid.uuid4().hex
        rows = df.withColumn(self.BUCKET, self._bucket_of(key, buckets))
        rows = rows.repartition(self.BUCKET, *self.by) if key else rows
        rows.write.partitionBy(self.BUCKET, *self.by).parquet(self._folder(part))
        found = (name.split("=")[1] for name in self._commits.names(self._folder(part)) if name.startswith(self.BUCKET))
        return {"id": part, "buckets": sorted(map(int, found)), "level": 0}

    def _fitting(self, df: DataFrame) -> int:
        """The number of buckets for a table that starts with ``df``."""
        if self.buckets:
            return self.buckets
        expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return min(self.MOST, max(self.FEWEST, expected // self.BUCKET_BYTES))

    @staticmethod
    def _schema(df: DataFrame) -> str:
        return json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).jsonValue())

    # -- reading

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of the newest version, all or those of some buckets. Later commits don't change what this returns."""
        state = self._state()
        if state is None:
            raise FileNotFoundError(f"{self.path} has no published version")
        return self._rows(state, self._files(state, buckets))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys of ``keys`` fall into; no more than the table has."""
        state = self._state()
        found = keys.select(self._bucket_of(state["key"], state["buckets"]).alias("n")).distinct()
        return sorted(r.n for r in found.collect())

    # -- writing

    def replace(self, df: DataFrame, key: str | None = None) -> None:
        """Refill the table; the cursor starts over. There is always a table to read."""
        state = self._state()
        buckets = self._fitting(df) if key else 1
        part = self._write(df, key, buckets)
        batches = state["batches"] if state else {}
        new = self._next(None, cursor_value=None, key=key, buckets=buckets, schema=self._schema(df), batches=batches)
        try:
            self._log({**new, "version": (state["version"] if state else 0) + 1, "parts": [part]})
        except VersionTaken as taken:
            raise CommitConflict(f"{self.path} was changed while it was to be replaced") from taken

    def append(self, df: DataFrame, key: str | None = None, batch: StreamBatch | None = None) -> None:
        """Add rows, for tables that only grow; ``key`` buckets a table that this call begins.

        With a ``batch`` its rows count once, however often it is run (see :meth:`taken`).
        """
        state = self._state()
        if state is None:
            buckets, schema = (self._fitting(df) if key else 1), self._schema(df)
        else:
            key, buckets, schema = state["key"], state["buckets"], state["schema"]
            names = T.StructType.fromJson(json.loads(schema)).names
            df = df.select(*names)
            if self._schema(df) != schema:
                raise ValueError(f"the rows to append have other types than {self.path}")
        part = self._write(df, key, buckets)
        while True:
            batches = state["batches"] if state else {}
            if batch is not None:
                batches = batch.noted(batches, part["id"], self.REMEMBERED)
            parts = [*(state["parts"] if state else []), part]
            try:
                self._log(self._next(state, key=key, buckets=buckets, schema=schema, parts=parts, batches=batches))
                return
            except VersionTaken:
                state = self._state()
                if (state["key"], state["buckets"], state["schema"]) != (key, buckets, schema):
                    raise CommitConflict(f"{self.path} was replaced while rows were to be appended") from None
                if batch is not None and batch.known(state["batches"]):
                    raise CommitConflict(f"batch {batch.id} of {batch.stream} was taken in by another writer") from None

    def merge(self, batch: DataFrame, key: str, cursor: str) -> None:
        """Merge a slice in and move the cursor to the highest value seen.

        The batch is read once, for its newest row per key; these are written down by bucket. Only buckets that have
        some are read and rewritten. A table that isn't bucketed by ``key`` yet is rewritten whole, once.
        """
        state = self._state()
        base = state["version"] if state else 0
        schema = state["schema"] if state else self._schema(batch)
        names = T.StructType.fromJson(json.loads(schema)).names
        bucketed = state is not None and state["key"] == key
        buckets = state["buckets"] if bucketed else self._fitting(self._rows(state, self._files(state)) if state else batch)
        seen = Observation()
        newest = latest_per_key(batch.observe(seen, F.max(cursor).cast("string").alias("reached")), key, cursor)
        staged = self._write(newest.select(*names), key, buckets)
        reached = seen.get["reached"] if staged["buckets"] else None  # a batch known to be empty isn't observed
        if not staged["buckets"] and state is not None:
            self._commits.delete(self._folder(staged["id"]))
            return
        arrived = self._rows({"schema": schema}, self._files({"parts": [staged]}))
        touched = set(staged["buckets"])
        if state is None:
            part = staged
        else:
            stored = self._rows(state, self._files(state, touched if bucketed else None))
            part = self._write(merge_upsert(stored, arrived, key, cursor), key, buckets)
            self._commits.delete(self._folder(staged["id"]))
        while True:
            old = state["parts"] if bucketed else []
            kept = [{**p, "buckets": [n for n in p["buckets"] if n not in touched]} for p in old]
            kept = [p for p in kept if p["buckets"]]
            value = reached if reached is not None else (state["cursor_value"] if state else None)
            new = self._next(state, key=key, buckets=buckets, schema=schema, cursor_value=value, parts=[*kept, part])
            try:
                self._log(new)
                return
            except VersionTaken:
                now = self._state()
                fields = ("key", "buckets", "schema", "cursor_value")
                if not bucketed or any(now[f] != state[f] for f in fields) or self._touched(state, now) & touched:
                    raise CommitConflict(f"{self.path} was changed after version {base} where a merge was to change it") from None
                state = now

    @staticmethod
    def _touched(before: dict, after: dict) -> set[int]:
        """Buckets whose files are others."""

        def files(state: dict) -> set[tuple[str, int]]:
            return {(p["id"], n) for p in state["parts"] for n in p["buckets"]}

        return {n for _, n in files(before) ^ files(after)}

    def refresh(self, source_rows: DataFrame, key: str, cursor: str, null_cursors: str = "fail") -> None:
        """One incremental run: slice at the stored cursor, merge, publish."""
        last = self.cursor()
        if last is not None:
            last = F.lit(last).cast(source_rows.schema[cursor].dataType)
        self.merge(incremental_slice(source_rows, cursor, last, null_cursors), key, cursor)

    # -- upkeep

    def compact(self, fan: int = 16, combine: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Merge parts so that there are less than ``fan`` of each level; returns how often some were merged.

        ``fan`` parts of a level, the oldest first, become one part of the next level, so a row is rewritten as often
        as the logarithm of the number of parts, and there are about ``fan`` times that many parts. ``combine`` may make
        fewer rows of theirs; it must not matter which parts it has seen. Other commits go on meanwhile.
        """
        times = 0
        while True:
            state = self._state()
            merged = self._tier(state["parts"] if state else [], fan)
            if not merged:
                return times
            times += 1
            rows = self._rows(state, self._files({"parts": merged}))
            part = self._write(combine(rows) if combine else rows, state["key"], state["buckets"])
            part["level"] = merged[0]["level"] + 1
            while True:
                if any(p not in state["parts"] for p in merged):
                    raise CommitConflict(f"parts of {self.path} were changed while they were merged")
                first = state["parts"].index(merged[0])
                parts = [p for p in state["parts"] if p not in merged]
                try:
                    self._log(self._next(state, parts=[*parts[:first], part, *parts[first:]]))
                    break
                except VersionTaken:
                    state = self._state()

    @staticmethod
    def _tier(parts: list[dict], fan: int) -> list[dict]:
        """The oldest ``fan`` parts of the lowest level that has as many."""
        levels: dict[int, list[dict]] = {}
        for part in parts:
            levels.setdefault(part["level"], []).append(part)
        full = [level for level, own in levels.items() if len(own) >= fan]
        return levels[min(full)][:fan] if full else []

    def vacuum(self, keep: int = 10, grace_seconds: float = 86_400) -> list[str]:
        """Remove versions but the newest ``keep``, and the parts that none of these names; returns the parts' ids.

        Parts younger than ``grace_seconds`` stay: a writer may be about to publish them.
        """
        versions = self._commits.versions()
        states = [self._commits.read(v) for v in versions[-keep:]]
        named = {p["id"] for s in states for p in s["parts"]}
        for version in versions[:-keep]:
            self._commits.delete(self._commits._name(version))
        ages = self._commits.ages(f"{self.path}/data")
        gone = [n for n, age in ages.items() if n.removeprefix("commit=") not in named and age >= grace_seconds]
        for name in gone:
            self._commits.delete(f"{self.path}/data/{name}")
        return sorted(n.removeprefix("commit=") for n in gone)

    # -- streams

    def taken(self, batch: StreamBatch) -> bool:
        """Was this batch committed? It fails where the log has another batch under this id, or no longer knows."""
        state = self._state()
        return state is not None and batch.known(state["batches"])

    def part_of(self, batch: StreamBatch) -> DataFrame:
        """The rows that a committed batch wrote, as long as they weren't merged with others."""
        state = self._state()
        part = state["batches"][batch.stream]["seen"][str(batch.id)]["part"]
        return self._rows(state, self._files({"parts": [p for p in state["parts"] if p["id"] == part]}))


@dataclass
class StreamBatch:
    """A micro-batch as a table's log knows it: the stream's name, the batch's id, and what its rows look like.

    The same rows under the same id are a replay. Other rows under an id that was taken in mean that a stream was
    started anew beside its table; that fails instead of losing them.
    """

    stream: str
    id: int
    content: str

    @classmethod
    def of(cls, rows: DataFrame, batch_id: int, stream: str = "stream") -> StreamBatch:
        """One pass over the batch: its number of rows and a hash that doesn't depend on their order."""
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("h")).first()
        return cls(stream, batch_id, f"{seen.n}:{seen.h}")

    def known(self, batches: dict) -> bool:
        own = batches.get(self.stream)
        if own is None or self.id > own["last"]:
            return False
        entry = own["seen"].get(str(self.id))
        if entry is None or entry["content"] != self.content:
            raise CommitConflict(f"batch {self.id} of {self.stream} was taken in before, with other rows")
        return True

    def noted(self, batches: dict, part: str, remembered: int) -> dict:
        own = batches.get(self.stream, {"last": -1, "seen": {}})
        seen = {**own["seen"], str(self.id): {"content": self.content, "part": part}}
        kept = sorted(seen, key=int)[-remembered:]
        return {**batches, self.stream: {"last": max(own["last"], self.id), "seen": {i: seen[i] for i in kept}}}


class FanOutFailed(RuntimeError):
    def __init__(self, failures: dict[str, Exception]):
        super().__init__("targets failed: " + ", ".join(sorted(failures)))
        self.failures = failures


def fan_out(tables: Mapping[str, DataFrame], targets: Mapping[str, Callable[[str, DataFrame], None]]) -> None:
    """Write the same tables to several targets.

    The source is read once and held for all targets. A target that fails does
    not stop the others; all failures are raised together at the end.
    """
    held = {name: df.persist() for name, df in tables.items()}
    failures: dict[str, Exception] = {}
    try:
        for target, write in targets.items():
            try:
                for name, df in held.items():
                    write(name, df)
            except Exception as error:
                failures[target] = error
    finally:
        for df in held.values():
            df.unpersist()
    if failures:
        raise FanOutFailed(failures)


def mirror_tables(
    spark: SparkSession,
    source: Source,
    target_folder: str,
    tables: Iterable[str],
    disposition: str = "merge",
    null_cursors: str = "fail",
    keep_versions: int = 10,
) -> None:
    """Bring the named tables of a target up to date: ``merge``, ``replace`` or ``append``.

    ``null_cursors`` is what :func:`incremental_slice` does with rows without a cursor. Versions before the newest
    ``keep_versions`` are removed with the files that only they name.
    """
    for name in tables:
        target = MirroredTable(spark, f"{target_folder.rstrip('/')}/{name}")
        rows = read_table(spark, source, name)
        if disposition == "merge":
            target.refresh(rows, PRIMARY_KEYS[name], CURSORS[name], null_cursors)
        elif disposition == "replace":
            target.replace(rows, PRIMARY_KEYS[name])
        elif disposition == "append":
            target.append(rows)
        else:
            raise ValueError(f"unknown disposition {disposition!r}")
        target.compact()
        target.vacuum(keep_versions)


def convert_files(spark: SparkSession, source: str, target: str, format: str = "csv") -> None:
    """Parquet files into CSV (with a header) or parquet, in parallel."""
    rows = spark.read.parquet(source)
    writer = rows.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
        ).csv(target)
    elif format == "parquet":
        writer.parquet(target)
    else:
        raise ValueError(f"unknown format {format!r}")
