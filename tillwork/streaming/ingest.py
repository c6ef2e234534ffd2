"""Requests to events as a stream: normalize, drop repeats, write by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillwork.operators.requests import dedupe_events, normalize_requests
from tillwork.sources.mirror import MirroredTable, StreamBatch

# Work off everything there is, in batches, then stop. A service passes
# {"processingTime": "250 milliseconds"} instead.
DRAIN = {"availableNow": True}


def _id() -> Column:
    """An event's id as the index has it; no id is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), "event_id"), F.lit("")).alias("id")



def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; ``max_files`` limits a micro-batch."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def dedupe_stream(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each event id once, as long as its repeats arrive within ``within``.

    The watermark runs on arrival, not on the event's own time. State is bounded
    by it all the same, and an event that comes late is never dropped for that.
    A repeat that comes later still is written again; :func:`clean_events` removes it.
    """
    arrived = events.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    return arrived.dropDuplicatesWithinWatermark(["event_id"]).drop("arrived_at")


def write_events(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append events to parquet, one folder per day.

    The file sink and the checkpoint together write each micro-batch once. A
    failed batch is run again from the checkpoint, so nothing is dropped; when
    input comes faster than it can be written, it waits in the source.
    """
    return (
        events.withColumn("event_date", F.to_date("event_timestamp"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date")
        .trigger(**(trigger or DRAIN))
        .start()
    )


def ingest_requests(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The whole way from raw requests to the event table as one stream."""
    return write_events(dedupe_stream(normalize_requests(raw)), path, checkpoint, trigger)


def clean_events(spark: SparkSession, path: str, target: str, buckets: int | None = None) -> DataFrame:
    """The written events with each event id once, whatever lies between its repeats, as a table of ``target`` by day.

    A job beside the stream: the stream's own files stay as its log names them, and readers take this table. A run looks
    at the files that came since the last one. Their ids are looked up in an index, a table of ids in buckets by hash, of
    which only the buckets that they fall into are read; new events and then new ids are appended. Both tables know which
    batches they took in, so a run that broke off goes on where it was, and readers see whole batches. ``buckets`` is the
    number of buckets of the index. An event without an id is one event with the others that have none.
    """
    events = MirroredTable(spark, f"{target}/events", by=["event_date"])
    index = MirroredTable(spark, f"{target}/ids", buckets)
    written = spark.read.parquet(path)
    if not events.exists():
        events.replace(written.where("1 = 0"))
        index.replace(written.where("1 = 0").select(_id()), "id")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            seen = StreamBatch.of(batch, batch_id, "clean")
            if not events.taken(seen):
                known = index.read(index.buckets_of(batch.select(_id())))
                fresh = dedupe_events(batch).withColumn("id", _id()).join(known, "id", "left_anti").drop("id")
                events.append(fresh.repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(8))), batch=seen)
            if not index.taken(seen):
                index.append(events.part_of(seen).select(_id()), batch=seen)
            for table in (events, index):
                if table.compact():
                    table.vacuum()
        finally:
            batch.unpersist()

    (
        read_stream(spark, path, written.schema)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(**DRAIN)
        .start()
        .awaitTermination()
    )
    return events.read()
