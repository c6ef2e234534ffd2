"""Streams end up where the batch jobs end up."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tillwork.operators.relations import Relations
from tillwork.plans.metrics import METRICS
from tillwork.schemas import RAW_REQUESTS
from tillwork.sources.mirror import MirroredTable
from tillwork.streaming import ingest, rollups


def raw_files(shop, path, parts):
    """Raw requests spread over several files, in no order of time."""
    shop["raw_requests"].repartition(parts).write.parquet(path)
    return path


def test_ingest_in_several_batches_equals_the_batch_job(spark, shop, tmp_path):
    from tillwork.operators.requests import normalize_requests

    source = raw_files(shop, str(tmp_path / "raw"), 5)
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    raw = ingest.read_stream(spark, source, RAW_REQUESTS, max_files=2)
    ingest.ingest_requests(raw, out, checkpoint).awaitTermination()
    expected = spark_rows(normalize_requests(shop["raw_requests"]))
    assert spark_rows(spark.read.parquet(out).drop("event_date")) == expected

    # The same requests arrive again in new files: nothing is written twice.
    shop["raw_requests"].repartition(3).write.mode("append").parquet(source)
    raw = ingest.read_stream(spark, source, RAW_REQUESTS, max_files=2)
    ingest.ingest_requests(raw, out, checkpoint).awaitTermination()
    assert spark_rows(spark.read.parquet(out).drop("event_date")) == expected


def test_late_events_are_kept(spark, shop, tmp_path):
    """An event that is weeks older than the ones before it is still written."""
    source = str(tmp_path / "raw")
    raw = shop["raw_requests"]
    cut = F.lit("2024-01-15").cast("timestamp")
    raw.where(F.col("received_at") >= cut).coalesce(1).write.parquet(source)
    out, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    ingest.ingest_requests(ingest.read_stream(spark, source, RAW_REQUESTS), out, checkpoint).awaitTermination()
    raw.where(F.col("received_at") < cut).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_requests(ingest.read_stream(spark, source, RAW_REQUESTS), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == raw.count()


def test_repeats_after_the_watermark_are_cleaned_up(spark, shop, tmp_path):
    """The stream forgets an id and writes it again; the clean-up leaves it once, also when it runs again."""
    from tillwork.operators.requests import normalize_requests

    requests = shop["raw_requests"].orderBy("event_id").limit(30)
    requests = spark.createDataFrame(requests.collect(), requests.schema)
    first, others = requests.limit(20), requests.exceptAll(requests.limit(20))
    source, out, clean, checkpoint = (str(tmp_path / x) for x in ("raw", "events", "clean", "checkpoint"))

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        raw = normalize_requests(ingest.read_stream(spark, source, RAW_REQUESTS))
        ingest.write_events(ingest.dedupe_stream(raw, "1 second"), out, checkpoint).awaitTermination()

    expected = spark_rows(normalize_requests(requests))
    for rows in (first, others.limit(5), others):  # each takes the watermark past what came before
        arrive(rows)
        time.sleep(3)
    arrive(first)
    assert spark.read.parquet(out).count() > len(expected[1])
    for _ in range(2):
        assert spark_rows(ingest.clean_events(spark, out, clean).drop("event_date")) == expected


def test_session_parts_equal_the_batch_and_a_replay_changes_nothing(spark, shop, tmp_path):
    events = shop["api_performance"]
    source, parts = str(tmp_path / "events"), str(tmp_path / "parts")
    events.repartition(6).write.parquet(source)
    stream = ingest.read_stream(spark, source, events.schema, max_files=2)
    rollups.write_parts(stream, rollups.session_part, parts, str(tmp_path / "checkpoint")).awaitTermination()
    columns = [
        "session_id", "request_count", "first_event_ts", "last_event_ts", "first_cart_ts", "first_checkout_ts",
        "first_endpoint", "last_endpoint", "duration_seconds",
    ]
    expected = spark_rows(shop.relations.sessions.select(*columns))
    assert len(MirroredTable(spark, parts)._state()["parts"]) == 3
    assert spark_rows(rollups.read_sessions(spark, parts).select(*columns)) == expected

    # A fresh checkpoint runs every batch again, under the same batch ids.
    stream = ingest.read_stream(spark, source, events.schema, max_files=2)
    rollups.write_parts(stream, rollups.session_part, parts, str(tmp_path / "again")).awaitTermination()
    assert spark_rows(rollups.read_sessions(spark, parts).select(*columns)) == expected


def test_hourly_revenue_equals_the_batch_metric(spark, shop, tmp_path):
    events = shop["api_performance"]
    source, parts = str(tmp_path / "events"), str(tmp_path / "parts")
    events.repartition(4).write.parquet(source)
    stream = ingest.read_stream(spark, source, events.schema, max_files=1)
    rollups.write_parts(stream, rollups.sales_part, parts, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark_rows(rollups.read_revenue_by_hour(spark, parts, shop)) == spark_rows(METRICS["M08"](shop))


def test_cleaning_reads_only_new_files_and_the_buckets_of_their_ids(spark, shop, tmp_path, monkeypatch):
    events = shop["api_performance"].withColumn("event_date", F.to_date("event_timestamp"))
    path, target = str(tmp_path / "events"), str(tmp_path / "clean")
    events.write.parquet(path)
    assert ingest.clean_events(spark, path, target, buckets=64).count() == events.count()
    looked = []
    read = MirroredTable.read
    monkeypatch.setattr(MirroredTable, "read", lambda self, buckets=None: looked.append((self.path, buckets)) or read(self, buckets))
    known = events.limit(3)
    new = known.limit(1).withColumn("event_id", F.lit("never seen"))
    known.unionByName(new).unionByName(new).coalesce(1).write.mode("append").parquet(path)
    clean = ingest.clean_events(spark, path, target, buckets=64)
    assert clean.count() == events.count() + 1
    index = [b for p, b in looked if p.endswith("/ids")]
    assert len(index) == 1 and 1 <= len(index[0]) <= 4


def test_a_batch_that_fails_halfway_is_taken_in_once(spark, shop, tmp_path, monkeypatch):
    """The events are committed, their ids are not; the replay adds the ids alone."""
    events = shop["api_performance"].limit(40).withColumn("event_date", F.to_date("event_timestamp"))
    path, target = str(tmp_path / "events"), str(tmp_path / "clean")
    events.write.parquet(path)
    append = MirroredTable.append

    def broken(self, df, key=None, batch=None):
        if self.path.endswith("/ids") and batch is not None:
            raise OSError("lost")
        append(self, df, key, batch)

    with monkeypatch.context() as patched:
        patched.setattr(MirroredTable, "append", broken)
        with pytest.raises(Exception, match="lost"):
            ingest.clean_events(spark, path, target, buckets=4)
    assert ingest.clean_events(spark, path, target, buckets=4).count() == 40
    assert MirroredTable(spark, f"{target}/ids").read().count() == 40


def test_a_failing_part_is_run_again_and_parts_are_merged_on_the_way(spark, shop, tmp_path):
    events = shop["api_performance"]
    source, parts, checkpoint = (str(tmp_path / x) for x in ("events", "parts", "checkpoint"))
    events.repartition(7).write.parquet(source)
    calls = []

    def reduce(batch):
        calls.append(1)
        if len(calls) == 5:
            raise OSError("lost")
        return rollups.session_part(batch)

    def run():
        stream = ingest.read_stream(spark, source, events.schema, max_files=1)
        rollups.write_parts(stream, reduce, parts, checkpoint, merge=rollups.merge_sessions, fan=2).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert len(calls) == 8 and len(MirroredTable(spark, parts)._state()["parts"]) <= 3
    columns = ["session_id", "request_count", "first_event_ts", "last_event_ts", "first_endpoint", "last_endpoint"]
    assert spark_rows(rollups.read_sessions(spark, parts).select(*columns)) == spark_rows(shop.relations.sessions.select(*columns))


def windows_of(spark, shop, tmp_path, delay):
    source = str(tmp_path / "events")
    events = shop["api_performance"]
    stream = ingest.read_stream(spark, source, events.schema, max_files=1)
    return rollups.revenue_windows(stream, spark.read.parquet(str(tmp_path / "carts")), delay)


def arrive(df, tmp_path):
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))


def test_hours_of_event_time_equal_the_batch_metric(spark, shop, tmp_path):
    """Events come late, within the delay; each hour is given once, also when a batch runs again."""
    events = shop["api_performance"]
    rollups.cart_snapshot(shop.relations).write.parquet(str(tmp_path / "carts"))
    hours, checkpoint = str(tmp_path / "hours"), str(tmp_path / "checkpoint")

    def run():
        rollups.write_windows(windows_of(spark, shop, tmp_path, "3 days"), hours, checkpoint).awaitTermination()

    first, last = events.agg(F.min("event_timestamp"), F.max("event_timestamp")).first()
    middle = first + (last - first) / 2
    late = (F.xxhash64("event_id") % 5 == 0) & (F.col("event_timestamp") > F.lit(middle) - F.expr("INTERVAL 2 DAYS"))
    early = F.col("event_timestamp") < F.lit(middle)
    arrive(events.where(early & ~late), tmp_path)
    run()
    so_far = rollups.read_windows(spark, hours).collect()
    whole = METRICS["M08"](shop)
    assert 0 < len(so_far) < whole.count() and all(r.checkout_hour < middle for r in so_far)
    arrive(events.where(early & late), tmp_path)  # up to two days behind what was seen
    arrive(events.where(~early), tmp_path)
    run()
    arrive(rollups.heartbeat(events, last + dt.timedelta(days=5)), tmp_path)
    run()
    expected = spark_rows(whole)
    assert spark_rows(rollups.read_windows(spark, hours)) == expected

    # The last batch that wrote something lost its mark of being done: it runs again.
    commits = sorted((int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit()))
    for mark in (tmp_path / "checkpoint" / "commits").iterdir():
        if str(commits[-1]) in mark.name.split("."):
            mark.unlink()
    run()
    assert spark_rows(rollups.read_windows(spark, hours)) == expected


def test_a_checkout_after_the_delay_is_not_counted_and_told(spark, shop, tmp_path):
    events = shop["api_performance"]
    rollups.cart_snapshot(shop.relations).write.parquet(str(tmp_path / "carts"))
    first, last = events.agg(F.min("event_timestamp"), F.max("event_timestamp")).first()
    half = F.col("event_timestamp") < F.lit(first + (last - first) / 2)
    arrive(events.where(~half), tmp_path)
    hours, checkpoint = str(tmp_path / "hours"), str(tmp_path / "checkpoint")
    rollups.write_windows(windows_of(spark, shop, tmp_path, "1 hour"), hours, checkpoint).awaitTermination()
    arrive(events.where(half), tmp_path)
    arrive(rollups.heartbeat(events, last + dt.timedelta(days=5)), tmp_path)
    query = rollups.write_windows(windows_of(spark, shop, tmp_path, "1 hour"), hours, checkpoint)
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped > 0
    later = spark_rows(METRICS["M08"](Relations({**{n: shop[n] for n in ("shopping_cart", "shopping_cart_item", "product_availability", "product_price")}, "api_performance": events.where(~half)})))
    assert spark_rows(rollups.read_windows(spark, hours)) == later
