"""Group runs and what is written about them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.handmade import at, tables
from tillwork.operators.relations import Relations
from tillwork.plans import runs
from tillwork.plans.metrics import METRICS

AS_OF = dt.datetime(2024, 2, 15, 12, 0, 0)


def test_run_writes_rows_and_record(spark, shop, tmp_path):
    results = runs.run_group(shop, "operational_dashboard", str(tmp_path), AS_OF)
    assert [r.metric for r in results] == runs.GROUPS["operational_dashboard"]
    revenue = results[-1]
    assert revenue.path.endswith("/operational_dashboard/q08_revenue_by_hour/20240215T120000Z")
    record = runs.read_record(spark, revenue.path)
    assert record["row_count"] == METRICS["M08"](shop).count() == spark.read.option("header", True).csv(f"{revenue.path}/data").count()
    newest = shop["api_performance"].agg(F.max("event_timestamp")).first()[0]
    assert record["data_latency_seconds"] == round((AS_OF - newest).total_seconds(), 3)
    assert record["data_volume_bytes"] > 0 and record["result_size_bytes"] > 0 and record["query_id"] == 8


def test_the_other_reading_of_two_numbers(shop, tmp_path):
    results = runs.run_group(shop, "operational_dashboard", str(tmp_path), AS_OF, id_map=runs.ALTERNATIVE_IDS)
    assert [r.metric for r in results] == ["M01", "M02", "M03", "M22", "M08"]
    assert results[3].path.split("/")[-2] == "q06_cart_abandonment"


def test_groups_share_what_they_hold(spark, tmp_path, monkeypatch):
    """All groups work the sessions, sold lines and their values out once, and nothing stays held afterwards."""
    held = []
    hold = Relations._hold

    def seen(self, df):
        df = hold(self, df)
        held.append((tuple(df.columns), df))
        return df

    monkeypatch.setattr(Relations, "_hold", seen)
    source = tables(spark, [("a", 0, "GET /x"), ("a", 30, "POST /api/v1/cart"), ("b", 5, "GET /y")])
    results = runs.run_all(source, str(tmp_path), AS_OF)
    assert [r.metric for r in results] == [m for group in runs.GROUPS.values() for m in group]
    columns = [c for c, _ in held]
    assert len(columns) == len(set(columns))
    assert sum("request_count" in c for c in columns) == 1 and ("SHP_CART_ID", "PRODUCT_ID", "QUANTITY") in columns
    assert not any(df.is_cached for _, df in held)


def test_coverage_is_checked_first():
    with pytest.raises(runs.MissingMetric, match="lacks M08"):
        runs.check_coverage("operational_dashboard", known={id: None for id in METRICS if id != "M08"})
    with pytest.raises(runs.MissingMetric, match="unknown group"):
        runs.check_coverage("nope")
    assert sum(len(runs.check_coverage(g)) for g in runs.GROUPS) == 18


def test_freshness(spark):
    events = tables(spark, [("a", 0, "x"), ("a", 30.5, "y")])["api_performance"]
    assert runs.freshness(events, at(40)).first().data_latency_seconds == 9.5
    assert runs.freshness(events, at(10)).first().data_latency_seconds == 0.0
    assert tuple(runs.freshness(tables(spark)["api_performance"], at(10)).first()) == (None, None)


def test_choice_of_the_event_table(spark):
    def events(*seconds):
        return tables(spark, [("a", s, "x") for s in seconds])["api_performance"]

    undated = events(1, 2, 3).withColumn("event_timestamp", F.lit(None).cast("timestamp"))
    missing = lambda: spark.read.parquet("/no/such/folder")
    choose = runs.choose_event_table
    assert choose({"a": events(1), "b": events(5), "c": events(2, 3)}, "a") == "b"
    assert choose({"a": events(5), "b": events(5, 5)}, "b") == "a"
    assert choose({"a": undated, "b": events(1)}, "x") == "b"
    assert choose({"a": undated.limit(1), "b": undated, "c": undated}, "x") == "b"
    assert choose({"a": missing, "b": events()}, "x") == "x"
    assert choose({"a": missing}, "x") == "x"


def test_the_volume_is_that_of_the_scanned_files(spark, tmp_path):
    path = tmp_path / "rows"
    spark.range(5000).select("id", (F.col("id") % 2).alias("part")).write.partitionBy("part").parquet(str(path))
    sizes = {n: sum(f.stat().st_size for f in path.glob(f"part={n}/*.parquet")) for n in (0, 1)}
    rows = spark.read.parquet(str(path))
    assert runs.scanned_bytes(rows.groupBy("part").count()) == sizes[0] + sizes[1]
    assert runs.scanned_bytes(rows.where("part = 1").orderBy("id")) == sizes[1]
    assert runs.scanned_bytes(rows.where("part = 1").join(rows.where("part = 0"), "id")) == sizes[0] + sizes[1]
    held = rows.where("part = 0").persist()
    try:
        assert runs.scanned_bytes(held.groupBy("id").count()) == sizes[0]
    finally:
        held.unpersist()
    assert runs.scanned_bytes(spark.range(9)) == 0


def test_every_metric_of_a_run_has_its_volume(shop, tmp_path):
    results = runs.run_group(shop, "daily_reporting", str(tmp_path), AS_OF)
    assert all(r.metadata["data_volume_bytes"] > 0 for r in results)
