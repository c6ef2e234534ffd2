"""What the plans look like: no Python, no cross joins, filters at the scan, hot keys split."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tillwork.operators import relations
from tillwork.plans.catalogue import QUERIES
from tillwork.plans.metrics import METRICS
from tillwork.session import tune
from tillwork.sources import mirror


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


STORED = ("_stream", "_stored", "E04", "E05", "E08", "E09", "R0", "T07", "T08", "C14")


@pytest.mark.parametrize("id", sorted(q for q in QUERIES if not any(s in q for s in STORED)))
def test_no_python_and_no_cross_join(shop, id):
    text = plan(QUERIES[id](shop))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if id != "C25":
        assert not any(node in text for node in ("InPandas", "InArrow", "EvalPython", "PythonUDF"))


@pytest.fixture(scope="module")
def stored_events(spark, shop, tmp_path_factory):
    """Events as a table of their own, as the ingest writes them."""
    path = str(tmp_path_factory.mktemp("events"))
    shop["api_performance"].write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_checkout_prefix_reaches_the_scan(stored_events):
    text = plan(relations.checkouts(stored_events))
    assert "StringStartsWith(endpoint,POST /api/v1/auth/cart/)" in text
    assert "ReadSchema: struct<event_timestamp:timestamp,endpoint:string,session_id:string>" in text


def test_only_the_columns_a_metric_needs_are_read(stored_events):
    tables = {"api_performance": stored_events}
    assert "ReadSchema: struct<event_timestamp:timestamp,session_id:string>" in plan(METRICS["M01"](tables))
    assert "ReadSchema: struct<event_timestamp:timestamp,endpoint:string,session_id:string>" in plan(METRICS["M02"](tables))


def test_sessions_are_cut_down_before_the_shuffle(stored_events):
    text = plan(METRICS["M02"]({"api_performance": stored_events}))
    assert "partial_min" in text and "SortAggregate" not in text


def test_newest_version_per_key_is_limited_before_the_shuffle(shop):
    text = plan(mirror.latest_per_key(shop["shopping_cart"], "SHP_CART_ID", "DATE_MODIFIED"))
    assert text.count("WindowGroupLimit") >= 2


def test_a_small_batch_is_merged_without_shuffling_the_target(spark, shop, tmp_path):
    path = str(tmp_path / "target")
    shop["shopping_cart"].write.parquet(path)
    target = spark.read.parquet(path)
    merged = mirror.merge_upsert(target, target.where("SHP_CART_ID < 10"), "SHP_CART_ID", "DATE_MODIFIED")
    merged.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        merged.explain()
    lines = out.getvalue().split("Initial Plan")[0].splitlines()
    anti = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "LeftAnti" in line)
    # What the join reads on its left is the table itself.
    assert "FileScan" in lines[anti + 2] and "Exchange" not in lines[anti + 1] + lines[anti + 2]


def test_pages_are_a_top_k(shop):
    assert "TakeOrderedAndProject" in plan(QUERIES["C31"](shop))


@pytest.fixture
def small_partitions(spark):
    """Settings under which a few megabytes count as much, to see hot keys split."""
    changes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_product_in_a_third_of_all_lines_is_split(spark, small_partitions):
    rows = 300_000
    product = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50_000)
    items = spark.range(0, rows, 1, 8).select(
        F.col("id").alias("SHP_CART_ID"), product.alias("PRODUCT_ID"), F.lit(2).alias("QUANTITY")
    )
    products = spark.range(50_000).select(F.col("id").alias("PRODUCT_ID"), F.col("id").alias("PRODUCT_AVAIL_ID"))
    amounts = products.select("PRODUCT_AVAIL_ID", F.lit("1.50").cast("decimal(18,2)").alias("PRODUCT_PRICE_AMOUNT"))
    prices = relations.product_prices(products, amounts)
    values = relations.cart_values(items, prices)
    assert tuple(values.agg(F.count("*"), F.sum("cart_value")).first()) == (rows, rows * 3)
    joined = relations.line_values(items, prices)
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    assert "skew=true" in plan(joined)


def test_a_cart_in_a_third_of_all_lines_is_split(spark, small_partitions):
    rows = 300_000
    cart = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50_000)
    # The quantities are spread so that the hot cart's lines do not compress away.
    items = spark.range(0, rows, 1, 8).select(
        cart.alias("SHP_CART_ID"), F.xxhash64("id").alias("PRODUCT_ID"), F.lit(1).alias("QUANTITY")
    )
    sold = spark.range(50_000).select(F.col("id").alias("SHP_CART_ID"))
    lines = items.join(sold, "SHP_CART_ID", "left_semi").groupBy("SHP_CART_ID", "PRODUCT_ID").agg(F.sum("QUANTITY").alias("QUANTITY"))
    assert len(lines.collect()) == rows
    assert "skew=true" in plan(lines)


def test_a_session_with_a_third_of_all_events(spark):
    rows = 300_000
    session = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("id") % 1000).cast("string")))
    endpoint = F.when(F.col("id") % 100 == 1, "POST /api/v1/cart").otherwise(F.concat(F.lit("GET /p/"), (F.col("id") % 17).cast("string")))
    events = spark.range(0, rows, 1, 8).select(
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("event_timestamp"), endpoint.alias("endpoint"), session.alias("session_id")
    )
    sessions = relations.session_facts(events)
    hot = sessions.where("session_id = ''").first()
    assert hot.request_count == rows // 3 and hot.first_endpoint == "GET /p/0"
    assert sessions.agg(F.sum("request_count")).first()[0] == rows


def test_weights_are_summed_without_a_row_per_unit(shop):
    for name in ("C20", "C22"):
        assert "UNIT#" not in plan(QUERIES[name](shop)), name
    assert "UNIT#" in plan(QUERIES["C24"](shop))


def test_session_value_needs_no_join_of_all_sessions(shop):
    """The value of sales is a subquery of one row; the sessions themselves are only counted."""
    text = plan(METRICS["M03"](shop))
    outer = text.split("Subquery")[0]
    assert "SortMergeJoin" not in outer and "BroadcastHashJoin" not in outer


def test_small_partitions_are_merged_up_to_a_bounded_size(spark):
    """About 40 MB that are shuffled come to several tasks, also where Spark needs no more of them to keep its cores busy."""
    tune(spark)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(2_500_000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).repartition("id")
        tasks = len(rows.groupBy(F.spark_partition_id()).agg(F.sum("a"), F.sum("b")).collect())
        assert 3 <= tasks < 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
