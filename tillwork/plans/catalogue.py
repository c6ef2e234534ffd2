"""Every operator as a named query over the shop tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.operators.relations import Relations
from tillwork.operators.requests import dedupe_events, normalize_requests
from tillwork.plans import runs, shop_queries
from tillwork.plans.metrics import METRICS
from tillwork.session import use_checkpoints
from tillwork.sources import mirror
from tillwork.sources.starschema import Shop
from tillwork.streaming import ingest, rollups

Query = Callable[[Shop], DataFrame]

QUERIES: dict[str, Query] = {}


def query(id: str):
    def register(build: Query) -> Query:
        if id in QUERIES:
            raise ValueError(f"{id} is registered twice")
        QUERIES[id] = build
        return build

    return register


def _relation(pick: Callable[[Relations], DataFrame]) -> Query:
    return lambda shop: pick(shop.relations)


def _amount(name: str):
    return F.col(name).cast("double").alias(name)


QUERIES.update(
    {
        "B01": _relation(lambda r: r.checkouts),
        "B02": _relation(lambda r: r.sale_sessions),
        "B03": _relation(
            lambda r: r.sessions.select("session_id", "first_event_ts", "first_cart_ts", "first_checkout_ts")
        ),
        "B04": _relation(lambda r: r.sold_carts),
        "B05": _relation(lambda r: r.session_carts),
        "B06": _relation(lambda r: r.prices.select("PRODUCT_ID", _amount("product_price_amount"))),
        "B07_sold_carts": _relation(lambda r: r.sold_cart_values.select("SHP_CART_ID", _amount("cart_value"))),
        "B07_all_carts": _relation(lambda r: r.cart_values.select("SHP_CART_ID", _amount("cart_value"))),
        "B07_session_carts": _relation(
            lambda r: r.session_cart_values.select("session_id", "SHP_CART_ID", _amount("cart_value"))
        ),
        "B08": _relation(lambda r: r.session_values.select("session_id", _amount("session_value"))),
        "B09": _relation(lambda r: r.sessions.select("session_id", "request_count", "duration_seconds")),
        "B10": _relation(lambda r: r.cart_stats),
    }
)

for _id, _metric in METRICS.items():
    QUERIES[_id] = lambda shop, metric=_metric: metric(shop.relations)

QUERIES["M16_per_status"] = lambda shop: METRICS["M16"].build(shop.relations, per_status=True)

# ------------------------------------------------------ sources, sinks and mirror


def _work(shop: Shop, name: str) -> str:
    """A new folder on the shared checkpoint storage for a query that writes."""
    return f"{use_checkpoints(shop.spark)}/tillwork/{name}-{uuid.uuid4().hex}"


@query("E01")
def e01(shop):
    return mirror.read_table(
        shop.spark, mirror.ParquetSource(shop.folder), "customer", ["c_custkey", "c_name", "c_nationkey"]
    )


_SLICE_FROM = "1999-01-01 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


@query("E02")
def e02(shop):
    return mirror.incremental_slice(shop["shopping_cart"], "DATE_MODIFIED", _ts(_SLICE_FROM))


@query("E02_next_cursor")
def e02_next_cursor(shop):
    return mirror.next_cursor(shop["shopping_cart"], "DATE_MODIFIED")


def _cart_batch(shop):
    """Updates of the carts changed since mid 1998, new carts, and rows that come late."""
    carts = shop["shopping_cart"]
    fresh = carts.where(F.col("DATE_MODIFIED") >= _ts("1998-06-01 00:00:00")).withColumn("PROMO_CODE", F.lit("new"))
    late = carts.where("SHP_CART_ID % 7 = 0").withColumns(
        {
            "PROMO_CODE": F.lit("late"),
            "DATE_MODIFIED": F.col("DATE_MODIFIED") - F.expr("INTERVAL '1000' DAY"),
        }
    )
    undated = carts.where("SHP_CART_ID % 11 = 0").withColumns(
        {"PROMO_CODE": F.lit("undated"), "DATE_MODIFIED": F.lit(None).cast("timestamp")}
    )
    return fresh.unionByName(late).unionByName(undated)


def _stored_carts(shop):
    return shop["shopping_cart"].where(F.col("DATE_MODIFIED") < _ts(_SLICE_FROM))


@query("E03")
def e03(shop):
    return mirror.merge_upsert(_stored_carts(shop), _cart_batch(shop), "SHP_CART_ID", "DATE_MODIFIED")


@query("E03_stored")
def e03_stored(shop):
    """The same merge as a job: stored, merged twice with the same batch, read back."""
    table = mirror.MirroredTable(shop.spark, _work(shop, "merge"))
    table.replace(_stored_carts(shop))
    batch = _cart_batch(shop)
    table.merge(batch, "SHP_CART_ID", "DATE_MODIFIED")
    table.merge(batch, "SHP_CART_ID", "DATE_MODIFIED")
    return table.read()


@query("E04")
def e04(shop):
    table = mirror.MirroredTable(shop.spark, _work(shop, "replace"))
    table.replace(_stored_carts(shop))
    table.replace(shop["shopping_cart"])
    return table.read()


@query("E05")
def e05(shop):
    table = mirror.MirroredTable(shop.spark, _work(shop, "append"))
    table.append(_stored_carts(shop))
    table.append(shop["shopping_cart"])
    return table.read()


@query("E06")
def e06(shop):
    return mirror.range_slice(
        shop["shopping_cart"], "DATE_MODIFIED", _ts("1997-01-01 00:00:00"), _ts("1998-01-01 00:00:00"), limit=10,
        tie_break=["SHP_CART_ID"],
    )


@query("E07")
def e07(shop):
    typed = shop["customer"].select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("float").alias("as_float"),
        F.array("c_name", "c_mktsegment").alias("as_array"),
    )
    return mirror.adapt_types(typed).withColumn("as_float", F.col("as_float").cast("double"))


@query("E08")
def e08(shop):
    work = _work(shop, "targets")
    targets = {
        name: lambda table, df, name=name: df.write.mode("overwrite").parquet(f"{work}/{name}/{table}")
        for name in ("first", "second")
    }
    mirror.fan_out({"customer": shop["shop_customer"], "cart": shop["shopping_cart"]}, targets)
    parts = [
        shop.spark.read.parquet(f"{work}/{target}/{table}").select(F.lit(target).alias("target"), F.lit(table).alias("table_name"), key)
        for target in targets
        for table, key in (("customer", F.col("CUSTOMER_ID").alias("key")), ("cart", F.col("SHP_CART_ID").alias("key")))
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy("target", "table_name").agg(F.count("key").alias("row_count"), F.sum("key").alias("key_sum"))


@query("E09")
def e09(shop):
    target = _work(shop, "csv")
    mirror.convert_files(shop.spark, f"{shop.folder}/customer.parquet", target, "csv")
    schema = shop["customer"].schema
    return shop.spark.read.schema(schema).option("header", True).csv(target)


# ------------------------------------------------------------------ trace events


@query("T01")
def t01(shop):
    return normalize_requests(shop["raw_requests"])


def _event_fields(*columns):
    """Some fields of the events; what the others cost is pruned."""
    return lambda shop: normalize_requests(shop["raw_requests"]).select("event_id", *columns)


QUERIES["T02"] = _event_fields("api_name")
QUERIES["T03"] = _event_fields("error_type")
QUERIES["T04"] = _event_fields("user_id")
QUERIES["T05"] = _event_fields("request_id", "client_id", "session_id")
QUERIES["T06"] = _event_fields("payload")


def _streamed(shop, copies: int = 1) -> Shop:
    """The shop with its events as a stream, each event ``copies`` times."""
    schema = shop["events"].schema
    # A pattern, as a stream takes a plain path only for a folder.
    files = f"{shop.folder}/events*.parquet"
    streams = [ingest.read_stream(shop.spark, files, schema) for _ in range(copies)]
    union = streams[0]
    for other in streams[1:]:
        union = union.unionByName(other)
    streaming = Shop(shop.spark, shop.folder)
    streaming.use("events", union)
    return streaming


@query("T07")
def t07(shop):
    work = _work(shop, "events")
    ingest.ingest_requests(_streamed(shop)["raw_requests"], f"{work}/data", f"{work}/checkpoint").awaitTermination()
    return ingest.clean_events(shop.spark, f"{work}/data", f"{work}/clean").drop("event_date")


@query("T08")
def t08(shop):
    """Every request arrives twice and is written once."""
    work = _work(shop, "twice")
    raw = _streamed(shop, copies=2)["raw_requests"]
    ingest.ingest_requests(raw, f"{work}/data", f"{work}/checkpoint").awaitTermination()
    return ingest.clean_events(shop.spark, f"{work}/data", f"{work}/clean").drop("event_date")


@query("T08_batch")
def t08_batch(shop):
    events = shop["api_performance"]
    return dedupe_events(events.unionByName(events))


@query("B03_stream")
def b03_stream(shop):
    work = _work(shop, "sessions")
    events = _streamed(shop)["api_performance"]
    rollups.write_parts(
        events, rollups.session_part, f"{work}/parts", f"{work}/checkpoint", merge=rollups.merge_sessions
    ).awaitTermination()
    return rollups.read_sessions(shop.spark, f"{work}/parts").select(
        "session_id", "first_event_ts", "first_cart_ts", "first_checkout_ts", "request_count", "duration_seconds"
    )


@query("M08_stream")
def m08_stream(shop):
    work = _work(shop, "sales")
    events = _streamed(shop)["api_performance"]
    rollups.write_parts(
        events, rollups.sales_part, f"{work}/parts", f"{work}/checkpoint", merge=rollups.merge_sales
    ).awaitTermination()
    return rollups.read_revenue_by_hour(shop.spark, f"{work}/parts", shop)


@query("B03_stream_compacted")
def b03_stream_compacted(shop):
    """Sessions from a stream whose batches are merged two by two on the way."""
    work = _work(shop, "compacted")
    events = shop["api_performance"]
    events.repartition(5).write.parquet(f"{work}/events")
    rollups.write_parts(
        ingest.read_stream(shop.spark, f"{work}/events", events.schema, max_files=1),
        rollups.session_part, f"{work}/parts", f"{work}/checkpoint", merge=rollups.merge_sessions, fan=2,
    ).awaitTermination()
    return rollups.read_sessions(shop.spark, f"{work}/parts").select(
        "session_id", "first_event_ts", "first_cart_ts", "first_checkout_ts", "request_count", "duration_seconds"
    )


@query("M08_windows")
def m08_windows(shop):
    """Hours of event time, each given once when its end has passed; a heartbeat ends the last one."""
    work = _work(shop, "windows")
    rollups.cart_snapshot(shop.relations).write.parquet(f"{work}/carts")
    events = shop["api_performance"]
    last = events.agg(F.max("event_timestamp")).first()[0]
    rollups.heartbeat(events, last + dt.timedelta(days=3)).write.parquet(f"{work}/clock")
    stream = _streamed(shop)["api_performance"].unionByName(ingest.read_stream(shop.spark, f"{work}/clock", events.schema))
    windows = rollups.revenue_windows(stream, shop.spark.read.parquet(f"{work}/carts"), "1 day")
    rollups.write_windows(windows, f"{work}/hours", f"{work}/checkpoint").awaitTermination()
    return rollups.read_windows(shop.spark, f"{work}/hours")


# ------------------------------------------------------------------- metric runs

_RUN_AT = dt.datetime(2024, 2, 15)


@query("R01")
def r01(shop):
    """All groups run; one row per metric with the rows it gave."""
    work = _work(shop, "runs")
    results = runs.run_all(shop, work, _RUN_AT)
    rows = [(r.metadata["group"], r.metric, r.slug, r.row_count) for r in results]
    return shop.spark.createDataFrame(rows, "group_name STRING, metric STRING, slug STRING, row_count BIGINT")


@query("R01_values")
def r01_values(shop):
    """All groups run and their written results read back: the sum of each number of each metric."""
    work = _work(shop, "values")
    sums = None
    for result in runs.run_all(shop, work, _RUN_AT):
        schema = METRICS[result.metric](shop.relations).schema
        written = shop.spark.read.schema(schema).option("header", True).csv(f"{result.path}/data")
        numbers = [f.name for f in schema if isinstance(f.dataType, T.NumericType)]
        total = written.agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in numbers])
        pairs = F.explode(F.create_map(*[c for n in numbers for c in (F.lit(n), F.round(n, 2))])).alias("number", "total")
        one = total.select(F.lit(result.metric).alias("metric"), pairs)
        sums = one if sums is None else sums.unionByName(one)
    return sums


@query("R05")
def r05(shop):
    """The metrics of each group as a run checks them beforehand, and how many rows each has."""
    parts = [
        METRICS[id](shop.relations).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(group).alias("group_name"), F.lit(id).alias("metric"), "row_count")
        for group in runs.GROUPS
        for id in runs.check_coverage(group)
    ]
    return reduce(DataFrame.unionByName, parts)


@query("R02")
def r02(shop):
    """Revenue by hour as it was written to CSV."""
    path = _work(shop, "result")
    metric = METRICS["M08"](shop)
    runs.write_result(metric, path, {"slug": "revenue_by_hour"})
    return shop.spark.read.schema(metric.schema).option("header", True).csv(f"{path}/data")


@query("R03")
def r03(shop):
    return runs.freshness(shop["api_performance"], "2024-02-15 00:00:00")


@query("R04")
def r04(shop):
    events = shop["api_performance"]
    candidates = {
        "older": events.where(F.col("event_timestamp") < _ts("2024-01-10 00:00:00")),
        "broken": lambda: events.drop("event_timestamp"),
        "undated": events.withColumn("event_timestamp", F.lit(None).cast("timestamp")),
        "newest": events,
        "empty": events.where(F.lit(False)),
    }
    ranked = runs.rank_event_tables(runs.probe_event_tables(candidates))
    return ranked.select("candidate", "row_count", "latest").limit(1)


QUERIES.update(shop_queries.QUERIES)
