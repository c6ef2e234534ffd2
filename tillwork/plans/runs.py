"""Scheduled runs of metric groups, and what is written about them."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillwork.operators.relations import Relations
from tillwork.plans.metrics import METRICS

# The metrics of each group.
GROUPS: dict[str, list[str]] = {
    "operational_dashboard": ["M01", "M02", "M03", "M06", "M08"],
    "business_dashboard": ["M07", "M09", "M10", "M11", "M12"],
    "behavioral_analytics": ["M14", "M15", "M16", "M17", "M18"],
    "daily_reporting": ["M04", "M05", "M13"],
}

# The other reading of two numbers: "6" as cart abandonment and "7" as the cart
# value distribution. Pass as ``id_map`` to run a group that way.
ALTERNATIVE_IDS = {"M06": "M22", "M07": "M23"}


class MissingMetric(RuntimeError):
    pass


def check_coverage(group: str, id_map: Mapping[str, str] | None = None, known: Mapping = METRICS) -> list[str]:
    """Ids of the group's metrics; fails before anything runs if one is undefined."""
    if group not in GROUPS:
        raise MissingMetric(f"unknown group {group!r}")
    ids = [(id_map or {}).get(id, id) for id in GROUPS[group]]
    missing = [id for id in ids if id not in known]
    if missing:
        raise MissingMetric(f"group {group!r} lacks {', '.join(missing)}")
    return ids


def latest_event(events: DataFrame) -> DataFrame:
    return events.agg(F.max("event_timestamp").alias("latest_data_used_at"))


def freshness(events: DataFrame, as_of) -> DataFrame:
    """Age in seconds of the newest event at ``as_of``: never negative, null if there is none."""
    at = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(at) - F.unix_micros("latest_data_used_at")) / 1_000_000
    # greatest() skips nulls, so the null case is spelled out.
    age = F.when(F.col("latest_data_used_at").isNotNull(), F.greatest(F.lit(0.0), age))
    return latest_event(events).select("latest_data_used_at", F.round(age, 3).alias("data_latency_seconds"))


def probe_event_tables(candidates: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame | None:
    """Rows and newest event of each usable candidate; None if none is usable."""
    probes = None
    for position, (name, table) in enumerate(candidates.items()):
        try:
            table = table() if callable(table) else table
            probe = table.agg(F.count(F.lit(1)).alias("row_count"), F.max("event_timestamp").alias("latest"))
            probe = probe.select(F.lit(name).alias("candidate"), F.lit(position).alias("position"), "row_count", "latest")
            # One row, read here: a table that can't be read fails now and is skipped.
            probe = probe.sparkSession.createDataFrame(probe.collect(), probe.schema)
        except Exception:
            continue
        probes = probe if probes is None else probes.unionByName(probe)
    return probes


def rank_event_tables(probes: DataFrame) -> DataFrame:
    """Best candidate first: newest event, else most rows, else the order given."""
    rows_if_undated = F.when(F.col("latest").isNull(), F.col("row_count"))
    return probes.where("row_count > 0").orderBy(F.desc_nulls_last("latest"), rows_if_undated.desc_nulls_last(), "position")


def choose_event_table(candidates: Mapping[str, DataFrame | Callable[[], DataFrame]], configured: str) -> str:
    probes = probe_event_tables(candidates)
    best = rank_event_tables(probes).limit(1).collect() if probes is not None else []
    return best[0].candidate if best else configured


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that the scans of a query's plan select, after partition pruning.

    The scans look their files up anyway, so none is listed a second time, and none by name on the driver. A table that
    is scanned twice counts twice, and a held relation with the files it was made of. Sources that aren't files count 0.
    """
    total, plans = 0, [df._jdf.queryExecution().sparkPlan()]
    while plans:
        plan = plans.pop()
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.getClass().getSimpleName()
            if kind == "FileSourceScanExec":
                total += leaf.selectedPartitions().totalFileSize()
            elif kind == "InMemoryTableScanExec":
                plans.append(leaf.relation().cacheBuilder().cachedPlan())
            elif kind == "AdaptiveSparkPlanExec":
                plans.append(leaf.inputPlan())
    return total


@dataclass(frozen=True)
class Result:
    metric: str
    slug: str
    row_count: int
    path: str
    metadata: dict


def write_result(df: DataFrame, path: str, metadata: Mapping) -> dict:
    """Write a metric as CSV and its run record as JSON next to it.

    The row count is observed while the rows are written, not counted again; the data volume comes from the plan's scans.
    """
    spark = df.sparkSession
    observation = Observation()
    started = time.perf_counter()
    observed = df.observe(observation, F.count(F.lit(1)).alias("row_count"))
    observed.write.mode("overwrite").option("header", True).csv(f"{path}/data")
    volume = scanned_bytes(df)
    record = {
        **metadata,
        "row_count": observation.get["row_count"],
        "duration_seconds": round(time.perf_counter() - started, 3),
        "data_volume_bytes": volume,
        "data_volume_megabytes": round(volume / (1024 * 1024), 3),
    }
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{path}/data").agg(F.sum("length"))
    record["result_size_bytes"] = size.first()[0]
    # One short line of text, about the data and not part of it.
    spark.range(1).select(F.lit(json.dumps(record)).alias("value")).write.mode("overwrite").text(f"{path}/meta")
    return record


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def run_group(
    tables: Mapping[str, DataFrame] | Relations,
    group: str,
    out: str,
    as_of: dt.datetime,
    id_map: Mapping[str, str] | None = None,
) -> list[Result]:
    """Run the metrics of a group one after the other on shared relations.

    A metric's data volume has all files behind it, also those of relations that are held for several metrics. Several
    groups share what is held if they are given the same ``Relations``; whoever made these releases them.
    """
    ids = check_coverage(group, id_map)
    run_key = as_of.strftime("%Y%m%dT%H%M%SZ")
    relations = tables if isinstance(tables, Relations) else Relations(tables, keep=True)
    results = []
    try:
        newest = relations.sessions.agg(F.max("last_event_ts")).first()[0]
        latency = None if newest is None else max(0.0, (as_of.replace(tzinfo=None) - newest).total_seconds())
        for number, id in zip(GROUPS[group], ids):
            slug = METRICS[id].name
            path = f"{out.rstrip('/')}/{group}/q{number[1:]}_{slug}/{run_key}"
            record = write_result(
                METRICS[id](relations),
                path,
                {
                    "executed_at_utc": run_key,
                    "calculated_at_utc": as_of.isoformat(),
                    "latest_data_used_at_utc": newest.isoformat() if newest else None,
                    "data_latency_seconds": None if latency is None else round(latency, 3),
                    "data_latency_minutes": None if latency is None else round(latency / 60, 3),
                    "group": group,
                    "query_id": int(number[1:]),
                    "slug": slug,
                },
            )
            results.append(Result(id, slug, record["row_count"], path, record))
    finally:
        if relations is not tables:
            relations.release()
    return results


def run_all(tables: Mapping[str, DataFrame], out: str, as_of: dt.datetime) -> list[Result]:
    """Run all groups one after the other; what they share is worked out once."""
    relations = Relations(tables, keep=True)
    try:
        return [result for group in GROUPS for result in run_group(relations, group, out, as_of)]
    finally:
        relations.release()
