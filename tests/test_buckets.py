"""Buckets, commits and batches of mirrored tables."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tillwork.sources import mirror
from tillwork.sources.commits import CommitConflict, CommitLog, VersionTaken

SCHEMA = "id BIGINT, at TIMESTAMP, v STRING"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def numbered(spark, n):
    return spark.range(n).select("id", F.lit(day(1)).alias("at"), F.concat(F.lit("v"), "id").alias("v"))


def content(df):
    return {r.id: (r.at, r.v) for r in df.collect()}


def files(table):
    return {(p["id"], n) for p in table._state()["parts"] for n in p["buckets"]}


def test_a_small_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"), buckets=40)
    table.replace(numbered(spark, 2000), "id")
    before = files(table)
    assert len(before) == 40
    batch = spark.range(0, 2000, 200).select("id", F.lit(day(2)).alias("at"), F.lit("new").alias("v"))
    table.merge(batch, "id", "at")
    after = files(table)
    assert 1 <= len(after - before) <= 10 and len(after) == 40
    rows = content(table.read())
    assert len(rows) == 2000 and all((rows[i][1] == "new") == (i % 200 == 0) for i in rows)
    assert table.cursor().startswith("2024-01-03")
    assert table.buckets_of(batch) == sorted(n for _, n in after - before)
    table.merge(batch.where("1 = 0"), "id", "at")
    assert files(table) == after


def test_a_batch_is_read_once(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"), buckets=4)
    table.replace(numbered(spark, 100), "id")
    read = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    batch = spark.range(30).select("id", F.lit(day(3)).alias("at"), F.lit("x").alias("v")).mapInArrow(watch, SCHEMA)
    table.merge(batch, "id", "at")
    assert read.value == 30 and sum(v == "x" for _, v in content(table.read()).values()) == 30


def test_a_table_without_a_key_is_bucketed_by_its_first_merge(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"), buckets=8)
    table.append(numbered(spark, 50))
    table.append(numbered(spark, 50).withColumn("id", F.col("id") + 50))
    table.merge(spark.createDataFrame([(3, day(9), "z"), (500, day(9), "y")], SCHEMA), "id", "at")
    assert table._state()["key"] == "id" and len(files(table)) <= 8
    rows = content(table.read())
    assert len(rows) == 101 and rows[3][1] == "z" and rows[4][1] == "v4"


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"), buckets=4)
    table.replace(numbered(spark, 20), "id")
    opened = table.read()
    table.merge(numbered(spark, 20).withColumn("at", F.lit(day(5))).withColumn("v", F.lit("later")), "id", "at")
    assert all(v.startswith("v") for _, v in content(opened).values())


def test_two_appends_at_once_both_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    mirror.MirroredTable(spark, path).append(numbered(spark, 5))
    errors, ready = [], threading.Barrier(4)

    def add(k):
        try:
            table = mirror.MirroredTable(spark, path)
            write = table._write

            def together(*args):
                part = write(*args)
                ready.wait(60)  # all have read the same version
                return part

            table._write = together
            table.append(numbered(spark, 5).withColumn("v", F.lit(f"w{k}")))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    counts = {r.v: r["count"] for r in mirror.MirroredTable(spark, path).read().groupBy("v").count().collect()}
    assert all(counts[f"w{k}"] == 5 for k in range(4))


def test_merges_at_once_survive_in_other_buckets_and_fail_in_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    table = mirror.MirroredTable(spark, path, buckets=50)
    table.replace(numbered(spark, 200), "id")

    def one(i, at, v):
        return spark.createDataFrame([(i, at, v)], SCHEMA)

    def during(slow, other):
        """``slow`` is merged while ``other`` is: it comes second."""
        late = mirror.MirroredTable(spark, path)
        log = late._log

        def after_the_other(state):
            late._log = log
            mirror.MirroredTable(spark, path).merge(other, "id", "at")
            log(state)

        late._log = after_the_other
        late.merge(slow, "id", "at")

    mine = table.buckets_of(one(1, None, ""))
    elsewhere = next(i for i in range(2, 200) if table.buckets_of(one(i, None, "")) != mine)
    table.merge(one(0, day(7), "cursor"), "id", "at")
    during(one(1, day(7), "mine"), one(elsewhere, day(7), "theirs"))
    rows = content(table.read())
    assert (rows[1][1], rows[elsewhere][1]) == ("mine", "theirs")
    with pytest.raises(CommitConflict):
        during(one(1, day(8), "again"), one(1, day(7), "first"))
    assert content(table.read())[1][1] == "first"


def test_a_version_has_one_winner(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.read() is None and log.versions() == []
    log.write({"version": 1, "who": "first"})
    with pytest.raises(VersionTaken):
        log.write({"version": 1, "who": "second"})
    assert log.read()["who"] == "first" and [n for n in log.names(log.path) if "draft" in n] == []


def test_old_versions_are_removed_and_the_newest_stay_whole(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"), buckets=4)
    for k in range(5):
        table.replace(numbered(spark, 10).withColumn("v", F.lit(str(k))), "id")
    lost = table._write(numbered(spark, 3), "id", 4)  # a writer that crashed before its commit
    assert table.vacuum(keep=2) == []  # all too young
    gone = table.vacuum(keep=2, grace_seconds=0)
    assert lost["id"] in gone and len(gone) == 4
    assert {v for _, v in content(table.read()).values()} == {"4"} and len(table._commits.versions()) == 2


def test_parts_are_merged_in_tiers(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    table.append(numbered(spark, 2))
    for _ in range(30):
        table.append(numbered(spark, 2))
        table.compact(fan=3, combine=lambda rows: rows.distinct())
        assert len(table._state()["parts"]) <= 2 * 4
    assert content(table.read()) == content(numbered(spark, 2)) and table.read().count() < 20


def test_the_log_stays_bounded_over_a_thousand_batches():
    """Which parts are merged and which batches are remembered, without their files."""
    parts, batches, most = [], {}, 0
    for k in range(1000):
        parts.append({"id": str(k), "buckets": [0], "level": 0})
        batches = mirror.StreamBatch("s", k, f"{k}").noted(batches, str(k), 50)
        while merged := mirror.MirroredTable._tier(parts, 10):
            first = parts.index(merged[0])
            parts = [p for p in parts if p not in merged]
            parts.insert(first, {"id": f"{merged[0]['id']}+", "buckets": [0], "level": merged[0]["level"] + 1})
        most = max(most, len(parts))
    assert most <= 9 * 3 + 1 and len(parts) == 1
    assert len(batches["s"]["seen"]) == 50 and mirror.StreamBatch("s", 999, "999").known(batches)
    with pytest.raises(CommitConflict):
        mirror.StreamBatch("s", 3, "3").known(batches)


def test_batches_count_once_and_others_under_their_id_fail(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    rows = numbered(spark, 3)
    first = mirror.StreamBatch.of(rows, 0)
    assert not table.taken(first)
    table.append(rows, batch=first)
    assert table.taken(mirror.StreamBatch.of(rows.orderBy(F.desc("id")), 0))
    assert content(table.part_of(first)) == content(rows)
    with pytest.raises(CommitConflict, match="with other rows"):
        table.taken(mirror.StreamBatch.of(rows.limit(2), 0))
    assert not table.taken(mirror.StreamBatch.of(rows, 1)) and not table.taken(mirror.StreamBatch.of(rows, 0, "other"))


def test_rows_of_other_types_are_refused(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    table.append(numbered(spark, 3))
    with pytest.raises(ValueError, match="other types"):
        table.append(numbered(spark, 3).withColumn("v", F.lit(1)))
    with pytest.raises(ValueError, match="_bucket"):
        mirror.MirroredTable(spark, str(tmp_path / "u")).append(numbered(spark, 3).withColumn("_bucket", F.lit(1)))


def pushed(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.split("\n") if "PushedFilters" in line][0].split("PushedFilters:")[1]


def test_slices_reach_the_scan(spark, tmp_path):
    numbered(spark, 10).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert "GreaterThanOrEqual(at" in pushed(mirror.incremental_slice(rows, "at", F.lit(day(1))))
    taken = pushed(mirror.incremental_slice(rows, "at", F.lit(day(1)), "take"))
    assert "Or(GreaterThanOrEqual(at" in taken and "IsNull(at)" in taken


def test_mirror_takes_rows_without_a_cursor_if_told(spark, tmp_path):
    rows = [(1, 5, day(1)), (2, 6, None)]
    schema = "SHP_CART_ID BIGINT, X INT, DATE_MODIFIED TIMESTAMP"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "source" / "shopping_cart.parquet"))
    source, out = mirror.ParquetSource(str(tmp_path / "source")), str(tmp_path / "out")
    mirror.mirror_tables(spark, source, out, ["shopping_cart"])
    with pytest.raises(ValueError, match="has no DATE_MODIFIED"):
        mirror.mirror_tables(spark, source, out, ["shopping_cart"])
    mirror.mirror_tables(spark, source, out, ["shopping_cart"], null_cursors="take", keep_versions=1)
    assert mirror.MirroredTable(spark, f"{out}/shopping_cart").read().count() == 2
