"""Incremental copies: merges, replays, versions."""

import datetime as dt
import itertools

import pytest

from tillwork.sources import mirror

DAY = [dt.datetime(2024, 1, d) for d in range(1, 29)]
SCHEMA = "id BIGINT, at TIMESTAMP, v STRING"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return sorted((r.id, r.at, r.v) for r in df.select("id", "at", "v").collect())


def merged(spark, target, batch):
    return content(mirror.merge_upsert(frame(spark, *target), frame(spark, *batch), "id", "at"))


TARGET = [(1, DAY[1], "a"), (2, DAY[5], "b"), (3, None, "c")]


def test_update_insert_late_and_equal(spark):
    batch = [(1, DAY[2], "a2"), (2, DAY[3], "late"), (4, DAY[1], "new"), (3, DAY[0], "dated")]
    assert merged(spark, TARGET, batch) == [(1, DAY[2], "a2"), (2, DAY[5], "b"), (3, DAY[0], "dated"), (4, DAY[1], "new")]
    assert merged(spark, TARGET, [(2, DAY[5], "same cursor")])[1] == (2, DAY[5], "same cursor")
    assert merged(spark, TARGET, [(2, None, "no cursor")])[1] == (2, DAY[5], "b")
    assert (3, None, "c2") in [r for r in mirror.merge_upsert(frame(spark, *TARGET), frame(spark, (3, None, "c2")), "id", "at").collect()]


def test_replay_changes_nothing_and_order_of_batches_does_not_matter(spark):
    batches = [[(1, DAY[2], "x")], [(1, DAY[4], "y"), (5, DAY[4], "z")], [(1, DAY[3], "w"), (5, DAY[1], "old")]]
    results = []
    for order in itertools.permutations(batches):
        df = frame(spark, *TARGET[:2])
        for batch in (*order, order[0]):
            df = mirror.merge_upsert(df, frame(spark, *batch), "id", "at")
        results.append(content(df))
    assert all(r == results[0] for r in results)
    assert results[0] == [(1, DAY[4], "y"), (2, DAY[5], "b"), (5, DAY[4], "z")]


def test_several_versions_of_a_key_in_one_batch(spark):
    assert merged(spark, [], [(1, DAY[d], str(d)) for d in (3, 9, 5)]) == [(1, DAY[9], "9")]


def test_slice_includes_the_stored_cursor(spark):
    df = frame(spark, (1, DAY[1], "a"), (2, DAY[2], "b"), (3, DAY[3], "c"), (4, None, "d"))
    dated = df.where("at IS NOT NULL")
    assert [r[0] for r in content(mirror.incremental_slice(dated, "at", DAY[2]))] == [2, 3]
    assert sorted(r[0] for r in mirror.incremental_slice(df, "at", DAY[2], null_cursors="take").collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="has no at"):
        mirror.incremental_slice(df, "at", DAY[2]).collect()
    assert mirror.incremental_slice(df, "at", None).count() == 4
    assert mirror.next_cursor(df, "at").first()[0] == DAY[3]
    assert [r.id for r in mirror.range_slice(df, "at", DAY[1], DAY[3]).collect()] == [2, 1]
    assert [r.id for r in mirror.range_slice(df, "at", DAY[1], DAY[3], descending=False, limit=1).collect()] == [1]


def test_incremental_runs_end_where_a_full_copy_ends(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    assert not table.exists() and table.cursor() is None
    source = [(1, DAY[1], "a"), (2, DAY[2], "b")]
    table.refresh(frame(spark, *source), "id", "at")
    assert content(table.read()) == source
    table.refresh(frame(spark, *source), "id", "at")
    assert content(table.read()) == source
    changed = [(1, DAY[7], "a2"), (2, DAY[2], "b"), (3, DAY[2], "same moment")]
    table.refresh(frame(spark, *changed), "id", "at")
    assert content(table.read()) == sorted(changed)
    assert table.cursor().startswith("2024-01-08")
    table.refresh(frame(spark), "id", "at")
    assert content(table.read()) == sorted(changed) and table.cursor().startswith("2024-01-08")


def test_crash_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    table.replace(frame(spark, (1, DAY[1], "a")))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_log", crash)
        with pytest.raises(RuntimeError):
            table.merge(frame(spark, (1, DAY[2], "b")), "id", "at")
    assert content(table.read()) == [(1, DAY[1], "a")]
    table.merge(frame(spark, (1, DAY[2], "b")), "id", "at")
    assert content(table.read()) == [(1, DAY[2], "b")]


def test_replace_and_append(spark, tmp_path):
    table = mirror.MirroredTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, (1, DAY[1], "a")))
    table.append(frame(spark, (1, DAY[1], "a")))
    assert table.read().count() == 2
    table.merge(frame(spark, (9, DAY[9], "z")), "id", "at")
    table.replace(frame(spark, (2, DAY[2], "b")))
    assert content(table.read()) == [(2, DAY[2], "b")] and table.cursor() is None


def test_mirror_of_whole_tables(spark, tmp_path):
    source = tmp_path / "source"
    rows = spark.createDataFrame([(1, 5, DAY[1]), (2, 6, DAY[2])], "SHP_CART_ID BIGINT, X INT, DATE_MODIFIED TIMESTAMP")
    rows.write.parquet(str(source / "shopping_cart.parquet"))
    for disposition, expected in (("merge", 2), ("merge", 2), ("append", 4), ("replace", 2)):
        mirror.mirror_tables(spark, mirror.ParquetSource(str(source)), str(tmp_path / "out"), ["shopping_cart"], disposition)
        assert mirror.MirroredTable(spark, str(tmp_path / "out" / "shopping_cart")).read().count() == expected


def test_one_failing_target_does_not_stop_the_others(spark):
    seen = []

    def broken(name, df):
        raise OSError("no connection")

    with pytest.raises(mirror.FanOutFailed, match="targets failed: one, three") as failed:
        mirror.fan_out(
            {"t": frame(spark, *TARGET)},
            {"one": broken, "two": lambda name, df: seen.append((name, df.count())), "three": broken},
        )
    assert seen == [("t", 3)] and set(failed.value.failures) == {"one", "three"}


def test_adapt_types(spark):
    df = spark.sql("SELECT 0.1D AS d, CAST(0.1 AS FLOAT) AS f, array(1, 2) AS a, 'x' AS s")
    row = mirror.adapt_types(df).first()
    assert (row.d, str(row.f), row.a, row.s) == (0.1, "0.100000000", "[1,2]", "x")
    odd = spark.sql("SELECT CAST('NaN' AS FLOAT) AS a, CAST('Infinity' AS FLOAT) AS b, CAST(1e37 AS FLOAT) AS c")
    assert tuple(mirror.adapt_types(odd).first()) == (None, None, None)
    assert mirror.adapt_types(df, float_as_decimal=None, array_as_json=False).schema == df.schema


def test_parallel_jdbc_options():
    source = mirror.JdbcSource("jdbc:x", {"user": "u"}, {"orders": mirror.SplitBy("ID", 1, 1000, 16)})
    assert source.options("orders") == {
        "url": "jdbc:x", "dbtable": "orders", "fetchsize": "10000", "user": "u",
        "partitionColumn": "ID", "lowerBound": "1", "upperBound": "1000", "numPartitions": "16",
    }
    assert "partitionColumn" not in source.options("other")


def test_convert_files(spark, shop, tmp_path):
    for format in ("csv", "parquet"):
        mirror.convert_files(spark, f"{shop.folder}/orders.parquet", str(tmp_path / format), format)
    expected = shop["orders"].count()
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == expected
    csv = spark.read.schema(shop["orders"].schema).option("header", True).csv(str(tmp_path / "csv"))
    assert csv.exceptAll(shop["orders"]).isEmpty() and csv.count() == expected
