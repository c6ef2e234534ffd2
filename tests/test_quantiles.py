"""Exact percentiles against a plain computation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwork.operators.quantiles import exact_summary
from tillwork.plans.metrics import METRICS


def expected(values, percent):
    values = sorted(values)
    place = (len(values) - 1) * percent
    low, rest = divmod(place, 100)
    high = low + (1 if rest else 0)
    return float(round(values[low] + (values[high] - values[low]) * rest / 100, 4))


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_of_skewed_amounts(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b"):
        amounts = [Decimal(rng.randint(-500, 10**rng.randint(1, 9))) / 100 for _ in range(rng.randint(1, 400))]
        amounts += [Decimal("42.00")] * len(amounts)  # one value holds half of the rows
        rows += [(key, a) for a in amounts]
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "k STRING, v DECIMAL(18,2)")
    wanted = {"p0": 0, "p50": 50, "p75": 75, "p95": 95, "p100": 100}
    for r in exact_summary(df, ["k"], "v", wanted).collect():
        values = [v for k, v in rows if k == r.k and v is not None]
        assert (r["count"], float(r.total), r.least, r.most) == (len(values), float(sum(values)), min(values), max(values))
        assert [r[name] for name in wanted] == [expected(values, p) for p in wanted.values()]


def test_no_input_gives_one_row_without_keys(spark):
    row = exact_summary(spark.createDataFrame([], "v DECIMAL(18,2)"), [], "v", {"p50": 50}).collect()
    assert [tuple(r) for r in row] == [(0, None, None, None, None)]


def test_sketches_come_close(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id") % 7919 / F.lit(100)).cast("decimal(18,2)").alias("v"))
    wanted = {"p50": 50, "p95": 95}
    exact = exact_summary(df, [], "v", wanted).first()
    rough = exact_summary(df, [], "v", wanted, approximate=True).first()
    assert tuple(exact)[:4] == tuple(rough)[:4]
    assert abs(exact.p50 - rough.p50) < 1 and abs(exact.p95 - rough.p95) < 1


@pytest.mark.parametrize("id", ["M08", "M13", "M14", "M15", "M21", "M23"])
def test_the_rough_form_of_a_metric_has_the_same_shape(shop, id):
    exact, rough = METRICS[id](shop), METRICS[id].build(shop.relations, approximate=True)
    assert exact.columns == rough.columns and exact.count() == rough.count()
