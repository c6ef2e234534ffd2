"""Pages of hits, common beginnings, suggestions cut per request; taxes of many stores."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tests.test_shop_rules import ADDRESS, LINE, RATE
from tillwork.operators import search, taxes
from tillwork.operators.taxes import TaxSettings

NAMES = "id BIGINT, store STRING, language STRING, name STRING"
ASKED = "request_id STRING, store STRING, language STRING, text STRING, count INT, start INT"


def test_pages_of_hits(spark):
    names = [(i, "s", "en", "Handbag red" if i % 2 else "Hand cream") for i in range(10)] + [(90, "s", "fr", "Handbag"), (91, "t", "en", "Handbag")]
    terms = search.search_terms(spark.createDataFrame(names, NAMES))
    asked = [
        ("first", "s", "en", "handbag", 3, 0),
        ("second", "s", "en", "handbag", 3, 3),
        ("far", "s", "en", "handbag", 5, 8),
        ("beyond", "s", "en", "handbag", 5, 50),
        ("all", "s", "en", "handbag", None, None),
        ("none", "s", "en", "handbag", 0, 0),
        ("before", "s", "en", "handbag", 1, -4),
        ("nothing", "s", "en", "zzz", 5, 0),
        ("null", "s", "en", None, 5, 0),
    ]
    rows = {}
    for r in search.search_page(terms, spark.createDataFrame(asked, ASKED)).orderBy("request_id", "place").collect():
        rows.setdefault(r.request_id, []).append((r.place, r.id))
    best = [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]  # more of the word first, then by id
    assert rows == {
        "first": list(zip([0, 1, 2], best)),
        "second": list(zip([3, 4, 5], best[3:])),
        "far": list(zip([8, 9], best[8:])),
        "all": list(enumerate(best)),
        "before": [(0, 1)],
    }


def test_a_task_makes_few_hits_however_small_its_input_is(spark):
    """40 requests find all of 2,000 names by 3 terms each. Adaptive execution sees a few KB and would join them in one task."""
    documents = spark.range(2_000).select("id", F.lit("s").alias("store"), F.lit("en").alias("language"), F.concat(F.lit("hando "), "id").alias("name"))
    asked = spark.range(40).select(F.concat(F.lit("q"), "id").alias("request_id"), F.lit("s").alias("store"), F.lit("en").alias("language"), F.lit("hando").alias("text"))
    terms = search.search_terms(documents)
    hits = search.matched_terms(terms, asked, most=2_000)
    counts = [r["count"] for r in hits.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(counts) == 2_000 * 40 * 3 and max(counts) < sum(counts) / 8
    found = search.keyword_search(terms, asked)
    assert found.count() == 2_000 * 40 and found.where("matched_terms <> 3").count() == 0


def test_a_common_beginning_is_dealt_to_several_tasks(spark):
    """A third of all names begin alike; without adaptive execution no task gets more than some of them."""
    n = 30_000
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("common "), "id")).otherwise(F.concat(F.lit("x"), "id"))
    documents = spark.range(n).select("id", F.lit("s").alias("store"), F.lit("en").alias("language"), name.alias("name"))
    asked = spark.createDataFrame([("q", "s", "en", "com", 3, 0)], ASKED)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hits = search.matched_terms(search.search_terms(documents), asked, most=100)
        counts = [r["count"] for r in hits.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(counts) == n // 3 and len(counts) > 30 and max(counts) < n // 3 / 8
        page = search.search_page(search.search_terms(documents), asked)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit", 1)[1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dealt_terms_give_the_same_hits(spark):
    names = [(i, "s", "en", f"word{i % 4} common thing{i % 7}") for i in range(50)]
    terms = search.search_terms(spark.createDataFrame(names, NAMES))
    asked = spark.createDataFrame([("q", "s", "en", "common word1 thing3", None, None)], ASKED)

    def hits(most):
        return sorted((r.id, r.term) for r in search.matched_terms(terms, asked, most).collect())

    assert hits(5) == hits(1) == hits(1000) != []


def test_suggestions_up_to_a_limit(spark):
    documents = spark.createDataFrame([(i, "s", "en", f"Lamp {chr(97 + i)}") for i in range(20)] + [(50, "s", "en", "Lamp a")], NAMES)
    asked = spark.createDataFrame([("q", "s", "en", "lamp", None, None)], ASKED)
    found = search.suggest(documents, search.search_terms(documents), asked, search.MOST_SUGGESTIONS)
    assert sorted(r.suggestion for r in found.collect()) == [f"Lamp {chr(97 + i)}" for i in range(15)]


STORES = "MERCHANT_ID INT, " + ADDRESS + ", BILLING_COUNTRY STRING, BILLING_ZONE STRING, BILLING_STATE STRING"
RULES = (
    "MERCHANT_ID INT, BASIS STRING, COLLECT_OUTSIDE_PROVINCE BOOLEAN, COLLECT_AT_STORE_ADDRESS BOOLEAN, DEFAULT_CLASS INT, "
    "STORE_COUNTRY STRING, STORE_ZONE STRING, STORE_ZONE_NAME STRING, STORE_STATE STRING"
)


def test_each_store_taxes_by_its_own_rules_and_rates(spark):
    orders = [
        # store, order, delivery country / zone / state, shipping, handling, billing country / zone / state
        (1, 10, "CA", "QC", None, D("10"), D("2"), "CA", "ON", None),
        (2, 20, "CA", "QC", None, D("10"), D("2"), "CA", "ON", None),
        (3, 30, "CA", "QC", None, None, None, "CA", "ON", None),
        (3, 31, "CA", "ON", None, None, None, "CA", "QC", None),
        (4, 40, "CA", "QC", None, None, None, "CA", "QC", None),
        (5, 50, None, None, None, None, None, None, None, None),
    ]
    lines = [(i, 1, 1, D("100.00"), None) for i in (10, 20, 30, 31, 40, 50)] + [(20, 2, 1, D("50.00"), 2)]
    rates = [(m, 100 * m + k, k, rate, code, k > 0, "CA", zone, None) for m in (1, 2, 3, 5) for k, rate, code, zone in (
        (0, D(m), "GST", "QC"), (1, D("10"), "QST", "QC"), (0, D(5 + m), "HST", "ON"))]
    rules = [
        (1, "SHIPPING", True, False, 1, "CA", None, None, None),
        (2, "BILLING", True, False, 2, "CA", None, None, None),
        (3, "SHIPPING", False, False, 1, "CA", "ON", "Ontario", None),
        (5, "SHIPPING", True, True, 1, "CA", "QC", None, None),
    ]

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    got = taxes.store_taxes(
        frame(orders, STORES), frame(lines, LINE), frame(rates, "MERCHANT_ID INT, " + RATE), frame(rules, RULES)
    ).collect()
    assert sorted((r.ORDER_ID, r.TAX_CODE, float(r.VALUE)) for r in got) == [
        (10, "GST", 1.12), (10, "QST", 11.31),  # 1 % of 112, then 10 % of 113.12
        (20, "HST", 11.34),  # 7 % of 100 + 12 + 50, all of the default class
        (31, "HST", 8.0),  # 30 is outside the store's province
        (50, "GST", 5.0), (50, "QST", 10.5),  # taxed where the store is; store 4 has no rules
    ]
    for m, settings in ((1, TaxSettings(store_country="CA")), (2, TaxSettings(basis="BILLING", default_class=2, store_country="CA"))):
        alone = taxes.taxes(
            frame([o for o in orders if o[0] == m], STORES), frame(lines, LINE),
            frame([r for r in rates if r[0] == m], "MERCHANT_ID INT, " + RATE), settings,
        )
        assert {tuple(r) for r in alone.collect() if r.ORDER_ID == 10 * m} == {tuple(r) for r in got if r.ORDER_ID == 10 * m}
