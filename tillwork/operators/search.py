"""Search documents, their terms, and looking them up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillwork.functions.values import money_text
from tillwork.operators.skew import own_shuffle

# Lengths of the word beginnings that are indexed.
SHORTEST_TERM, LONGEST_TERM = 3, 10
# Fixed value: suggestions per request.
MOST_SUGGESTIONS = 15
#: Hits of a request that doesn't say how many, and rows that a term makes beyond which it is dealt to several tasks.
DEFAULT_COUNT, NAMES_PER_PART = 20, 100_000
_NO_WORD = "[^\\p{L}\\p{Nd}]+"


def _stock_entry() -> Column:
    """Stock of a SKU as a map of texts; the discounted price only if there is one."""

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    base = F.array(
        entry("sku", F.col("SKU")), entry("qty", F.col("QUANTITY").cast("string")), entry("price", money_text("FINAL_PRICE"))
    )
    discount = F.array(entry("discountPrice", money_text("DISCOUNTED_PRICE")))
    return F.map_from_entries(F.when(F.col("DISCOUNTED"), F.concat(base, discount)).otherwise(base))


def search_documents(tables: Mapping[str, DataFrame], product_stock: DataFrame, variant_stock: DataFrame, reviews: DataFrame, store: str) -> DataFrame:
    """One document per product and language.

    Attributes, variants and stock are nested in the document. They are gathered
    per product, as the document itself holds them all.
    """
    # One value per option: the one entered last.
    values = tables["product_attribute"].groupBy("PRODUCT_ID", "OPTION_CODE").agg(F.max_by("VALUE_NAME", "ATTRIBUTE_ID").alias("VALUE_NAME"))
    attributes = values.groupBy("PRODUCT_ID").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("OPTION_CODE", "VALUE_NAME")))).alias("attributes")
    )
    variant = F.map_from_arrays(F.array("OPTION_CODE", F.lit("vsku")), F.array("VALUE_CODE", "SKU"))
    variants = (
        tables["product_variant"]
        .groupBy("PRODUCT_ID")
        .agg(F.array_sort(F.collect_list(F.struct("VARIANT_ID", F.map_entries(variant).alias("entries")))).alias("found"))
        .select("PRODUCT_ID", F.transform("found", lambda v: F.map_from_entries(v["entries"])).alias("variants"))
    )
    stock = (
        product_stock.select("PRODUCT_ID", F.lit(0).cast("bigint").alias("place"), _stock_entry().alias("entry"))
        .unionByName(variant_stock.select("PRODUCT_ID", F.col("VARIANT_ID").alias("place"), _stock_entry().alias("entry")))
        .groupBy("PRODUCT_ID")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.map_entries("entry").alias("entries")))).alias("found"))
        .select("PRODUCT_ID", F.transform("found", lambda s: F.map_from_entries(s["entries"])).alias("inventory"))
    )
    image = tables["product_image"].groupBy("PRODUCT_ID").agg(
        F.min_by("IMAGE", F.struct((~F.col("DEFAULT_IMAGE")).alias("other"), "IMAGE_ID")).alias("image")
    )
    first_category = tables["product_category"].groupBy("PRODUCT_ID").agg(F.min("CATEGORY_ID").alias("CATEGORY_ID"))
    category = first_category.join(tables["category"].select("CATEGORY_ID", F.col("NAME").alias("category")), "CATEGORY_ID").drop("CATEGORY_ID")
    brand = tables["manufacturer"].select("MANUFACTURER_ID", F.col("NAME").alias("brand"))
    review = reviews.select("PRODUCT_ID", F.col("REVIEW_AVG").alias("reviews"))

    # All of these have one row per product; the names come last, as they
    # multiply the product by its languages.
    products = tables["product"].select("PRODUCT_ID", "MANUFACTURER_ID").join(brand, "MANUFACTURER_ID", "left")
    for part in (category, attributes, stock, variants, image, review):
        products = products.join(part, "PRODUCT_ID", "left")
    names = tables["product_description"].select("PRODUCT_ID", "LANGUAGE", "NAME", "SEF_URL")
    return products.join(names, "PRODUCT_ID").select(
        F.col("PRODUCT_ID").alias("id"),
        F.lit(store.lower()).alias("store"),
        F.col("LANGUAGE").alias("language"),
        F.col("NAME").alias("name"),
        F.col("SEF_URL").alias("link"),
        "brand",
        "category",
        "attributes",
        "inventory",
        "variants",
        "image",
        "reviews",
    )


def _beginnings(text: Column) -> Column:
    """Beginnings of 3 to 10 characters of every run of letters and digits."""
    words = F.split(F.lower(text), _NO_WORD)
    long_enough = F.filter(words, lambda w: F.length(w) >= SHORTEST_TERM)
    return F.array_distinct(
        F.flatten(
            F.transform(
                long_enough,
                lambda w: F.transform(
                    F.sequence(F.lit(SHORTEST_TERM), F.least(F.length(w), F.lit(LONGEST_TERM))), lambda n: F.substr(w, F.lit(1), n)
                ),
            )
        )
    )


def search_terms(documents: DataFrame) -> DataFrame:
    """(store, language, term, id): the index the lookups join with."""
    return documents.select("store", "language", "id", F.explode(_beginnings(F.col("name"))).alias("term"))


def matched_terms(terms: DataFrame, requests: DataFrame, most: int = NAMES_PER_PART) -> DataFrame:
    """(request_id, id, term): the request's terms that a name has, by an equi join on the term.

    A term makes a row for each of its names and each request that asks for it. One of more than ``most`` rows is dealt to
    parts by product, and asked for in each of them, and the join has as many tasks as it makes ``most`` rows: the rows it
    reads are few and short, so sizes of its inputs don't tell how much a task makes. How many rows a term
    makes is counted on the map side first.
    """
    key = ["store", "language", "term"]
    asked = requests.select("request_id", "store", "language", F.explode(_beginnings(F.col("text"))).alias("term"))
    names_of, asked_for = (df.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((terms, "names"), (asked, "requests")))
    made = names_of.join(asked_for, key).select(*key, "names", (F.col("names") * F.col("requests")).alias("rows"))
    tasks = max(1, -(-(made.agg(F.sum("rows")).first()[0] or 0) // most))
    # No more parts than names: a request is then copied no more often than it makes rows.
    parts = F.least(F.ceil(F.col("rows") / most), F.col("names")).cast("int")
    common = made.where(F.col("rows") > most).select(*key, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    dealt = terms.join(own_shuffle(common), key, "left").select(*key, "id", part)
    in_parts = asked.join(common, key, "left").select(
        "request_id", *key, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    by = [*key, "part"]
    return in_parts.repartition(tasks, *by).join(dealt.repartition(tasks, *by), by).select("request_id", "id", "term")


def keyword_search(terms: DataFrame, requests: DataFrame) -> DataFrame:
    """Products per request with the number of its terms they match.

    ``requests`` has ``request_id``, ``store``, ``language`` and ``text``; its text
    is taken apart like the names.
    """
    return matched_terms(terms, requests).groupBy("request_id", "id").agg(F.count(F.lit(1)).alias("matched_terms"))


def search_page(terms: DataFrame, requests: DataFrame) -> DataFrame:
    """The hits of each request from its ``start`` on (from 0), ``count`` of them, best first.

    Hits that match more of the request's terms come first, then those of the smaller id; ``place`` counts them from 0.
    Without a count there are ``DEFAULT_COUNT``, without a start it is 0; a count below 1 or a start below 0 gives
    nothing and the beginning. Each task cuts a request's hits down to the last place that any request asks for before
    they are brought together.
    """
    start = F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)).cast("long")
    wanted = requests.withColumn("start", start).withColumn("stop", start + F.coalesce("count", F.lit(DEFAULT_COUNT)))
    deepest = requests.agg(F.max(start + F.coalesce("count", F.lit(DEFAULT_COUNT)))).first()[0] or 0
    best_first = Window.partitionBy("request_id").orderBy(F.desc("matched_terms"), "id")
    ranked = keyword_search(terms, requests).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= deepest)
    return (
        ranked.join(wanted.select("request_id", "start", "stop"), "request_id")
        .where("rank > start and rank <= stop")
        .select("request_id", "id", "matched_terms", (F.col("rank") - 1).alias("place"))
    )


def suggest(documents: DataFrame, terms: DataFrame, requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Names that hold the request's text with its first word beginning a word, each once per request.

    The first word, as far as it is indexed, finds the candidates by an equi join;
    the whole text is then compared. With a ``limit`` a request gets that many, by name; each task
    cuts them down before they are brought together.
    """
    typed = F.lower(F.trim("text"))
    first_word = F.get(F.filter(F.split(typed, _NO_WORD), lambda w: F.length(w) > 0), F.lit(0))
    asked = requests.select(
        "request_id", "store", "language", typed.alias("typed"), F.substr(first_word, F.lit(1), F.lit(LONGEST_TERM)).alias("term")
    )
    hits = asked.join(terms, ["store", "language", "term"]).select("request_id", "typed", "language", "id")
    names = documents.select("id", "language", F.col("name").alias("suggestion"))
    found = hits.join(names, ["id", "language"]).where(F.lower("suggestion").contains(F.col("typed")))
    names = found.select("request_id", "suggestion").distinct()
    if limit is None:
        return names
    by_name = Window.partitionBy("request_id").orderBy("suggestion")
    return names.withColumn("_rank", F.row_number().over(by_name)).where(F.col("_rank") <= limit).drop("_rank")


def category_search_facets(hits: DataFrame, memberships: DataFrame) -> DataFrame:
    """Number of hits per request and category."""
    pairs = memberships.select(F.col("PRODUCT_ID").alias("id"), "CATEGORY_ID").distinct()
    return hits.join(pairs, "id").groupBy("request_id", "CATEGORY_ID").agg(F.count(F.lit(1)).alias("hit_count"))
