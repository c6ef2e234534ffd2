"""The category tree: paths, subtrees, and what lies below a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.values import moment
from tillwork.session import use_checkpoints


def rebuild_lineage(categories: DataFrame) -> DataFrame:
    """Depth and path of every category from the parent ids alone.

    Every category knows a stretch of its path and the next category above it; in
    each round it takes over the stretch that one knows. Stretches double, so the
    rounds grow with the logarithm of the depth, and they go on until no category
    has one above. Each round is one join, cut off by a checkpoint on shared storage.
    A category that comes back in its own stretch is part of a cycle and climbs no
    further. It and all below it, and those whose chain of parents ends at one that
    does not exist, come back with an ``ERROR`` and no path.
    """
    use_checkpoints(categories.sparkSession)
    state = categories.select(
        "CATEGORY_ID",
        "PARENT_ID",
        F.col("PARENT_ID").alias("above"),
        F.lit(0).alias("DEPTH"),
        F.concat(F.lit("/"), F.col("CATEGORY_ID").cast("string"), F.lit("/")).alias("LINEAGE"),
        F.lit(None).cast("string").alias("ERROR"),
    )
    while True:
        upper = state.select(
            F.col("CATEGORY_ID").alias("above"),
            F.col("above").alias("next"),
            F.col("DEPTH").alias("more"),
            F.col("LINEAGE").alias("front"),
            F.col("ERROR").alias("inherited"),
            F.lit(True).alias("exists"),
        )
        climbs = F.col("above").isNotNull()
        missing = climbs & F.col("exists").isNull()
        own = F.concat(F.lit("/"), F.col("CATEGORY_ID").cast("string"), F.lit("/"))
        returns = climbs & F.coalesce(F.contains("front", own), F.lit(False))
        state = (
            state.join(upper, "above", "left")
            .select(
                "CATEGORY_ID",
                "PARENT_ID",
                F.when(climbs & ~returns, F.col("next")).alias("above"),
                F.when(climbs, F.col("DEPTH") + F.col("more") + 1).otherwise(F.col("DEPTH")).alias("DEPTH"),
                F.when(climbs, F.concat("front", F.substr("LINEAGE", F.lit(2)))).otherwise(F.col("LINEAGE")).alias("LINEAGE"),
                F.when(missing, "missing parent")
                .when(returns, "cycle")
                .otherwise(F.coalesce("ERROR", "inherited"))
                .alias("ERROR"),
            )
            .checkpoint()
        )
        if state.where("above IS NOT NULL").isEmpty():
            break
    found = F.col("ERROR").isNull()
    return state.select(
        "CATEGORY_ID",
        "PARENT_ID",
        F.when(found, F.col("DEPTH")).alias("DEPTH"),
        F.when(found, F.col("LINEAGE")).alias("LINEAGE"),
        "ERROR",
    )


def move_category(categories: DataFrame, category_id: int, new_parent: int | None) -> DataFrame:
    """The tree after hanging a subtree somewhere else, all paths below rewritten."""
    moved = F.when(F.col("CATEGORY_ID") == category_id, F.lit(new_parent).cast("bigint")).otherwise(F.col("PARENT_ID"))
    return rebuild_lineage(categories.withColumn("PARENT_ID", moved))


def ancestors(categories: DataFrame) -> DataFrame:
    """(category, ancestor) pairs read off the paths; a category is its own ancestor.

    A path is as long as the tree is deep, so this stays a small multiple of the
    categories, and every prefix question becomes an equi join.
    """
    steps = F.split(F.trim(F.col("LINEAGE"), F.lit("/")), "/+")
    return categories.select("CATEGORY_ID", F.explode(steps).alias("step")).select(
        "CATEGORY_ID", F.col("step").cast("bigint").alias("ANCESTOR_ID")
    )


def subtrees(categories: DataFrame, roots: DataFrame) -> DataFrame:
    """All categories at or below each root (column ``CATEGORY_ID``)."""
    pairs = ancestors(categories)
    wanted = roots.select(F.col("CATEGORY_ID").alias("ANCESTOR_ID"))
    inside = pairs.join(wanted, "ANCESTOR_ID")
    return categories.join(inside, "CATEGORY_ID").withColumnRenamed("ANCESTOR_ID", "ROOT_ID")


def category_listing(
    categories: DataFrame,
    store: int | None = None,
    min_depth: int = 0,
    featured: bool | None = None,
    visible: bool | None = None,
    name: str | None = None,
) -> DataFrame:
    """Categories by depth, flags and part of the name, in path order."""
    rows = categories.where(F.col("DEPTH") >= min_depth)
    if store is not None:
        rows = rows.where(F.col("MERCHANT_ID") == store)
    if featured is not None:
        rows = rows.where(F.col("FEATURED") == featured)
    if visible is not None:
        rows = rows.where(F.col("VISIBLE") == visible)
    if name is not None:
        rows = rows.where(F.col("NAME").contains(name))
    return rows.orderBy("LINEAGE", "SORT_ORDER")


def on_sale(as_of) -> Column:
    """Products that are available and whose date has come."""
    return F.col("AVAILABLE") & (F.col("DATE_AVAILABLE").cast("timestamp") <= moment(as_of))


def products_per_category(products: DataFrame, memberships: DataFrame, as_of) -> DataFrame:
    live = products.where(on_sale(as_of)).select("PRODUCT_ID")
    return memberships.join(live, "PRODUCT_ID").groupBy("CATEGORY_ID").agg(F.count("PRODUCT_ID").alias("product_count"))


def memberships_below(memberships: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct (category, product) where the product is in the category or below it."""
    pairs = memberships.join(ancestors(categories), "CATEGORY_ID")
    return pairs.select(F.col("ANCESTOR_ID").alias("CATEGORY_ID"), "PRODUCT_ID").distinct()


def products_per_subtree(products: DataFrame, memberships: DataFrame, categories: DataFrame, as_of) -> DataFrame:
    return products_per_category(products, memberships_below(memberships, categories), as_of)


def products_per_manufacturer(products: DataFrame) -> DataFrame:
    return products.groupBy("MANUFACTURER_ID").agg(F.count("PRODUCT_ID").alias("product_count"))


def store_totals(categories: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """Categories and manufacturers per store."""
    both = categories.select("MERCHANT_ID", F.lit(1).alias("category"), F.lit(0).alias("manufacturer")).unionByName(
        manufacturers.select("MERCHANT_ID", F.lit(0).alias("category"), F.lit(1).alias("manufacturer"))
    )
    return both.groupBy("MERCHANT_ID").agg(
        F.sum("category").alias("category_count"), F.sum("manufacturer").alias("manufacturer_count")
    )


def category_facets(memberships: DataFrame, categories: DataFrame, attributes: DataFrame) -> DataFrame:
    """Option values found below each category, each once, by name."""
    below = memberships_below(memberships, categories)
    values = attributes.select("PRODUCT_ID", "OPTION_CODE", "VALUE_CODE", "VALUE_NAME")
    found = below.join(values, "PRODUCT_ID").select("CATEGORY_ID", "OPTION_CODE", "VALUE_CODE", "VALUE_NAME").distinct()
    return found.orderBy("CATEGORY_ID", "OPTION_CODE", "VALUE_NAME")


def brands_in_category(memberships: DataFrame, categories: DataFrame, products: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """Manufacturers with a product in the category or below it."""
    makers = products.select("PRODUCT_ID", "MANUFACTURER_ID")
    found = memberships_below(memberships, categories).join(makers, "PRODUCT_ID").select("CATEGORY_ID", "MANUFACTURER_ID").distinct()
    return found.join(manufacturers.select("MANUFACTURER_ID", "NAME"), "MANUFACTURER_ID")


def category_removal_impact(memberships: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category: what its removal would do to each product below it.

    ``deleted`` if the product is in no category outside the subtree, else
    ``detached``.
    """
    pairs = memberships.select("PRODUCT_ID", "CATEGORY_ID").distinct()
    inside = pairs.join(ancestors(categories), "CATEGORY_ID").groupBy("ANCESTOR_ID", "PRODUCT_ID").agg(F.count(F.lit(1)).alias("inside"))
    total = pairs.groupBy("PRODUCT_ID").agg(F.count(F.lit(1)).alias("total"))
    outcome = F.when(F.col("inside") == F.col("total"), "deleted").otherwise("detached")
    return inside.join(total, "PRODUCT_ID").select(F.col("ANCESTOR_ID").alias("CATEGORY_ID"), "PRODUCT_ID", outcome.alias("outcome"))
