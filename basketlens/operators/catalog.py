"""Catalog filters, latest-observation views, paging and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import UNMAPPED_TRIGGER

LATEST_COLUMNS = ("price", "mrp", "in_stock")


def catalog_filter(catalog: DataFrame, **equals) -> DataFrame:
    """Listings by id, platform, category, brand, ...; reaches the scan as a filter."""
    for column, value in equals.items():
        if value is not None:
            catalog = catalog.where(F.col(column) == value)
    return catalog


def unmapped_listings(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    return catalog.join(
        mappings.select(F.col("catalog_id").alias("id")), "id", "left_anti"
    )


def unmapped_by_category(
    catalog: DataFrame, mappings: DataFrame, threshold: int = UNMAPPED_TRIGGER
) -> DataFrame:
    counts = unmapped_listings(catalog, mappings).groupBy("category")
    return counts.agg(F.count(F.lit(1)).alias("unmapped")).where(F.col("unmapped") >= threshold)


def observations_at(
    obs: DataFrame, day: str, time_of_day: str, pincode: str | None = None
) -> DataFrame:
    """Readings of one day and slot.

    A stored table has ``obs_date`` as its partition column; otherwise the day is
    asked for as a time range, which prunes row groups, not as a function of the
    timestamp.
    """
    if "obs_date" in obs.columns:
        rows = obs.where(F.col("obs_date") == F.lit(day).cast("date"))
    else:
        start = F.lit(day).cast("timestamp_ntz")
        rows = obs.where(
            (F.col("observed_at") >= start)
            & (F.col("observed_at") < start + F.expr("INTERVAL 1 DAY"))
        )
    rows = rows.where(F.col("time_of_day") == time_of_day)
    return rows if pincode is None else rows.where(F.col("pincode") == pincode)


def latest_by_pincode(obs: DataFrame) -> DataFrame:
    """Latest reading per (listing, pincode) by time, then id."""
    return _latest(obs, ["catalog_id", "pincode"])


def latest_any_pincode(obs: DataFrame) -> DataFrame:
    """Latest reading per listing by time, then id."""
    return _latest(obs, ["catalog_id"])


def _latest(obs: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in obs.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("observed_at", "id")).alias("_row")
    return obs.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*obs.columns)


def reading_order(time: str = "observed_at", id_col: str = "id"):
    """Time, then id, as one number: a decimal stays in a hash aggregate's buffer."""
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(18,0)")
    shift = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (micros * shift + F.col(id_col).cast("decimal(20,0)")).cast("decimal(38,0)")


def latest_by_id(obs: DataFrame, columns: tuple[str, ...] = LATEST_COLUMNS) -> DataFrame:
    """Values of the latest reading (by time, then id) per listing, over all pincodes.

    One ``max_by`` per fixed-width column instead of one over a struct: the
    buffers stay primitive, so Spark uses a hash aggregate with map-side combine
    where a struct would force a sort.
    """
    rows = obs.withColumn("_order", reading_order())
    return rows.groupBy("catalog_id").agg(
        F.max_by("id", "_order").alias("obs_id"),
        *[F.max_by(c, "_order").alias(c) for c in columns],
    )


def with_latest(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """Catalog with the latest price columns; unpriced listings stay, with nulls."""
    return catalog.join(latest.withColumnRenamed("catalog_id", "id"), "id", "left")


def latest_positive_mrp(obs: DataFrame) -> DataFrame:
    return (
        obs.where(F.col("mrp") > 0)
        .groupBy("catalog_id")
        .agg(F.max_by("mrp", reading_order()).alias("mrp"))
    )


def sales_by_category(
    sales: DataFrame, catalog: DataFrame, category: str | None = None, day: str | None = None
) -> DataFrame:
    listings = catalog_filter(catalog, category=category)
    rows = sales if day is None else sales.where(F.col("sale_date") == F.lit(day).cast("date"))
    return rows.join(
        listings.select(F.col("id").alias("catalog_id"), "category"), "catalog_id"
    )


def top_sellers(sales: DataFrame, n: int = 20, day: str | None = None) -> DataFrame:
    """Best high-confidence records; equal units are ordered by key."""
    rows = sales.where(F.col("confidence") == "high")
    if day is not None:
        rows = rows.where(F.col("sale_date") == F.lit(day).cast("date"))
    return rows.orderBy(F.desc("estimated_sales"), "catalog_id", "pincode", "sale_date").limit(n)


def cross_platform_view(
    canonicals: DataFrame, mappings: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Canonical products with their listings, one row per listing.

    Flat on purpose: a cluster can be any size, and a nested list would have to
    pass through one task.  Sort by (canonical_id, platform) to read it in the
    reference's order.
    """
    listings = catalog.select(
        F.col("id").alias("catalog_id"),
        "platform",
        "name",
        F.col("platform_product_id").alias("product_id"),
    )
    heads = canonicals.select(
        F.col("id").alias("canonical_id"),
        "canonical_name",
        "brand",
        "category",
        F.col("unit_normalized").alias("unit"),
    )
    members = mappings.select(
        "catalog_id", "canonical_id", F.col("similarity_score").alias("similarity")
    ).join(listings, "catalog_id")
    return members.join(heads, "canonical_id")


def list_brands(catalog: DataFrame) -> DataFrame:
    """Listings and distinct categories per brand; the list is bounded by the taxonomy."""
    per_category = (
        catalog.where(F.col("brand").isNotNull())
        .groupBy("brand", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_category.groupBy("brand").agg(
        F.sum("n").alias("product_count"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )


def list_categories(catalog: DataFrame) -> DataFrame:
    per_brand = catalog.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"))
    return per_brand.groupBy("category").agg(
        F.sum("n").alias("product_count"), F.count("brand").alias("brand_count")
    )


def products_page(
    catalog: DataFrame,
    obs: DataFrame,
    page: int = 1,
    per_page: int = 20,
    after_id: int | None = None,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """One page of listings with latest prices, and the total as a one-row table.

    The page is cut first, so readings are looked up for its listings only: at
    most 100 ids, a bound that makes the broadcast safe.  ``after_id`` reads on
    from the last id of the previous page instead of skipping rows.
    """
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be >= 1 and per_page between 1 and 100")
    matching = catalog_filter(catalog, **filters)
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    ordered = matching.select("id", "platform", "name", "brand", "category", "unit").orderBy("id")
    if after_id is not None:
        rows = ordered.where(F.col("id") > after_id).limit(per_page)
    else:
        rows = ordered.offset((page - 1) * per_page).limit(per_page)
    ids = F.broadcast(rows.select(F.col("id").alias("catalog_id")))
    latest = latest_by_id(obs.join(ids, "catalog_id", "left_semi")).drop("obs_id")
    return with_latest(rows, latest), total


def dashboard_stats(catalog: DataFrame, runs: DataFrame, approximate: bool = False) -> DataFrame:
    """Counts over the catalog and the start of the last run."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    last = runs.agg(F.max("started_at").alias("last_scrape"))
    return catalog.agg(
        F.count(F.lit(1)).alias("products"),
        distinct("brand").alias("brands"),
        distinct("category").alias("categories"),
        distinct("platform").alias("platforms"),
    ).withColumn("last_scrape", last.scalar())


def runs_by_date(runs: DataFrame, day: str) -> DataFrame:
    start = F.lit(day).cast("timestamp_ntz")
    return runs.where(
        (F.col("started_at") >= start) & (F.col("started_at") < start + F.expr("INTERVAL 1 DAY"))
    )


def brand_search(
    brands: DataFrame, query: str = "", category: str | None = None, n: int = 8
) -> DataFrame:
    """Brands whose name contains the text, biggest first."""
    rows = brands
    if category is not None:
        rows = rows.where(F.array_contains("categories", category))
    if query.strip():
        rows = rows.where(F.lower("brand").contains(query.lower()))
    return rows.orderBy(F.desc("product_count"), "brand").limit(n)
