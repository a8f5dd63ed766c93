"""Daily sales from paired morning and night readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE_WEIGHTS, INVENTORY_CAP
from .stats import top_n

SIGNALS = ("inventory_count", "max_cart_qty", "in_stock")


def _slot(slot: str, column: str, order: str) -> Column:
    return F.min_by(column, F.when(F.col("time_of_day") == slot, F.col(order)))


def slot_pairs_aggregates(order: str) -> list[Column]:
    """Aggregates that put the first reading of both slots side by side."""
    out = [F.count_if(F.col("time_of_day") == s).alias(f"{s[0]}_n") for s in ("morning", "night")]
    for slot, letter in (("morning", "m"), ("night", "n")):
        out += [_slot(slot, c, order).alias(f"{letter}_{c}") for c in SIGNALS]
    return out


def estimate(pairs: DataFrame, cap: int = INVENTORY_CAP) -> DataFrame:
    """Decision table over paired readings: the strongest signal both have wins.

    Inventory counts first, then a changed cart limit, then the stock flag.
    """
    m_inv, n_inv = F.col("m_inventory_count"), F.col("n_inventory_count")
    m_cart, n_cart = F.col("m_max_cart_qty"), F.col("n_max_cart_qty")
    m_flag, n_flag = F.col("m_in_stock").cast("int"), F.col("n_in_stock").cast("int")
    by_inventory = m_inv.isNotNull() & n_inv.isNotNull()
    by_cart = m_cart != n_cart
    by_flag = m_flag.isNotNull() & n_flag.isNotNull()

    def pick(inventory: Column, cart: Column, flag: Column) -> Column:
        return F.when(by_inventory, inventory).when(by_cart, cart).when(by_flag, flag).otherwise(cart)

    out = pairs.withColumn("morning_qty", pick(m_inv, m_cart, m_flag)).withColumn(
        "night_qty", pick(n_inv, n_cart, n_flag)
    )
    morning, night = F.col("morning_qty"), F.col("night_qty")
    at_cap = m_inv >= cap
    graded = (
        F.when(morning > night, F.when(at_cap, "medium").otherwise("high"))
        .when((morning == night) & ~at_cap, "medium")
        .otherwise("low")
    )
    return out.select(
        "catalog_id",
        "pincode",
        "sale_date",
        "morning_qty",
        "night_qty",
        F.greatest(morning - night, F.lit(0)).alias("estimated_sales"),
        F.when(by_inventory, graded).otherwise("low").alias("confidence"),
        (morning < night).alias("restock_flag"),
    )


def daily_sales(
    obs: DataFrame,
    day: str | None = None,
    pincode: str | None = None,
    cap: int = INVENTORY_CAP,
    order: str = "observed_at",
) -> DataFrame:
    """Estimated sales per (listing, pincode, date) that has both readings.

    Of several readings of a slot the first in ``order`` counts, with all its signals.

    Both slots meet in one aggregation instead of a self join: one exchange, hash
    aggregate on primitive buffers, combined on the map side.
    """
    rows = obs
    if pincode is not None:
        rows = rows.where(F.col("pincode") == pincode)
    if day is not None:
        start = F.lit(day).cast("timestamp_ntz")
        rows = rows.where(
            (F.col("observed_at") >= start)
            & (F.col("observed_at") < start + F.expr("INTERVAL 1 DAY"))
        )
    pairs = (
        rows.groupBy("catalog_id", "pincode", F.to_date("observed_at").alias("sale_date"))
        .agg(*slot_pairs_aggregates(order))
        .where((F.col("m_n") > 0) & (F.col("n_n") > 0))
    )
    return estimate(pairs, cap)


def sales_summary(sales: DataFrame, pincode: str | None = None) -> DataFrame:
    """Records, units and records per confidence grade, per date."""
    rows = sales if pincode is None else sales.where(F.col("pincode") == pincode)
    grades = [
        F.count_if(F.col("confidence") == g).alias(f"n_{g}") for g in ("high", "medium", "low")
    ]
    return rows.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("estimated_sales").alias("total_estimated_sales"),
        *grades,
    )


def by_confidence(summary: DataFrame) -> DataFrame:
    """The same summary with the grades as a map, absent grades left out."""
    entries = F.array(
        *[
            F.struct(F.lit(g).alias("grade"), F.col(f"n_{g}").alias("n"))
            for g in ("high", "medium", "low")
        ]
    )
    return summary.withColumn(
        "by_confidence", F.map_filter(F.map_from_entries(entries), lambda _grade, n: n > 0)
    )


def confidence_weight() -> Column:
    weight = F.lit(0.0)
    for grade, value in CONFIDENCE_WEIGHTS.items():
        weight = F.when(F.col("confidence") == grade, F.lit(value)).otherwise(weight)
    return weight


def category_sales_by_brand(
    sales: DataFrame, catalog: DataFrame, category: str | None = None, day: str | None = None
) -> DataFrame:
    """Per (category, date, brand): records, units, mean confidence weight."""
    listings = catalog if category is None else catalog.where(F.col("category") == category)
    rows = sales if day is None else sales.where(F.col("sale_date") == F.lit(day).cast("date"))
    joined = rows.join(
        listings.select(F.col("id").alias("catalog_id"), "brand", "category"), "catalog_id"
    )
    return joined.groupBy("category", "sale_date", "brand").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("estimated_sales").alias("total_estimated_sales"),
        F.avg(confidence_weight()).alias("avg_confidence"),
    )


def sales_velocity(sales: DataFrame, catalog: DataFrame) -> DataFrame:
    """High-confidence totals per listing, aggregated before the catalog join."""
    per_listing = (
        sales.where(F.col("confidence") == "high")
        .groupBy("catalog_id")
        .agg(
            F.sum("estimated_sales").alias("total_units"),
            F.avg("estimated_sales").alias("avg_per_pincode"),
            F.count(F.lit(1)).alias("pincode_count"),
            F.sum(F.col("restock_flag").cast("int")).alias("restocks"),
        )
    )
    names = catalog.select(F.col("id").alias("catalog_id"), "name", "brand", "category", "platform")
    return per_listing.join(names, "catalog_id")


def category_top_sellers(sales: DataFrame, catalog: DataFrame, n: int = 20) -> DataFrame:
    """Best listings per category by high-confidence units."""
    return top_n(
        sales_velocity(sales, catalog).select(
            "category", "catalog_id", "name", "brand", "platform", "total_units"
        ),
        ["category"],
        [F.desc("total_units"), F.col("catalog_id")],
        n,
        "position",
    )


def apply_probed_stock(obs: DataFrame, probes: DataFrame, cap: int = INVENTORY_CAP) -> DataFrame:
    """Replace a capped reading by the probed stock where that is above the cap.

    ``probes``: catalog_id, pincode, probed_qty - one row per key.
    """
    probed = probes.select("catalog_id", "pincode", "probed_qty")
    stock = F.col("inventory_count")
    raised = F.when((stock >= cap) & (F.col("probed_qty") > cap), F.col("probed_qty")).otherwise(stock)
    return (
        obs.join(probed, ["catalog_id", "pincode"], "left")
        .withColumn("inventory_count", raised.cast("int"))
        .drop("probed_qty")
        .select(*obs.columns)
    )


def capped_share(obs: DataFrame, catalog: DataFrame, cap: int = INVENTORY_CAP) -> DataFrame:
    """Readings with a count, and how many sit at the cap, per platform."""
    counted = (
        obs.where(F.col("inventory_count").isNotNull())
        .groupBy("catalog_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("inventory_count") >= cap).alias("c"))
    )
    platforms = catalog.select(F.col("id").alias("catalog_id"), "platform")
    return (
        counted.join(platforms, "catalog_id")
        .groupBy("platform")
        .agg(F.sum("n").alias("readings"), F.sum("c").alias("capped"))
        .withColumn("capped_share", F.col("capped") / F.col("readings"))
    )
