"""The retail tables, derived from the star-schema tables of the test data.

Pure projections and filters wherever possible: no global ordering, no row
numbers, no cross product; a listing's presence is a predicate on its key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.brand import brand_cube
from ..operators.catalog import latest_by_id, with_latest
from ..operators.sales import daily_sales
from ..operators.tables import first_per_key
from ..schemas import PLATFORMS
from ..session import apply_sql_defaults
from ..sources.dims import SEED_PINCODES

CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
UNIT_SUFFIXES = (" ml", "g", " Kg", " pcs", " bunch")
NO_BRAND = "Brand#13"


def cents(amount: Column) -> Column:
    """Amount in whole paise, half up, with plain floating-point steps."""
    return F.floor(amount * 100 + 0.5) / 100


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, with ties settled upwards past the noise of float sums."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.floor(column * 1e6 + 0.5001) / 1e6).alias(name or c)


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class RetailTables:
    """Lazily built tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_sql_defaults(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table dealt over all tasks by its key: files are split by bytes, and a compact one, whose
        rows become much work each, would be read and worked on in one task or a few."""
        return self.raw(name).repartition(key)

    @cached_property
    def catalog(self) -> DataFrame:
        return self.listings_of(self.raw("part"))

    def listings_of(self, parts: DataFrame, *more: Column) -> DataFrame:
        """Up to three listings per part (batch or stream), one per platform slot, and ``more`` of it."""
        slots = parts.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
        key, i = F.col("p_partkey"), F.col("i")
        return slots.where((key * 7 + i * 3) % 5 < 3).select(
            (key * 3 + i + 1).alias("id"),
            pick(PLATFORMS, i).alias("platform"),
            key.cast("string").alias("platform_product_id"),
            F.col("p_name").alias("name"),
            F.nullif(F.col("p_brand"), F.lit(NO_BRAND)).alias("brand"),
            F.col("p_type").alias("category"),
            F.lit(None).cast("string").alias("subcategory"),
            F.concat(F.col("p_size").cast("string"), pick(UNIT_SUFFIXES, (key + i) % 5)).alias("unit"),
            F.lit(None).cast("string").alias("image_url"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("first_seen_at"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_seen_at"),
            *more,
        )

    @cached_property
    def obs(self) -> DataFrame:
        """Price readings; the id is the ship day, then the order line."""
        part, i = F.col("l_partkey"), F.col("l_suppkey") % 3
        unit_price = F.col("l_extendedprice") / F.col("l_quantity")
        day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
        return (
            self.raw("lineitem")
            .where((part * 7 + i * 3) % 5 < 3)
            .select(
                (day * F.lit(1 << 51) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                (part * 3 + i + 1).alias("catalog_id"),
                F.col("l_orderkey").cast("string").alias("scrape_run_id"),
                pick(SEED_PINCODES[:4], F.col("l_orderkey") % 4).alias("pincode"),
                cents(unit_price * (1 - F.col("l_discount"))).alias("price"),
                cents(unit_price).alias("mrp"),
                (F.col("l_linestatus") == "O").alias("in_stock"),
                F.col("l_linenumber").cast("int").alias("max_cart_qty"),
                F.col("l_quantity").cast("int").alias("inventory_count"),
                F.when(F.col("l_linenumber") % 2 == 0, "morning").otherwise("night").alias("time_of_day"),
                F.col("l_shipdate").alias("observed_at"),
            )
        )

    @cached_property
    def latest(self) -> DataFrame:
        return latest_by_id(self.obs)

    @cached_property
    def priced(self) -> DataFrame:
        return with_latest(self.catalog, self.latest)

    @cached_property
    def cube(self) -> DataFrame:
        return brand_cube(self.priced)

    @cached_property
    def canonicals(self) -> DataFrame:
        """Every second part is a canonical product."""
        key = F.col("p_partkey")
        return (
            self.raw("part")
            .where(key % 2 == 0)
            .select(
                key.alias("id"),
                F.col("p_name").alias("canonical_name"),
                F.nullif(F.col("p_brand"), F.lit(NO_BRAND)).alias("brand"),
                F.col("p_type").alias("category"),
                F.lit(None).cast("string").alias("unit_normalized"),
            )
        )

    @cached_property
    def mappings(self) -> DataFrame:
        """Two neighbouring parts per cluster; some listings are not mapped yet."""
        c = self.catalog
        part = F.floor((F.col("id") - 1) / 3)
        return c.where(F.col("id") % 11 != 0).select(
            F.col("id").alias("catalog_id"),
            (part - part % 2).alias("canonical_id"),
            F.when(F.col("platform") == "blinkit", F.lit(1.0))
            .otherwise(0.80 + (F.col("id") % 20) / 100.0)
            .alias("similarity_score"),
        )

    def readings(self, events: DataFrame) -> DataFrame:
        """Stock readings from events (batch or stream), repetitions included."""
        user, value = F.col("user_id"), F.col("value")
        slot = F.when(F.hour("ts") < 12, "morning").otherwise("night")
        pincode = pick(SEED_PINCODES[:4], user % 4)
        return events.select(
            F.col("event_id").alias("seq"),
            F.col("event_id").alias("id"),
            user.alias("catalog_id"),
            F.concat_ws("-", F.to_date("ts").cast("string"), slot, pincode).alias("scrape_run_id"),
            pincode.alias("pincode"),
            (F.abs(value) + 1.0).alias("price"),
            (F.abs(value) + 2.0).alias("mrp"),
            (F.col("event_type") != "error").alias("in_stock"),
            (F.floor(value) % 3).cast("int").alias("max_cart_qty"),
            F.when(user % 3 != 2, F.floor(F.least(value, F.lit(50.0))).cast("int")).alias(
                "inventory_count"
            ),
            slot.alias("time_of_day"),
            F.col("ts").alias("observed_at"),
            "event_type",
        )

    @cached_property
    def event_readings(self) -> DataFrame:
        return self.readings(self.raw("events"))

    @cached_property
    def stock(self) -> DataFrame:
        """Stock readings after first-write-wins."""
        dated = self.event_readings.withColumn("obs_date", F.to_date("observed_at"))
        return first_per_key(dated, ["catalog_id", "pincode", "obs_date", "time_of_day"], ["seq"])

    @cached_property
    def sales(self) -> DataFrame:
        return daily_sales(self.event_readings, order="seq")

    @cached_property
    def runs(self) -> DataFrame:
        """Run ledger from orders."""
        key = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            key.cast("string").alias("id"),
            pick(PLATFORMS, F.col("o_custkey") % 3).alias("platform"),
            pick(SEED_PINCODES, key % 8).alias("pincode"),
            pick(CATEGORIES, key % 6).alias("category"),
            F.when(key % 2 == 0, "morning").otherwise("night").alias("time_of_day"),
            F.col("o_orderdate").alias("started_at"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("products_found"),
            (F.col("o_custkey") % 4).cast("int").alias("errors"),
            F.when(status == "F", "completed").when(status == "O", "running").otherwise("failed").alias(
                "status"
            ),
        )
