"""Table maintenance: upserts, first-wins appends, remaps, run ledger, exports.

Spark enforces no unique keys, so each unique key of the model is an operator.
All of them return the new table content; ``overwrite_partitions`` writes only
the partitions that content touches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compose_text, normalize_unit
from ..session import cut_lineage
from ..sources.listings import parse_items, parse_rejects
from ..sources.validate import LISTING_RULES, validate_rows

CATALOG_KEY = ["platform", "platform_product_id"]
OBSERVATION_KEY = ["catalog_id", "pincode", "obs_date", "time_of_day"]
SALES_KEY = ["catalog_id", "pincode", "sale_date"]
_CATALOG_ATTRS = ["name", "brand", "category", "subcategory", "unit", "image_url"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; copies of a key are combined before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` plus the rows of ``old`` whose key it does not carry."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_catalog(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """Last listing wins by (platform, platform_product_id), nulls included.

    ``batch`` brings ``seq`` (order inside the batch) and ``seen_at``.  First and
    last sighting are kept; a new listing's id is the hash of its key, so the same
    listing gets the same id in every run and no sequence is needed.
    """
    stored = catalog.select(
        "id", *CATALOG_KEY, *_CATALOG_ATTRS, "first_seen_at", "last_seen_at",
        F.struct(F.lit(0).alias("new"), F.col("last_seen_at").alias("at"),
                 F.lit(0).cast("bigint").alias("seq")).alias("_order"),
    )
    incoming = batch.select(
        F.lit(None).cast("bigint").alias("id"), *CATALOG_KEY, *_CATALOG_ATTRS,
        F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"),
        F.struct(F.lit(1).alias("new"), F.col("seen_at").alias("at"),
                 F.col("seq").cast("bigint").alias("seq")).alias("_order"),
    )
    merged = (
        stored.unionByName(incoming)
        .groupBy(*CATALOG_KEY)
        .agg(
            F.max("id").alias("_id"),
            F.max_by(F.struct(*_CATALOG_ATTRS), "_order").alias("_attrs"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
        )
    )
    return merged.select(
        F.coalesce("_id", F.xxhash64(*CATALOG_KEY)).alias("id"),
        *CATALOG_KEY,
        "_attrs.*",
        "first_seen_at",
        "last_seen_at",
    )


def with_obs_date(obs: DataFrame) -> DataFrame:
    return obs.withColumn("obs_date", F.to_date("observed_at"))


def append_observations(
    stored: DataFrame,
    batch: DataFrame,
    dates: Iterable | None = None,
    order: tuple[str, ...] = ("observed_at", "seq"),
) -> DataFrame:
    """Rows of ``batch`` to append: first per key, and only where the key is free.

    ``dates`` names the calendar days of the batch when the caller knows them (a
    run has one), so only those partitions of the stored table are read.
    """
    first = first_per_key(with_obs_date(batch), OBSERVATION_KEY, list(order))
    known = stored if "obs_date" in stored.columns else with_obs_date(stored)
    if dates is not None:
        known = known.where(F.col("obs_date").isin(list(dates)))
    return first.join(known.select(*OBSERVATION_KEY), OBSERVATION_KEY, "left_anti")


def upsert_daily_sales(sales: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(sales, new, SALES_KEY)


def upsert_mappings(mappings: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(mappings, new, ["catalog_id"])


def insert_canonicals(founders: DataFrame) -> DataFrame:
    """Canonical rows; each has one founder listing, whose id becomes its id."""
    return founders.select(
        F.col("id"),
        F.col("name").alias("canonical_name"),
        "brand",
        "category",
        normalize_unit("unit").alias("unit_normalized"),
    )


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions present in ``df``; the others stay as they are."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)


def ingest_run(
    items: DataFrame, runs: DataFrame, catalog: DataFrame, stored: DataFrame
) -> dict[str, DataFrame]:
    """Parse and store the captured items of one or many runs.

    ``items``: run_id, platform, category, seq, item (VARIANT).  ``runs``: id,
    platform, pincode, category, time_of_day, started_at.  Items the row model
    refuses are dropped; what breaks a table rule afterwards counts as an error.
    Duplicates that the observation key ignores still count as found.  ``rejected`` in
    the result holds every item that is not stored, with the reason.  A run with errors
    and without any product has failed; ``completed_at`` is the ledger's, if it has one.
    """
    attrs = runs.select(
        F.col("id").alias("run_id"), "pincode", "time_of_day", F.col("started_at").alias("seen_at")
    )
    # The category of the run replaces whatever the item says.
    own = runs.select(F.col("id").alias("run_id"), F.col("category").alias("_category"))
    listings = parse_items(
        items.join(own, "run_id").withColumn("category", F.col("_category")).drop("_category")
    )
    # Four tables are made of the parsed rows; parse the captures once.
    parsed = cut_lineage(listings.join(attrs, "run_id"))
    valid, rejected = validate_rows(parsed, LISTING_RULES)

    new_catalog = upsert_catalog(catalog, valid)
    with_id = valid.join(new_catalog.select("id", *CATALOG_KEY), CATALOG_KEY)
    batch = with_id.select(
        observation_id("seen_at", "id", "pincode", "time_of_day").alias("obs_id"),
        F.col("id").alias("catalog_id"),
        F.col("run_id").alias("scrape_run_id"),
        "pincode", "price", "mrp", "in_stock", "max_cart_qty", "inventory_count", "time_of_day",
        F.col("seen_at").alias("observed_at"), "seq",
    ).withColumnRenamed("obs_id", "id")
    appended = append_observations(stored, batch).drop("seq")

    no_end = F.lit(None).cast("timestamp_ntz")
    ended = [F.col("completed_at") if "completed_at" in runs.columns else no_end.alias("completed_at")]
    found = valid.groupBy("run_id").agg(F.count(F.lit(1)).alias("products_found"))
    errors = rejected.groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"))
    finished = (
        runs.withColumnRenamed("id", "run_id")
        .join(found, "run_id", "left")
        .join(errors, "run_id", "left")
        .select(
            F.col("run_id").alias("id"),
            "platform", "pincode", "category", "time_of_day", "started_at",
            F.coalesce("products_found", F.lit(0)).alias("products_found"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.when((F.col("errors") > 0) & F.col("products_found").isNull(), "failed")
            .otherwise("completed").alias("status"),
            *ended,
        )
    )
    refused = parse_rejects(items).unionByName(
        items.join(own, "run_id", "left_anti").select(
            "run_id", "seq", "platform", F.lit("run unknown").alias("reason"),
            F.to_json("item").alias("raw_json"),
        )
    ).unionByName(
        rejected.select("run_id", "seq", "platform", F.array_join("reasons", ", ").alias("reason"), "raw_json")
    )
    return {
        "catalog": new_catalog, "observations": appended, "runs": finished, "rejected": refused
    }


def observation_id(seen_at: str, *key: str):
    """64-bit hash of time and key; readings are put in order by time, then id."""
    return F.xxhash64(seen_at, *key)


def remap_categories(
    catalog: DataFrame, remap: DataFrame, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Apply ``remap`` (id, from_category, to_category) and report the change.

    ``strict`` moves only listings that are in ``from_category``.  The report
    counts both sides in one pass: each listing adds one to its old and one to
    its new category, so the totals cannot drift apart.
    """
    joined = catalog.join(
        remap.select("id", F.col("from_category").alias("_from"), F.col("to_category").alias("_to")),
        "id",
        "left",
    )
    target = F.col("_to")
    if strict:
        target = F.when(F.col("category") == F.col("_from"), target)
    moved = joined.withColumn("_new", F.coalesce(target, F.col("category")))
    sides = F.array(
        F.struct(F.col("category").alias("category"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.col("_new").alias("category"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    audit = (
        moved.select(F.inline(sides))
        .groupBy("category")
        .agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )
    remapped = moved.select(*[F.col("_new").alias(c) if c == "category" else c for c in catalog.columns])
    return remapped, audit


def export_catalog(catalog: DataFrame, category: str | None = None) -> DataFrame:
    """Nine-column export with the text an encoder reads."""
    rows = catalog if category is None else catalog.where(F.col("category") == category)
    return rows.select(
        "id", "name", "brand", "category", "subcategory", "unit", "platform", "platform_product_id",
        compose_text("brand", "name", "unit").alias("text"),
    )


def write_catalog_export(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").partitionBy("category", "platform").json(path)


def drop_rejected_mappings(mappings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Remove mappings judged NO; a mapping without a verdict stays.

    ``verdicts``: catalog_id_b (the mapped listing), is_match.
    """
    rejected = verdicts.where(~F.col("is_match")).select(F.col("catalog_id_b").alias("catalog_id"))
    return mappings.join(rejected, "catalog_id", "left_anti")


def judge_pairs(pairs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Pair payload for a judge, with the known verdict where there is one."""
    out = pairs.withColumn("pair_id", F.col("catalog_id_a"))
    if truth is None:
        return out.withColumn("truth_verdict", F.lit(None).cast("string"))
    known = truth.select(
        "catalog_id_a",
        "catalog_id_b",
        F.when(F.col("is_match"), "YES").otherwise("NO").alias("truth_verdict"),
    )
    return out.join(known, ["catalog_id_a", "catalog_id_b"], "left")


def work_grid(
    spark: SparkSession, categories: Iterable[str], pincodes: Iterable[str], platforms: Iterable[str]
) -> DataFrame:
    """Every platform x pincode x category of a batch, from three fixed lists."""

    def each(values: Iterable[str], name: str):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    grid = spark.range(1).select(each(categories, "category"))
    grid = grid.select("category", each(pincodes, "pincode"))
    return grid.select("category", "pincode", each(platforms, "platform"))


def pending_runs(grid: DataFrame, runs: DataFrame, day: str, time_of_day: str) -> DataFrame:
    """Grid cells without any run recorded for that day and slot, whatever its status."""
    done = runs.where(
        (F.to_date("started_at") == F.lit(day).cast("date")) & (F.col("time_of_day") == time_of_day)
    ).select("platform", "pincode", "category")
    return grid.join(done, ["platform", "pincode", "category"], "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    """Remaining categories per platform and pincode (lists bounded by the fixed grid)."""
    return pending.groupBy("platform", "pincode").agg(
        F.sort_array(F.collect_list("category")).alias("remaining"),
        F.count(F.lit(1)).alias("n_remaining"),
    )


def batch_summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return runs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("products_found"), F.lit(0)).alias("total_products"),
    )
