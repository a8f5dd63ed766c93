"""Catalog, sales and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import sales as D
from ..operators import tables as W
from ..sources.dims import SEED_PINCODES, with_location
from ..sources.validate import SALES_RULES, with_reasons
from .bindings import CATEGORIES, PLATFORMS, RetailTables, pick, r6
from .oracle import unit_sql
from .registry import query

DAY = "2024-01-15"


def day_text(name: str):
    return F.col(name).cast("date").cast("string").alias(name)


# ---------------------------------------------------------------------- catalog


@query(
    "catalog_filter",
    "SELECT id, name, unit FROM catalog WHERE platform = 'zepto' AND category = 'PROMO' AND brand = 'Brand#4'",
)
def _(t: RetailTables) -> DataFrame:
    rows = C.catalog_filter(t.catalog, platform="zepto", category="PROMO", brand="Brand#4")
    return rows.select("id", "name", "unit")


@query(
    "unmapped_listings",
    "SELECT id, platform, category FROM catalog WHERE id NOT IN (SELECT catalog_id FROM mappings)",
)
def _(t: RetailTables) -> DataFrame:
    return C.unmapped_listings(t.catalog, t.mappings).select("id", "platform", "category")


@query(
    "unmapped_by_category",
    """SELECT c.category, count(*) AS unmapped FROM catalog c LEFT JOIN mappings m ON m.catalog_id = c.id
       WHERE m.catalog_id IS NULL GROUP BY c.category HAVING count(*) >= 5""",
)
def _(t: RetailTables) -> DataFrame:
    return C.unmapped_by_category(t.catalog, t.mappings)


@query(
    "observations_at",
    f"""SELECT catalog_id, price, inventory_count, in_stock FROM stock
        WHERE obs_date = DATE '{DAY}' AND time_of_day = 'morning' AND pincode = '122002'""",
)
def _(t: RetailTables) -> DataFrame:
    rows = C.observations_at(t.stock, DAY, "morning", "122002")
    return rows.select("catalog_id", "price", "inventory_count", "in_stock")


@query(
    "latest_by_pincode",
    """SELECT catalog_id, pincode, id, price, mrp FROM obs
       QUALIFY row_number() OVER (PARTITION BY catalog_id, pincode ORDER BY observed_at DESC, id DESC) = 1""",
)
def _(t: RetailTables) -> DataFrame:
    return C.latest_by_pincode(t.obs).select("catalog_id", "pincode", "id", "price", "mrp")


@query("latest_by_id", "SELECT id, platform, price, mrp, in_stock FROM priced")
def _(t: RetailTables) -> DataFrame:
    return t.priced.select("id", "platform", "price", "mrp", "in_stock")


@query(
    "latest_any_pincode",
    """SELECT catalog_id, id, pincode, price FROM obs
       QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY observed_at DESC, id DESC) = 1""",
)
def _(t: RetailTables) -> DataFrame:
    return C.latest_any_pincode(t.obs).select("catalog_id", "id", "pincode", "price")


@query("latest_positive_mrp", "SELECT catalog_id, mrp FROM positive_mrp")
def _(t: RetailTables) -> DataFrame:
    return C.latest_positive_mrp(t.obs)


@query(
    "sales_by_category",
    f"""SELECT s.catalog_id, s.pincode, s.estimated_sales, s.confidence
        FROM sales s JOIN catalog c ON c.id = s.catalog_id
        WHERE c.category = 'PROMO' AND s.sale_date = DATE '{DAY}'""",
)
def _(t: RetailTables) -> DataFrame:
    rows = C.sales_by_category(t.sales, t.catalog, "PROMO", DAY)
    return rows.select("catalog_id", "pincode", "estimated_sales", "confidence")


@query(
    "top_sellers",
    """SELECT catalog_id, pincode, CAST(sale_date AS VARCHAR) AS sale_date, estimated_sales FROM sales
       WHERE confidence = 'high'
       ORDER BY estimated_sales DESC, catalog_id, pincode, sales.sale_date LIMIT 20""",
)
def _(t: RetailTables) -> DataFrame:
    return C.top_sellers(t.sales).select(
        "catalog_id", "pincode", day_text("sale_date"), "estimated_sales"
    )


@query(
    "cross_platform_view",
    """SELECT p.id AS canonical_id, p.canonical_name, p.brand, p.category, m.platform, m.name,
              m.catalog_id, round(m.similarity_score, 6) AS similarity
       FROM canonicals p JOIN cluster m ON m.canonical_id = p.id""",
)
def _(t: RetailTables) -> DataFrame:
    view = C.cross_platform_view(t.canonicals, t.mappings, t.catalog)
    return view.select(
        "canonical_id", "canonical_name", "brand", "category", "platform", "name", "catalog_id",
        r6("similarity"),
    )


@query(
    "list_brands",
    """SELECT brand, CAST(count(*) AS BIGINT) AS product_count,
              string_agg(DISTINCT category, ',' ORDER BY category) AS categories
       FROM catalog WHERE brand IS NOT NULL GROUP BY brand""",
)
def _(t: RetailTables) -> DataFrame:
    return C.list_brands(t.catalog).withColumn("categories", F.array_join("categories", ","))


@query(
    "list_categories",
    """SELECT category, CAST(count(*) AS BIGINT) AS product_count, count(DISTINCT brand) AS brand_count
       FROM catalog GROUP BY category""",
)
def _(t: RetailTables) -> DataFrame:
    return C.list_categories(t.catalog)


@query(
    "products_page",
    """SELECT id, platform, name, brand, unit, price, mrp, in_stock,
              (SELECT count(*) FROM catalog WHERE category = 'PROMO') AS total
       FROM priced WHERE category = 'PROMO' ORDER BY id LIMIT 50 OFFSET 50""",
)
def _(t: RetailTables) -> DataFrame:
    rows, total = C.products_page(t.catalog, t.obs, page=2, per_page=50, category="PROMO")
    return rows.select(
        "id", "platform", "name", "brand", "unit", "price", "mrp", "in_stock"
    ).withColumn("total", total.scalar())


@query(
    "dashboard_stats",
    """SELECT count(*) AS products, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories,
              count(DISTINCT platform) AS platforms,
              (SELECT CAST(CAST(max(started_at) AS DATE) AS VARCHAR) FROM runs) AS last_scrape
       FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    return C.dashboard_stats(t.catalog, t.runs).withColumn("last_scrape", day_text("last_scrape"))


@query(
    "runs_by_date",
    """SELECT id, platform, pincode, status FROM runs
       WHERE CAST(started_at AS DATE) = DATE '1996-05-01'""",
)
def _(t: RetailTables) -> DataFrame:
    return C.runs_by_date(t.runs, "1996-05-01").select("id", "platform", "pincode", "status")


@query(
    "brand_search",
    """SELECT brand, CAST(count(*) AS BIGINT) AS product_count FROM catalog
       WHERE contains(lower(brand), 'brand#1')
         AND brand IN (SELECT brand FROM catalog WHERE category = 'PROMO')
       GROUP BY brand ORDER BY product_count DESC, brand LIMIT 8""",
)
def _(t: RetailTables) -> DataFrame:
    found = C.brand_search(C.list_brands(t.catalog), "BRAND#1", "PROMO", 8)
    return found.select("brand", "product_count")


# ------------------------------------------------------------------------ sales


@query(
    "daily_sales",
    """SELECT catalog_id, pincode, CAST(sale_date AS VARCHAR) AS sale_date,
              CAST(morning_qty AS INTEGER) AS morning_qty, CAST(night_qty AS INTEGER) AS night_qty,
              CAST(estimated_sales AS INTEGER) AS estimated_sales, confidence, restock_flag FROM sales""",
)
def _(t: RetailTables) -> DataFrame:
    return t.sales.withColumn("sale_date", day_text("sale_date"))


@query(
    "sales_summary",
    """SELECT CAST(sale_date AS VARCHAR) AS sale_date, count(*) AS records,
              CAST(sum(estimated_sales) AS BIGINT) AS total_estimated_sales,
              count(*) FILTER (confidence = 'high') AS n_high,
              count(*) FILTER (confidence = 'medium') AS n_medium,
              count(*) FILTER (confidence = 'low') AS n_low
       FROM sales GROUP BY sales.sale_date""",
)
def _(t: RetailTables) -> DataFrame:
    return D.sales_summary(t.sales).withColumn("sale_date", day_text("sale_date"))


@query(
    "category_sales_by_brand",
    """SELECT c.category, CAST(s.sale_date AS VARCHAR) AS sale_date, c.brand, count(*) AS product_count,
              CAST(sum(s.estimated_sales) AS BIGINT) AS total_estimated_sales,
              round(avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5
                        WHEN 'low' THEN 0.25 ELSE 0.0 END), 6) AS avg_confidence
       FROM sales s JOIN catalog c ON c.id = s.catalog_id GROUP BY c.category, s.sale_date, c.brand""",
)
def _(t: RetailTables) -> DataFrame:
    rows = D.category_sales_by_brand(t.sales, t.catalog)
    return rows.withColumns(
        {"sale_date": day_text("sale_date"), "avg_confidence": r6("avg_confidence")}
    )


@query(
    "sales_velocity",
    """SELECT catalog_id, name, brand, category, platform, CAST(total_units AS BIGINT) AS total_units,
              round(avg_per_pincode, 6) AS avg_per_pincode, pincode_count,
              CAST(restocks AS BIGINT) AS restocks FROM velocity""",
)
def _(t: RetailTables) -> DataFrame:
    return D.sales_velocity(t.sales, t.catalog).withColumn("avg_per_pincode", r6("avg_per_pincode"))


@query(
    "category_top_sellers",
    """SELECT category, catalog_id, name, brand, platform, CAST(total_units AS BIGINT) AS total_units,
              CAST(row_number() OVER (PARTITION BY category ORDER BY total_units DESC, catalog_id)
                   AS INTEGER) AS position
       FROM velocity QUALIFY position <= 20""",
)
def _(t: RetailTables) -> DataFrame:
    return D.category_top_sellers(t.sales, t.catalog)


def _probes(t: RetailTables) -> DataFrame:
    """Probed stock: the largest event value seen for a listing."""
    return t.event_readings.groupBy("catalog_id", "pincode").agg(
        F.floor(F.max(F.col("price") - 1.0)).cast("int").alias("probed_qty")
    )


@query(
    "capped_stock",
    """SELECT s.catalog_id, s.pincode, CAST(s.obs_date AS VARCHAR) AS obs_date, s.time_of_day,
              CASE WHEN s.inventory_count >= 50 AND p.probed_qty > 50 THEN p.probed_qty
                   ELSE s.inventory_count END AS inventory_count
       FROM stock s LEFT JOIN (
         SELECT catalog_id, pincode, CAST(floor(max(price - 1.0)) AS INTEGER) AS probed_qty
         FROM readings GROUP BY catalog_id, pincode) p USING (catalog_id, pincode)""",
)
def _(t: RetailTables) -> DataFrame:
    probed = D.apply_probed_stock(t.stock, _probes(t))
    return probed.select(
        "catalog_id", "pincode", day_text("obs_date"), "time_of_day", "inventory_count"
    )


@query(
    "capped_share",
    """SELECT c.platform, count(*) AS readings, count(*) FILTER (inventory_count >= 50) AS capped,
              round(count(*) FILTER (inventory_count >= 50) / count(*)::DOUBLE, 6) AS capped_share
       FROM stock s JOIN catalog c ON c.id = s.catalog_id
       WHERE inventory_count IS NOT NULL GROUP BY c.platform""",
)
def _(t: RetailTables) -> DataFrame:
    return D.capped_share(t.stock, t.catalog).withColumn("capped_share", r6("capped_share"))


# ----------------------------------------------------------------- maintenance


@query(
    "upsert_catalog",
    """SELECT coalesce(c.platform, n.platform) AS platform,
              coalesce(c.platform_product_id, n.platform_product_id) AS platform_product_id,
              CASE WHEN n.platform IS NULL THEN c.name ELSE n.name END AS name,
              CASE WHEN n.platform IS NULL THEN c.brand ELSE n.brand END AS brand,
              CASE WHEN c.id IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS first_seen,
              CASE WHEN n.platform IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_seen,
              c.id IS NULL AS is_new
       FROM catalog c FULL JOIN (
         SELECT ['blinkit', 'zepto', 'instamart'][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS platform,
                CAST(s_suppkey AS VARCHAR) AS platform_product_id, s_name AS name,
                CAST(NULL AS VARCHAR) AS brand FROM supplier) n
         ON n.platform = c.platform AND n.platform_product_id = c.platform_product_id""",
)
def _(t: RetailTables) -> DataFrame:
    batch = t.raw("supplier").select(
        pick(PLATFORMS, F.col("s_suppkey") % 3).alias("platform"),
        F.col("s_suppkey").cast("string").alias("platform_product_id"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("brand"),
        F.lit("PROMO").alias("category"),
        *[F.lit(None).cast("string").alias(c) for c in ("subcategory", "unit", "image_url")],
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("seen_at"),
        F.col("s_suppkey").alias("seq"),
    )
    merged = W.upsert_catalog(t.catalog, batch)
    return merged.select(
        "platform", "platform_product_id", "name", "brand",
        day_text("first_seen_at").alias("first_seen"), day_text("last_seen_at").alias("last_seen"),
        (F.to_date("first_seen_at") == F.lit("2024-02-01").cast("date")).alias("is_new"),
    )


@query(
    "append_observations",
    """SELECT r.seq, r.catalog_id, r.pincode, CAST(r.obs_date AS VARCHAR) AS obs_date, r.time_of_day
       FROM (SELECT * FROM readings WHERE event_type <> 'view'
             QUALIFY row_number() OVER (
               PARTITION BY catalog_id, pincode, obs_date, time_of_day ORDER BY observed_at, seq) = 1) r
       WHERE NOT EXISTS (SELECT 1 FROM readings o WHERE o.event_type = 'view'
         AND o.catalog_id = r.catalog_id AND o.pincode = r.pincode AND o.obs_date = r.obs_date
         AND o.time_of_day = r.time_of_day)""",
)
def _(t: RetailTables) -> DataFrame:
    arrived = t.event_readings
    stored = arrived.where(F.col("event_type") == "view")
    appended = W.append_observations(stored, arrived.where(F.col("event_type") != "view"))
    return appended.select("seq", "catalog_id", "pincode", day_text("obs_date"), "time_of_day")


@query(
    "upsert_daily_sales",
    """SELECT catalog_id, pincode, CAST(sale_date AS VARCHAR) AS sale_date,
              CASE WHEN sale_date >= DATE '2024-01-15' THEN CAST(estimated_sales AS INTEGER) ELSE -1 END AS units
       FROM sales""",
)
def _(t: RetailTables) -> DataFrame:
    stored = t.sales.withColumn("estimated_sales", F.lit(-1))
    new = t.sales.where(F.col("sale_date") >= F.lit("2024-01-15").cast("date"))
    return W.upsert_daily_sales(stored, new).select(
        "catalog_id", "pincode", day_text("sale_date"), F.col("estimated_sales").alias("units")
    )


@query(
    "upsert_mappings",
    """SELECT catalog_id, CASE WHEN similarity_score < 0.85 THEN catalog_id ELSE canonical_id END AS canonical_id
       FROM mappings""",
)
def _(t: RetailTables) -> DataFrame:
    new = t.mappings.where(F.col("similarity_score") < 0.85).withColumn(
        "canonical_id", F.col("catalog_id")
    )
    return W.upsert_mappings(t.mappings, new).select("catalog_id", "canonical_id")


@query(
    "insert_canonicals",
    f"""SELECT id, name AS canonical_name, brand, category, {unit_sql('unit')} AS unit_normalized
        FROM catalog WHERE id NOT IN (SELECT catalog_id FROM mappings)""",
)
def _(t: RetailTables) -> DataFrame:
    return W.insert_canonicals(C.unmapped_listings(t.catalog, t.mappings))


def _remap(t: RetailTables) -> DataFrame:
    """Supplier keys stand for the listings to move."""
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.lit("PROMO").alias("from_category"),
        F.lit("LARGE").alias("to_category"),
    )


@query(
    "remap_categories",
    """SELECT category, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after,
              CAST(sum(a) - sum(b) AS BIGINT) AS delta
       FROM (SELECT category, 1 AS b, 0 AS a FROM catalog
             UNION ALL SELECT CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'LARGE' ELSE category END,
                              0, 1 FROM catalog) GROUP BY category""",
)
def _(t: RetailTables) -> DataFrame:
    _, audit = W.remap_categories(t.catalog, _remap(t))
    return audit


@query(
    "remap_categories_strict",
    """SELECT id, CASE WHEN category = 'PROMO' AND id IN (SELECT s_suppkey FROM supplier)
                       THEN 'LARGE' ELSE category END AS category FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    remapped, _ = W.remap_categories(t.catalog, _remap(t), strict=True)
    return remapped.select("id", "category")


@query("export_catalog", "SELECT id, name, brand, category, platform, text FROM texts")
def _(t: RetailTables) -> DataFrame:
    return W.export_catalog(t.catalog).select("id", "name", "brand", "category", "platform", "text")


_GRID_SQL = """
  SELECT c.category, p.pincode, f.platform
  FROM (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']) AS category) c,
       (SELECT unnest(['122001', '122002', '122003', '122008', '122010', '122015', '122018', '122051'])
               AS pincode) p,
       (SELECT unnest(['blinkit', 'zepto', 'instamart']) AS platform) f
  WHERE NOT EXISTS (
    SELECT 1 FROM runs r WHERE r.category = c.category AND r.pincode = p.pincode
      AND r.platform = f.platform AND r.time_of_day = 'night'
      AND CAST(r.started_at AS DATE) = DATE '1996-05-01')"""


@query(
    "pending_runs",
    f"""SELECT platform, pincode, string_agg(category, ',' ORDER BY category) AS remaining,
               count(*) AS n_remaining
        FROM ({_GRID_SQL}) g GROUP BY platform, pincode""",
)
def _(t: RetailTables) -> DataFrame:
    grid = W.work_grid(t.spark, CATEGORIES, SEED_PINCODES, ("blinkit", "zepto", "instamart"))
    pending = W.pending_runs(grid, t.runs, "1996-05-01", "night")
    return W.pending_summary(pending).withColumn("remaining", F.array_join("remaining", ","))


@query(
    "batch_summary",
    """SELECT platform, count(*) AS total_runs, CAST(sum(errors) AS BIGINT) AS errors,
              CAST(sum(products_found) AS BIGINT) AS total_products FROM runs GROUP BY platform""",
)
def _(t: RetailTables) -> DataFrame:
    return W.batch_summary(t.runs, ["platform"])


@query(
    "pincode_dimension",
    """SELECT id, pincode,
              CASE pincode WHEN '122001' THEN 28.4595 WHEN '122002' THEN 28.4729 WHEN '122003' THEN 28.46
                WHEN '122008' THEN 28.43 WHEN '122010' THEN 28.47 WHEN '122015' THEN 28.49
                WHEN '122018' THEN 28.44 ELSE 28.41 END::DOUBLE AS lat,
              'Gurugram' AS city
       FROM runs""",
)
def _(t: RetailTables) -> DataFrame:
    return with_location(t.runs).select("id", "pincode", "lat", "city")


@query(
    "validate_rows",
    """SELECT 'grade not accepted' AS reason, count(*) AS n FROM sales
       WHERE confidence NOT IN ('high', 'medium', 'no_data')
       UNION ALL SELECT 'nothing sold', count(*) FROM sales WHERE estimated_sales = 0""",
)
def _(t: RetailTables) -> DataFrame:
    rules = {
        **{k: v for k, v in SALES_RULES.items() if k != "confidence unknown"},
        "grade not accepted": "confidence NOT IN ('high', 'medium', 'no_data')",
        "nothing sold": "estimated_sales = 0",
    }
    rejected = with_reasons(t.sales, rules).select(F.explode("reasons").alias("reason"))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
