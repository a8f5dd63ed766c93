"""Brand, category and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import brand as B
from ..operators import category as G
from ..operators import report as R
from .bindings import RetailTables, r6
from .oracle import DISCOUNT
from .registry import query


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# ------------------------------------------------------------------------ brand

_SHARE = """
  SELECT category, brand, n AS sku_count,
         rank() OVER (PARTITION BY category ORDER BY n DESC) AS rank,
         CAST(t.total AS BIGINT) AS category_total, t.brands AS total_brands,
         n / t.total::DOUBLE * 100 AS share_pct
  FROM brand_counts JOIN (SELECT category, sum(n) AS total, count(brand) AS brands
                          FROM brand_counts GROUP BY category) t USING (category)
  WHERE brand IS NOT NULL"""


@query("brand_share", f"SELECT * REPLACE (round(share_pct, 6) AS share_pct) FROM ({_SHARE})")
def _(t: RetailTables) -> DataFrame:
    per_brand = t.catalog.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("sku_count"))
    return rounded(B.brand_share(per_brand), "share_pct")


_BINS = ", ".join(
    f"count(*) FILTER (lo < hi AND least(floor((price - lo) / ((hi - lo) / 8)), 7) = {i}) AS bin{i}"
    for i in range(8)
)


@query(
    "price_histogram",
    f"""SELECT category, brand, lo AS cat_min, hi AS cat_max, {_BINS}
        FROM priced JOIN (SELECT category, min(price) AS lo, max(price) AS hi FROM priced GROUP BY category)
          USING (category)
        WHERE lo IS NOT NULL GROUP BY category, brand, lo, hi""",
)
def _(t: RetailTables) -> DataFrame:
    return B.price_histogram(t.priced)


@query(
    "category_histogram",
    f"""SELECT category, lo AS cat_min, hi AS cat_max, {_BINS}
        FROM priced JOIN (SELECT category, min(price) AS lo, max(price) AS hi FROM priced GROUP BY category)
          USING (category)
        WHERE price IS NOT NULL GROUP BY category, lo, hi""",
)
def _(t: RetailTables) -> DataFrame:
    return B.category_histogram(B.price_histogram(t.priced))


@query(
    "mrp_tiers",
    """SELECT category, brand, round(t1, 6) AS budget_threshold, round(t2, 6) AS premium_threshold,
              count(*) FILTER (mrp <= t1) AS budget, count(*) FILTER (mrp > t1 AND mrp <= t2) AS mid,
              count(*) FILTER (mrp > t2) AS premium
       FROM priced JOIN (SELECT category, quantile_cont(mrp, 0.3333) AS t1, quantile_cont(mrp, 0.6667) AS t2
                         FROM priced GROUP BY category) USING (category)
       WHERE t1 IS NOT NULL GROUP BY category, brand, t1, t2""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(B.mrp_tiers(t.priced), "budget_threshold", "premium_threshold")


_DISCOUNTED = f"(SELECT *, {DISCOUNT} AS d FROM priced)"


@query(
    "avg_discount",
    f"""SELECT category, brand, round(coalesce(avg(d), 0), 6) AS brand_avg,
               round(any_value(c), 6) AS category_avg
        FROM {_DISCOUNTED} JOIN (SELECT category, coalesce(avg(d), 0) AS c FROM {_DISCOUNTED} GROUP BY category)
          USING (category)
        WHERE brand IS NOT NULL GROUP BY category, brand""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(B.avg_discount(t.cube), "brand_avg", "category_avg")


_BY_PLATFORM = ", ".join(
    f"count(*) FILTER (platform = '{p}') AS n_{p}" for p in ("blinkit", "zepto", "instamart")
)


@query(
    "platform_mix",
    f"""SELECT category, brand, {_BY_PLATFORM}, count(*) AS total FROM catalog
        WHERE brand IS NOT NULL GROUP BY category, brand""",
)
def _(t: RetailTables) -> DataFrame:
    return B.platform_mix(t.cube)


@query(
    "cross_platform_count",
    """SELECT brand, category, count(*) FILTER (p >= 2) AS cross_platform_count
       FROM (SELECT brand, category, canonical_id, count(DISTINCT platform) AS p FROM cluster
             WHERE brand IS NOT NULL GROUP BY ALL) GROUP BY brand, category""",
)
def _(t: RetailTables) -> DataFrame:
    return B.cross_platform_count(t.catalog, t.mappings)


_PARITY = """
  SELECT m.canonical_id, {names}
  FROM cluster m LEFT JOIN latest l ON l.catalog_id = m.catalog_id GROUP BY m.canonical_id"""


def _parity_sql(pairs) -> str:
    names = ", ".join(
        f"max(CASE WHEN platform = '{p}' THEN price END) AS {p}" for p in ("blinkit", "zepto", "instamart")
    )
    sides = " UNION ALL ".join(
        f"SELECT canonical_id, '{a}_{b}' AS pair, {a} AS price_a, {b} AS price_b FROM p" for a, b in pairs
    )
    return f"""
      SELECT canonical_id, pair, price_a, price_b, round(price_a - price_b, 6) AS delta,
             round(abs(price_a - price_b) / greatest(price_a, price_b) * 100, 6) AS delta_pct,
             canonical_name, brand, category
      FROM (WITH p AS ({_PARITY.format(names=names)}) {sides}) s
      JOIN canonicals c ON c.id = s.canonical_id
      WHERE price_a IS NOT NULL AND price_b IS NOT NULL AND round(price_a - price_b, 2) <> 0"""


@query("price_parity", _parity_sql([("blinkit", "zepto")]))
def _(t: RetailTables) -> DataFrame:
    return rounded(
        B.price_parity(t.canonicals, t.mappings, t.latest, t.catalog), "delta", "delta_pct"
    )


@query("price_parity_all_pairs", _parity_sql(B.PLATFORM_PAIRS))
def _(t: RetailTables) -> DataFrame:
    found = B.price_parity(t.canonicals, t.mappings, t.latest, t.catalog, B.PLATFORM_PAIRS)
    return rounded(found, "delta", "delta_pct")


@query(
    "competitors",
    """SELECT category, brand, n AS sku_count, brand = 'Brand#4' AS is_target FROM brand_counts
       WHERE brand IS NOT NULL""",
)
def _(t: RetailTables) -> DataFrame:
    return B.competitors(t.cube, "Brand#4")


@query(
    "canonical_competitors",
    f"""SELECT DISTINCT a.brand, a.category, b.brand AS competitor
        FROM cluster a JOIN cluster b ON b.canonical_id = a.canonical_id AND b.brand <> a.brand
        JOIN (SELECT brand, category FROM ({_SHARE}) WHERE rank = 1) k
          ON k.brand = a.brand AND k.category = a.category""",
)
def _(t: RetailTables) -> DataFrame:
    leaders = B.brand_share(t.cube).where(F.col("rank") == 1)
    return B.canonical_competitors(t.catalog, t.mappings, leaders)


@query(
    "brand_scorecard",
    f"""SELECT brand, count(*) AS total_skus, count(DISTINCT category) AS category_count, {_BY_PLATFORM},
               round(coalesce(avg(d), 0), 6) AS avg_discount_pct, coalesce(min(price), 0) AS price_min,
               coalesce(max(price), 0) AS price_max,
               CAST(count(DISTINCT platform) AS INTEGER) AS platform_count
        FROM {_DISCOUNTED} WHERE brand IS NOT NULL GROUP BY brand""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(B.brand_scorecard(t.cube), "avg_discount_pct")


@query(
    "scorecard_by_category",
    f"""SELECT s.category, s.brand, s.sku_count, s.rank, s.category_total, s.total_brands,
               round(s.share_pct, 6) AS share_pct, b.platforms,
               array_to_string(list_sort(list_filter(['blinkit', 'instamart', 'zepto'],
                 lambda x: NOT contains(b.platforms, x))), ',') AS missing_platforms,
               round(b.avg_price, 6) AS avg_price, round(b.avg_discount, 6) AS avg_discount_pct,
               round(c.avg_price, 6) AS category_avg_price,
               round(c.avg_discount, 6) AS category_avg_discount_pct
        FROM ({_SHARE}) s
        JOIN (SELECT category, brand, coalesce(avg(price), 0) AS avg_price, coalesce(avg(d), 0) AS avg_discount,
                     string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms
              FROM {_DISCOUNTED} GROUP BY category, brand) b ON b.category = s.category AND b.brand = s.brand
        JOIN (SELECT category, coalesce(avg(price), 0) AS avg_price, coalesce(avg(d), 0) AS avg_discount
              FROM {_DISCOUNTED} GROUP BY category) c ON c.category = s.category""",
)
def _(t: RetailTables) -> DataFrame:
    card = rounded(
        B.scorecard_by_category(t.cube),
        "share_pct", "avg_price", "avg_discount_pct", "category_avg_price", "category_avg_discount_pct",
    )
    return joined(card, "platforms", "missing_platforms")


_GAPS = """
  WITH gap_rows AS (
    SELECT p.brand, p.category, p.canonical_name AS product_name, m.platform, m.catalog_id
    FROM canonicals p JOIN cluster m ON m.canonical_id = p.id WHERE p.brand IS NOT NULL
    UNION ALL
    SELECT c.brand, c.category, c.name, c.platform, c.id FROM catalog c
    WHERE c.brand IS NOT NULL AND (
      c.id NOT IN (SELECT catalog_id FROM mappings)
      OR NOT EXISTS (SELECT 1 FROM canonicals p JOIN cluster m ON m.canonical_id = p.id
                     WHERE p.brand = c.brand AND p.category = c.category)))
  SELECT brand, category, product_name,
         {columns},
         CAST(3 - count(DISTINCT platform) AS INTEGER) AS gap_count
  FROM gap_rows LEFT JOIN latest l USING (catalog_id) GROUP BY brand, category, product_name"""
_GAPS = _GAPS.format(
    columns=", ".join(
        f"first(price ORDER BY catalog_id DESC) FILTER (platform = '{p}') AS {p}_price, "
        f"count(*) FILTER (platform = '{p}') > 0 AS {p}_present"
        for p in ("blinkit", "zepto", "instamart")
    )
)


@query("distribution_gaps", f"SELECT * FROM ({_GAPS})")
def _(t: RetailTables) -> DataFrame:
    return B.distribution_gaps(t.canonicals, t.mappings, t.catalog, t.latest)


@query(
    "gap_summary",
    f"""SELECT brand, category, count(*) AS total_products, count(*) FILTER (gap_count = 0) AS on_all,
               count(*) FILTER (gap_count = 1) AS on_two, count(*) FILTER (gap_count = 2) AS on_one,
               count(*) FILTER (NOT blinkit_present) AS gaps_blinkit,
               count(*) FILTER (NOT zepto_present) AS gaps_zepto,
               count(*) FILTER (NOT instamart_present) AS gaps_instamart
        FROM ({_GAPS}) GROUP BY brand, category""",
)
def _(t: RetailTables) -> DataFrame:
    return B.gap_summary(B.distribution_gaps(t.canonicals, t.mappings, t.catalog, t.latest))


@query(
    "discount_battle",
    f"""SELECT category, brand, round(coalesce(avg(d), 0), 6) AS avg_discount_pct,
               round(count(d) / count(*)::DOUBLE * 100, 6) AS discounted_sku_pct, count(*) AS sku_count,
               round(any_value(c), 6) AS category_avg_discount
        FROM {_DISCOUNTED}
        JOIN (SELECT category, coalesce(avg(d), 0) AS c FROM {_DISCOUNTED}
              WHERE brand IS NOT NULL GROUP BY category) USING (category)
        WHERE brand IS NOT NULL GROUP BY category, brand""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(
        B.discount_battle(t.cube), "avg_discount_pct", "discounted_sku_pct", "category_avg_discount"
    )


_INTENSITY = ", ".join(
    f"""CASE WHEN n_{p} = 0 THEN 'none' WHEN n_{p} / m::DOUBLE > 0.7 THEN 'high'
        WHEN n_{p} / m::DOUBLE > 0.3 THEN 'medium' ELSE 'low' END AS intensity_{p}"""
    for p in ("blinkit", "zepto", "instamart")
)


@query(
    "platform_heatmap",
    f"""SELECT brand, category, n_blinkit, n_zepto, n_instamart, total, {_INTENSITY}
        FROM (SELECT *, max(total) OVER (PARTITION BY brand) AS m
              FROM (SELECT brand, category, {_BY_PLATFORM}, count(*) AS total FROM catalog
                    WHERE brand IS NOT NULL GROUP BY brand, category))""",
)
def _(t: RetailTables) -> DataFrame:
    return B.platform_heatmap(t.cube)


# --------------------------------------------------------------------- category


@query(
    "landscape",
    f"""SELECT category, brand, count(*) AS sku_count, round(coalesce(avg(price), 0), 6) AS avg_price,
               round(coalesce(avg(d), 0), 6) AS avg_discount_pct,
               string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms,
               CAST(count(DISTINCT platform) AS INTEGER) AS platform_count,
               round(greatest(sqrt(count(*)) * 5, 4), 6) AS bubble_radius,
               any_value(tb) AS total_brands, any_value(ts) AS total_skus,
               any_value(lo) AS price_min, any_value(hi) AS price_max
        FROM {_DISCOUNTED}
        JOIN (SELECT category, count(DISTINCT brand) AS tb, count(*) AS ts, min(price) AS lo, max(price) AS hi
              FROM priced GROUP BY category) USING (category)
        WHERE brand IS NOT NULL GROUP BY category, brand""",
)
def _(t: RetailTables) -> DataFrame:
    rows = rounded(G.landscape(t.cube), "avg_price", "avg_discount_pct", "bubble_radius")
    return joined(rows, "platforms")


_BANDS = """
  WITH span AS (SELECT category, min(price) AS lo, max(price) AS hi,
                       CASE WHEN max(price) > min(price) THEN (max(price) - min(price)) / 10 ELSE 1.0 END AS w
                FROM priced WHERE price IS NOT NULL GROUP BY category),
  bands AS (SELECT category, CAST(i AS INTEGER) AS band, lo + i * w AS band_low,
                   lo + (i + 1) * w AS band_high FROM span, range(10) r(i)),
  banded AS (SELECT b.category, b.band, b.band_low, b.band_high, p.id, p.brand
             FROM bands b LEFT JOIN priced p
               ON p.category = b.category AND p.price >= b.band_low
              AND (p.price < b.band_high OR b.band = 9)),
  leaders AS (SELECT category, band, string_agg(brand, ',' ORDER BY n DESC, brand) AS top_brands
              FROM (SELECT category, band, brand, count(*) AS n FROM banded WHERE brand IS NOT NULL
                    GROUP BY category, band, brand
                    QUALIFY row_number() OVER (PARTITION BY category, band ORDER BY count(*) DESC, brand) <= 3)
              GROUP BY category, band)
  SELECT category, band, round(band_low, 6) AS band_low, round(band_high, 6) AS band_high,
         count(id) AS sku_count, count(DISTINCT brand) AS brand_count,
         coalesce(any_value(top_brands), '') AS top_brands,
         CASE WHEN count(DISTINCT brand) <= 3 THEN 'sparse' WHEN count(DISTINCT brand) <= 8 THEN 'moderate'
              ELSE 'crowded' END AS density
  FROM banded LEFT JOIN leaders USING (category, band) GROUP BY category, band, band_low, band_high"""


@query("whitespace", f"SELECT * FROM ({_BANDS})")
def _(t: RetailTables) -> DataFrame:
    return joined(rounded(G.whitespace(t.priced), "band_low", "band_high"), "top_brands")


@query("opportunity_bands", f"SELECT * FROM ({_BANDS}) WHERE density = 'sparse'")
def _(t: RetailTables) -> DataFrame:
    bands = G.opportunity_bands(G.whitespace(t.priced))
    return joined(rounded(bands, "band_low", "band_high"), "top_brands")


@query(
    "price_distribution",
    """SELECT category, CAST(b.band AS INTEGER) AS band, b.label,
              count(*) FILTER (platform = 'blinkit' AND i = b.band) AS blinkit,
              count(*) FILTER (platform = 'zepto' AND i = b.band) AS zepto,
              count(*) FILTER (platform = 'instamart' AND i = b.band) AS instamart
       FROM (SELECT category, platform, CASE WHEN price < 50 THEN 0 WHEN price < 100 THEN 1
                      WHEN price < 200 THEN 2 WHEN price < 500 THEN 3 ELSE 4 END AS i
             FROM priced WHERE price IS NOT NULL),
            (VALUES (0, '₹0-50'), (1, '₹50-100'), (2, '₹100-200'), (3, '₹200-500'), (4, '₹500+')) b(band, label)
       GROUP BY category, b.band, b.label""",
)
def _(t: RetailTables) -> DataFrame:
    return G.price_distribution(t.catalog, t.latest)


@query(
    "platform_coverage",
    "SELECT brand, platform, count(*) AS cnt FROM catalog WHERE brand IS NOT NULL GROUP BY brand, platform",
)
def _(t: RetailTables) -> DataFrame:
    return G.platform_coverage(t.cube)


@query(
    "brand_share_top10",
    """SELECT category, CASE WHEN p <= 10 THEN brand ELSE 'Others' END AS label, CAST(sum(n) AS BIGINT) AS cnt,
              CAST(min(least(p, 11)) AS INTEGER) AS place
       FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, brand) AS p
             FROM brand_counts WHERE brand IS NOT NULL) GROUP BY ALL""",
)
def _(t: RetailTables) -> DataFrame:
    return G.brand_share_top(t.cube)


# ----------------------------------------------------------------------- report


def _requests(t: RetailTables) -> DataFrame:
    """Brands of even canonical parts, asked for in their own category.

    A brand that has no listing there gives an opportunity report.
    """
    return t.canonicals.where(F.col("brand").isNotNull()).select("brand", "category").distinct()


def _report(t: RetailTables) -> dict[str, DataFrame]:
    return R.report_dataset(_requests(t), t.catalog, t.latest, t.sales, t.canonicals, t.mappings)


_ASKED = "(SELECT DISTINCT brand, category FROM canonicals WHERE brand IS NOT NULL)"


@query(
    "report_dataset",
    f"""SELECT a.brand, a.category, count(c.id) AS brand_product_count,
               coalesce(string_agg(DISTINCT c.platform, ',' ORDER BY c.platform), '') AS platforms_present,
               any_value(t.n) AS total_category_products,
               any_value(t.b) - CASE WHEN count(c.id) > 0 THEN 1 ELSE 0 END AS n_competitor_brands,
               any_value((SELECT string_agg(brand, ',' ORDER BY brand) FROM (
                  SELECT DISTINCT x.brand FROM catalog x WHERE x.category = a.category AND x.brand <> a.brand
                  ORDER BY x.brand LIMIT 15))) AS first_competitor_brands,
               count(c.id) = 0 AS is_opportunity
        FROM {_ASKED} a
        LEFT JOIN catalog c ON c.brand = a.brand AND c.category = a.category
        LEFT JOIN (SELECT category, count(*) AS n, count(DISTINCT brand) AS b FROM catalog GROUP BY category) t
          ON t.category = a.category
        GROUP BY a.brand, a.category""",
)
def _(t: RetailTables) -> DataFrame:
    return joined(_report(t)["overview"], "platforms_present", "first_competitor_brands")


@query(
    "report_competitor_prices",
    f"""SELECT k.brand, k.category, k.catalog_id, k.competitor, l.price, l.mrp
        FROM (SELECT a.brand, a.category, c.id AS catalog_id, c.brand AS competitor
              FROM {_ASKED} a JOIN catalog c ON c.category = a.category AND c.brand IS DISTINCT FROM a.brand
              QUALIFY row_number() OVER (PARTITION BY a.brand, a.category ORDER BY c.id) <= 50) k
        JOIN latest l ON l.catalog_id = k.catalog_id""",
)
def _(t: RetailTables) -> DataFrame:
    rows = _report(t)["competitor_prices"]
    return rows.select("brand", "category", "catalog_id", "competitor", "price", "mrp")


@query(
    "report_brand_sales",
    f"""SELECT v.brand, v.category, v.catalog_id, CAST(v.total_units AS BIGINT) AS total_units, v.pincode_count
        FROM velocity v JOIN {_ASKED} a ON a.brand = v.brand AND a.category = v.category""",
)
def _(t: RetailTables) -> DataFrame:
    rows = _report(t)["brand_sales"]
    return rows.select("brand", "category", "catalog_id", "total_units", "pincode_count")


_MONEY = "': ₹' || CAST(price AS VARCHAR) || ' (MRP ₹' || coalesce(CAST(mrp AS VARCHAR), 'None') || ')'"


def _section(number: int, headers: list[str], source: str, line: str, order1: str, order2: str) -> str:
    """SQL for a list section: its header lines where it has rows, then the rows."""
    heads = " ".join(
        f"""UNION ALL SELECT DISTINCT brand, category, {number}, {i}, 0.0::DOUBLE, '', {text} FROM {source}"""
        for i, text in enumerate(headers)
    )
    return f"""{heads} UNION ALL
      SELECT brand, category, {number}, {len(headers)}, CAST({order1} AS DOUBLE), {order2}, {line}
      FROM {source}"""


_REPORT_SQL = f"""
  WITH asked AS (SELECT DISTINCT brand, category FROM canonicals WHERE brand IS NOT NULL),
  facts AS (
    SELECT a.brand, a.category, count(c.id) AS own, any_value(t.n) AS total, any_value(t.b) AS brands,
           coalesce(string_agg(DISTINCT c.platform, ', ' ORDER BY c.platform), '') AS platforms,
           coalesce(any_value((SELECT string_agg(brand, ', ' ORDER BY brand) FROM (
             SELECT DISTINCT x.brand FROM catalog x WHERE x.category = a.category AND x.brand <> a.brand
             ORDER BY x.brand LIMIT 15))), '') AS others
    FROM asked a
    LEFT JOIN catalog c ON c.brand = a.brand AND c.category = a.category
    LEFT JOIN (SELECT category, count(*) AS n, count(DISTINCT brand) AS b FROM catalog GROUP BY category) t
      ON t.category = a.category
    GROUP BY a.brand, a.category),
  own_prices AS (
    SELECT a.brand, a.category, c.id, c.name, c.platform, l.price, l.mrp, l.in_stock
    FROM asked a JOIN catalog c ON c.brand = a.brand AND c.category = a.category
    JOIN latest l ON l.catalog_id = c.id),
  rivals AS (
    SELECT k.*, l.price, l.mrp FROM (
      SELECT a.brand, a.category, c.id, c.name, c.platform, c.brand AS rival
      FROM asked a JOIN catalog c ON c.category = a.category AND c.brand IS DISTINCT FROM a.brand
      QUALIFY row_number() OVER (PARTITION BY a.brand, a.category ORDER BY c.id) <= 50) k
    JOIN latest l ON l.catalog_id = k.id),
  spread AS (
    SELECT a.brand, a.category, p.id, p.canonical_name,
           string_agg(m.platform, ', ' ORDER BY m.platform) AS platforms
    FROM asked a JOIN canonicals p ON p.brand = a.brand JOIN cluster m ON m.canonical_id = p.id
    GROUP BY a.brand, a.category, p.id, p.canonical_name),
  sold AS (SELECT v.* FROM velocity v JOIN asked a ON a.brand = v.brand AND a.category = v.category),
  best_sold AS (
    SELECT a.brand, a.category, v.* EXCLUDE (brand, category) FROM asked a JOIN (
      SELECT brand AS seller, category, brand, name, platform, total_units,
             row_number() OVER (PARTITION BY category ORDER BY total_units DESC, catalog_id) AS position
      FROM velocity QUALIFY position <= 20) v ON v.category = a.category)
  SELECT brand, category, CAST(section AS INTEGER) AS section, CAST(part AS INTEGER) AS part,
         order1, order2, line
  FROM (
    SELECT brand, category, 0 AS section, part, 0.0::DOUBLE AS order1, '' AS order2, line FROM (
      SELECT brand, category, unnest([0, 1, 2, 3, 4]) AS part, unnest([
        CASE WHEN own = 0 THEN 'Category ' || category || ' seen by **' || brand
               || '**, which lists nothing there yet: competitors, prices and open price bands.'
             ELSE '**' || brand || '** in category ' || category || ': listings, prices and sales.' END,
        chr(10) || '### Category Overview',
        '- Total products in category: ' || total,
        '- Active brands: ' || brands,
        '- Competitor brands: ' || others]) AS line FROM facts)
    UNION ALL
    SELECT brand, category, 1, part, 0.0::DOUBLE, '', line FROM (
      SELECT brand, category, unnest([0, 1, 2]) AS part, unnest([
        chr(10) || '### ' || brand || ' Presence', '- Products listed: ' || own,
        '- Platforms present: ' || platforms]) AS line FROM facts WHERE own > 0)
    {_section(2, ["chr(10) || '### ' || brand || ' Product Prices'"], "own_prices",
              f"'- ' || name || ' (' || platform || ')' || {_MONEY} || CASE WHEN in_stock THEN ' [In Stock]' ELSE ' [OOS]' END",
              "id", "''")}
    {_section(3, ["chr(10) || '### Competitor Products & Prices (full sample)'"], "rivals",
              f"'- ' || name || ' by ' || coalesce(rival, 'None') || ' (' || platform || ')' || {_MONEY}",
              "id", "''")}
    {_section(4, ["chr(10) || '### ' || brand || ' Cross-Platform Availability'"], "spread",
              "'- ' || canonical_name || ': ' || platforms", "id", "''")}
    {_section(5, ["chr(10) || '### ' || brand || ' Sales Velocity (Blinkit inventory delta)'",
                  "'*" + R.SALES_NOTE + "*'"], "sold",
              "'- ' || name || ' (' || platform || '): ' || total_units || ' units sold (avg ' "
              "|| CAST(round(avg_per_pincode, 1) AS VARCHAR) || '/pincode across ' || pincode_count "
              "|| ' pincodes, ' || restocks || ' restocks)'",
              "-total_units", "lpad(CAST(catalog_id AS VARCHAR), 20, '0')")}
    {_section(6, ["chr(10) || '### Category Top Sellers (' || category || ')'"], "best_sold",
              "'- ' || name || ' by ' || coalesce(seller, 'None') || ' (' || platform || '): ' "
              "|| total_units || ' units'", "position", "''")}
  )"""


@query("report_text", f"SELECT * FROM ({_REPORT_SQL})")
def _(t: RetailTables) -> DataFrame:
    return R.report_lines(_report(t))
