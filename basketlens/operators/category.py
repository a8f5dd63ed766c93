"""Category analytics: landscape, price whitespace, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PLATFORMS
from .brand import branded, category_totals, has_brand, mean_or_zero, platforms_present
from .stats import join_groups, top_n, value_counts

BANDS = 10
# Upper limits of the price bands and their labels.
PRICE_BANDS = (
    (50, "₹0-50"), (100, "₹50-100"), (200, "₹100-200"), (500, "₹200-500"), (None, "₹500+"),
)
SPARSE_BRANDS, MODERATE_BRANDS = 3, 8


def landscape(cube: DataFrame) -> DataFrame:
    """Brand positions with the totals and price range of their category."""
    totals = category_totals(cube).select(
        "category",
        "total_brands",
        F.col("category_total").alias("total_skus"),
        F.coalesce("cat_min_price", F.lit(0.0)).alias("price_min"),
        F.coalesce("cat_max_price", F.lit(0.0)).alias("price_max"),
    )
    own = branded(cube).select(
        "category",
        "brand",
        "sku_count",
        mean_or_zero("sum_price", "n_priced").alias("avg_price"),
        mean_or_zero("sum_discount", "n_discounted").alias("avg_discount_pct"),
        platforms_present().alias("platforms"),
        F.size(platforms_present()).alias("platform_count"),
        F.greatest(F.sqrt("sku_count") * 5, F.lit(4.0)).alias("bubble_radius"),
    )
    return join_groups(own, totals, ["category"])


def _band(price: Column, low: Column, width: Column, bands: int) -> Column:
    """Band whose limits hold the price.

    The limits are low + i * width in floating point, so the quotient can be one
    off; one comparison on each side settles it without a range join.
    """
    guess = F.floor((price - low) / width)
    fixed = (
        F.when(price < low + guess * width, guess - 1)
        .when(price >= low + (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    return F.least(fixed, F.lit(bands - 1)).cast("int")


def whitespace(priced: DataFrame, bands: int = BANDS) -> DataFrame:
    """SKUs, brands, top three brands and density of equal price bands.

    The highest price always falls in the last band.
    """
    points = value_counts(priced, ["category", "brand"], "price")
    span = points.groupBy("category").agg(
        F.min("price").alias("low"), F.max("price").alias("high")
    ).withColumn(
        "width",
        F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bands).otherwise(1.0),
    )
    per_brand = (
        join_groups(points, span, ["category"])
        .withColumn("band", _band(F.col("price"), F.col("low"), F.col("width"), bands))
        .groupBy("category", "band", "brand")
        .agg(F.sum("n").alias("n"))
    )
    counts = per_brand.groupBy("category", "band").agg(
        F.sum("n").alias("sku_count"), F.count_if(has_brand()).alias("brand_count")
    )
    leaders = top_n(
        branded(per_brand), ["category", "band"], [F.desc("n"), F.col("brand")], 3, "_place"
    )
    top = leaders.groupBy("category", "band").agg(
        F.array_compact(
            F.array(*[F.max(F.when(F.col("_place") == i, F.col("brand"))) for i in (1, 2, 3)])
        ).alias("top_brands")
    )
    grid = span.select(
        "category", "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    )
    brands = F.coalesce("brand_count", F.lit(0))
    return (
        grid.join(counts, ["category", "band"], "left")
        .join(top, ["category", "band"], "left")
        .select(
            "category",
            "band",
            (F.col("low") + F.col("band") * F.col("width")).alias("band_low"),
            (F.col("low") + (F.col("band") + 1) * F.col("width")).alias("band_high"),
            F.coalesce("sku_count", F.lit(0)).alias("sku_count"),
            brands.alias("brand_count"),
            F.coalesce("top_brands", F.expr("CAST(array() AS array<string>)")).alias("top_brands"),
            F.when(brands <= SPARSE_BRANDS, "sparse")
            .when(brands <= MODERATE_BRANDS, "moderate")
            .otherwise("crowded")
            .alias("density"),
        )
    )


def opportunity_bands(bands: DataFrame) -> DataFrame:
    return bands.where(F.col("density") == "sparse")


def price_band_label(price: str = "price") -> Column:
    label = F.lit(PRICE_BANDS[-1][1])
    for limit, name in reversed(PRICE_BANDS[:-1]):
        label = F.when(F.col(price) < limit, F.lit(name)).otherwise(label)
    return label


def price_distribution(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """SKUs per fixed price band, a zero-filled column per platform.

    Every band shows up for a category that has any price at all.
    """
    rows = catalog.select(F.col("id").alias("catalog_id"), "category", "platform").join(
        latest.select("catalog_id", "price"), "catalog_id"
    )
    label = price_band_label()
    counted = rows.groupBy("category").agg(
        *[
            F.count_if((label == name) & (F.col("platform") == p)).alias(f"{i}_{p}")
            for i, (_limit, name) in enumerate(PRICE_BANDS)
            for p in PLATFORMS
        ]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.lit(name).alias("label"),
                *[F.col(f"{i}_{p}").alias(p) for p in PLATFORMS],
            )
            for i, (_limit, name) in enumerate(PRICE_BANDS)
        ]
    )
    return counted.select("category", F.inline(lines))


def platform_coverage(cube: DataFrame) -> DataFrame:
    """SKUs of a brand per platform, over all categories; only platforms it is on."""
    per_brand = branded(cube).groupBy("brand").agg(
        *[F.sum(f"n_{p}").alias(p) for p in PLATFORMS]
    )
    cells = F.array(
        *[F.struct(F.lit(p).alias("platform"), F.col(p).alias("cnt")) for p in PLATFORMS]
    )
    return per_brand.select("brand", F.inline(cells)).where(F.col("cnt") > 0)


def brand_share_top(cube: DataFrame, n: int = 10) -> DataFrame:
    """The n biggest brands per category, the rest summed up as ``Others``.

    ``Others`` is the category's total less its top brands, so only n rows per
    category are ever ordered.  Brands that are empty text count like any other.
    """
    named = cube.where(F.col("brand").isNotNull())
    top = top_n(
        named.select("category", F.col("brand").alias("label"), F.col("sku_count").alias("cnt")),
        ["category"], [F.desc("cnt"), F.col("label")], n, "place",
    )
    listed = top.groupBy("category").agg(F.sum("cnt").alias("listed"))
    others = (
        named.groupBy("category")
        .agg(F.sum("sku_count").alias("total"))
        .join(listed, "category")
        .select(
            "category",
            F.lit("Others").alias("label"),
            (F.col("total") - F.col("listed")).alias("cnt"),
            F.lit(n + 1).alias("place"),
        )
        .where(F.col("cnt") > 0)
    )
    return top.select("category", "label", "cnt", "place").unionByName(others)
