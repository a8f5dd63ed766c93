"""Brand analytics for all brands and categories at once.

``priced`` is the catalog joined with the latest reading of each listing.  One
aggregation, ``brand_cube``, shrinks it to a row per (category, brand); shares,
ranks, discounts, platform mixes and scorecards are all computed from that.
A single brand or category is a filter on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PLATFORMS
from .stats import discount_pct, grouped_percentiles, join_groups, rank_levels, value_counts

HISTOGRAM_BINS = 8
TIER_PERCENTS = {"budget_threshold": 33.33, "premium_threshold": 66.67}


def brand_cube(priced: DataFrame) -> DataFrame:
    """Counts and sums per (category, brand); listings without brand form one row."""
    return priced.groupBy("category", "brand").agg(
        F.count(F.lit(1)).alias("sku_count"),
        F.count("price").alias("n_priced"),
        F.sum("price").alias("sum_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count(discount_pct()).alias("n_discounted"),
        F.sum(discount_pct()).alias("sum_discount"),
        *[F.count_if(F.col("platform") == p).alias(f"n_{p}") for p in PLATFORMS],
    )


def has_brand() -> Column:
    return F.coalesce(F.col("brand") != "", F.lit(False))


def branded(df: DataFrame) -> DataFrame:
    return df.where(has_brand())


def mean_or_zero(total: str | Column, n: str | Column) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    n = F.col(n) if isinstance(n, str) else n
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def platforms_present() -> Column:
    """Platforms with at least one SKU, in name order."""
    return F.filter(
        F.array(*[F.when(F.col(f"n_{p}") > 0, F.lit(p)) for p in sorted(PLATFORMS)]),
        lambda p: p.isNotNull(),
    )


def category_totals(cube: DataFrame) -> DataFrame:
    """Category level of the cube, listings without brand included."""
    return cube.groupBy("category").agg(
        F.sum("sku_count").alias("category_total"),
        F.count_if(has_brand()).alias("total_brands"),
        F.sum("n_priced").alias("cat_n_priced"),
        F.sum("sum_price").alias("cat_sum_price"),
        F.min("min_price").alias("cat_min_price"),
        F.max("max_price").alias("cat_max_price"),
        F.sum("n_discounted").alias("cat_n_discounted"),
        F.sum("sum_discount").alias("cat_sum_discount"),
        F.sum(F.when(has_brand(), F.col("n_discounted"))).alias("cat_branded_n_discounted"),
        F.sum(F.when(has_brand(), F.col("sum_discount"))).alias("cat_branded_sum_discount"),
    )


def brand_share(cube: DataFrame) -> DataFrame:
    """SKU count, share of the category and rank per brand.

    Takes the cube, or any (category, brand, sku_count).  Listings without a
    brand count in the total and are not ranked; a brand that is absent from a
    category would rank last, one behind ``total_brands``.
    """
    totals = cube.groupBy("category").agg(
        F.sum("sku_count").alias("category_total"), F.count_if(has_brand()).alias("total_brands")
    )
    ranks = rank_levels(branded(cube), "category", "sku_count")
    own = branded(cube).select("category", "brand", "sku_count")
    ranked = join_groups(own, ranks.join(totals, "category"), ["category", "sku_count"])
    return ranked.withColumn("share_pct", F.col("sku_count") / F.col("category_total") * 100)


def competitors(cube: DataFrame, target: str | None = None) -> DataFrame:
    """Brands of each category with their SKU count; ``target`` is flagged."""
    is_target = F.col("brand") == target if target is not None else F.lit(False)
    return branded(cube).select("category", "brand", "sku_count", is_target.alias("is_target"))


def price_histogram(priced: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """SKUs per equal-width price bin of the category, one column per bin.

    A category whose prices are all equal gets zeros, as does a brand without
    prices.  ``brand`` null stands for listings without brand.
    """
    points = value_counts(priced, ["category", "brand"], "price")
    span = points.groupBy("category").agg(
        F.min("price").alias("cat_min"), F.max("price").alias("cat_max")
    )
    width = (F.col("cat_max") - F.col("cat_min")) / bins
    bin_no = F.when(
        width > 0, F.least(F.floor((F.col("price") - F.col("cat_min")) / width), F.lit(bins - 1))
    )
    brands = priced.where(F.col("price").isNull()).select("category", "brand").distinct()
    listed = brands.join(span.where(F.col("cat_min").isNotNull()).select("category"), "category", "left_semi")
    unpriced = listed.withColumns({"price": F.lit(None).cast("double"), "n": F.lit(0).cast("bigint")})
    return (
        join_groups(points.select("category", "brand", "price", "n").unionByName(unpriced), span, ["category"])
        .withColumn("_bin", bin_no)
        .groupBy("category", "brand", "cat_min", "cat_max")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("n"))), F.lit(0)).alias(f"bin{i}")
                for i in range(bins)
            ]
        )
    )


def category_histogram(histogram: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histogram.groupBy("category", "cat_min", "cat_max").agg(
        *[F.sum(f"bin{i}").alias(f"bin{i}") for i in range(bins)]
    )


def histogram_labels(bins: int = HISTOGRAM_BINS) -> Column:
    """Text of the bins from ``cat_min`` and ``cat_max``, whole rupees, half to even."""
    same = F.col("cat_min") == F.col("cat_max")
    width = F.when(same, F.lit(1.0)).otherwise((F.col("cat_max") - F.col("cat_min")) / bins)

    def rupees(c: Column) -> Column:
        return F.format_string("%.0f", F.bround(c, 0))

    return F.array(
        *[
            F.concat(
                F.lit("₹"), rupees(F.col("cat_min") + i * width),
                F.lit("–"), rupees(F.col("cat_min") + (i + 1) * width),
            )
            for i in range(bins)
        ]
    )


def mrp_tiers(priced: DataFrame) -> DataFrame:
    """SKUs per MRP tier of the category, split at its exact tertiles."""
    points = value_counts(priced, ["category", "brand"], "mrp")
    cuts = grouped_percentiles(
        points.groupBy("category", "mrp").agg(F.sum("n").alias("n")), "category", "mrp", TIER_PERCENTS
    )
    mrp, low, high = F.col("mrp"), F.col("budget_threshold"), F.col("premium_threshold")

    def tier(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)

    brands = priced.where(F.col("mrp").isNull()).select("category", "brand").distinct()
    listed = brands.join(cuts.select("category"), "category", "left_semi")
    unknown = listed.withColumns({"mrp": F.lit(None).cast("double"), "n": F.lit(0).cast("bigint")})
    return (
        join_groups(points.select("category", "brand", "mrp", "n").unionByName(unknown), cuts, ["category"])
        .groupBy("category", "brand", "budget_threshold", "premium_threshold")
        .agg(
            tier(mrp <= low, "budget"),
            tier((mrp > low) & (mrp <= high), "mid"),
            tier(mrp > high, "premium"),
        )
    )


def avg_discount(cube: DataFrame) -> DataFrame:
    """Mean discount of the discounted SKUs per brand, next to the category's."""
    totals = category_totals(cube).select(
        "category", mean_or_zero("cat_sum_discount", "cat_n_discounted").alias("category_avg")
    )
    own = branded(cube).select(
        "category", "brand", mean_or_zero("sum_discount", "n_discounted").alias("brand_avg")
    )
    return join_groups(own, totals, ["category"])


def platform_mix(cube: DataFrame) -> DataFrame:
    return branded(cube).select(
        "category", "brand", *[f"n_{p}" for p in PLATFORMS], F.col("sku_count").alias("total")
    )


def cross_platform_count(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """Clusters in which a brand is on two or more platforms, per (brand, category)."""
    members = mappings.join(
        catalog.select(F.col("id").alias("catalog_id"), "brand", "category", "platform"), "catalog_id"
    ).where(F.col("brand").isNotNull())
    on_platform = [F.max((F.col("platform") == p).cast("int")) for p in PLATFORMS]
    spread = members.groupBy("brand", "category", "canonical_id").agg(
        sum(on_platform[1:], on_platform[0]).alias("n_platforms")
    )
    return spread.groupBy("brand", "category").agg(
        F.count_if(F.col("n_platforms") >= 2).alias("cross_platform_count")
    )


PLATFORM_PAIRS = tuple(
    (a, b) for i, a in enumerate(PLATFORMS) for b in PLATFORMS[i + 1 :]
)


def price_parity(
    canonicals: DataFrame,
    mappings: DataFrame,
    latest: DataFrame,
    catalog: DataFrame,
    pairs=PLATFORM_PAIRS[:1],
) -> DataFrame:
    """Price gap of a cluster between two platforms; gaps that round to 0.00 drop out.

    Several listings of one platform count with their highest price.
    """
    members = (
        mappings.select("catalog_id", "canonical_id")
        .join(catalog.select(F.col("id").alias("catalog_id"), "platform"), "catalog_id")
        .join(latest.select("catalog_id", "price"), "catalog_id")
    )
    prices = members.groupBy("canonical_id").agg(
        *[F.max(F.when(F.col("platform") == p, F.col("price"))).alias(p) for p in PLATFORMS]
    )
    sides = F.array(
        *[
            F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("price_a"), F.col(b).alias("price_b"))
            for a, b in pairs
        ]
    )
    delta = F.col("price_a") - F.col("price_b")
    heads = canonicals.select(
        F.col("id").alias("canonical_id"), "canonical_name", "brand", "category"
    )
    return (
        prices.select("canonical_id", F.inline(sides))
        .where(F.abs(delta) >= 0.005)
        .withColumn("delta", delta)
        .withColumn(
            "delta_pct", F.abs(delta) / F.greatest("price_a", "price_b") * 100
        )
        .join(heads, "canonical_id")
    )


def canonical_competitors(
    catalog: DataFrame, mappings: DataFrame, targets: DataFrame
) -> DataFrame:
    """Other brands that share a cluster with a target brand.

    ``targets``: brand, category - the brands asked for.  Each cluster is first
    reduced to its distinct brands; those of a target's clusters are then listed,
    so the work grows with clusters x targets in them, never with listing pairs.
    """
    members = mappings.select("catalog_id", "canonical_id").join(
        catalog.select(F.col("id").alias("catalog_id"), "brand", "category"), "catalog_id"
    ).where(F.col("brand").isNotNull())
    own = (
        members.select("canonical_id", "brand", "category")
        .distinct()
        .join(targets.select("brand", "category"), ["brand", "category"], "left_semi")
    )
    present = members.select("canonical_id", F.col("brand").alias("competitor")).distinct()
    return (
        own.join(present, "canonical_id")
        .where(F.col("competitor") != F.col("brand"))
        .select("brand", "category", "competitor")
        .distinct()
    )


def brand_scorecard(cube: DataFrame) -> DataFrame:
    """Brand over all categories."""
    return (
        branded(cube)
        .groupBy("brand")
        .agg(
            F.sum("sku_count").alias("total_skus"),
            F.count(F.lit(1)).alias("category_count"),
            *[F.sum(f"n_{p}").alias(f"n_{p}") for p in PLATFORMS],
            mean_or_zero(F.sum("sum_discount"), F.sum("n_discounted")).alias("avg_discount_pct"),
            F.coalesce(F.min("min_price"), F.lit(0.0)).alias("price_min"),
            F.coalesce(F.max("max_price"), F.lit(0.0)).alias("price_max"),
        )
        .withColumn("platform_count", F.size(platforms_present()))
    )


def scorecard_by_category(cube: DataFrame) -> DataFrame:
    """Brand per category, against the category's averages."""
    totals = category_totals(cube).select(
        "category",
        mean_or_zero("cat_sum_price", "cat_n_priced").alias("category_avg_price"),
        mean_or_zero("cat_sum_discount", "cat_n_discounted").alias("category_avg_discount_pct"),
    )
    own = branded(cube).select(
        "category",
        "brand",
        platforms_present().alias("platforms"),
        F.array_except(
            F.array(*[F.lit(p) for p in sorted(PLATFORMS)]), platforms_present()
        ).alias("missing_platforms"),
        mean_or_zero("sum_price", "n_priced").alias("avg_price"),
        mean_or_zero("sum_discount", "n_discounted").alias("avg_discount_pct"),
    )
    return join_groups(brand_share(cube).join(own, ["category", "brand"]), totals, ["category"])


def distribution_gaps(
    canonicals: DataFrame, mappings: DataFrame, catalog: DataFrame, latest: DataFrame
) -> DataFrame:
    """Product x platform presence and price, per brand and category.

    Products are the canonical names of the brand plus its unmapped listings by
    name; where the brand has no canonical in the category, all its listings
    count.  Equal names merge, the highest listing id gives a platform's price.
    """
    prices = latest.select("catalog_id", "price")
    heads = canonicals.select(
        F.col("id").alias("canonical_id"), F.col("canonical_name").alias("product_name"),
        "brand", "category",
    )
    links = mappings.select("catalog_id", "canonical_id")
    canonical_side = (
        links.join(heads, "canonical_id")
        .join(catalog.select(F.col("id").alias("catalog_id"), "platform"), "catalog_id")
        .select("brand", "category", "product_name", "platform", "catalog_id")
        .where(F.col("brand").isNotNull())
    )
    covered = canonical_side.select("brand", "category").distinct().withColumn("_covered", F.lit(True))
    listing_side = (
        catalog.where(F.col("brand").isNotNull())
        .select("brand", "category", F.col("name").alias("product_name"), "platform",
                F.col("id").alias("catalog_id"))
        .join(links.select("catalog_id").withColumn("_mapped", F.lit(True)), "catalog_id", "left")
    )
    listing_side = (
        join_groups(listing_side, covered, ["brand", "category"], "left")
        .where(F.col("_mapped").isNull() | F.col("_covered").isNull())
        .drop("_mapped", "_covered")
    )
    rows = canonical_side.unionByName(listing_side).join(prices, "catalog_id", "left")

    def on(platform: str, value: str) -> Column:
        return F.when(F.col("platform") == platform, F.col(value))

    matrix = rows.groupBy("brand", "category", "product_name").agg(
        *[F.max_by("price", on(p, "catalog_id")).alias(f"{p}_price") for p in PLATFORMS],
        *[(F.count(on(p, "catalog_id")) > 0).alias(f"{p}_present") for p in PLATFORMS],
    )
    absent = [(~F.col(f"{p}_present")).cast("int") for p in PLATFORMS]
    return matrix.withColumn("gap_count", sum(absent[1:], absent[0]))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("brand", "category").agg(
        F.count(F.lit(1)).alias("total_products"),
        *[
            F.count_if(F.col("gap_count") == n).alias(name)
            for n, name in ((0, "on_all"), (1, "on_two"), (2, "on_one"))
        ],
        *[F.count_if(~F.col(f"{p}_present")).alias(f"gaps_{p}") for p in PLATFORMS],
    )


def discount_battle(cube: DataFrame) -> DataFrame:
    """Mean discount and share of discounted SKUs per brand; the category mean
    covers branded listings only."""
    totals = category_totals(cube).select(
        "category",
        mean_or_zero("cat_branded_sum_discount", "cat_branded_n_discounted").alias(
            "category_avg_discount"
        ),
    )
    own = branded(cube).select(
        "category",
        "brand",
        mean_or_zero("sum_discount", "n_discounted").alias("avg_discount_pct"),
        (F.col("n_discounted") / F.col("sku_count") * 100).alias("discounted_sku_pct"),
        "sku_count",
    )
    return join_groups(own, totals, ["category"])


def platform_heatmap(cube: DataFrame) -> DataFrame:
    """Brand x category counts per platform with their intensity bucket.

    Buckets compare a count with the brand's largest category.
    """
    largest = branded(cube).groupBy("brand").agg(F.max("sku_count").alias("_max"))

    def bucket(platform: str) -> Column:
        ratio = F.col(f"n_{platform}") / F.col("_max")
        return (
            F.when(F.col(f"n_{platform}") == 0, F.lit("none"))
            .when(ratio > 0.7, F.lit("high"))
            .when(ratio > 0.3, F.lit("medium"))
            .otherwise(F.lit("low"))
            .alias(f"intensity_{platform}")
        )

    return (
        branded(cube)
        .join(largest, "brand")
        .select(
            "brand", "category", *[f"n_{p}" for p in PLATFORMS],
            F.col("sku_count").alias("total"), *[bucket(p) for p in PLATFORMS],
        )
    )
