"""Skew-safe group statistics shared by the analytics operators.

One category may hold a third of all rows, so nothing here sorts a whole group in
one task: ranks come from counts of counts, percentiles from a histogram that
leaves only a sliver of the distinct values to be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discount_pct(price="price", mrp="mrp") -> Column:
    """Discount in percent, null unless mrp > 0 and the discount is positive."""
    pct = (F.col(mrp) - F.col(price)) / F.nullif(F.col(mrp), F.lit(0.0)) * 100
    return F.when((F.col(mrp) > 0) & (pct > 0), pct)


def rank_levels(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) -> ``rank``: 1 + number of rows with a larger value.

    Works on the distinct values of a group.  For row counts that add up to N
    there are at most sqrt(2N) of them, so the window stays small even for a
    group that owns most rows.
    """
    levels = counts.groupBy(group, value).agg(F.count(F.lit(1)).alias("_at"))
    above = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return levels.select(
        group, value, (F.coalesce(F.sum("_at").over(above), F.lit(0)) + 1).alias("rank")
    )


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, position: str) -> DataFrame:
    """First ``n`` rows per group.

    Spark turns ``row_number() <= n`` into a group limit that runs before the
    exchange as well, so each task ships at most n rows per group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


SALTS = 64


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per group, with hot groups split.

    A plain join would leave the rows partitioned by the group key, and Spark would
    keep that layout for the aggregation that follows: all of a hot group in one
    task.  So the rows carry a salt (a hash of the row, the same in every retry)
    and the one-row groups are repeated per salt.
    """
    hashable = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("_salt", salt)
    return salted.join(groups.withColumn("_salt", salts), [*keys, "_salt"], how).drop("_salt")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct non-null values with their multiplicity ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def grouped_percentiles(
    points: DataFrame, group: str, value: str, percents: dict[str, float], buckets: int = 1024
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry.

    ``points`` are distinct values with multiplicity ``n``.  A first pass counts
    them in ``buckets`` equal slices of the group's range and locates the slices
    that hold the wanted ranks; only the values of those slices are ordered.
    """
    span = points.groupBy(group).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("_total")
    )
    width = (F.col("_hi") - F.col("_lo")) / buckets
    slice_no = F.when(
        width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(buckets - 1))
    ).otherwise(F.lit(0))
    sliced = join_groups(points, span, [group]).withColumn("_slice", slice_no.cast("int"))

    before = (
        Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        sliced.groupBy(group, "_slice")
        .agg(F.sum("n").alias("_in"), F.first("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    )
    targets = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(p / 100) * (F.col("_total") - 1)).alias("at"))
            for name, p in percents.items()
        ]
    )
    wanted = F.filter(
        F.flatten(
            F.transform(
                targets,
                lambda t: F.array(
                    F.struct(t["name"].alias("name"), t["at"].alias("at"), F.floor(t["at"]).alias("rank")),
                    F.struct(
                        t["name"].alias("name"),
                        t["at"].alias("at"),
                        F.least(F.floor(t["at"]) + 1, F.col("_total") - 1).alias("rank"),
                    ),
                ),
            )
        ),
        lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_in")),
    )
    hit = slices.withColumn("_wanted", wanted).where(F.size("_wanted") > 0)

    inside = (
        Window.partitionBy(group, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    located = (
        sliced.select(group, "_slice", value, "n")
        .join(hit.select(group, "_slice", "_before", "_wanted"), [group, "_slice"])
        .withColumn("_from", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .select(group, value, "_from", "n", F.explode("_wanted").alias("t"))
        .where((F.col("t.rank") >= F.col("_from")) & (F.col("t.rank") < F.col("_from") + F.col("n")))
    )

    def interpolated(name: str) -> Column:
        mine = F.col("t.name") == name
        low, high = F.min(F.when(mine, F.col(value))), F.max(F.when(mine, F.col(value)))
        at = F.max(F.when(mine, F.col("t.at")))
        return (low + (at - F.floor(at)) * (high - low)).alias(name)

    return located.groupBy(group).agg(*[interpolated(name) for name in percents])
