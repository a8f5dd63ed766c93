"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns ``names`` of ``row``, some replaced or added by ``new``."""
    row = F.col("row")
    kept = [new.get(c, row.getField(c)).alias(c) for c in names]
    return df.select(*kept, *[col.alias(c) for c, col in new.items() if c not in names])


def about(rows: DataFrame, wanted: int, *key: str) -> DataFrame:
    """About ``wanted`` of the rows, chosen by the hash of ``key``; all if there are fewer."""
    spot = F.pmod(F.xxhash64(*key, F.lit("about")), F.lit(1 << 30))
    share = min(1.0, wanted / max(1, rows.count()))
    return rows.where(spot < int(share * (1 << 30)))


def sample_by_label(
    labelled: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, more: tuple[str, ...] = ()
) -> DataFrame:
    """About ``rows`` rows of each label, chosen by the hash of the id."""
    usable = labelled.where(
        F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    )
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    share = {r[0]: rows / r[1] for r in usable.groupBy(label_col).count().collect()}
    wanted = F.lit(False)
    for label, part in share.items():
        wanted = wanted | ((F.col(label_col) == label) & (spot < int(min(part, 1.0) * (1 << 30))))
    return usable.where(wanted).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), *more
    )


def is_held_out(id_col: Column, parts: int, held: int) -> Column:
    """crc32 of the id's text, modulo ``parts``, equals ``held``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == held, F.lit(False))
