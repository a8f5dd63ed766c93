"""Scalar column functions: pure JVM expressions, no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words and their factor to the base unit (ml, g).
VOLUME_FACTORS = {
    "ml": 1.0,
    "l": 1000.0,
    "ltr": 1000.0,
    "litre": 1000.0,
    "liter": 1000.0,
    "litres": 1000.0,
    "liters": 1000.0,
}
WEIGHT_FACTORS = {
    "g": 1.0,
    "gm": 1.0,
    "gms": 1.0,
    "gram": 1.0,
    "grams": 1.0,
    "kg": 1000.0,
    "kgs": 1000.0,
}
PIECE_WORDS = ("pcs", "pc", "piece", "pieces", "pack", "packs", "unit", "units", "nos", "no")
DOZEN_WORD = "dozen"

_SIZE = r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]+)"
_PAREN_SIZE = r"\(\s*" + _SIZE + r"\s*\)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """Null for null or empty text, so ``coalesce`` skips both."""
    return F.nullif(_col(c), F.lit(""))


def truthy_num(c) -> Column:
    """Null for null or zero, so ``coalesce`` skips both."""
    return F.nullif(_col(c), F.lit(0).cast("double"))


def _unit_specs() -> Column:
    """Unit word -> (factor, suffix, suffix of whole thousands)."""
    rows = [(w, f, "ml", "l") for w, f in VOLUME_FACTORS.items()]
    rows += [(w, f, "g", "kg") for w, f in WEIGHT_FACTORS.items()]
    rows += [(w, 1.0, "pcs", None) for w in PIECE_WORDS] + [(DOZEN_WORD, 1.0, "dozen", None)]
    return F.create_map(
        *[
            part
            for word, factor, small, large in rows
            for part in (
                F.lit(word),
                F.struct(
                    F.lit(factor).alias("factor"),
                    F.lit(small).alias("small"),
                    F.lit(large).cast("string").alias("large"),
                ),
            )
        ]
    )


def normalize_unit(unit) -> Column:
    """Pack size in a standard form (``0.5 kg`` -> ``500g``), null when it has none."""
    text = F.lower(_col(unit))

    def group(i: int) -> Column:
        in_paren = F.nullif(F.regexp_extract(text, _PAREN_SIZE, i), F.lit(""))
        return F.coalesce(in_paren, F.regexp_extract(text, _SIZE, i))

    def written(size: Column) -> Column:
        amount, whole = size["amount"], size["amount"].cast("bigint")
        # Plain notation for any size; Spark writes large doubles with an exponent.
        plain = F.regexp_replace(amount.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        number = (
            F.when(amount == whole, whole.cast("string"))
            .when((amount >= 1e-3) & (amount < 1e7), amount.cast("string"))
            .otherwise(plain)
        )
        thousands = size["spec"]["large"].isNotNull() & (amount >= 1000) & (amount % 1000 == 0)
        return F.when(
            thousands, F.concat((amount / 1000).cast("bigint").cast("string"), size["spec"]["large"])
        ).otherwise(F.concat(number, size["spec"]["small"]))

    spec = F.try_element_at(_unit_specs(), group(2))
    # The lambda names the parsed size, so its pieces are computed once per row
    # instead of once per mention.
    size = F.struct((group(1).try_cast("double") * spec["factor"]).alias("amount"), spec.alias("spec"))
    return F.get(F.transform(F.array(size), written), 0)


def compose_text(brand, name, unit, keep_raw_unit: bool = False) -> Column:
    """``brand name unit`` with absent parts skipped.

    An unparseable unit is dropped, or kept as written with ``keep_raw_unit``.
    """
    size = normalize_unit(unit)
    if keep_raw_unit:
        size = F.coalesce(size, truthy(unit))
    return F.concat_ws(" ", truthy(brand), _col(name), size)


def stable_listing_id(platform, name, unit) -> Column:
    """Content id for listings that come without one."""
    key = F.concat(
        _col(platform),
        F.lit(":"),
        F.lower(F.trim(_col(name))),
        F.lit(":"),
        F.lower(F.trim(F.coalesce(_col(unit), F.lit("")))),
    )
    return F.substring(F.md5(key), 1, 16)


def tokens(text) -> Column:
    """Distinct lower-case whitespace tokens."""
    return F.array_distinct(F.array_remove(F.split(F.lower(_col(text)), r"\s+"), ""))


def token_jaccard(a, b) -> Column:
    """Share of common tokens; 0 when either side has none."""
    ta, tb = tokens(a), tokens(b)
    both_filled = (F.size(ta) > 0) & (F.size(tb) > 0)
    overlap = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return F.when(both_filled, overlap).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    """Cosine of two float arrays; a zero vector gives 0."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, zero, lambda acc, v: acc + v)

    a, b = _col(a), _col(b)
    eps = 1e-10
    return dot(a, b) / ((F.sqrt(dot(a, a)) + eps) * (F.sqrt(dot(b, b)) + eps))


def slugify(text) -> Column:
    """Lower-case name with every other run of characters turned into ``_``."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), F.lit("_"))
