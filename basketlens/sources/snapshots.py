"""Accessibility-tree text snapshots -> listing rows.

A snapshot is one row; its lines stay an array inside that row and each marker
looks at a small slice of it.  No window, no exchange, any number of snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the two snapshot formats.
LINK_TEXT = r'link "(.+?)" \[ref='
LINK_PVID = r"/pvid/([a-f0-9-]+)"
LINK_AD_MARK = r"P[0-9]+\s*-\s*Ad\.png\s*"
LINK_NAME = r"^(.+?)\s+ADD\b"
LINK_DISCOUNT = r"₹[0-9]+(?:\.[0-9]+)?\s+OFF"
RUPEES = r"₹([0-9]+(?:\.[0-9]+)?)"
LINK_SIZE = (
    r"(?i)([0-9]+\s*(?:pack|pc|pcs|pieces?)\s*\([^)]+\)|[0-9]+\s*(?:ml|g|kg|l|ltr)\b)"
)
CARD_MARK = 'generic "Delivery in'
CARD_NAME = r"(?s)generic\s*[^\n:]*:\s*(.{5,})\s*$"
CARD_SIZE = (
    r"(?i)(?:text|generic[^\n:]*):?\s*([0-9.]+\s*(?:ml|g|kg|ltr?|pcs?|pack|piece|items?))\b"
)
CARD_RUPEES = r"₹\s*([0-9]+(?:\.[0-9]+)?)"
CARD_PRICE_RANGE = (5, 10000)

_STRIP = r"^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def _first(array: Column) -> Column:
    return F.get(array, 0)


def _line_numbers(lines: Column, is_marker) -> Column:
    numbered = F.transform(lines, lambda line, i: F.when(is_marker(line), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _numbered(df: DataFrame, id_col: str, found: Column, rank: str) -> DataFrame:
    return df.select(id_col, F.posexplode(found).alias(rank, "c"))


def snapshot_links(snapshots: DataFrame, id_col: str = "snapshot_id") -> DataFrame:
    """Product links: the ``/url: /pn/`` line and the link text in the 3 lines above."""
    lines = F.col("_lines")

    def link(i: Column) -> Column:
        start = F.greatest(i - 3, F.lit(0))
        above = F.transform(
            F.slice(lines, start + 1, i - start), lambda x: F.regexp_extract(x, LINK_TEXT, 1)
        )
        text = _first(F.filter(above, lambda x: x.contains("ADD") & x.contains("₹")))
        return F.struct(
            F.regexp_replace(text, LINK_AD_MARK, "").alias("text"),
            F.regexp_extract(F.get(lines, i), LINK_PVID, 1).alias("pvid"),
        )

    def parsed(c: Column) -> Column:
        amounts = F.regexp_extract_all(
            F.regexp_replace(c["text"], LINK_DISCOUNT, ""), F.lit(RUPEES), F.lit(1)
        )
        return F.struct(
            c["pvid"].alias("pvid"),
            _strip(F.regexp_extract(c["text"], LINK_NAME, 1)).alias("name"),
            F.transform(amounts, lambda p: p.cast("double")).alias("prices"),
            F.nullif(_strip(F.regexp_extract(c["text"], LINK_SIZE, 1)), F.lit("")).alias("size"),
        )

    candidates = F.filter(
        F.transform(_line_numbers(lines, lambda x: x.contains("/url: /pn/")), link),
        lambda c: c["text"].isNotNull(),
    )
    found = F.filter(
        F.transform(candidates, parsed),
        lambda c: (c["name"] != "") & (F.size(c["prices"]) > 0),
    )
    rows = _numbered(snapshots.withColumn("_lines", F.split("text", "\n")), id_col, found, "pos")
    fallback = F.concat(F.lit("z-"), (F.col("pos") + 1).cast("string"))
    return rows.select(
        id_col,
        "pos",
        F.coalesce(F.nullif("c.pvid", F.lit("")), fallback).alias("product_id"),
        F.col("c.name").alias("name"),
        F.lit(None).cast("string").alias("brand_name"),
        F.col("c.size").alias("unit_quantity"),
        _first(F.col("c.prices")).alias("discounted_price"),
        F.coalesce(F.get("c.prices", 1), _first(F.col("c.prices"))).alias("mrp"),
        F.lit(True).alias("in_stock"),
        F.lit(5).alias("max_cart_quantity"),
    )


def snapshot_cards(snapshots: DataFrame, id_col: str = "snapshot_id") -> DataFrame:
    """Product cards: delivery marker, a name within 5 lines, size and prices within 15."""
    lines = F.col("_lines")
    low, high = CARD_PRICE_RANGE

    def name_of(mark: Column) -> Column:
        near = F.transform(
            F.slice(lines, mark + 2, 5),
            lambda x, j: F.struct(
                (mark + 1 + j).alias("at"), _strip(F.regexp_extract(x, CARD_NAME, 1)).alias("name")
            ),
        )
        ok = F.filter(
            near,
            lambda c: (c["name"] != "")
            & ~c["name"].contains("MINS")
            & ~c["name"].contains("Delivery")
            & ~c["name"].startswith("₹")
            & ~c["name"].startswith("http")
            & ~c["name"].contains("OFF"),
        )
        return _first(ok)

    def parsed(c: Column) -> Column:
        window = F.slice(lines, c["at"] + 2, 15)
        priced = F.filter(
            F.transform(
                window,
                lambda x, k: F.struct(
                    k.alias("k"), F.regexp_extract(x, CARD_RUPEES, 1).try_cast("double").alias("v")
                ),
            ),
            lambda p: p["v"].between(low, high),
        )
        # The size is looked for up to the line that completes the price pair.
        last = F.coalesce(F.get(priced, 1)["k"], F.lit(14))
        sizes = F.filter(
            F.transform(F.slice(window, 1, last + 1), lambda x: F.regexp_extract(x, CARD_SIZE, 1)),
            lambda s: s != "",
        )
        return F.struct(
            c["name"].alias("name"),
            F.get(priced, 0)["v"].alias("price"),
            F.get(priced, 1)["v"].alias("mrp"),
            _strip(_first(sizes)).alias("size"),
        )

    marks = _line_numbers(lines, lambda x: x.contains(CARD_MARK) & x.contains("MINS"))
    named = F.filter(F.transform(marks, name_of), lambda c: c.isNotNull())
    found = F.filter(F.transform(named, parsed), lambda c: c["price"].isNotNull())
    rows = _numbered(snapshots.withColumn("_lines", F.split("text", "\n")), id_col, found, "pos")
    first_word = F.regexp_extract("c.name", r"^(\S+)\s+\S", 1)
    return rows.select(
        id_col,
        "pos",
        F.concat(F.lit("im-"), (F.col("pos") + 1).cast("string")).alias("id"),
        F.col("c.name").alias("name"),
        F.when(first_word.rlike(r"^\p{Lu}\p{L}*$"), first_word).alias("brand"),
        F.col("c.size").alias("packSize"),
        F.col("c.price").alias("price"),
        F.coalesce("c.mrp", "c.price").alias("totalPrice"),
        F.lit(True).alias("inStock"),
        F.lit(5).alias("maxSelectableQuantity"),
    )
