"""Captured JSON payloads -> listing rows, with VARIANT and higher-order functions.

Everything here is a narrow transformation: a payload is walked inside its own
row, level by level, so no node is shuffled and no level is parsed twice.  Only
the de-duplication of product ids needs an exchange.

Object keys come out of a VARIANT in name order, so "first in walk order" means
first by (array index / key name), not by the key order of the source text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy

ZEPTO_IMAGE_BASE = "https://cdn.zeptonow.com/"
INSTAMART_IMAGE_BASE = "https://media-assets.swiggy.com/swiggy/image/upload/"

# Words that mark a stock-like field name.
INVENTORY_KEYWORDS = (
    "inventory", "stock", "quantity", "available", "sellable", "count", "remaining",
    "supply", "warehouse", "max_order", "maxorder", "maxqty", "sold", "units",
)

_NODE = "array<struct<pos:array<int>,path:string,v:variant>>"


# ---------------------------------------------------------------- variant access


def field(v: Column, path: str, kind: str) -> Column:
    """Typed field of a variant; null when absent or of another type."""
    return F.try_variant_get(v, f"$.{path}", kind)


def field_kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(field(v, path, "variant"))


def field_text(v: Column, path: str) -> Column:
    """Field as text, null when it is falsy (missing, null, '', 0, false)."""
    text = truthy(field(v, path, "string"))
    is_text = field_kind(v, path) == "STRING"
    falsy = ~is_text & (text.isin("false") | (text.try_cast("double") == 0))
    return F.when(~F.coalesce(falsy, F.lit(False)), text)


def field_number(v: Column, path: str) -> Column:
    """Field as a number, null when it is falsy."""
    return F.nullif(field(v, path, "double"), F.lit(0.0))


def has_field(v: Column, path: str) -> Column:
    """True when the key is there, even with a JSON null."""
    return field(v, path, "variant").isNotNull()


def is_true(v: Column, path: str) -> Column:
    """Truth value of a present field: false for null, false, 0 and ''."""
    kind = field_kind(v, path)
    return F.coalesce(
        F.when(kind == "BOOLEAN", field(v, path, "boolean")).when(
            kind != "VOID", field_text(v, path).isNotNull()
        ),
        F.lit(False),
    )


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


# ------------------------------------------------------------------------- walk


def nesting(payloads: DataFrame, payload: str = "payload") -> int:
    """Deepest nesting of any payload, from one pass over their text."""
    bare = F.regexp_replace(F.to_json(payload), r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    depth = F.aggregate(brackets, start, count)["most"]
    return payloads.agg(F.coalesce(F.max(depth), F.lit(0)).alias("depth")).first()["depth"]


def walk(
    payloads: DataFrame,
    keep: Callable[[Column], Column],
    *,
    payload: str = "payload",
    max_depth: int | None = None,
    stop: Callable[[Column], Column] | None = None,
    first_items: int | None = None,
) -> DataFrame:
    """Nodes of every payload for which ``keep(node)`` holds.

    Adds ``pos`` (position path, sorts in walk order), ``path``, ``depth`` and
    ``node``.  ``stop`` ends the descent below a node.  ``max_depth`` and
    ``first_items`` leave out what lies deeper or comes later in a list; without
    them everything is walked, as deep as the deepest payload of the input.
    """

    if max_depth is None:
        max_depth = nesting(payloads, payload)

    def child(parent: Column, i: Column, label: Column, value: Column) -> Column:
        return F.struct(
            F.concat(parent["pos"], F.array(i.cast("int"))).alias("pos"),
            label.alias("path"),
            value.alias("v"),
        )

    def children(parent: Column) -> Column:
        members = F.transform(
            F.map_entries(_as_map(parent["v"])),
            lambda e, i: child(
                parent,
                i,
                F.concat(
                    parent["path"],
                    F.when(parent["path"] == "", F.lit("")).otherwise(F.lit(".")),
                    e["key"],
                ),
                e["value"],
            ),
        )
        items = _as_array(parent["v"])
        if first_items is not None:
            items = F.slice(items, 1, first_items)
        items = F.transform(
            items,
            lambda x, i: child(
                parent, i, F.concat(parent["path"], F.lit("["), i.cast("string"), F.lit("]")), x
            ),
        )
        found = F.coalesce(members, items, F.expr(f"CAST(array() AS {_NODE})"))
        if stop is None:
            return found
        return F.when(stop(parent["v"]), F.expr(f"CAST(array() AS {_NODE})")).otherwise(found)

    root = F.struct(
        F.expr("CAST(array() AS array<int>)").alias("pos"),
        F.lit("").alias("path"),
        F.col(payload).alias("v"),
    )

    def hits_of(level: Column) -> Column:
        return F.filter(level, lambda n: F.coalesce(keep(n["v"]), F.lit(False)))

    # Only the hits so far and the current level travel on, not every level.
    out = payloads.withColumns(
        {"_level": F.array(root), "_hits": F.expr(f"CAST(array() AS {_NODE})")}
    ).drop(payload)
    for _ in range(max_depth):
        out = out.withColumns(
            {
                "_hits": F.concat("_hits", hits_of(F.col("_level"))),
                "_level": F.flatten(F.transform("_level", children)),
            }
        )
    last = F.col("_level")
    hits = F.concat(F.col("_hits"), hits_of(last))
    keep_columns = [c for c in payloads.columns if c != payload]
    return out.select(*keep_columns, F.explode(hits).alias("_n")).select(
        *keep_columns,
        F.col("_n.pos").alias("pos"),
        F.col("_n.path").alias("path"),
        F.size("_n.pos").alias("depth"),
        F.col("_n.v").alias("node"),
    )


def _first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``; map-side combined, so copies cost nothing."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def walk_cart_items(
    payloads: DataFrame,
    id_col: str = "payload_id",
    *,
    missing_means_available: bool = True,
    max_depth: int | None = None,
) -> DataFrame:
    """Objects holding ``cart_item.product_id``, one per product id and payload.

    ``missing_means_available`` is the reading of an absent
    ``unavailable_quantity``: True as in the direct-API form, False as in the
    in-page form.
    """
    hits = walk(
        payloads, lambda v: has_field(v, "cart_item.product_id"), max_depth=max_depth
    ).where(field_text(F.col("node"), "cart_item.product_id").isNotNull())
    item = F.try_variant_get("node", "$.cart_item", "variant")
    unavailable = field(item, "unavailable_quantity", "double")
    available = F.when(
        has_field(item, "unavailable_quantity"), F.coalesce(unavailable == 0, F.lit(False))
    ).otherwise(F.lit(missing_means_available))
    rows = hits.select(
        id_col,
        field_text(item, "product_id").alias("id"),
        "pos",
        F.coalesce(field_text(item, "product_name"), field(item, "display_name", "string"), F.lit(""))
        .alias("name"),
        field(item, "brand", "string").alias("brand"),
        field(item, "unit", "string").alias("unit"),
        F.coalesce(field(item, "price", "double"), F.lit(0.0)).alias("price"),
        field(item, "mrp", "double").alias("mrp"),
        F.when(field_kind(item, "inventory") == "BIGINT", field(item, "inventory", "int"))
        .alias("inventory"),
        field(item, "image_url", "string").alias("image_url"),
        available.alias("available"),
        F.coalesce(field(item, "quantity", "int"), F.lit(0)).alias("max_allowed_quantity"),
    )
    return _first_per(rows, [id_col, "id"], "pos")


def walk_bff_products(
    payloads: DataFrame, id_col: str = "payload_id", *, max_depth: int | None = None
) -> DataFrame:
    """Objects with ``availableQuantity``, ``mrp`` and ``product``; paise to rupees."""

    def wanted(v: Column) -> Column:
        return (
            has_field(v, "availableQuantity") & has_field(v, "mrp") & has_field(v, "product.name")
        )

    v = F.col("node")
    images = F.coalesce(
        F.when(F.size(field(v, "productVariant.images", "array<variant>")) > 0,
               field(v, "productVariant.images", "array<variant>")),
        field(v, "images", "array<variant>"),
        F.expr("CAST(array() AS array<variant>)"),
    )
    urls = F.transform(
        images,
        lambda i: F.when(
            is_object(i), F.concat(F.lit(ZEPTO_IMAGE_BASE), truthy(field(i, "path", "string")))
        ).when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")),
    )
    return (
        walk(payloads, wanted, max_depth=max_depth)
        .where(field_text(v, "product.name").isNotNull())
        .select(
            id_col,
            "pos",
            F.coalesce(field_text(v, "id"), field(v, "objectId", "string"), F.lit(""))
            .alias("product_id"),
            field(v, "product.name", "string").alias("name"),
            field(v, "product.brand", "string").alias("brand_name"),
            field(v, "productVariant.formattedPacksize", "string").alias("unit_quantity"),
            (F.coalesce(field(v, "discountedSellingPrice", "double"), F.lit(0.0)) / 100)
            .alias("discounted_price"),
            (F.coalesce(field(v, "mrp", "double"), F.lit(0.0)) / 100).alias("mrp"),
            (~is_true(v, "outOfStock")).alias("in_stock"),
            F.coalesce(field(v, "productVariant.maxAllowedQuantity", "int"), F.lit(0))
            .alias("max_cart_quantity"),
            field(v, "availableQuantity", "int").alias("quantity"),
            F.filter(urls, lambda u: u.isNotNull()).alias("images"),
        )
    )


def _variants(v: Column, path: str) -> Column:
    return F.coalesce(field(v, path, "array<variant>"), F.expr("CAST(array() AS array<variant>)"))


def _pos(*columns: str) -> Column:
    return F.array(*[F.col(c) for c in columns]).alias("pos")


def cards_products(payloads: DataFrame, id_col: str = "payload_id") -> DataFrame:
    """``data.cards[]`` shape: one row per variation (SKU)."""
    variations = (
        payloads.select(id_col, F.posexplode(_variants(F.col("payload"), "data.cards")).alias("c", "card"))
        .select(
            id_col, "c",
            F.posexplode(
                _variants(F.col("card"), "card.card.gridElements.infoWithStyle.items")
            ).alias("i", "item"),
        )
        .select(id_col, "c", "i", "item", F.posexplode(_variants(F.col("item"), "variations")).alias("k", "v"))
    )
    v, item = F.col("v"), F.col("item")
    price = F.coalesce(
        field_number(v, "price.offerPrice.units"),
        field_number(v, "price.offerPrice.amount"),
        F.lit(0.0),
    )
    image_ids = _variants(v, "imageIds")
    first_image = F.try_variant_get(F.get(image_ids, 0), "$", "string")
    return variations.where(field_text(v, "displayName").isNotNull()).select(
        id_col,
        _pos("c", "i", "k"),
        F.coalesce(
            field_text(item, "productId"), field_text(v, "skuId"), field_text(v, "spinId"), F.lit("")
        ).alias("id"),
        field(v, "displayName", "string").alias("name"),
        field(v, "brandName", "string").alias("brand"),
        field(v, "subCategoryType", "string").alias("subcategory"),
        field(v, "quantityDescription", "string").alias("packSize"),
        price.alias("price"),
        F.coalesce(field_number(v, "price.mrp.units"), field_number(v, "price.mrp.amount"), price)
        .alias("totalPrice"),
        F.coalesce(field(v, "inventory.inStock", "boolean"), F.lit(True)).alias("inStock"),
        F.coalesce(field(v, "cartAllowedQuantity.allowedQuantity", "int"), F.lit(0))
        .alias("maxSelectableQuantity"),
        F.concat(F.lit(INSTAMART_IMAGE_BASE), first_image).alias("image_url"),
    )


def widgets_products(payloads: DataFrame, id_col: str = "payload_id") -> DataFrame:
    """Older ``data.widgets[]`` shape, for payloads without any cards product.

    Whether the newer shape yields a product is read from the payload itself, so
    the fallback needs no join back to the other extractor.
    """
    names = F.flatten(F.transform(
        _variants(F.col("payload"), "data.cards"),
        lambda c: F.flatten(F.transform(
            _variants(c, "card.card.gridElements.infoWithStyle.items"),
            lambda i: F.transform(_variants(i, "variations"), lambda v: field_text(v, "displayName")),
        )),
    ))
    no_cards = ~F.exists(names, lambda n: n.isNotNull())
    def product(entry: Column) -> Column:
        return F.when(has_field(entry, "product"), field(entry, "product", "variant")).otherwise(entry)

    def product_name(p: Column) -> Column:
        return F.coalesce(field_text(p, "name"), field_text(p, "display_name"))

    products = F.flatten(
        F.transform(
            _variants(F.col("payload"), "data.widgets"),
            lambda w: F.transform(F.filter(_variants(w, "data.products"), is_object), product),
        )
    )
    entries = payloads.where(no_cards).select(
        id_col,
        F.posexplode(F.filter(products, lambda p: product_name(p).isNotNull())).alias("k", "p"),
    )
    p = F.col("p")
    price = F.coalesce(
        field_number(p, "pricing.offer_price"), field_number(p, "pricing.price"), F.lit(0.0)
    )
    first_image = F.try_variant_get(F.get(_variants(p, "images"), 0), "$", "string")
    rows = entries.select(
        id_col,
        _pos("k"),
        F.coalesce(
            field_text(p, "id"),
            field_text(p, "product_id"),
            F.concat(F.lit("im-"), (F.col("k") + 1).cast("string")),
        ).alias("id"),
        product_name(p).alias("name"),
        field(p, "brand_name", "string").alias("brand"),
        field(p, "category.name", "string").alias("subcategory"),
        F.coalesce(field_text(p, "weight"), field_text(p, "packSize")).alias("packSize"),
        price.alias("price"),
        F.coalesce(field_number(p, "pricing.mrp"), price).alias("totalPrice"),
        F.coalesce(field(p, "in_stock", "boolean"), F.lit(True)).alias("inStock"),
        F.coalesce(field(p, "max_selectable_quantity", "int"), F.lit(0)).alias("maxSelectableQuantity"),
        F.coalesce(field_text(p, "image_url"), first_image).alias("image_url"),
    )
    return rows


def instamart_products(payloads: DataFrame, id_col: str = "payload_id") -> DataFrame:
    """Cards products, or the older widgets shape for payloads that have none."""
    return cards_products(payloads, id_col).unionByName(widgets_products(payloads, id_col))


# ------------------------------------------------------------------ payload scans


def product_scan(payloads: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """Objects with a name key and a price or id key; matches are not entered."""

    def any_key(v: Column, *names: str) -> Column:
        found = F.lit(False)
        for name in names:
            found = found | has_field(v, name)
        return found

    def matches(v: Column) -> Column:
        return any_key(v, "name", "product_name", "display_name") & any_key(
            v, "mrp", "price", "discounted_price", "product_id", "id"
        )

    return walk(payloads, matches, stop=matches, max_depth=max_depth)


def _scan_name(path: Column) -> Column:
    """Last key of a path, lower-case, ``-`` and blanks as ``_``."""
    last = F.regexp_extract(path, r"([^.\[\]]+)$", 1)
    return F.regexp_replace(F.lower(last), "[- ]", "_")


def field_scan(
    payloads: DataFrame, *, max_depth: int | None = None, first_items: int | None = None
) -> DataFrame:
    """Distinct (path, value, type) of every key that looks like a stock field."""
    nodes = walk(
        payloads,
        lambda v: F.lit(True),
        max_depth=max_depth,
        first_items=first_items,
    )
    hit = _scan_name(F.col("path")).rlike("|".join(INVENTORY_KEYWORDS))
    keys = [c for c in payloads.columns if c != "payload"]
    return (
        nodes.where((F.col("depth") > 0) & ~F.col("path").endswith("]") & hit)
        .select(
            *keys,
            "path",
            F.to_json("node").alias("value"),
            value_kind(F.col("node")).alias("type"),
        )
        .distinct()
    )


def structure(
    payloads: DataFrame, *, max_depth: int | None = None, first_items: int | None = None
) -> DataFrame:
    """Profile over all payloads: path -> kind, occurrences and largest size.

    Entries of a list have paths of their own; ``first_items=1`` lets its first
    entry stand for all.  ``max_depth`` counts keys, not list levels.
    """
    deepest = None if max_depth is None else 2 * max_depth
    nodes = walk(payloads, lambda v: F.lit(True), max_depth=deepest, first_items=first_items)
    if max_depth is not None:
        keys = F.split(F.regexp_replace("path", r"\[[0-9]+\]", ""), r"\.")
        nodes = nodes.where(F.size(keys) <= max_depth)
    v = F.col("node")
    return (
        nodes.where(F.col("depth") > 0)
        .select(
            "path",
            value_kind(v).alias("type"),
            F.coalesce(F.size(_as_array(v)), F.size(F.map_keys(_as_map(v)))).alias("size"),
        )
        .groupBy("path", "type")
        .agg(F.count(F.lit(1)).alias("count"), F.max("size").alias("max_size"))
    )


def value_kind(v: Column) -> Column:
    """object, array, or the plain type of a value, without precision."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise(F.regexp_replace(kind, r"\(.*\)", ""))
    )
