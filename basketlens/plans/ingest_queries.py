"""Payload, snapshot and file queries; the captures are assembled from the part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stable_listing_id
from ..operators import tables as W
from ..schemas import CATALOG, OBSERVATION, PLATFORMS
from ..session import shared_dir
from ..sources import files, listings, payloads, snapshots
from .bindings import SEED_PINCODES, RetailTables, pick, r6
from .registry import query

P = F.col


def _capture(t: RetailTables, doc: Column) -> DataFrame:
    """One payload per part, as text turned into a VARIANT."""
    return t.spread("part", "p_partkey").select(
        P("p_partkey").alias("payload_id"), F.parse_json(F.to_json(doc)).alias("payload")
    )


def _named(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


# ------------------------------------------------------------------- cart items


def _cart_item(i: int, **extra: Column) -> Column:
    return _named(
        cart_item=_named(
            product_id=P("p_partkey") * 3 + i,
            brand=P("p_brand"),
            unit=F.concat(P("p_size").cast("string"), F.lit(" g")),
            price=P("p_retailprice") + i,
            mrp=P("p_retailprice") + 10,
            quantity=P("p_size") % 5,
            **extra,
        )
    )


def _cart_payloads(t: RetailTables) -> DataFrame:
    first = _cart_item(
        0, product_name=P("p_name"), inventory=P("p_size"), unavailable_quantity=P("p_partkey") % 2
    )
    second = _cart_item(1, display_name=P("p_name"), inventory=F.lit("many"))
    repeat = _cart_item(
        0, product_name=F.lit("repetition"), inventory=F.lit(0), unavailable_quantity=F.lit(9)
    )
    deep = _named(data=_named(inner=_named(leaf=second)))
    doc = _named(
        status=F.lit("ok"),
        snippets=F.array(
            F.to_json(_named(data=first)), F.to_json(deep), F.to_json(_named(more=F.array(repeat)))
        ),
    )
    # The entries differ in shape, so they are put together as text.
    text = F.concat(
        F.lit('{"status":"ok","response":{"snippets":['), F.array_join(doc["snippets"], ","), F.lit("]}}")
    )
    parts = t.spread("part", "p_partkey")
    return parts.select(P("p_partkey").alias("payload_id"), F.parse_json(text).alias("payload"))


@query(
    "ingest_walk_cart_items",
    """SELECT p_partkey AS payload_id, CAST(p_partkey * 3 + i AS VARCHAR) AS id, p_name AS name,
              p_brand AS brand, CAST(p_size AS VARCHAR) || ' g' AS unit, p_retailprice + i AS price,
              p_retailprice + 10 AS mrp, CASE WHEN i = 0 THEN CAST(p_size AS INTEGER) END AS inventory,
              CASE WHEN i = 0 THEN p_partkey % 2 = 0 ELSE true END AS available,
              CAST(p_size % 5 AS INTEGER) AS max_allowed_quantity
       FROM part, (VALUES (0), (1)) s(i) WHERE p_partkey * 3 + i <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    return payloads.walk_cart_items(_cart_payloads(t)).drop("pos", "image_url")


@query(
    "ingest_walk_deep_payloads",
    "SELECT p_partkey AS payload_id, CAST(p_partkey + 1 AS VARCHAR) AS id, p_name AS name FROM part",
)
def _(t: RetailTables) -> DataFrame:
    item = F.to_json(
        _named(cart_item=_named(product_id=P("p_partkey") + 1, product_name=P("p_name")))
    )
    levels = F.lit(15) + P("p_partkey") % 10
    text = F.concat(F.repeat(F.lit('{"a":['), levels), item, F.repeat(F.lit("]}"), levels))
    deep = t.spread("part", "p_partkey").select(P("p_partkey").alias("payload_id"), F.parse_json(text).alias("payload"))
    return payloads.walk_cart_items(deep).select("payload_id", "id", "name")


@query(
    "ingest_walk_cart_items_in_page",
    """SELECT p_partkey AS payload_id, CAST(p_partkey * 3 + i AS VARCHAR) AS id,
              i = 0 AND p_partkey % 2 = 0 AS available FROM part, (VALUES (0), (1)) s(i)
       WHERE p_partkey * 3 + i <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    rows = payloads.walk_cart_items(_cart_payloads(t), missing_means_available=False)
    return rows.select("payload_id", "id", "available")


@query(
    "payload_product_scan",
    """SELECT p_partkey AS payload_id, path, p_partkey * 3 + i AS product_id
       FROM part, (VALUES (0, 'response.snippets[0].data.cart_item'),
                          (1, 'response.snippets[1].data.inner.leaf.cart_item'),
                          (0, 'response.snippets[2].more[0].cart_item')) s(i, path)""",
)
def _(t: RetailTables) -> DataFrame:
    found = payloads.product_scan(_cart_payloads(t))
    return found.select(
        "payload_id", "path", F.try_variant_get("node", "$.product_id", "bigint").alias("product_id")
    )


@query(
    "payload_field_scan",
    """SELECT * FROM (
         SELECT p_partkey AS payload_id, b.path || '.' || f.k AS path,
                CASE f.k WHEN 'quantity' THEN CAST(p_size % 5 AS VARCHAR)
                  WHEN 'inventory' THEN CASE b.n WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '"many"' ELSE '0' END
                  ELSE CASE b.n WHEN 0 THEN CAST(p_partkey % 2 AS VARCHAR) WHEN 2 THEN '9' END END AS value,
                CASE WHEN f.k = 'inventory' AND b.n = 1 THEN 'STRING' ELSE 'BIGINT' END AS type
         FROM part, (VALUES (0, 'response.snippets[0].data.cart_item'),
                            (1, 'response.snippets[1].data.inner.leaf.cart_item'),
                            (2, 'response.snippets[2].more[0].cart_item')) b(n, path),
              (VALUES ('quantity'), ('inventory'), ('unavailable_quantity')) f(k)) WHERE value IS NOT NULL""",
)
def _(t: RetailTables) -> DataFrame:
    return payloads.field_scan(_cart_payloads(t))


def _structure_sql() -> str:
    """Every path of the cart payloads; each occurs once per part."""
    plain = {"product_id": "BIGINT", "brand": "STRING", "unit": "STRING", "price": "DECIMAL",
             "mrp": "DECIMAL", "quantity": "BIGINT"}
    counted = {"product_name": "STRING", "inventory": "BIGINT", "unavailable_quantity": "BIGINT"}
    first, second, third = (f"response.snippets[{i}]" for i in range(3))
    items = {
        f"{first}.data.cart_item": plain | counted,
        f"{second}.data.inner.leaf.cart_item": plain | {"display_name": "STRING", "inventory": "STRING"},
        f"{third}.more[0].cart_item": plain | counted,
    }
    rows = [("status", "STRING", "NULL"), ("response", "object", 1), ("response.snippets", "array", 3)]
    rows += [(path, "object", 1) for path in (first, f"{first}.data", second, f"{second}.data", third)]
    rows += [(f"{second}.data.inner", "object", 1), (f"{second}.data.inner.leaf", "object", 1)]
    rows += [(f"{third}.more", "array", 1), (f"{third}.more[0]", "object", 1)]
    for path, fields in items.items():
        rows.append((path, "object", len(fields)))
        rows += [(f"{path}.{name}", kind, "NULL") for name, kind in fields.items()]
    values = ", ".join(f"('{path}', '{kind}', {size})" for path, kind, size in rows)
    return f"""SELECT path, type, n AS count, CAST(size AS INTEGER) AS max_size
       FROM (SELECT count(*) AS n FROM part), (VALUES {values}) s(path, type, size)"""


@query("payload_structure", _structure_sql())
def _(t: RetailTables) -> DataFrame:
    return payloads.structure(_cart_payloads(t))


@query(
    "event_props_structure",
    """SELECT 'k' AS path, 'BIGINT' AS type, count(*) AS count, CAST(NULL AS INTEGER) AS max_size
       FROM events WHERE props IS NOT NULL""",
)
def _(t: RetailTables) -> DataFrame:
    props = t.raw("events").select("event_id", F.try_parse_json("props").alias("payload"))
    return payloads.structure(props)


# ---------------------------------------------------------------- other payloads


@query(
    "ingest_walk_bff_products",
    """SELECT p_partkey AS payload_id, 'pv-' || p_partkey AS product_id, p_name AS name,
              p_brand AS brand_name, p_size || ' ml' AS unit_quantity,
              CAST(floor(p_retailprice * 90) AS BIGINT) / 100.0::DOUBLE AS discounted_price,
              CAST(floor(p_retailprice * 100) AS BIGINT) / 100.0::DOUBLE AS mrp,
              p_size % 2 <> 0 AS in_stock, CAST(p_size % 7 AS INTEGER) AS max_cart_quantity,
              CAST(p_size AS INTEGER) AS quantity,
              'https://cdn.zeptonow.com/img/' || p_partkey || '.png' AS images
       FROM part""",
)
def _(t: RetailTables) -> DataFrame:
    product = _named(
        id=F.concat(F.lit("pv-"), P("p_partkey").cast("string")),
        mrp=F.floor(P("p_retailprice") * 100),
        discountedSellingPrice=F.floor(P("p_retailprice") * 90),
        availableQuantity=P("p_size"),
        outOfStock=P("p_size") % 2 == 0,
        product=_named(name=P("p_name"), brand=P("p_brand")),
        productVariant=_named(
            formattedPacksize=F.concat(P("p_size").cast("string"), F.lit(" ml")),
            maxAllowedQuantity=P("p_size") % 7,
            images=F.array(
                _named(path=F.concat(F.lit("img/"), P("p_partkey").cast("string"), F.lit(".png")))
            ),
        ),
    )
    doc = _named(layout=F.array(_named(widget=_named(items=F.array(product)))))
    found = payloads.walk_bff_products(_capture(t, doc)).drop("pos")
    return found.withColumn("images", F.array_join("images", ","))


def _store_payloads(t: RetailTables) -> DataFrame:
    """Cards for most parts, only the older widgets for every part of an odd size."""
    variation = _named(
        displayName=P("p_name"),
        brandName=P("p_brand"),
        quantityDescription=F.concat(P("p_size").cast("string"), F.lit(" pcs")),
        skuId=F.concat(F.lit("sku-"), P("p_partkey").cast("string")),
        price=_named(
            offerPrice=_named(units=F.floor(P("p_retailprice")).cast("string")),
            mrp=_named(units=F.when(P("p_size") % 4 == 0, F.floor(P("p_retailprice")) + 5)),
        ),
        inventory=_named(inStock=P("p_size") % 3 != 0),
        cartAllowedQuantity=_named(allowedQuantity=P("p_size") % 6),
        imageIds=F.array(F.concat(F.lit("im"), P("p_partkey").cast("string"))),
    )
    items = F.array(_named(variations=F.array(variation)))
    card = _named(card=_named(card=_named(gridElements=_named(infoWithStyle=_named(items=items)))))
    old = _named(
        product=_named(
            display_name=P("p_name"),
            brand_name=P("p_brand"),
            pricing=_named(price=P("p_retailprice"), mrp=P("p_retailprice") + 1),
            category=_named(name=P("p_type")),
            weight=F.concat(P("p_size").cast("string"), F.lit(" g")),
            max_selectable_quantity=P("p_size") % 6,
        )
    )
    doc = _named(
        data=_named(
            cards=F.when(P("p_size") % 2 == 0, F.array(card)),
            widgets=F.array(_named(data=_named(products=F.array(old)))),
        )
    )
    return _capture(t, doc)


@query(
    "ingest_cards_payload",
    """SELECT p_partkey AS payload_id, 'sku-' || p_partkey AS id, p_name AS name, p_brand AS brand,
              p_size || ' pcs' AS "packSize", floor(p_retailprice) AS price,
              floor(p_retailprice) + CASE WHEN p_size % 4 = 0 THEN 5 ELSE 0 END AS "totalPrice",
              p_size % 3 <> 0 AS "inStock", CAST(p_size % 6 AS INTEGER) AS "maxSelectableQuantity",
              'https://media-assets.swiggy.com/swiggy/image/upload/im' || p_partkey AS image_url
       FROM part WHERE p_size % 2 = 0""",
)
def _(t: RetailTables) -> DataFrame:
    return payloads.cards_products(_store_payloads(t)).drop("pos", "subcategory")


@query(
    "ingest_widgets_payload",
    """SELECT p_partkey AS payload_id, 'im-1' AS id, p_name AS name, p_brand AS brand,
              p_type AS subcategory, p_size || ' g' AS "packSize", p_retailprice AS price,
              p_retailprice + 1 AS "totalPrice", true AS "inStock",
              CAST(p_size % 6 AS INTEGER) AS "maxSelectableQuantity"
       FROM part WHERE p_size % 2 <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    return payloads.widgets_products(_store_payloads(t)).drop("pos", "image_url")


# --------------------------------------------------------------------- snapshots


@query(
    "ingest_snapshot_links",
    """SELECT p_partkey AS snapshot_id, CAST(i AS INTEGER) AS pos,
              ['ab-' || p_partkey, 'ffff', 'z-3'][i + 1] AS product_id,
              CASE WHEN i < 2 THEN p_name ELSE 'second ' || p_name END AS name,
              CASE WHEN i < 2 THEN '1 pack (' || p_size || ' ml)' ELSE p_size || ' g' END AS unit_quantity,
              CAST(CASE WHEN i < 2 THEN p_size ELSE p_size + 1 END AS DOUBLE) AS discounted_price,
              CAST(CASE WHEN i < 2 THEN p_size + 9 ELSE p_size + 1 END AS DOUBLE) AS mrp
       FROM part, (VALUES (0), (1), (2)) s(i)""",
)
def _(t: RetailTables) -> DataFrame:
    size, name, key = P("p_size").cast("string"), P("p_name"), P("p_partkey").cast("string")
    text = F.concat(
        F.lit('- main:\n  - link "'), name, F.lit(" ADD P3 - Ad.png ₹"), size, F.lit(" ₹"),
        (P("p_size") + 9).cast("string"), F.lit(" ₹9 OFF "), name, F.lit(" 1 pack ("), size,
        F.lit(' ml) 4.5" [ref=e1]:\n    - /url: /pn/x/pvid/ab-'), key,
        F.lit('\n  - link "no price ADD" [ref=e2]:\n    - /url: /pn/y/pvid/ffff\n  - text: gap'),
        F.lit('\n  - link "second '), name, F.lit(" ADD ₹"), (P("p_size") + 1).cast("string"),
        F.lit(" "), size, F.lit(' g" [ref=e3]:\n    - img\n    - /url: /pn/z/other'),
    )
    shots = t.spread("part", "p_partkey").select(P("p_partkey").alias("snapshot_id"), text.alias("text"))
    return snapshots.snapshot_links(shots).select(
        "snapshot_id", "pos", "product_id", "name", "unit_quantity", "discounted_price", "mrp"
    )


@query(
    "ingest_snapshot_cards",
    """SELECT p_partkey AS snapshot_id, CAST(0 AS INTEGER) AS pos, 'im-1' AS id, 'Fresh ' || p_name AS name,
              'Fresh' AS brand, p_size || ' ml' AS "packSize", CAST(p_size + 10 AS DOUBLE) AS price,
              CAST(p_size + 20 AS DOUBLE) AS "totalPrice"
       FROM part""",
)
def _(t: RetailTables) -> DataFrame:
    size = P("p_size").cast("string")
    text = F.concat(
        F.lit('generic "Delivery in 9 MINS" [ref=e1]:\n  generic [ref=e2]: 9 MINS now\n'),
        F.lit("  generic [ref=e3]: Fresh "), P("p_name"),
        F.lit("\n  generic [ref=e4]: nice\n  generic [ref=e5]:\n    text: "), size,
        F.lit(" ml\n    img [ref=e6]\n  generic [ref=e7]: ₹ 2\n  generic [ref=e8]: ₹ "),
        (P("p_size") + 10).cast("string"), F.lit("\n  generic [ref=e9]: ₹"),
        (P("p_size") + 20).cast("string"), F.lit("\n  generic: 7 kg"),
        F.lit('\ngeneric "Delivery in 7 MINS" [ref=f1]:\n  generic [ref=f2]: Without price here'),
    )
    shots = t.spread("part", "p_partkey").select(P("p_partkey").alias("snapshot_id"), text.alias("text"))
    return snapshots.snapshot_cards(shots).drop("inStock", "maxSelectableQuantity")


# ----------------------------------------------------------------------- parsing


def _items(t: RetailTables, **fields: Column) -> DataFrame:
    return t.spread("part", "p_partkey").select(
        P("p_type").alias("run_id"),
        P("p_type").alias("category"),
        P("p_partkey").alias("seq"),
        F.parse_json(F.to_json(_named(**fields))).alias("item"),
    )


_LISTING = [
    "seq", "platform_product_id", "name", "brand", "category", "unit", "price", "mrp", "in_stock",
    "max_cart_qty", "inventory_count",
]


@query(
    "parse_blinkit",
    """SELECT p_partkey AS seq,
              CASE WHEN p_partkey % 3 = 0 THEN substr(md5('blinkit:' || lower(trim(p_name)) || ':'), 1, 16)
                   ELSE CAST(p_partkey AS VARCHAR) END AS platform_product_id,
              p_name AS name, p_brand AS brand, p_type AS category, CAST(NULL AS VARCHAR) AS unit,
              p_retailprice AS price, CAST(NULL AS DOUBLE) AS mrp, p_size % 2 = 0 AS in_stock,
              CAST(p_size % 4 AS INTEGER) AS max_cart_qty, CAST(p_size AS INTEGER) AS inventory_count
       FROM part WHERE p_size % 5 <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    items = _items(
        t,
        id=F.when(P("p_partkey") % 3 != 0, P("p_partkey")).otherwise(0),
        name=F.lit(""),
        product_name=P("p_name"),
        brand=P("p_brand"),
        price=F.when(P("p_size") % 5 != 0, P("p_retailprice")).otherwise(0.0),
        unavailable_quantity=P("p_size") % 2,
        max_allowed_quantity=F.lit(0),
        quantity=P("p_size") % 4,
        inventory=P("p_size"),
    )
    return listings.parse_blinkit(items).select(*_LISTING)


@query(
    "parse_zepto",
    """SELECT p_partkey AS seq, CAST(p_size AS VARCHAR) AS platform_product_id, p_name AS name,
              p_brand AS brand, p_type AS category, p_size || ' g' AS unit, p_retailprice - 1 AS price,
              p_retailprice AS mrp, true AS in_stock, CAST(0 AS INTEGER) AS max_cart_qty,
              CAST(p_size AS INTEGER) AS inventory_count
       FROM (SELECT * FROM part
             QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) = 1)
       WHERE p_partkey % 7 <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    items = _items(
        t,
        product_id=P("p_size").cast("string"),
        name=P("p_name"),
        brand_name=F.lit(""),
        brand=P("p_brand"),
        unit_quantity=F.concat(P("p_size").cast("string"), F.lit(" g")),
        discounted_price=F.when(P("p_partkey") % 7 != 0, P("p_retailprice") - 1).otherwise(-1.0),
        mrp=P("p_retailprice"),
        quantity=P("p_size"),
    )
    return listings.parse_zepto(items).select(*_LISTING)


@query(
    "parse_instamart",
    """SELECT p_partkey AS seq, 'im-' || p_partkey AS platform_product_id, p_name AS name, p_brand AS brand,
              p_type AS category, p_size || ' pcs' AS unit, p_retailprice AS price, p_retailprice + 2 AS mrp,
              p_size % 2 = 0 AS in_stock, CAST(p_size % 4 AS INTEGER) AS max_cart_qty,
              CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 3 END AS INTEGER) AS inventory_count
       FROM part""",
)
def _(t: RetailTables) -> DataFrame:
    items = _items(
        t,
        product_id=F.concat(F.lit("im-"), P("p_partkey").cast("string")),
        name=P("p_name"),
        brand_name=P("p_brand"),
        packSize=F.lit(""),
        unit=F.concat(P("p_size").cast("string"), F.lit(" pcs")),
        price=P("p_retailprice"),
        totalPrice=F.lit(0),
        mrp=P("p_retailprice") + 2,
        in_stock=P("p_size") % 2 == 0,
        max_cart_qty=P("p_size") % 4,
        inventory_count=F.when(P("p_size") % 2 == 0, P("p_size")).otherwise(0),
        available_quantity=F.lit(3),
    )
    return listings.parse_instamart(items).select(*_LISTING)


@query(
    "parse_rejects",
    """SELECT p_partkey AS seq, platform,
              CASE WHEN platform = 'elsewhere' THEN 'platform unknown'
                   WHEN p_partkey % 7 = 0 THEN 'name missing'
                   WHEN p_size % 5 = 0 THEN 'price not positive'
                   WHEN p_partkey % 11 = 0 AND platform = 'zepto' THEN 'inventory_count not whole' END AS reason
       FROM (SELECT *, ['blinkit', 'zepto', 'instamart', 'elsewhere'][CAST(p_partkey % 4 + 1 AS INTEGER)]
                       AS platform FROM part) WHERE reason IS NOT NULL""",
)
def _(t: RetailTables) -> DataFrame:
    price = F.when(P("p_size") % 5 != 0, P("p_retailprice")).otherwise(0.0)
    items = _items(
        t,
        id=P("p_partkey").cast("string"),
        product_id=P("p_partkey").cast("string"),
        name=F.when(P("p_partkey") % 7 != 0, P("p_name")),
        price=price,
        discounted_price=price,
        quantity=F.when(P("p_partkey") % 11 == 0, F.lit(0.5)).otherwise(1.0),
        max_allowed_quantity=F.lit(1),
    ).withColumn("platform", pick(("blinkit", "zepto", "instamart", "elsewhere"), P("seq") % 4))
    return listings.parse_rejects(items).select("seq", "platform", "reason")


@query(
    "stable_listing_id",
    """SELECT id, substr(md5(platform || ':' || lower(trim(name)) || ':' || lower(trim(unit))), 1, 16) AS stable_id
       FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    return t.catalog.select("id", stable_listing_id("platform", "name", "unit").alias("stable_id"))


def _term_items(t: RetailTables) -> DataFrame:
    """Search hits of a run: a term position, a position in its list, id and name."""
    return t.raw("part").select(
        P("p_type").alias("run_id"),
        (P("p_size") % 5).alias("term_pos"),
        P("p_partkey").alias("pos"),
        F.when(P("p_size") % 4 != 0, (P("p_partkey") % 50).cast("string")).alias("id"),
        P("p_name").alias("name"),
    )


@query(
    "dedupe_terms_by_key",
    """SELECT p_type AS run_id, p_partkey AS pos FROM part
       QUALIFY row_number() OVER (
         PARTITION BY p_type, CASE WHEN p_size % 4 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE p_name END
         ORDER BY p_size % 5, p_partkey) = 1""",
)
def _(t: RetailTables) -> DataFrame:
    return listings.dedupe_terms_by_key(_term_items(t)).select("run_id", "pos")


@query(
    "dedupe_terms_by_name",
    """SELECT p_type AS run_id, p_name AS name, p_partkey AS pos FROM part
       QUALIFY row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_size % 5, p_partkey) = 1""",
)
def _(t: RetailTables) -> DataFrame:
    return listings.dedupe_terms_by_name(_term_items(t)).select("run_id", "name", "pos")


_ID_OR_NAME = """
  WITH RECURSIVE hits AS (
    SELECT p_type AS run_id, CASE WHEN p_size % 4 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) END AS id,
           p_name AS name, p_partkey AS pos,
           row_number() OVER (PARTITION BY p_type ORDER BY p_size % 5, p_partkey) AS n
    FROM part),
  settled AS (
    SELECT run_id, id, name, pos, n, [name] AS names, CASE WHEN id IS NULL THEN [] ELSE [id] END AS ids,
           true AS kept
    FROM hits WHERE n = 1
    UNION ALL
    SELECT h.run_id, h.id, h.name, h.pos, h.n,
           CASE WHEN f THEN list_append(s.names, h.name) ELSE s.names END,
           CASE WHEN f AND h.id IS NOT NULL THEN list_append(s.ids, h.id) ELSE s.ids END, f
    FROM settled s JOIN (SELECT * FROM hits) h ON h.run_id = s.run_id AND h.n = s.n + 1,
         LATERAL (SELECT NOT list_contains(s.names, h.name)
                    AND NOT coalesce(list_contains(s.ids, h.id), false) AS f))
  SELECT run_id, id, name, pos FROM settled WHERE kept"""


@query("dedupe_terms_by_id_or_name", _ID_OR_NAME)
def _(t: RetailTables) -> DataFrame:
    return listings.dedupe_terms_by_id_or_name(_term_items(t)).select("run_id", "id", "name", "pos")


# ------------------------------------------------------------------- files, runs

_FILE_ROWS = 5000


def _write_arrays(rows: DataFrame, item: Column, *tags: str) -> str:
    """JSON array files of a bounded number of entries, in folders by tag."""
    path = shared_dir(rows.sparkSession, "arrays")
    (
        rows.withColumn("part", F.floor(P("id") / _FILE_ROWS))
        .groupBy(*tags, "part")
        .agg(F.to_json(F.collect_list(item)).alias("value"))
        .write.partitionBy(*tags, "part")
        .text(path)
    )
    return path


@query(
    "read_listing_files",
    """SELECT platform, category, CAST(id AS VARCHAR) AS platform_product_id, name, brand, unit,
              CAST(id % 1000 + 1 AS DOUBLE) AS price FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    name = {"blinkit": "price", "zepto": "discounted_price", "instamart": "price"}
    size = {"blinkit": "unit", "zepto": "unit_quantity", "instamart": "packSize"}
    item = _named(
        id=P("id"), product_id=P("id").cast("string"), name=P("name"), brand=P("brand"),
        **{n: F.when(P("platform").isin([p for p in PLATFORMS if size[p] == n]), P("unit"))
           for n in sorted(set(size.values()))},
        **{n: F.when(P("platform").isin([p for p in PLATFORMS if name[p] == n]), P("id") % 1000 + 1)
           for n in sorted(set(name.values()))},
    )
    path = _write_arrays(t.catalog, item, "platform", "category")
    items = files.read_listing_files(t.spark, path).withColumn("run_id", P("file_name"))
    return listings.parse_items(items).select(
        "platform", "category", "platform_product_id", "name", "brand", "unit", "price"
    )


@query(
    "read_match_results",
    """SELECT category, catalog_id AS query_id, canonical_id AS corpus_id,
              round(CASE WHEN catalog_id % 2 = 0 THEN similarity_score ELSE 0.9 END, 6) AS score
       FROM cluster
       WHERE CASE WHEN catalog_id % 2 = 0 THEN similarity_score >= 0.85::DOUBLE ELSE true END""",
)
def _(t: RetailTables) -> DataFrame:
    spark = t.spark
    rows = t.mappings.join(t.catalog.select(P("id").alias("catalog_id"), "category"), "catalog_id")
    match = _named(
        query_id=P("catalog_id"),
        corpus_id=P("canonical_id"),
        rerank_score=F.when(P("catalog_id") % 2 == 0, P("similarity_score")),
        score=F.lit(0.9),
    )
    path = shared_dir(spark, "matches")
    documents = (
        rows.groupBy("category", F.floor(P("catalog_id") / _FILE_ROWS).alias("part"))
        .agg(F.collect_list(match).alias("matches"))
        .select("category", F.lit("sets").alias("model"), "matches")
    )
    documents.write.json(path)
    found = files.read_match_results(spark, path, threshold=0.85, multi_line=False)
    return found.select("category", "query_id", "corpus_id", r6("score"))


@query(
    "read_judge_verdicts",
    "SELECT canonical_id AS catalog_id_a, catalog_id AS catalog_id_b, similarity_score >= 0.9::DOUBLE AS is_match FROM mappings",
)
def _(t: RetailTables) -> DataFrame:
    verdict = _named(
        pair_id=P("canonical_id"),
        catalog_id_a=P("canonical_id"),
        catalog_id_b=P("catalog_id"),
        similarity=P("similarity_score"),
        verdict=F.when(P("similarity_score") >= 0.9, "YES").otherwise("NO"),
    )
    path = shared_dir(t.spark, "verdicts")
    (
        t.mappings.groupBy(F.floor(P("catalog_id") / _FILE_ROWS).alias("part"))
        .agg(F.collect_list(verdict).alias("verdicts"))
        .drop("part")
        .write.json(path)
    )
    return files.read_judge_verdicts(t.spark, path, multi_line=False)


def _run_items(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """Two runs per category and platform: every listing in the morning and at night."""
    slots = F.explode(F.array(F.lit("morning"), F.lit("night")))
    cells = t.catalog.repartition("id").select("id", "platform", "category", "name", "brand", "unit", slots.alias("slot"))
    run_id = F.concat_ws("-", "platform", "category", "slot")
    item = _named(
        id=P("id"), product_id=P("id").cast("string"), name=P("name"), brand=P("brand"), unit=P("unit"),
        price=F.when(P("id") % 9 != 0, P("id") % 1000 + 1).otherwise(0),
    )
    items = cells.select(
        run_id.alias("run_id"), "platform", P("id").alias("seq"),
        F.parse_json(F.to_json(item)).alias("item"),
    )
    runs = cells.select("platform", "category", P("slot").alias("time_of_day")).distinct().select(
        F.concat_ws("-", "platform", "category", "time_of_day").alias("id"), "platform",
        pick(SEED_PINCODES[:1], F.lit(0)).alias("pincode"), "category", "time_of_day",
        F.when(P("time_of_day") == "morning", F.lit("2024-03-01 08:00:00"))
        .otherwise(F.lit("2024-03-01 20:00:00")).cast("timestamp_ntz").alias("started_at"),
    )
    return items, runs


def _ingested(t: RetailTables) -> dict[str, DataFrame]:
    items, runs = _run_items(t)
    empty = t.spark.createDataFrame
    return W.ingest_run(items, runs, empty([], CATALOG), empty([], OBSERVATION))


@query(
    "ingest_run",
    """SELECT platform || '-' || category || '-' || s.slot AS id, count(*) FILTER (id % 9 <> 0) AS products_found,
              CAST(0 AS BIGINT) AS errors, 'completed' AS status
       FROM catalog, (VALUES ('morning'), ('night')) s(slot) GROUP BY platform, category, s.slot""",
)
def _(t: RetailTables) -> DataFrame:
    return _ingested(t)["runs"].select("id", "products_found", "errors", "status")


@query(
    "observation_ids_unique",
    """SELECT 2 * count(*) AS n, 2 * count(*) AS n_ids
       FROM catalog WHERE id % 9 <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    ids = _ingested(t)["observations"]
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query(
    "ingest_run_observations",
    """SELECT CAST(id AS VARCHAR) AS platform_product_id, s.slot AS time_of_day, '122001' AS pincode,
              CAST(id % 1000 + 1 AS DOUBLE) AS price, '2024-03-01' AS obs_date
       FROM catalog, (VALUES ('morning'), ('night')) s(slot) WHERE id % 9 <> 0""",
)
def _(t: RetailTables) -> DataFrame:
    result = _ingested(t)
    ids = result["catalog"].select(P("id").alias("catalog_id"), "platform_product_id")
    return result["observations"].join(ids, "catalog_id").select(
        "platform_product_id", "time_of_day", "pincode", "price",
        P("obs_date").cast("string").alias("obs_date"),
    )
