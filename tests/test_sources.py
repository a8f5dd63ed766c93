from __future__ import annotations

import json

from pyspark.sql import functions as F

from basketlens.plans import ingest_queries
from basketlens.plans.bindings import RetailTables
from basketlens.sources import dims, listings, payloads, snapshots
from basketlens.sources.validate import LISTING_RULES, MAPPING_RULES, validate_rows


def variants(spark, docs, column="payload"):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "payload_id BIGINT, js STRING")
    return df.select("payload_id", F.parse_json("js").alias(column))


def items(spark, docs):
    return variants(spark, docs, "item").select(
        F.lit("r").alias("run_id"), F.lit("Dairy").alias("category"),
        F.col("payload_id").alias("seq"), "item",
    )


def test_walk_cart_items_nested_and_repeated(spark, rows):
    doc = {
        "a": [{"cart_item": {"product_id": 7, "product_name": "Milk", "price": 30}}],
        "b": {"c": {"cart_item": {"product_id": 7, "product_name": "again"}}},
        "d": [{"cart_item": {"product_id": 0}}, {"cart_item": {"product_id": "x", "inventory": 2.5}}],
    }
    got = rows(payloads.walk_cart_items(variants(spark, [doc])), "id", "name", "available", "inventory")
    assert got == [("7", "Milk", True, None), ("x", "", True, None)]


def test_walk_reaches_any_depth(spark):
    doc: dict = {"cart_item": {"product_id": 1, "note": "]}[{\\"}}
    for _ in range(30):
        doc = {"n": [doc]}
    df = variants(spark, [doc, {"cart_item": {"product_id": 2}}])
    assert payloads.nesting(df) == 62
    assert payloads.walk_cart_items(df).count() == 2
    assert payloads.walk_cart_items(df, max_depth=18).count() == 1


def test_rejects_carry_their_reason(spark):
    items = [("r", 1, "blinkit", {"name": "a", "price": 1}), ("r", 2, "blinkit", {"price": 1}),
             ("r", 3, "zepto", {"name": "a", "price": 0}), ("r", 4, "else", {"name": "a"}), ("r", 5, None, {})]
    df = spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in items], "run_id string, seq long, platform string, t string")
    df = df.select("run_id", "seq", "platform", F.lit("c").alias("category"), F.parse_json("t").alias("item"))
    got = {r["seq"]: r["reason"] for r in listings.parse_rejects(df).collect()}
    assert got == {2: "name missing", 3: "price not positive", 4: "platform unknown", 5: "platform unknown"}
    assert listings.parse_items(df).count() == 1


def test_bff_product_in_paise(spark):
    doc = [{"id": "p1", "mrp": 5550, "discountedSellingPrice": 4999, "availableQuantity": 3,
            "outOfStock": False, "product": {"name": "Curd", "brand": "B"},
            "productVariant": {"formattedPacksize": "400 g", "images": ["u", {"path": "i.png"}]}},
           {"mrp": 1, "availableQuantity": 3, "product": {"name": ""}}]
    got = payloads.walk_bff_products(variants(spark, [doc])).collect()
    assert len(got) == 1
    assert (got[0]["discounted_price"], got[0]["mrp"], got[0]["in_stock"]) == (49.99, 55.5, True)
    assert got[0]["images"] == ["u", "https://cdn.zeptonow.com/i.png"]


def test_widgets_only_without_cards(spark, rows):
    card = {"card": {"card": {"gridElements": {"infoWithStyle": {"items": [
        {"variations": [{"displayName": "New", "price": {"offerPrice": {"units": "12"}}}]}]}}}}}
    old = {"data": {"products": [{"product": {"name": "Old", "pricing": {"price": 5}}}, {"name": "Bare"}]}}
    docs = [{"data": {"cards": [card], "widgets": [old]}}, {"data": {"widgets": [old]}}]
    got = rows(payloads.instamart_products(variants(spark, docs)), "payload_id", "id", "name", "price")
    assert got == [(0, "", "New", 12.0), (1, "im-1", "Old", 5.0), (1, "im-2", "Bare", 0.0)]


def test_parse_blinkit_aliases_and_rejects(spark, rows):
    docs = [
        {"id": 0, "product_id": 5, "name": "", "product_name": "A", "price": "12", "available": 0},
        {"name": "B", "price": 10, "unavailable_quantity": 0, "quantity": 4},
        {"name": "zero", "price": 0},
        {"price": 10},
        {"name": "C", "price": 9, "inventory": 1.5},
        {"name": "D", "price": 9, "unavailable_quantity": 3},
    ]
    got = rows(listings.parse_blinkit(items(spark, docs)), "name", "price", "in_stock", "max_cart_qty")
    assert got == [("A", 12.0, False, 0), ("B", 10.0, True, 4), ("D", 9.0, False, 0)]
    ids = dict(rows(listings.parse_blinkit(items(spark, docs)), "name", "platform_product_id"))
    assert ids["A"] == "5" and len(ids["B"]) == 16


def test_parse_zepto_marks_invalid_ids_as_seen(spark, rows):
    docs = [
        {"product_id": "z1", "name": "bad", "price": 0},
        {"product_id": "z1", "name": "later", "price": 5},
        {"product_id": "z2", "name": "ok", "discounted_price": 0, "price": 7, "images": ["i"]},
        {"product_id": "z3", "name": "null flag", "price": 7, "in_stock": None},
    ]
    got = rows(listings.parse_zepto(items(spark, docs)), "platform_product_id", "name", "price", "image_url")
    assert got == [("z2", "ok", 7.0, "i")]


def test_parse_instamart_zero_inventory_falls_through(spark, rows):
    docs = [{"id": "i", "name": "A", "price": 3, "inventory_count": 0, "available_quantity": 6,
             "totalPrice": 0, "mrp": 4, "inStock": False, "in_stock": True}]
    got = rows(listings.parse_instamart(items(spark, docs)), "mrp", "in_stock", "inventory_count")
    assert got == [(4.0, False, 6)]


def brute_id_or_name(entries):
    kept, ids, names = [], set(), set()
    for term, pos, pid, name in sorted(entries):
        if not name or (pid and pid in ids) or name in names:
            continue
        kept.append((term, pos))
        if pid:
            ids.add(pid)
        names.add(name)
    return sorted(kept, key=repr)


def test_dedupe_by_id_or_name_equals_the_sequential_rule(spark, rows):
    entries = [(0, 0, "1", "x"), (0, 1, "2", "x"), (0, 2, "2", "y"), (0, 3, "", "y"), (0, 4, "", "")]
    entries += [(1, i, str((i * 7) % 23), f"n{(i * 5) % 19}") for i in range(120)]
    df = spark.createDataFrame(
        [("r", *e) for e in entries], "run_id STRING, term_pos INT, pos INT, id STRING, name STRING"
    )
    got = rows(listings.dedupe_terms_by_id_or_name(df), "term_pos", "pos")
    assert got == brute_id_or_name(entries)


def test_snapshot_cards_skip_noise(spark, rows):
    text = "\n".join([
        'generic "Delivery in 8 MINS" [ref=e1]:', "  generic [ref=e2]: 8 MINS",
        "  generic [ref=e3]: 20% OFF today", "  generic [ref=e4]: Amul Taaza Milk",
        "  text: 500 ml", "  generic [ref=e5]: ₹ 4", "  generic [ref=e6]: ₹ 29",
        'generic "Delivery in 8 MINS" [ref=f1]:', "  generic [ref=f2]: no price at all",
    ])
    df = spark.createDataFrame([(1, text)], "snapshot_id INT, text STRING")
    got = rows(snapshots.snapshot_cards(df), "id", "name", "brand", "packSize", "price", "totalPrice")
    assert got == [("im-1", "Amul Taaza Milk", "Amul", "500 ml", 29.0, 29.0)]


def test_pincode_lookup(spark, rows):
    df = spark.createDataFrame([("302020",), ("999999",)], "pincode STRING")
    got = rows(dims.with_location(df), "pincode", "lat", "city")
    assert got == [("302020", 26.8607, "Jaipur"), ("999999", 28.4595, "Jaipur")]
    terms = spark.createDataFrame([("Beverages",), ("Pet Food",)], "c STRING")
    assert [r[0][0] for r in terms.select(dims.category_terms(F.col("c"))).collect()] == [
        "cold drinks", "pet food",
    ]


def test_validate_rows_keeps_rejects_with_reasons(spark, rows):
    df = spark.createDataFrame(
        [("zepto", "1", "a", "c", 1.0, 0), ("shop", "1", None, "c", 0.0, -1)],
        "platform STRING, platform_product_id STRING, name STRING, category STRING, price DOUBLE, max_cart_qty INT",
    )
    valid, rejected = validate_rows(df, LISTING_RULES)
    assert valid.count() == 1
    assert rejected.first()["reasons"] == [
        "name missing", "price not positive", "max_cart_qty negative", "platform unknown",
    ]
    maps = spark.createDataFrame([(1, 1, 1.2)], "catalog_id INT, canonical_id INT, similarity_score DOUBLE")
    assert validate_rows(maps, MAPPING_RULES)[1].count() == 1


def test_payload_input_is_dealt_over_tasks(spark, tmp_path):
    """One small file is one read task; the payloads made of it are worked on in several."""
    key = F.col("id").alias("p_partkey")
    named = [F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in ("p_name", "p_brand", "p_type")]
    parts = spark.range(0, 20_000, 1, 1).select(
        key, *named, (F.col("id") % 50).cast("int").alias("p_size"), F.lit(9.5).alias("p_retailprice")
    )
    parts.write.parquet(f"{tmp_path}/part.parquet")
    tables = RetailTables(spark, str(tmp_path))
    assert tables.raw("part").rdd.getNumPartitions() == 1
    made = ingest_queries._cart_payloads(tables)
    # how many tasks read the exchange is settled by its size
    assert "RepartitionByExpression [p_partkey" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["payload_id"] for r in made.select("payload_id").collect()) == list(range(20_000))


def test_items_are_parsed_once(spark):
    """The filter on refused rows must not write the parsing of an item out at each mention."""
    rows = spark.createDataFrame([(1, '{"id":"a","name":"n","price":2}'), (2, '{"id":"b"}')], "seq int, text string")
    items = rows.select(F.lit("r").alias("run_id"), F.lit("c").alias("category"), "seq", F.parse_json("text").alias("item"))
    parsed = listings.parse_blinkit(items)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert [r["seq"] for r in parsed.collect()] == [1]
    assert [(r["seq"], r["reason"]) for r in listings.parse_rejects(items.withColumn("platform", F.lit("blinkit"))).collect()] == [
        (2, "name missing")
    ]
