from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from basketlens import functions as fn

UNITS = {
    "1 L": "1l", "2 litres": "2l", "1500ml": "1500ml", "1 Kg": "1kg", "1000 gm": "1kg",
    "0.5 kg": "500g", "250 gms": "250g", "6 pcs": "6pcs", "1 pack": "1pcs", "2 units": "2pcs",
    "1 dozen": "1dozen", "  500 ml  ": "500ml", "0.5 L": "500ml", "1 pack (500 ml)": "500ml",
    "1 pouch (450 ml)": "450ml", "1.5 pcs": "1.5pcs", "0.5 ml": "0.5ml", "2000 ml": "2l",
    None: None, "": None, "   ": None, "5 foobar": None, "ml": None,
}


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(u, w) for u, w in UNITS.items()], "unit STRING, want STRING")


def test_normalize_unit(units):
    for unit, want, got in units.select("unit", "want", fn.normalize_unit("unit")).collect():
        assert got == want, unit


def test_normalize_unit_in_sql(spark, units):
    names = fn.register_functions(spark)
    assert {"normalize_unit", "stable_listing_id", "token_jaccard", "cosine"} == set(names)
    for unit, want, got in units.selectExpr("unit", "want", "normalize_unit(unit)").collect():
        assert got == want, unit
    cos = spark.sql("SELECT cosine(array(1f, 0f), array(1f, 1f)), token_jaccard('a b', 'B c')").first()
    assert cos[0] == pytest.approx(2**-0.5, abs=1e-9)
    assert cos[1] == pytest.approx(1 / 3)


def test_compose_text(spark):
    df = spark.createDataFrame(
        [("Amul", "Milk", "500 ml"), (None, "Milk", "1 bunch"), ("", "Milk", None)],
        "brand STRING, name STRING, unit STRING",
    )
    plain = [r[0] for r in df.select(fn.compose_text("brand", "name", "unit")).collect()]
    raw = [r[0] for r in df.select(fn.compose_text("brand", "name", "unit", True)).collect()]
    assert plain == ["Amul Milk 500ml", "Milk", "Milk"]
    assert raw == ["Amul Milk 500ml", "Milk 1 bunch", "Milk"]


def test_stable_listing_id(spark):
    df = spark.createDataFrame([("zepto", "  Milk ", None)], "p STRING, n STRING, u STRING")
    want = hashlib.md5(b"zepto:milk:").hexdigest()[:16]
    assert df.select(fn.stable_listing_id("p", "n", "u")).first()[0] == want


def test_token_jaccard_and_cosine(spark):
    df = spark.createDataFrame(
        [("Amul Gold", "amul taaza", [1.0, 0.0], [0.0, 2.0]), ("", "x", [0.0, 0.0], [1.0, 1.0])],
        "a STRING, b STRING, x ARRAY<FLOAT>, y ARRAY<FLOAT>",
    )
    got = df.select(fn.token_jaccard("a", "b"), fn.cosine("x", "y")).collect()
    assert got[0][0] == pytest.approx(1 / 3) and got[1][0] == 0.0
    assert got[0][1] == 0.0 and got[1][1] == 0.0


def test_slugify(spark):
    df = spark.createDataFrame([("Dairy & Bread!",)], "c STRING")
    assert df.select(fn.slugify("c")).first()[0] == "dairy_bread"


def test_text_features_and_batch_scorer(spark):
    df = spark.createDataFrame([("Red  red Bolt",)], "t STRING")
    assert df.select(fn.text_features("t")).first()[0] == ["red", "bolt"]
    grams = df.select(fn.text_features("t", 3)).first()[0]
    assert grams[:2] == ["red", "bolt"] and "#d b" in grams
    length = fn.batch_scorer(lambda s: s.str.len().astype("float64"), "double")
    assert df.select(length(F.col("t"))).first()[0] == 13.0


def test_features_are_computed_once_per_text(spark):
    """A lambda that mentions the words of a text from outside would split it again per element."""
    df = spark.createDataFrame([("b a b",), ("",), ("a",), (None,)], "text STRING")
    grams, counts = fn.text_features("text", 3), fn.hashed_counts("text", 4)
    plan = df.select(grams.alias("g"), counts.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and "filter(transform(" not in plan
    got = [tuple(r) for r in df.select(grams, counts).collect()]
    assert got[0][0] == ["b", "a", "#b a"] and sum(got[0][1]) == 3
    assert got[1][0] == ["#"] and got[2][0] == ["a", "#a"]
    assert got[3][0] is None or got[3][0] == ["#"]
