"""Fixed dimensions: pincodes with coordinates, categories with search terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pincode, latitude, longitude, area.
GURUGRAM_PINCODES = (
    ("122001", 28.4595, 77.0266, "Civil Lines, Sector 14, Sadar Bazar"),
    ("122002", 28.4729, 77.0820, "DLF Phase 1-2, MG Road, Cyber City"),
    ("122003", 28.4600, 77.0700, "Sector 4, 7, 9, DLF Phase 3"),
    ("122004", 28.4500, 77.0700, "Sector 28, 29, Golf Course Road"),
    ("122006", 28.4800, 77.0300, "Palam Vihar, Sector 23"),
    ("122007", 28.4600, 77.0400, "Sector 10, 10A"),
    ("122008", 28.4300, 77.0600, "Sector 45, 46, 47"),
    ("122009", 28.4100, 77.0500, "Sohna Road, Sector 49, 50"),
    ("122010", 28.4700, 77.0700, "DLF Phase 3, Udyog Vihar 4-5"),
    ("122011", 28.4200, 77.0800, "Sector 56, 57, 58"),
    ("122015", 28.4900, 77.0700, "Sector 18, Udyog Vihar 1-3"),
    ("122016", 28.4600, 77.0500, "Sector 31, 32, 33"),
    ("122017", 28.4800, 77.0200, "Palam Vihar Extension, Sector 8"),
    ("122018", 28.4400, 77.0500, "Sector 47-49, Huda City Centre"),
    ("122021", 28.3600, 76.9400, "Manesar, Industrial belt"),
    ("122022", 28.4550, 77.0350, "Sector 17B, Jacobpura"),
    ("122051", 28.4100, 77.0200, "Sector 65-68, Dwarka Expressway"),
    ("122102", 28.3500, 77.0700, "Sohna Town"),
)
JAIPUR_PINCODES = (
    ("302020", 26.8607, 75.7633, "Mansarovar"),
    ("302021", 26.9361, 75.7618, "Vaishali Nagar"),
    ("302017", 26.8549, 75.8243, "Malviya Nagar"),
    ("302016", 26.9180, 75.7840, "Bani Park / Shastri Nagar"),
    ("302025", 26.8350, 75.8650, "Jagatpura"),
    ("302018", 26.8700, 75.8100, "Durgapura"),
    ("302004", 26.8990, 75.8200, "Raja Park / Jawahar Nagar"),
)
SEED_PINCODES = ("122001", "122002", "122003", "122008", "122010", "122015", "122018", "122051")
DEFAULT_LOCATION = (28.4595, 77.0266)

# Search terms per category.
CATEGORY_TERMS = {
    "Dairy & Bread": ("milk", "curd", "bread", "butter", "cheese", "paneer"),
    "Fruits & Vegetables": ("vegetables", "fruits", "onion", "potato", "tomato"),
    "Snacks & Munchies": ("chips", "namkeen", "popcorn", "peanuts", "snacks"),
    "Beverages": ("cold drinks", "juice", "energy drink", "soda", "coconut water"),
    "Atta & Staples": ("atta", "rice", "dal", "maida", "besan"),
    "Chocolates & Sweets": ("chocolate", "candy", "sweets", "mithai"),
    "Bakery & Biscuits": ("biscuit", "cookies", "cake", "rusk"),
    "Tea & Coffee": ("tea", "coffee", "green tea", "kadak chai"),
    "Instant & Frozen Food": ("noodles", "frozen food", "instant mix", "pasta"),
}


def pincode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(GURUGRAM_PINCODES + JAIPUR_PINCODES),
        "pincode STRING, lat DOUBLE, lng DOUBLE, area STRING",
    )


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(name, list(terms)) for name, terms in CATEGORY_TERMS.items()]
    return spark.createDataFrame(rows, "category STRING, terms ARRAY<STRING>")


def category_terms(category: Column) -> Column:
    """Search terms of a category; its lower-case name when it is not listed."""
    literal = F.create_map(
        *[
            part
            for name, terms in CATEGORY_TERMS.items()
            for part in (F.lit(name), F.array(*[F.lit(t) for t in terms]))
        ]
    )
    return F.coalesce(F.try_element_at(literal, category), F.array(F.lower(category)))


def with_location(df: DataFrame) -> DataFrame:
    """Add lat, lng, area and city by pincode.

    The dimension is a fixed list of 25 rows, so its broadcast cannot grow.
    """
    dim = F.broadcast(pincode_table(df.sparkSession))
    lat, lng = DEFAULT_LOCATION
    return df.join(dim, "pincode", "left").select(
        *df.columns,
        F.coalesce("lat", F.lit(lat)).alias("lat"),
        F.coalesce("lng", F.lit(lng)).alias("lng"),
        "area",
        F.when(F.col("pincode").startswith("122"), "Gurugram").otherwise("Jaipur").alias("city"),
    )
