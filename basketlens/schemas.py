"""Table schemas and the fixed value sets of the retail model."""

from __future__ import annotations

# Platforms in anchor preference order, time-of-day slots,
# confidence grades with their weights, run states.
PLATFORMS = ("blinkit", "zepto", "instamart")
TIMES_OF_DAY = ("morning", "night")
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.25}
CONFIDENCES = ("high", "medium", "low", "no_data")
RUN_STATUSES = ("running", "completed", "failed")

# Thresholds of the matching and sales rules.
INVENTORY_CAP = 50
MATCH_THRESHOLD = 0.80
HIGH_CONFIDENCE = 0.85
COSINE_FLOOR = 0.4
TOP_K = 5
MRP_TOLERANCE_PCT = 15.0
UNMAPPED_TRIGGER = 5
MAX_CLUSTER_SIZE = 3
MIN_TOKEN_OVERLAP = 0.30
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3
SWEEP_THRESHOLDS = (0.75, 0.80, 0.85, 0.90, 0.95)
JUDGE_PASS_ACCURACY = 0.95


# Table schemas, as DDL.
LISTING = (
    "platform STRING, platform_product_id STRING, name STRING, brand STRING, category STRING, "
    "subcategory STRING, unit STRING, image_url STRING, price DOUBLE, mrp DOUBLE, "
    "in_stock BOOLEAN, max_cart_qty INT, inventory_count INT, raw_json STRING"
)
CATALOG = (
    "id BIGINT, platform STRING, platform_product_id STRING, name STRING, brand STRING, "
    "category STRING, subcategory STRING, unit STRING, image_url STRING, "
    "first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ"
)
OBSERVATION = (
    "id BIGINT, catalog_id BIGINT, scrape_run_id STRING, pincode STRING, price DOUBLE, mrp DOUBLE, "
    "in_stock BOOLEAN, max_cart_qty INT, inventory_count INT, time_of_day STRING, "
    "observed_at TIMESTAMP_NTZ"
)
DAILY_SALES = (
    "catalog_id BIGINT, pincode STRING, sale_date DATE, morning_qty INT, night_qty INT, "
    "estimated_sales INT, confidence STRING, restock_flag BOOLEAN"
)
CANONICAL = (
    "id BIGINT, canonical_name STRING, brand STRING, category STRING, unit_normalized STRING"
)
MAPPING = ("catalog_id BIGINT, canonical_id BIGINT, similarity_score DOUBLE")
SCRAPE_RUN = (
    "id STRING, platform STRING, pincode STRING, category STRING, time_of_day STRING, "
    "started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, products_found INT, errors INT, "
    "status STRING"
)
MATCH_FILE = (
    "model STRING, reranker STRING, category STRING, anchor_platform STRING, num_matches BIGINT, "
    "matches ARRAY<STRUCT<query_id: BIGINT, query_text: STRING, corpus_id: BIGINT, "
    "corpus_text: STRING, dense_score: DOUBLE, rerank_score: DOUBLE, score: DOUBLE>>"
)
VERDICT_FILE = (
    "model STRING, count BIGINT, verdicts ARRAY<STRUCT<pair_id: BIGINT, catalog_id_a: BIGINT, "
    "catalog_id_b: BIGINT, similarity: DOUBLE, verdict: STRING>>"
)
