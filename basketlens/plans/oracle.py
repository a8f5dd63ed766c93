"""The same tables as SQL common table expressions, for the comparison queries."""

from __future__ import annotations

import re

from ..functions.text import PIECE_WORDS, VOLUME_FACTORS, WEIGHT_FACTORS


def unit_sql(u: str) -> str:
    """DuckDB expression for the standard form of a pack size."""
    size = r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]+)"
    paren = r"\(\s*" + size + r"\s*\)"

    def part(i: int) -> str:
        return (
            f"CASE WHEN regexp_matches(lower({u}), '{paren}') THEN regexp_extract(lower({u}), '{paren}', {i}) "
            f"ELSE regexp_extract(lower({u}), '{size}', {i}) END"
        )

    def quoted(words) -> str:
        return ", ".join(f"'{w}'" for w in words)

    value, word = f"TRY_CAST(({part(1)}) AS DOUBLE)", f"({part(2)})"

    def scaled(factors, small: str, large: str) -> str:
        kilo = quoted(w for w, f in factors.items() if f == 1000.0)
        amount = f"({value} * CASE WHEN {word} IN ({kilo}) THEN 1000 ELSE 1 END)"
        return (
            f"CASE WHEN {amount} >= 1000 AND {amount} % 1000 = 0 "
            f"THEN CAST(CAST({amount} / 1000 AS BIGINT) AS VARCHAR) || '{large}' "
            f"WHEN {amount} = floor({amount}) THEN CAST(CAST({amount} AS BIGINT) AS VARCHAR) || '{small}' "
            f"ELSE CAST({amount} AS VARCHAR) || '{small}' END"
        )

    plain = (
        f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({value} AS VARCHAR) END"
    )
    return (
        f"CASE WHEN {word} IN ({quoted(VOLUME_FACTORS)}) THEN {scaled(VOLUME_FACTORS, 'ml', 'l')} "
        f"WHEN {word} IN ({quoted(WEIGHT_FACTORS)}) THEN {scaled(WEIGHT_FACTORS, 'g', 'kg')} "
        f"WHEN {word} = 'dozen' THEN ({plain}) || 'dozen' "
        f"WHEN {word} IN ({quoted(PIECE_WORDS)}) THEN ({plain}) || 'pcs' END"
    )


DISCOUNT = "CASE WHEN mrp > 0 AND (mrp - price) / mrp * 100 > 0 THEN (mrp - price) / mrp * 100 END"

CTES = {
    "catalog": """
        SELECT p_partkey * 3 + i + 1 AS id,
               ['blinkit', 'zepto', 'instamart'][CAST(i + 1 AS INTEGER)] AS platform,
               CAST(p_partkey AS VARCHAR) AS platform_product_id, p_name AS name,
               nullif(p_brand, 'Brand#13') AS brand, p_type AS category,
               CAST(NULL AS VARCHAR) AS subcategory,
               CAST(p_size AS VARCHAR)
                 || [' ml', 'g', ' Kg', ' pcs', ' bunch'][CAST((p_partkey + i) % 5 + 1 AS INTEGER)] AS unit
        FROM part, (VALUES (0), (1), (2)) AS s(i)
        WHERE (p_partkey * 7 + i * 3) % 5 < 3""",
    "obs": """
        SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)
                 * 2251799813685248 + l_orderkey * 8 + l_linenumber AS id,
               l_partkey * 3 + l_suppkey % 3 + 1 AS catalog_id,
               CAST(l_orderkey AS VARCHAR) AS scrape_run_id,
               ['122001', '122002', '122003', '122008'][CAST(l_orderkey % 4 + 1 AS INTEGER)] AS pincode,
               floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) / 100 AS price,
               floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS mrp,
               l_linestatus = 'O' AS in_stock, CAST(l_linenumber AS INTEGER) AS max_cart_qty,
               CAST(l_quantity AS INTEGER) AS inventory_count,
               CASE WHEN l_linenumber % 2 = 0 THEN 'morning' ELSE 'night' END AS time_of_day,
               l_shipdate AS observed_at
        FROM lineitem
        WHERE (l_partkey * 7 + (l_suppkey % 3) * 3) % 5 < 3""",
    "latest": """
        SELECT catalog_id, id AS obs_id, price, mrp, in_stock
        FROM obs WHERE id IN (SELECT max(id) FROM obs GROUP BY catalog_id)
        QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY id DESC) = 1""",
    "priced": """
        SELECT c.*, l.price, l.mrp, l.in_stock
        FROM catalog c LEFT JOIN latest l ON l.catalog_id = c.id""",
    "canonicals": """
        SELECT p_partkey AS id, p_name AS canonical_name, nullif(p_brand, 'Brand#13') AS brand,
               p_type AS category
        FROM part WHERE p_partkey % 2 = 0""",
    "mappings": """
        SELECT id AS catalog_id, (id - 1) // 3 - ((id - 1) // 3) % 2 AS canonical_id,
               CASE WHEN platform = 'blinkit' THEN 1.0::DOUBLE
                    ELSE 0.80::DOUBLE + (id % 20) / 100.0::DOUBLE END AS similarity_score
        FROM catalog WHERE id % 11 <> 0""",
    "readings": """
        SELECT event_id AS seq, user_id AS catalog_id,
               ['122001', '122002', '122003', '122008'][CAST(user_id % 4 + 1 AS INTEGER)] AS pincode,
               CAST(ts AS DATE) AS obs_date, ts AS observed_at,
               CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'night' END AS time_of_day,
               abs(value) + 1.0 AS price, abs(value) + 2.0 AS mrp,
               event_type <> 'error' AS in_stock, CAST(floor(value) AS BIGINT) % 3 AS max_cart_qty,
               CASE WHEN user_id % 3 <> 2 THEN CAST(floor(least(value, 50.0)) AS INTEGER) END
                 AS inventory_count,
               event_type
        FROM events""",
    "stock": """
        SELECT * FROM readings
        QUALIFY row_number() OVER (
          PARTITION BY catalog_id, pincode, obs_date, time_of_day ORDER BY seq) = 1""",
    "sales": """
        SELECT catalog_id, pincode, sale_date, morning_qty, night_qty,
               CASE WHEN kind = 'inv' AND mi > ni THEN mi - ni WHEN kind = 'inv' THEN 0
                    WHEN kind = 'cart' AND mc > nc THEN mc - nc WHEN kind = 'cart' THEN 0
                    WHEN ms AND NOT ns THEN 1 ELSE 0 END AS estimated_sales,
               CASE WHEN kind = 'inv' AND mi > ni THEN CASE WHEN mi >= 50 THEN 'medium' ELSE 'high' END
                    WHEN kind = 'inv' AND mi = ni
                      THEN CASE WHEN mi >= 50 AND ni >= 50 THEN 'low' ELSE 'medium' END
                    ELSE 'low' END AS confidence,
               CASE WHEN kind = 'inv' THEN mi < ni WHEN kind = 'cart' THEN mc < nc
                    ELSE (NOT ms) AND ns END AS restock_flag
        FROM (
          SELECT *,
                 CASE kind WHEN 'inv' THEN mi WHEN 'cart' THEN mc ELSE CAST(ms AS INTEGER) END AS morning_qty,
                 CASE kind WHEN 'inv' THEN ni WHEN 'cart' THEN nc ELSE CAST(ns AS INTEGER) END AS night_qty
          FROM (
            SELECT m.catalog_id, m.pincode, m.obs_date AS sale_date,
                   m.inventory_count AS mi, n.inventory_count AS ni, m.max_cart_qty AS mc,
                   n.max_cart_qty AS nc, m.in_stock AS ms, n.in_stock AS ns,
                   CASE WHEN m.inventory_count IS NOT NULL AND n.inventory_count IS NOT NULL THEN 'inv'
                        WHEN m.max_cart_qty <> n.max_cart_qty THEN 'cart' ELSE 'flag' END AS kind
            FROM stock m JOIN stock n
              ON m.catalog_id = n.catalog_id AND m.pincode = n.pincode AND m.obs_date = n.obs_date
            WHERE m.time_of_day = 'morning' AND n.time_of_day = 'night'))""",
    "runs": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id,
               ['blinkit', 'zepto', 'instamart'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS platform,
               ['122001', '122002', '122003', '122008', '122010', '122015', '122018', '122051']
                 [CAST(o_orderkey % 8 + 1 AS INTEGER)] AS pincode,
               ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']
                 [CAST(o_orderkey % 6 + 1 AS INTEGER)] AS category,
               CASE WHEN o_orderkey % 2 = 0 THEN 'morning' ELSE 'night' END AS time_of_day,
               o_orderdate AS started_at, CAST(floor(o_totalprice / 1000) AS INTEGER) AS products_found,
               CAST(o_custkey % 4 AS INTEGER) AS errors,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status
        FROM orders""",
    "brand_counts": """
        SELECT category, brand, count(*) AS n FROM catalog GROUP BY category, brand""",
    "velocity": """
        SELECT s.catalog_id, c.name, c.brand, c.category, c.platform, sum(estimated_sales) AS total_units,
               avg(estimated_sales) AS avg_per_pincode, count(*) AS pincode_count,
               sum(CAST(restock_flag AS INTEGER)) AS restocks
        FROM sales s JOIN catalog c ON c.id = s.catalog_id WHERE confidence = 'high'
        GROUP BY ALL""",
    "texts": f"""
        SELECT id, category, platform, brand, name,
               concat_ws(' ', nullif(brand, ''), name, {unit_sql('unit')}) AS text FROM catalog""",
    "anchored": """
        SELECT t.*, t.platform = a.anchor AS is_anchor, a.anchor FROM texts t JOIN (
          SELECT category, CASE min(CASE platform WHEN 'blinkit' THEN 0 WHEN 'zepto' THEN 1 ELSE 2 END)
                   WHEN 0 THEN 'blinkit' WHEN 1 THEN 'zepto' ELSE 'instamart' END AS anchor
          FROM catalog GROUP BY category) a USING (category)""",
    "doc_tokens": """
        SELECT category, is_anchor, text, unnest(list_distinct(string_split(lower(text), ' '))) AS tok
        FROM (SELECT DISTINCT category, is_anchor, text FROM anchored)""",
    "doc_pairs": """
        SELECT q.category, q.text AS query_text, a.text AS corpus_text,
               count(*) / sqrt(CAST(len(list_distinct(string_split(lower(q.text), ' ')))
                             * len(list_distinct(string_split(lower(a.text), ' '))) AS DOUBLE)) AS score
        FROM doc_tokens q JOIN doc_tokens a ON q.category = a.category AND q.tok = a.tok
        WHERE NOT q.is_anchor AND a.is_anchor GROUP BY q.category, q.text, a.text
        HAVING count(*) / sqrt(CAST(len(list_distinct(string_split(lower(q.text), ' ')))
                             * len(list_distinct(string_split(lower(a.text), ' '))) AS DOUBLE)) >= 0.4""",
    "matched": """
        SELECT q.category, q.id AS query_id, a.id AS corpus_id, p.query_text, p.corpus_text, p.score,
               row_number() OVER (PARTITION BY q.id ORDER BY p.score DESC, a.id) AS rank
        FROM doc_pairs p
        JOIN anchored q ON q.category = p.category AND q.text = p.query_text AND NOT q.is_anchor
        JOIN anchored a ON a.category = p.category AND a.text = p.corpus_text AND a.is_anchor
        QUALIFY rank <= 5""",
    "best": """
        SELECT query_id, corpus_id, round(score, 4) AS score FROM matched
        WHERE round(score, 4) >= 0.80
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, corpus_id) = 1""",
    "positive_mrp": """
        SELECT catalog_id, mrp FROM obs WHERE mrp > 0
        QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY observed_at DESC, id DESC) = 1""",
    "guarded": f"""
        SELECT b.query_id, b.corpus_id, b.score,
               CASE WHEN qu <> cu THEN 'unit mismatch'
                    WHEN abs(qm - cm) / least(qm, cm) * 100 > 15.0 THEN 'MRP mismatch' END AS reject_reason
        FROM (SELECT b.*, {unit_sql('q.unit')} AS qu, {unit_sql('c.unit')} AS cu, qm.mrp AS qm, cm.mrp AS cm
              FROM best b JOIN catalog q ON q.id = b.query_id JOIN catalog c ON c.id = b.corpus_id
              LEFT JOIN positive_mrp qm ON qm.catalog_id = b.query_id
              LEFT JOIN positive_mrp cm ON cm.catalog_id = b.corpus_id) b""",
    "assigned": """
        SELECT a.id, a.category, a.is_anchor,
               coalesce(CASE WHEN NOT a.is_anchor THEN t.id END, a.id) AS canonical_id,
               CASE WHEN NOT a.is_anchor AND t.id IS NOT NULL THEN g.score ELSE 1.0 END AS similarity_score,
               NOT a.is_anchor AND t.id IS NOT NULL AS joined
        FROM anchored a
        LEFT JOIN guarded g ON g.query_id = a.id AND g.reject_reason IS NULL
        LEFT JOIN anchored t ON t.id = g.corpus_id AND t.is_anchor""",
    "cluster": """
        SELECT m.canonical_id, m.similarity_score, c.id AS catalog_id, c.platform, c.name, c.brand, c.unit,
               c.category
        FROM mappings m JOIN catalog c ON c.id = m.catalog_id""",
}

_WORD = re.compile(r"[a-z_]+")


def _needed(sql: str, seen: dict[str, None]) -> None:
    words = set(_WORD.findall(sql))
    for name, body in CTES.items():
        if name in words and name not in seen:
            _needed(body, seen)
            seen[name] = None


def _settle_ties(sql: str) -> str:
    """Write ``round(x, 6)`` as ``floor(x * 1e6 + 0.5001) / 1e6``.

    A mean over 32 prices has a 5 as its seventh and last decimal; the two engines
    add in different orders and would round such a tie apart.
    """
    out, i = "", 0
    while (start := sql.find("round(", i)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _settle_ties(sql[start + len("round(") : end - 1])
        is_six = inner.endswith(", 6")
        body = f"(floor(({inner[:-3]}) * 1e6 + 0.5001) / 1e6)" if is_six else f"round({inner})"
        out, i = out + sql[i:start] + body, end
    return out + sql[i:]


def with_tables(sql: str) -> str:
    """Prefix a query with the table definitions it uses, in dependency order."""
    sql = _settle_ties(sql)
    seen: dict[str, None] = {}
    _needed(sql, seen)
    if not seen:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({CTES[name]}\n)" for name in seen)
    return f"WITH {ctes}\n{sql.strip()}"
