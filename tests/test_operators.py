from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from basketlens.functions import batch_scorer
from basketlens.functions.text import normalize_unit
from basketlens.operators import (
    audit,
    brand,
    catalog,
    category,
    encoding,
    matching,
    report,
    sales,
    stats,
    tables,
)
from basketlens.operators import similarity as sim

DAY = dt.datetime(2026, 3, 28)


def readings(spark, pairs):
    rows = []
    for cid, (morning, night) in enumerate(pairs):
        for slot, hour, r in (("morning", 8, morning), ("night", 20, night)):
            if r is not None:
                inv, cart, stock = r
                rows.append((cid, "122001", DAY.replace(hour=hour), slot, inv, cart, stock))
    return spark.createDataFrame(
        rows,
        "catalog_id INT, pincode STRING, observed_at TIMESTAMP_NTZ, time_of_day STRING, "
        "inventory_count INT, max_cart_qty INT, in_stock BOOLEAN",
    )


def test_daily_sales_decision_table(spark, rows):
    cases = [
        ((20, 5, True), (5, 5, True), (15, "high", False)),
        ((10, 5, True), (10, 5, True), (0, "medium", False)),
        ((5, 5, True), (15, 5, True), (0, "low", True)),
        ((50, 5, True), (20, 5, True), (30, "medium", False)),
        ((50, 5, True), (50, 5, True), (0, "low", False)),
        ((None, 9, True), (4, 4, True), (5, "low", False)),
        ((None, 2, True), (None, 4, True), (0, "low", True)),
        ((None, 2, True), (None, 2, False), (1, "low", False)),
        ((None, 2, False), (None, 2, True), (0, "low", True)),
        ((None, 2, True), (None, 2, True), (0, "low", False)),
    ]
    df = readings(spark, [(m, n) for m, n, _ in cases] + [((9, 9, True), None)])
    got = rows(sales.daily_sales(df), "catalog_id", "estimated_sales", "confidence", "restock_flag")
    assert got == [(i, *want) for i, (_, _, want) in enumerate(cases)]
    assert sales.daily_sales(df, day="2026-03-27").count() == 0


def test_sales_summary_map(spark):
    df = sales.daily_sales(readings(spark, [((20, 0, True), (5, 0, True)), ((1, 0, True), (1, 0, True))]))
    row = sales.by_confidence(sales.sales_summary(df)).first()
    assert row["total_estimated_sales"] == 15
    assert row["by_confidence"] == {"high": 1, "medium": 1}


def catalog_rows(spark, entries):
    return spark.createDataFrame(
        entries, "id BIGINT, platform STRING, name STRING, brand STRING, category STRING, unit STRING"
    )


def test_upsert_catalog_last_wins_with_nulls(spark, rows):
    from basketlens.schemas import CATALOG

    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    old = spark.createDataFrame(
        [(5, "zepto", "p", "Old", "B", "c", None, "1 l", None, t0, t0)], CATALOG
    )
    batch = spark.createDataFrame(
        [("zepto", "p", "New", None, "c", None, None, None, t1, 1),
         ("zepto", "q", "first", "B", "c", None, None, None, t1, 1),
         ("zepto", "q", "second", "B", "c", None, None, None, t1, 2)],
        "platform STRING, platform_product_id STRING, name STRING, brand STRING, category STRING, "
        "subcategory STRING, unit STRING, image_url STRING, seen_at TIMESTAMP_NTZ, seq BIGINT",
    )
    out = tables.upsert_catalog(old, batch)
    got = {r["platform_product_id"]: r for r in out.collect()}
    assert (got["p"]["id"], got["p"]["name"], got["p"]["brand"], got["p"]["unit"]) == (5, "New", None, None)
    assert (got["p"]["first_seen_at"], got["p"]["last_seen_at"]) == (t0, t1)
    assert got["q"]["name"] == "second"
    again = tables.upsert_catalog(out, batch)
    assert rows(again) == rows(out)


def test_overwrite_partitions_keeps_the_others(spark, rows, tmp_path):
    path = str(tmp_path / "sales")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "v INT, d STRING")
    tables.overwrite_partitions(first, path, "d")
    tables.overwrite_partitions(spark.createDataFrame([(9, "b")], "v INT, d STRING"), path, "d")
    assert rows(spark.read.parquet(path), "v", "d") == [(1, "a"), (9, "b")]


def brute_percentile(values, p):
    values = sorted(values)
    at = (p / 100) * (len(values) - 1)
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (at - lo) * (values[hi] - values[lo])


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_grouped_percentiles_are_exact(spark, buckets):
    rng = random.Random(3)
    groups = {
        "even": [round(rng.uniform(1, 100), 2) for _ in range(500)],
        "hot": [10.0] * 300 + [round(rng.expovariate(0.01), 2) for _ in range(100)],
        "same": [4.0] * 9,
        "one": [3.5],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, v DOUBLE")
    points = stats.value_counts(df, ["g"], "v")
    percents = {"a": 33.33, "b": 66.67, "z": 100.0, "m": 0.0}
    got = {r["g"]: r for r in stats.grouped_percentiles(points, "g", "v", percents, buckets).collect()}
    for g, values in groups.items():
        for name, p in percents.items():
            assert got[g][name] == pytest.approx(brute_percentile(values, p)), (g, name)


def test_rank_levels_match_strictly_larger_count(spark, rows):
    counts = [("c", n) for n in (5, 3, 3, 1, 9)] + [("d", 2)]
    df = spark.createDataFrame(counts, "g STRING, n INT")
    want = sorted(
        {(g, n, 1 + sum(m > n for h, m in counts if h == g)) for g, n in counts}, key=repr
    )
    assert rows(stats.rank_levels(df, "g", "n")) == want


def test_whitespace_band_edges(spark):
    prices = [1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0]
    df = spark.createDataFrame([("c", "b", p) for p in prices], "category STRING, brand STRING, price DOUBLE")
    bands = {r["band"]: r for r in category.whitespace(df).collect()}
    assert len(bands) == 10 and sum(b["sku_count"] for b in bands.values()) == len(prices)
    width = (2.0 - 1.0) / 10
    for i in range(10):
        lo, hi = 1.0 + i * width, 1.0 + (i + 1) * width
        want = sum(lo <= p < hi or (i == 9 and p >= hi) for p in prices)
        assert bands[i]["sku_count"] == want, i


def test_histogram_of_equal_prices_is_zero(spark):
    df = spark.createDataFrame([("c", "b", 5.0)] * 3, "category STRING, brand STRING, price DOUBLE")
    row = brand.price_histogram(df).first()
    assert [row[f"bin{i}"] for i in range(8)] == [0] * 8
    label = brand.price_histogram(df).select(brand.histogram_labels()).first()[0]
    assert label[0] == "₹5–6"


# ------------------------------------------------------------------- similarity


def brute_top_k(queries, corpus, score, k, floor):
    out = set()
    for qid, qk, qv in queries:
        scored = [(-score(qv, cv), cid) for cid, ck, cv in corpus if ck == qk and score(qv, cv) >= floor]
        out |= {(qid, cid) for _, cid in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize(("hot", "block"), [(10_000, 1024), (0, 1024), (3, 5)])
def test_set_top_k_equals_brute_force(spark, hot, block):
    rng = random.Random(11)
    vocab = ["milk", "gold", "fresh", "1l"] + [f"w{i}" for i in range(30)]

    def docs(start, n):
        # A third of the rows share most of their tokens.
        return [
            (start + i, "hot" if i % 3 else "cold",
             sorted({"milk", "gold", *rng.sample(vocab, rng.randint(1, 4))} if i % 3 == 1
                    else set(rng.sample(vocab, rng.randint(1, 6)))))
            for i in range(n)
        ]

    queries, corpus = docs(0, 60), docs(1000, 50)
    schema = "id BIGINT, category STRING, features ARRAY<STRING>"
    both = [(*r, False) for r in queries] + [(*r, True) for r in corpus]
    ranked = sim.rarest_first(
        spark.createDataFrame(both, f"{schema}, is_anchor BOOLEAN"), ["category"]
    )
    got = sim.set_top_k(
        ranked.where("NOT is_anchor"), ranked.where("is_anchor"), ["category"],
        k=3, floor=0.4, hot=hot, block_rows=block,
    )

    def cosine(a, b):
        return len(set(a) & set(b)) / math.sqrt(len(a) * len(b))

    want = brute_top_k(queries, corpus, cosine, 3, 0.4)
    assert {(r["query_id"], r["corpus_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("block", [1024, 7])
def test_dense_top_k_with_copies(spark, block):
    rng = random.Random(5)

    def vecs(start, n):
        same = [rng.gauss(0, 1) for _ in range(8)]
        return [
            (start + i, "c", [float(x) for x in same] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)])
            for i in range(n)
        ]

    schema = "id BIGINT, category STRING, vec ARRAY<DOUBLE>"
    queries, corpus = vecs(0, 30), vecs(100, 40)
    got = sim.cosine_pairs(
        spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema), ["category"],
        floor=0.2, k=4, block_rows=block,
    )

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    want = brute_top_k(queries, corpus, cosine, 4, 0.2)
    assert {(r["query_id"], r["corpus_id"]) for r in got.collect()} == want


def test_hybrid_cells_and_lsh_recall(spark):
    rng = random.Random(9)
    rows = [
        (i, "c", [rng.gauss(0, 1) for _ in range(16)], {"a": 0.5, f"t{i % 4}": 0.5}) for i in range(80)
    ]
    df = spark.createDataFrame(rows, "id BIGINT, category STRING, vec ARRAY<DOUBLE>, weights MAP<STRING,DOUBLE>")
    q, c = df.where("id < 30"), df.where("id >= 30")
    pairs = sim.best_k(sim.cell_top_k(q, c, ["category"], sim.hybrid(0.7, 0.3), k=3, floor=0.0), 3)
    got = {(r["query_id"], r["corpus_id"]) for r in pairs.collect()}

    def score(a, b):
        dense = sum(x * y for x, y in zip(a[0], b[0])) / (math.hypot(*a[0]) * math.hypot(*b[0]))
        return 0.7 * dense + 0.3 * sum(w * b[1].get(t, 0.0) for t, w in a[1].items())

    flat = [(r[0], r[1], (r[2], r[3])) for r in rows]
    assert got == brute_top_k(flat[:30], flat[30:], score, 3, 0.0)

    exact = {(r[0], r[1]) for r in sim.cosine_pairs(q, c, ["category"], floor=0.0, k=5)
             .select("query_id", "corpus_id").collect()}
    near = {(r[0], r[1]) for r in sim.approximate_top_k(q, c, ["category"], dim=16, floor=0.0, k=5, tables=24)
            .select("query_id", "corpus_id").collect()}
    assert len(exact & near) / len(exact) > 0.8


# ---------------------------------------------------------------------- matching

LISTINGS = [
    (1, "blinkit", "Taaza Milk", "Amul", "Dairy", "500 ml"),
    (2, "blinkit", "Gold Milk", "Amul", "Dairy", "1 l"),
    (3, "zepto", "Taaza Milk", "Amul", "Dairy", "500ml"),
    (4, "zepto", "Gold Milk", "Amul", "Dairy", "500 ml"),
    (5, "instamart", "Taaza Milk", "Amul", "Dairy", "0.5 l"),
    (6, "zepto", "Taaza Milk", "Amul", "Dairy", "500 ml"),
    (7, "zepto", "Other", None, "Lone", None),
    (8, "instamart", "Other", None, "Lone", None),
]


def mrps(spark, values):
    return spark.createDataFrame(list(values.items()), "catalog_id BIGINT, mrp DOUBLE")


def test_copies_of_a_text_share_their_matches(spark, rows):
    df = catalog_rows(spark, LISTINGS)
    got = rows(matching.match_products(df, k=1), "query_id", "corpus_id", "rerank_score")
    assert [(q, c) for q, c, _ in got] == [(3, 1), (4, 1), (5, 1), (6, 1), (8, 7)]


def test_anchor_copies_are_expanded_in_id_order(spark, rows):
    copies = [(i, "blinkit", "Same", "B", "c", None) for i in range(10, 30)]
    df = catalog_rows(spark, copies + [(1, "zepto", "Same", "B", "c", None)])
    got = rows(matching.match_products(df, k=5), "query_id", "corpus_id", "rank")
    assert got == [(1, 10 + i, i + 1) for i in range(5)]


def test_assign_with_guards(spark, rows):
    df = catalog_rows(spark, LISTINGS)
    matches = spark.createDataFrame(
        [(3, 1, 0.95, 0), (4, 2, 0.9, 1), (5, 1, 0.85, 2), (6, 1, 0.79, 3), (8, 7, 0.9, 4)],
        "query_id BIGINT, corpus_id BIGINT, score DOUBLE, pos INT",
    )
    canonicals, mappings, counts = matching.assign_canonicals(
        df, matches, df, mrps(spark, {1: 30.0, 3: 30.0, 5: 70.0})
    )
    # 4 differs in size, 5 in MRP, 6 is below the threshold.
    want = [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)]
    assert rows(mappings, "catalog_id", "canonical_id") == want
    assert canonicals.count() == 6
    assert rows(counts) == [("Dairy", 5, 6, 3), ("Lone", 1, 2, 0)]
    assert [r["reject_reason"] for r in matching.match_guards(
        matching.best_match(matches), df, mrps(spark, {1: 30.0, 5: 70.0})
    ).orderBy("query_id").collect()] == [None, "unit mismatch", "MRP mismatch", None]


def test_mapped_anchor_founds_or_reuses(spark, rows):
    df = catalog_rows(spark, LISTINGS)
    existing = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "catalog_id BIGINT, canonical_id BIGINT, similarity_score DOUBLE")
    unmapped = df.where("id IN (3, 5)")
    matches = spark.createDataFrame([(3, 1, 0.95, 0), (5, 1, 0.95, 0)], "query_id BIGINT, corpus_id BIGINT, score DOUBLE, pos INT")
    none = mrps(spark, {99: 1.0})
    _, faithful, _ = matching.assign_canonicals(unmapped, matches, df, none)
    _, reused, _ = matching.assign_canonicals(unmapped, matches, df, none, existing=existing)
    assert rows(faithful, "catalog_id", "canonical_id") == [(3, 3), (5, 5)]
    assert rows(reused, "catalog_id", "canonical_id") == [(3, 3), (5, 1)]


def test_incremental_run_is_idempotent(spark):
    df = catalog_rows(spark, LISTINGS)
    empty = spark.createDataFrame([], "catalog_id BIGINT, canonical_id BIGINT, similarity_score DOUBLE")
    none = mrps(spark, {99: 1.0})
    _, first, _ = matching.incremental_normalize(df, empty, none, threshold=3)
    assert first.count() == 6
    _, second, _ = matching.incremental_normalize(df, first, none, threshold=3)
    assert second.count() == 0


def test_compare_matchers_counts_pairs(spark):
    df = catalog_rows(spark, LISTINGS)
    combos = {"tokens": {}, "one": {"k": 1}}
    got = {r["combo"]: r["num_scores"] for r in matching.compare_matchers(df, combos).collect()}
    assert got == {name: matching.match_products(df, **options).count() for name, options in combos.items()}


def test_compare_matchers_reports_failures_and_writes_pairs(spark, tmp_path):
    df = catalog_rows(spark, LISTINGS)
    broken = batch_scorer(lambda texts: 1 / 0, "array<double>")
    combos = {"while planned": {"floor": -1.0}, "while run": {"encoder": broken}, "good, one": {"k": 1}}
    got = {r["combo"]: r for r in matching.compare_matchers(df, combos, str(tmp_path)).collect()}
    assert "positive floor" in got["while planned"]["error"]
    assert "division by zero" in got["while run"]["error"]
    assert got["while planned"]["num_scores"] is None and got["while run"]["num_scores"] is None
    good = got["good, one"]
    assert good["error"] is None and good["elapsed_seconds"] > 0
    pairs = spark.read.parquet(str(tmp_path)).where("combo = 'good, one'")
    assert good["num_scores"] == pairs.count() == matching.match_products(df, k=1).count() > 0
    none = matching.compare_matchers(df.limit(0), {"tokens": {}}).first()
    assert (none["num_scores"], none["error"]) == (0, None)


def test_encoder_weights_rare_terms_and_unseen_ones(spark):
    texts = spark.createDataFrame(
        [(1, "amul milk"), (2, "amul butter"), (3, "amul milk"), (4, ""), (5, None)], "id long, text string"
    )
    idf = encoding.fit_idf(texts.where("id < 4"), ngram=0)
    assert idf.count() == 4
    got = {r["id"]: dict(zip(r["terms"], r["weights"])) for r in encoding.encode_texts(texts, idf, ngram=0).collect()}
    raw = {"amul": math.log(4 / 4) + 1, "milk": math.log(4 / 3) + 1, "butter": math.log(4 / 2) + 1}
    column = {w: int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % encoding.DIM for w in raw}
    for doc, words in {1: ("amul", "milk"), 2: ("amul", "butter"), 3: ("amul", "milk")}.items():
        norm = math.sqrt(sum(raw[w] ** 2 for w in words))
        assert got[doc] == pytest.approx({column[w]: raw[w] / norm for w in words})
    assert 5 not in got
    new = spark.createDataFrame([(9, "amul ghee")], "id long, text string")
    found = encoding.encode_texts(new, idf, ngram=0).first()
    unseen = math.log(4) + 1
    assert max(found["weights"]) == pytest.approx(unseen / math.sqrt(unseen**2 + 1))
    assert encoding.encode_texts(new.limit(0), idf, ngram=0).count() == 0


def test_choose_anchor_scan_order(spark, rows):
    df = catalog_rows(spark, [(1, "instamart", "a", None, "x", None), (2, "zepto", "b", None, "x", None)])
    assert rows(matching.choose_anchor(df, "scan"), "anchor") == [("instamart",)] * 2
    assert rows(matching.choose_anchor(df), "anchor") == [("zepto",)] * 2


def test_threshold_sweep_and_recommendation(spark):
    scored = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.82), (3, 11, 0.5)], "query_id INT, corpus_id INT, score DOUBLE")
    truth = spark.createDataFrame([(1, 10), (2, 11), (3, 11)], "query_id INT, corpus_id INT")
    sweep = audit.threshold_sweep(scored, truth, (0.4, 0.8, 0.85))
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in sweep.collect()}
    assert got == {0.4: (2, 1, 1), 0.8: (1, 1, 2), 0.85: (1, 0, 2)}
    best = audit.recommend_threshold(sweep, current=0.8).first()
    assert best["recommended"] == 0.4


def test_low_overlap_pairs_equal_the_full_join(spark, rows):
    rng = random.Random(2)
    platforms = ("blinkit", "zepto", "instamart")
    listings = [
        (i, platforms[rng.randrange(3)], f"n{rng.randrange(4)} x{rng.randrange(3)}", rng.choice(["B", None]), "c", None)
        for i in range(1, 120)
    ]
    maps = [(r[0], rng.randrange(12), rng.choice([1.0, 0.81, 0.9, 0.7])) for r in listings]
    catalog = catalog_rows(spark, listings)
    mappings = spark.createDataFrame(maps, "catalog_id BIGINT, canonical_id BIGINT, similarity_score DOUBLE")
    by_id = {r[0]: r for r in listings}
    first: dict = {}
    for o, oc, score in sorted(maps):
        for b, bc, _ in sorted(maps):
            if bc == oc and b != o and by_id[b][1] == "blinkit" and 0.8 <= score < 1.0:
                first.setdefault((oc, by_id[o][2]), (b, o))

    def text(r):
        return f"{r[3] or ''} {r[2]}".strip()

    want = []
    for (cluster, _), (b, o) in first.items():
        ta, tb = (set(text(by_id[i]).lower().split()) for i in (b, o))
        if len(ta & tb) / len(ta | tb) < 0.3:
            want.append((cluster, text(by_id[b]), text(by_id[o])))
    got = rows(audit.low_overlap_matches(mappings, catalog), "canonical_id", "blinkit", "other")
    assert got == sorted(want, key=repr)


def test_apply_verdicts_default(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "catalog_id_a INT, catalog_id_b INT")
    verdicts = spark.createDataFrame([(1, 2, False)], "catalog_id_a INT, catalog_id_b INT, is_match BOOLEAN")
    for default in (True, False):
        got = dict(audit.apply_verdicts(pairs, verdicts, default).select("catalog_id_b", "verified").collect())
        assert got == {2: False, 3: default}


def test_competitor_sample_is_the_first_n_of_others(spark, rows):
    rng = random.Random(4)
    entries = [(i, "zepto", f"p{i}", rng.choice(["A", "A", "A", "B", None]), "c", None) for i in range(60)]
    asked = spark.createDataFrame([("A", "c"), ("B", "c"), ("Z", "c")], "brand STRING, category STRING")
    got = rows(report.competitor_sample(asked, catalog_rows(spark, entries), n=5), "brand", "catalog_id")
    want = [(b, i) for b in "ABZ" for i in [r[0] for r in entries if r[3] != b][:5]]
    assert got == sorted(want, key=repr)


def test_report_lines_in_reading_order(spark, tmp_path):
    from basketlens.plans.bindings import RetailTables

    t = RetailTables(spark, "/root/testdata/sf0.001")
    asked = spark.createDataFrame([("Brand#4", "PROMO"), ("Nobody", "PROMO")], "brand STRING, category STRING")
    lines = report.report_lines(
        report.report_dataset(asked, t.catalog, t.latest, t.sales, t.canonicals, t.mappings)
    )
    report.write_reports(lines, str(tmp_path / "r"), "2026-03-28")
    folders = sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir())
    assert folders == ["slug=brand%234_promo_2026-03-28", "slug=nobody_promo_2026-03-28"]
    nobody = "".join(
        f.read_text() for f in sorted((tmp_path / "r" / folders[1]).iterdir()) if f.name.startswith("part")
    )
    assert "seen by **Nobody**, which lists nothing there yet" in nobody
    assert nobody.count("\n- ") > 50


def test_products_page_keyset_equals_offset(spark, rows):
    from basketlens.operators.catalog import products_page
    from basketlens.plans.bindings import RetailTables

    t = RetailTables(spark, "/root/testdata/sf0.001")
    first, total = products_page(t.catalog, t.obs, page=1, per_page=10)
    second, _ = products_page(t.catalog, t.obs, page=2, per_page=10)
    after = max(r["id"] for r in first.collect())
    keyset, _ = products_page(t.catalog, t.obs, per_page=10, after_id=after)
    assert rows(second) == rows(keyset)
    assert total.first()["total"] == t.catalog.agg(F.count(F.lit(1))).first()[0]
    with pytest.raises(ValueError):
        products_page(t.catalog, t.obs, page=1, per_page=101)


def test_task_functions_need_no_package_on_the_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    for scorer in (sim.dense_cosine, sim.SetScore(0.7, 0.3).block, sim.hybrid(0.7, 0.3)):
        task = cloudpickle.dumps(sim._cell_top_k(scorer, 3, 0.4))
        subprocess.run([sys.executable, "-c", code], input=task, cwd=tmp_path, check=True)


def test_a_sale_takes_the_first_reading_with_all_its_signals(spark):
    rows = [
        (1, 1, "p", "2024-01-01 08:00:00", "morning", 30, 1, True),
        (2, 1, "p", "2024-01-01 09:00:00", "morning", 40, 9, False),
        (3, 1, "p", "2024-01-01 20:00:00", "night", 20, 1, True),
    ]
    schema = (
        "id long, catalog_id long, pincode string, at string, time_of_day string,"
        " inventory_count int, max_cart_qty int, in_stock boolean"
    )
    obs = spark.createDataFrame(rows, schema).withColumn("observed_at", F.to_timestamp_ntz("at"))
    got = sales.daily_sales(obs).collect()
    assert [(r["morning_qty"], r["night_qty"], r["estimated_sales"]) for r in got] == [(30, 20, 10)]


def test_latest_reading_by_time_before_id(spark):
    rows = [(-5, 1, "2024-01-02", 2.0), (9, 1, "2024-01-01", 1.0), (7, 2, "2024-01-01", 3.0), (8, 2, "2024-01-01", 4.0)]
    obs = spark.createDataFrame(rows, "id long, catalog_id long, at string, price double").select(
        "*", F.to_timestamp_ntz("at").alias("observed_at")
    )
    df = catalog.latest_by_id(obs, ("price",))
    assert sorted(tuple(r) for r in df.collect()) == [(1, -5, 2.0), (2, 8, 4.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_hashing_scores_fewer_pairs_than_all(spark):
    """The pairs that meet in a bucket grow far less than with the square of the rows."""

    def meetings(n: int) -> int:
        rng = random.Random(3)
        rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, vec array<double>")
        keys = sim.lsh_keys(df, 16, tables=4, bits=sim.bits_for(n, 16))
        sizes = keys.groupBy("lsh_table", "lsh_bucket").count()
        return sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert meetings(1024) < 4 * 2 * meetings(256) < 4 * 256 * 256


def test_plain_notation_of_large_sizes(spark):
    got = spark.createDataFrame([("12345678.5 g",), ("0.0005 kg",)], "u string").select(normalize_unit("u"))
    assert [r[0] for r in got.collect()] == ["12345678.5g", "0.5g"]


def test_brands_without_price_have_zeros(spark):
    rows = [("c", "a", 1.0, 1.0), ("c", "a", 9.0, 9.0), ("c", "b", None, None)]
    priced = spark.createDataFrame(rows, "category string, brand string, price double, mrp double")
    got = {r["brand"]: r for r in brand.price_histogram(priced).collect()}
    assert sum(got["b"][f"bin{i}"] for i in range(8)) == 0 and sum(got["a"][f"bin{i}"] for i in range(8)) == 2
    tiers = {r["brand"]: (r["budget"], r["mid"], r["premium"]) for r in brand.mrp_tiers(priced).collect()}
    assert tiers == {"a": (1, 0, 1), "b": (0, 0, 0)}


def test_features_are_sent_as_codes_and_never_broadcast(spark, capsys):
    """One row a feature may be far more than the size of its documents tells; strings cost most."""
    rows = [(i, "c", ["milk", "#mil", "#ilk", f"w{i % 3}", f"#w{i}"], i > 9) for i in range(20)]
    schema = "id long, category string, features array<string>, is_anchor boolean"
    ranked = sim.rarest_first(spark.createDataFrame(rows, schema), ["category"])
    assert ranked.schema["ranked"].dataType.elementType["feature"].dataType.typeName() == "long"
    score = sim.SetScore(0.7, 0.3)
    found = sim.set_top_k(ranked.where("NOT is_anchor"), ranked.where("is_anchor"), ["category"], k=20, floor=0.45, score=score)
    for df in (ranked, sim._set_pairs(ranked, ranked, ["category"], 3, 0.8, score, 512, 1024)):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

    def cosine(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    def words(features):
        return {f for f in features if not f.startswith("#")}

    sets = {i: set(f) for i, _, f, _ in rows}
    want = {
        (q, c): 0.7 * cosine(sets[q], sets[c]) + 0.3 * cosine(words(sets[q]), words(sets[c]))
        for q in range(10) for c in range(10, 20)
    }
    got = {(r["query_id"], r["corpus_id"]): r["score"] for r in found.collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.45})


def test_settled_queries_leave_the_set_search(spark, monkeypatch):
    """Queries with k rows at a high floor go no further down, and no result changes."""
    words = lambda *w: list(w)
    corpus = [(i, "c", words("a", "b", "c", "d", f"x{i}")) for i in range(1, 5)] + [(9, "c", words("p", "y", "z"))]
    asked = [(20, "c", words("a", "b", "c", "d", "q")), (21, "c", words("p", "y", "w", "v")), (None, "c", words("p", "y"))]
    schema = "id long, category string, features array<string>"
    ranked = sim.rarest_first(
        spark.createDataFrame([(*r, True) for r in corpus] + [(*r, False) for r in asked], f"{schema}, is_anchor boolean"),
        ["category"],
    )
    sides = ranked.where("NOT is_anchor"), ranked.where("is_anchor")
    seen, search = [], sim._set_pairs

    def recorded(queries, corpus, keys, k, floor, *rest):
        seen.append((floor, sorted(r["id"] or 0 for r in queries.select("id").collect())))
        return search(queries, corpus, keys, k, floor, *rest)

    monkeypatch.setattr(sim, "_set_pairs", recorded)
    found = sorted(sim.set_top_k(*sides, ["category"], k=2, floor=0.4).collect(), key=repr)
    assert seen == [(0.8, [0, 20, 21]), (0.6, [0, 21]), (0.4, [0, 21])]
    monkeypatch.setattr(sim, "HIGH_FLOORS", ())
    assert sorted(sim.set_top_k(*sides, ["category"], k=2, floor=0.4).collect(), key=repr) == found
    assert [r["corpus_id"] for r in found if r["query_id"] == 20] == [1, 2]


def test_terms_are_counted_where_their_text_is(spark):
    from basketlens.operators import encoding

    texts = spark.createDataFrame([(1, "green tea green"), (2, "tea"), (3, "")], "id BIGINT, text STRING")
    counts = encoding.term_counts(texts, 3, 1 << 16)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id") >= 1 and ", term" not in "".join(
        part.split(")")[0] for part in plan.split("hashpartitioning(")[1:]
    )
    assert {r["id"] for r in counts.collect()} == {1, 2, 3}


def test_a_text_is_encoded_once(spark):
    from basketlens.functions import batch_scorer
    from basketlens.operators import matching

    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    rows = [(i, ("blinkit", "zepto")[i % 2], f"tea {i % 3}", "b", "c", "1 kg") for i in range(60)]
    df = spark.createDataFrame(rows, "id BIGINT, platform STRING, name STRING, brand STRING, category STRING, unit STRING")
    found = matching.match_products(df, encoder=batch_scorer(encode, "array<double>"), k=2)
    assert found.select("query_id").distinct().count() == 30
    assert seen.value == 3


def test_blocks_and_pairs_asked_for(spark, rows):
    sizes = spark.createDataFrame([(1,), (1024,), (16_384,), (100_000,), (200_000,)], "n BIGINT")
    blocks = [r[0] for r in sizes.orderBy("n").select(sim.blocks_of(F.col("n"))).collect()]
    assert blocks == [1, 1, 16, 16, 25]

    rng = random.Random(3)
    data = [(i, "ab"[i % 2], [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(data, "id BIGINT, label STRING, vec ARRAY<DOUBLE>")
    q, c = df.where("id < 30"), df.where("id >= 30")
    every = sim.cosine_pairs(q, c, ["label"], floor=0.1)
    asked = spark.createDataFrame(
        [(i, j) for i in range(0, 30, 4) for j in range(30, 60, 3)] * 2, "query_id BIGINT, corpus_id BIGINT"
    )
    got = sim.cosine_pairs(q, c, ["label"], floor=0.1, among=asked)
    rounded = [F.round("score", 9).alias("score")]
    want = every.join(asked.distinct(), ["query_id", "corpus_id"], "left_semi")
    assert rows(got, "query_id", "corpus_id", *rounded) == rows(want, "query_id", "corpus_id", *rounded) != []
    empty = asked.limit(0)
    assert sim.cosine_pairs(q, c, ["label"], floor=0.1, among=empty).count() == 0


def test_large_blocks_hand_on_k_with_ties_to_the_lower_id(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    sides = [pd.DataFrame({"id": rng.permutation(n), "vec": list(rng.integers(0, 3, (n, 3)) + 1.0)}) for n in (2500, 90)]
    q, c = sides
    found = sim._cell_top_k(lambda a, b: np.array(a["vec"].tolist()) @ np.array(b["vec"].tolist()).T, 4, 9.0)(q, c)
    scores = np.array(q["vec"].tolist()) @ np.array(c["vec"].tolist()).T
    want = set()
    for i, row in zip(q["id"], scores):
        best = sorted(zip(-row, c["id"]))[:4]
        want |= {(i, j, -s) for s, j in best if -s >= 9.0}
    assert set(found.itertuples(index=False, name=None)) == want and len(found) == len(want)


def test_report_sends_no_listings_through_the_driver(spark):
    from basketlens.operators import report

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    catalog = table(
        [(i, ("blinkit", "zepto")[i % 2], str(i), f"tea {i}", f"b{i % 3}", "c", "1 kg") for i in range(12)],
        "id BIGINT, platform STRING, platform_product_id STRING, name STRING, brand STRING, category STRING, unit STRING",
    )
    latest = table([(i, 1.0 + i, 2.0 + i, True) for i in range(12)], "catalog_id BIGINT, price DOUBLE, mrp DOUBLE, in_stock BOOLEAN")
    sales = table(
        [(i, "p", dt.date(2024, 1, 1), 9, 5, 4, "high", False) for i in range(12)],
        "catalog_id BIGINT, pincode STRING, sale_date DATE, morning_qty INT, night_qty INT, estimated_sales INT,"
        " confidence STRING, restock_flag BOOLEAN",
    )
    canonicals = table(
        [(i, f"tea {i}", f"b{i % 3}", "c", "1kg") for i in range(0, 12, 2)],
        "id BIGINT, canonical_name STRING, brand STRING, category STRING, unit_normalized STRING",
    )
    mappings = table([(i, i - i % 2, 0.9) for i in range(12)], "catalog_id BIGINT, canonical_id BIGINT, similarity_score DOUBLE")
    asked = canonicals.select("brand", "category").distinct()
    lines = report.report_lines(report.report_dataset(asked, catalog, latest, sales, canonicals, mappings))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashedRelationBroadcastMode(List(input[0, bigint" not in plan
    counts = {r["section"]: r["count"] for r in lines.groupBy("section").count().collect()}
    assert counts[2] == 3 + 12 and counts[6] == 3 + 3 * 12
