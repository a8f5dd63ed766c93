"""Clusters, fill-in-the-middle and line rules against brute force and odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import clusters, fill_middle, language_id, line_rules, ngram_join, pii, queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("row", "n", "cuts", "base", "common", "code", "host", "output", "cluster", "v", "kept", "_salt", "cut")


def odd_documents(spark):
    text = " ".join(f"w{i % 70}" for i in range(90))
    rows = [
        (1, "a", text), (1, "a", text), (2, None, text + " more"), (3, "a", None), (4, "a", ""), (None, "b", text),
        (None, None, None), (5, "a", "\n".join(["word word word"] * 30_000)), (6, "a", " \t\n\n"),
        (7, "b", "x<P>y"), (8, "b", "\n"), (9, "b", "ß\n½ é\x0bz\r\nlast 😀"), (10, "c", "<"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in NAMES])


@pytest.mark.parametrize("name", ["op11_ns_bounds", "op12_fill_middle", "op13_line_rules"])
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    rel = connect(SF_DIR).execute(queries.SQL[name])
    want = [d[0] for d in rel.description], rel.fetchall()
    assert compare((df.columns, [tuple(r) for r in df.collect()]), want) is None


# 11 clusters


def lloyd(v: np.ndarray, first: np.ndarray, rounds: int):
    c = first.copy()
    for n in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        if n < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = v[at == j].sum(0) // (at == j).sum()
    return at, d.min(1), c


def blobs(n: int, dims: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 6, (12, dims))
    v = middles[rng.integers(0, 12, n)] + rng.normal(0, 0.7, (n, dims))
    v[::17] = np.round(v[::17])  # ties and equal vectors
    v[1::17] = v[0]
    return np.floor(256 * v.astype(np.float32).astype(float)).astype(np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_assign_equals_full_search_over_rounds(seed):
    v = blobs(600, 8, seed)
    if seed % 2:
        v //= 400  # small integers: many ties
    first = v[:30].copy()
    groups = clusters.groups_of(first)
    n = len(v)
    state = {
        "cluster": np.zeros(n, np.int32), "own": np.zeros(n, np.int64), "own_seen": np.zeros(n, np.int32),
        "lower": np.full((n, len(groups)), -np.inf), "lower_seen": np.zeros((n, len(groups)), np.int32),
    }
    history, work = first[None], []
    for _ in range(12):
        state = clusters.assign(v, state, history, groups)
        d = ((v[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (state["cluster"] == d.argmin(1)).all()
        work.append(int(state["scanned"].sum()))
        after = history[-1].copy()
        for j in range(30):
            if (state["cluster"] == j).any():
                after[j] = v[state["cluster"] == j].sum(0) // (state["cluster"] == j).sum()
        history = np.concatenate([history, after[None]])
    assert work[0] == n * 31 and work[-1] < work[0] / 2


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(40)]
    good += [(7, good[7][1]), (7, [0.0, 0.0, 0.0, -0.001]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [
        (90, None), (91, []), (92, [1.0, None, 1.0, 1.0]), (93, [1.0, float("nan"), 1.0, 1.0]),
        (94, [float("inf"), 1.0, 1.0, 1.0]), (95, [1.0] * 5),
    ]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit("x").alias(c) for c in NAMES if c != "row"])
    found, centroids = clusters.cluster(df, k=5, rounds=3, seed=2, dims=4)
    rows = found.collect()
    assert len(rows) == len(good)
    v = np.array([[int(np.floor(256 * x)) for x in e] for _, e in good])
    key = [hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in good]
    order = sorted(range(len(good)), key=lambda i: (key[i], v[i].tolist()))
    at, d, c = lloyd(v, v[order[:5]], 3)
    assert centroids.tolist() == c.tolist()
    want = sorted((str(i), e.tolist(), int(a), int(x)) for (i, _), e, a, x in zip(good, v, at, d))
    assert sorted((str(r["vec_id"]), list(r["v"]), r["cluster"], r["distance"]) for r in rows) == want


def test_clusters_of_few_large_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few, c = clusters.cluster(spark.createDataFrame([(1, [1.0]), (2, [5.0])], schema), dims=1)
    assert len(c) == 2 and sorted(r["distance"] for r in few.collect()) == [0, 0]
    none, c = clusters.cluster(spark.createDataFrame([(1, None)], schema), dims=1)
    assert len(c) == 0 and clusters.with_inertia(none, c).count() == 0
    far = spark.createDataFrame([(1, [400_000.0]), (2, [-400_000.0])], schema)
    assert {r["distance"] for r in clusters.cluster(far, k=1, rounds=1, dims=1)[0].collect()} == {(400_000 * 256) ** 2}
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(spark.createDataFrame([(1, [1e9])], schema), dims=1)[0].collect()


# 12 fill-in-the-middle


def test_skip_list_reaches_every_rank():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 64, 65, 1000):
        widths = np.array([rng.randint(1, 9) for _ in range(n)], np.int64)
        units = fill_middle.SkipList(widths)
        sums = np.concatenate([[0], np.cumsum(widths)])
        assert [units.before(r) for r in range(n + 1)] == sums.tolist()
    assert max(len(x[0]) for x in fill_middle.SkipList(np.ones(1000, np.int64)).lanes[-1:]) <= fill_middle.FAN


def test_lines_are_those_of_the_pattern():
    for text in ("", "\n", "a", "a\n", "a\nb", "\n\né😀\r\n\n", "😀" * 9 + "\n" + "x"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        found = fill_middle.lines_of(text)
        assert [found.before(r) for r in range(len(found) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


def plain_cut(doc_id, text, share, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_of_odd_texts(spark):
    docs = odd_documents(spark).union(
        spark.createDataFrame(
            [(100 + i, "s", "<P\n<" * (i % 5) + "S>M>" + "\nline é" * (i % 4)) for i in range(60)],
            "doc_id long, source string, text string",
        ).select("*", *[F.lit("x").alias(c) for c in NAMES])
    )
    for share in (100, 40):
        found = fill_middle.transform(docs, share=share)
        assert sorted(found.columns) == sorted({*docs.columns, "form", "prefix_chars", "middle_chars"})
        rows = found.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            got = (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
            assert got == plain_cut(r["doc_id"], r["text"], share, 50)
            assert r["again"] == (r["text"] or "")
        assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


# 13 line rules


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
    )


def normal(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line).lower()).strip(" ")


def plain_verdicts(rows, documents, share):
    texts, holders = collections.defaultdict(set), collections.defaultdict(set)
    for _, host, text in rows:
        if text is not None:
            texts[host].add(text)
            for line in text.split("\n"):
                holders[host, normal(line)].add(text)
    out = []
    for doc_id, host, text in rows:
        base = plain_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        lines = (text or "").split("\n")
        bad = [
            bool(normal(x)) and len(holders[host, normal(x)]) > documents
            and len(holders[host, normal(x)]) > share * len(texts[host]) for x in lines
        ]
        chars = sum(len(normal(x)) for x in lines)
        gone = sum(len(normal(x)) for x, b in zip(lines, bad) if b)
        cleaned = text if not gone else "\n".join(x for x, b in zip(lines, bad) if not b)
        out.append((doc_id, host, text, *base, failed, gone, not failed and chars - gone >= chars * 0.5, cleaned))
    return out


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars_removed", "kept", "cleaned")


@pytest.mark.parametrize("limit", [line_rules.BROADCAST_LIMIT, 0])
def test_line_rules_equal_plain_ones(spark, limit):
    rng = random.Random(5)
    rows = [tuple(r[:3]) for r in odd_documents(spark).collect()]
    for i in range(120):
        host = rng.choice(["big"] * 4 + [None, "small"])
        body = [" ".join(f"{rng.choice('abc#$')}{rng.randint(0, 300)}" for _ in range(rng.randint(5, 20))) for _ in range(6)]
        shared = [f"Subscribe  NOW {i}" if rng.random() < 0.5 else "plain footer", "\tAll rights\t reserved 2024 "]
        long_shared = [" ".join(["notice"] + [f"term{k}" for k in range(80)])] if rng.random() < 0.3 else []
        rows.append((1000 + i, host, "\n".join(body + shared + long_shared + rng.choices(body, k=2))))
    rows += rows[-30:] + [(5000 + i, "copies", "\n".join(f"only line {'abcdefgh'[k]} of this text" for k in range(8)) * 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in NAMES])
    found = line_rules.judged(df, documents=5, share=0.1, broadcast_limit=limit)
    got = [tuple(r) for r in found.select("doc_id", "source", "text", *FIGURES).collect()]
    want = plain_verdicts(rows, 5, 0.1)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[-2] and r[-3] for r in got) and any(not r[-2] and not r[-4] for r in got)
    assert all(r[-3] == 0 for r in got if r[1] == "copies")
    kept = line_rules.clean(df, documents=5, share=0.1, broadcast_limit=limit)
    assert kept.columns == df.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r[-1] for r in want if r[-2])


def test_line_rules_of_no_documents(spark):
    assert line_rules.judged(odd_documents(spark).limit(0)).count() == 0


def test_line_rules_run_without_python_workers(spark):
    plan = line_rules.judged(odd_documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# mended operators: n-grams of 1, long values of 3, tiles of 5


def test_counted_grams_are_those_of_the_distinct_words(spark):
    words = [("en", "bc", 3), ("en", "a", 1), ("en", "houses", 2), ("de", "über", 9), ("de", "bc", 1)]
    df = spark.createDataFrame(words, "label string, entry string, count long")
    got = {(r["label"], r["entry"]): r["count"] for r in language_id.counted_grams(df, 5).collect()}
    want = collections.Counter(
        (label, gram) for label, word, _ in words for size in range(1, 6) for gram in language_id.grams(word, size)
    )
    assert got == dict(want) and ("en", "<bc>") in got and ("de", "<über") in got


def test_a_rare_language_keeps_its_words(spark):
    rng = random.Random(2)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "äöüßé", "абвгд", "ежзий", "клмно", "прсту"]

    def word(alphabet):
        return "".join(rng.choices(alphabet, k=rng.randint(3, 7)))

    rows = [(i, " ".join(word(letters[i % 10]) for _ in range(30)), f"l{i % 10}") for i in range(2000)]
    rows += [(9000 + i, " ".join(word("фхцчш") for _ in range(3)), "rare") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = language_id.MOST_WORDS
    try:
        language_id.MOST_WORDS = 330
        model = language_id.train(df)
    finally:
        language_id.MOST_WORDS = words
    kept = collections.Counter()
    for entry in model.words:
        kept[max(entry) in "фхцчш"] += 1
    assert kept[True] == 30 and len(model.words) <= 330
    assert all(model.predict(" ".join(word("фхцчш") for _ in range(4)))[0] == "rare" for _ in range(50))
    assert all(model.predict(word(letters[i]) + " " + word(letters[i]))[0] == f"l{i}" for i in range(10))
    # equal counts are taken in the order of the entries
    ties = spark.createDataFrame([("a", x, 1) for x in "dbca"], "label string, entry string, count long")
    assert sorted(e for e, _, _ in language_id.most_frequent(ties, 2, 1)) == ["a", "b"]


LONG_VALUES = [
    "x " + "'" + "aB3/" * 2_500 + "' y",
    'key="' + "0123456789abcdef" * 700 + '"',
    'z="' + "Q1w+" * 250_000 + '==" end',
    "mail me@" + ("a1" * 20 + ".") * 400 + "example now",
    '"AKIA' + "A" * 16 + "/" + "b2" * 5_000 + '"',
]


def test_long_values_are_replaced_and_restored(spark):
    df = spark.createDataFrame(list(enumerate(LONG_VALUES)), "doc_id long, text string")
    there = pii.pseudonymize(df, b"k", spans_col="spans")
    rows = {r["doc_id"]: r for r in there.collect()}
    for i, text in enumerate(LONG_VALUES):
        new = rows[i]["text"]
        assert len(new) == len(text) and new != text and rows[i]["spans"]
        assert all(a == b for a, b in zip(new, text) if not a.isalnum())
    # a change at the end reaches the beginning, a value is the same in every text
    one, other = (pii.Pseudonyms(b"k").secret("aB3d" * 100 + c + "7") for c in "xy")
    assert one[:40] != other[:40]
    assert pii.Pseudonyms(b"k").secret("aB3d" * 100 + "x7") == one
    back = {r["doc_id"]: r["text"] for r in pii.restore(there.drop("spans"), b"k").collect()}
    assert back == dict(enumerate(LONG_VALUES))


def test_tiles_of_a_batch_tie_the_same_documents(spark):
    rng = np.random.default_rng(4)
    tiles, owners = rng.integers(0, 60, 400), rng.integers(1, 90, 400)
    made = ngram_join.combined(tiles.astype(np.int64), owners.astype(np.int64))
    assert max(collections.Counter(made[0].tolist()).values()) <= 2

    def parts(t, o):
        parent = {x: x for x in o.tolist()}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        first = {}
        for tile, owner in zip(t.tolist(), o.tolist()):
            a, b = root(first.setdefault(tile, owner)), root(owner)
            parent[max(a, b)] = min(a, b)
        return {x: root(x) for x in parent}

    assert parts(*made) == parts(tiles, owners)
    df = spark.createDataFrame(list(zip(tiles.tolist(), owners.tolist())), "tile long, doc_id long").repartition(3)
    edges = ngram_join.hung(df).collect()
    lowest = {t: min(o for x, o in zip(tiles, owners) if x == t) for t in set(tiles.tolist())}
    assert {(r["u"], r["v"]) for r in edges} == {(int(lowest[t]), int(o)) for t, o in zip(tiles.tolist(), owners) if o != lowest[t]}
