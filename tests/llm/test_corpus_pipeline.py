"""The pipeline's stages against brute force, odd rows and reruns; its parts new in n-gram join and quality."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens.llm import ngram_join, pii, quality
from basketlens.llm.bpe import read_ranks
from basketlens.llm.common import is_held_out
from basketlens.llm.queries import PII_KEY, QUALITY_FLOOR

SF_DIR = "/root/testdata/sf0.001"


def by_id(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """documents, then what each stage made of them, each written and read again."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, found[-1], SF_DIR).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_quality_stage_equals_plain_votes(spark, steps):
    docs, kept = by_id(steps[0]), by_id(steps[1])
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~is_held_out(F.col("doc_id"), 5, 0))
    model = quality.train(steps[0], labels)
    want = set()
    for doc, row in docs.items():
        counts = quality.term_counts((row["text"] or "").encode(), model.terms)
        v = np.log1p(counts) * model.idf
        v = (v / (np.linalg.norm(v) or 1)) @ model.base
        near = [float(np.dot(v / (np.linalg.norm(v) or 1), w)) for w in model.vectors]
        best = sorted(range(len(near)), key=lambda i: -near[i])[: quality.NEIGHBOURS]
        weights = [max(near[i], 0.0) ** quality.POWER for i in best]
        total = sum(weights)
        score = sum(w * model.labels[i] for w, i in zip(weights, best)) / total if total > 1e-9 else model.share
        if abs(score - QUALITY_FLOOR) < 1e-4:
            want.update({doc} & set(kept))
        elif score >= QUALITY_FLOOR:
            want.add(doc)
    assert set(kept) == want and all(kept[d] == docs[d] for d in kept)


def test_join_stage_keeps_one_of_each_group(steps):
    rows = by_id(steps[1])
    sets = {}
    for doc, row in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (row["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    posted = collections.defaultdict(list)
    for doc, grams in sets.items():
        for g in grams:
            posted[g].append(doc)
    shared = collections.Counter((a, b) for d in posted.values() for a in d for b in d if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert by_id(steps[2]) == {d: row for d, row in rows.items() if find(d) == d}


def test_contaminated_documents_go(spark, steps):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    def windows(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    wanted = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        words = terms(r["text"])
        n = min(10, len(words))
        if n:
            wanted[n] |= windows(words, n)
    clean = {
        d: row for d, row in by_id(steps[2]).items()
        if not any(windows(terms(row["text"]), n) & found for n, found in wanted.items())
    }
    assert by_id(steps[3]) == clean


def test_personal_data_can_be_restored(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    back = by_id(pii.restore(steps[4], PII_KEY))
    assert set(after) == set(before)
    assert all(back[d]["text"] == before[d]["text"] for d in before)
    assert any(after[d]["text"] != before[d]["text"] for d in before)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)


def test_tokens_and_the_whole_run(spark, steps):
    ranks = {t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))) if t}
    encoder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc, row in by_id(steps[4]).items():
        text = row["text"] or ""
        ids = encoder.encode_ordinary(text)
        want[doc] = {
            "doc_id": doc,
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    assert by_id(steps[5]) == want
    assert by_id(corpus_pipeline.run(spark, SF_DIR)) == want


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the input tables of a run; returns their folder."""

    def write(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_odd_rows_go_through(spark, tables):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).cache()
    columns = [f"CAST(NULL AS {t}) AS {c}" for c, t in docs.dtypes if c not in ("doc_id", "text")]
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, long), (-3, long), (None, None), (None, "")], "doc_id long, text string"
    ).selectExpr("doc_id", "text", *columns)
    rows = docs.unionByName(docs).unionByName(odd.select(docs.columns))
    names = ("row", "n", "_id", "_score", "covered", "spans", "found", "label", "root", "component", "tile", "map")
    folder = tables(rows.select("*", *[F.lit("x").alias(c) for c in names]))
    got = corpus_pipeline.run(spark, folder).collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    assert all(n == 1 for doc, n in ids.items() if doc is not None)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (-1, -2, None)} <= {0}


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, tables(docs)).count() == 0


# parts of the stages


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_sets_that_bitmaps_leave_a_partner(percent):
    """All linked pairs of different roots are found, none of one root or without side 1."""
    rng, np_rng = random.Random(percent), np.random.default_rng(percent)
    sets = []
    for n in (1, 2, 5, 15, 16, 17, 60, 300, 5_000):
        base = np_rng.integers(0, 2**64, n, dtype=np.uint64)
        for _ in range(6):
            gone = rng.randint(0, max(1, n // 4))
            new = np_rng.integers(0, 2**64, rng.randint(0, max(1, n // 6)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[min(gone, n - 1) :], new])))
    sets.sort(key=len)
    bits = [min(max(64, 1 << (4 * len(s)).bit_length()), ngram_join.LARGEST_MAP) for s in sets]
    maps = [ngram_join.parity_map(s, b).tobytes() for s, b in zip(sets, bits)]
    sizes = np.array([len(s) for s in sets])
    side = np.array([rng.randint(0, 1) for _ in sets])
    roots = np.array([rng.randint(0, 20) for _ in sets])
    found = ngram_join.partnered(sizes, maps, side, roots, percent)
    allowed = np.zeros(len(sets), dtype=bool)
    for i in range(len(sets)):
        for j in range(i):
            if roots[i] != roots[j] and side[i] + side[j]:
                allowed[[i, j]] = True
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= percent * (sizes[i] + sizes[j] - n):
                    assert found[i] and found[j]
    assert not (found & ~allowed).any()


def test_folded_maps_are_those_of_fewer_bits():
    grams = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    large = ngram_join.parity_map(grams, 4_096)[None]
    assert (ngram_join.folded(large, 256)[0] == ngram_join.parity_map(grams, 256)).all()


def test_nearest_takes_the_first_of_equal_ones():
    near = np.random.default_rng(2).integers(0, 4, (50, 40)).astype(np.float32)
    for k in (1, 7, 40):
        want = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :k], axis=1)
        assert (quality.nearest(near, k) == want).all()


def test_repeated_ids_are_one_row_of_the_sample(spark, monkeypatch):
    docs = spark.range(3_000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (0, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert len(model.vectors) == 3 and sorted(model.labels) == [0, 1, 1]
