"""Language identification by words first, then shorter and shorter character n-grams.

Training counts the words of a bounded sample of labelled texts per language; the
n-grams come from the distinct words.  A known word is scored by its log frequency in
each language.  An unseen word is scored by its longest n-grams that are known at all,
backing off from ``longest`` characters to single ones.  A text's score is the sum over
its words plus the languages' log share; the result is the best language and its share
of probability.

Defined results: a null text, or one without a letter, gives ``und`` with score 0, and
so does any text if nothing could be learned; equal scores go to the language first in
the alphabet.  Whole texts are scored, one at a time, so very long ones need memory for
themselves only.  Training skips null texts, null labels and null ids.  Repeated rows
count as often as they occur.  Columns other than the named ones are passed on by
:func:`predict` and never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import top_n
from ..session import cut_lineage
from .common import sample_by_label, unpacked, whole_row

UNDETERMINED = "und"
#: Letters of any script, in runs; the same class in Spark's and Python's notation.
WORD = re.compile(r"[^\W\d_]+")
WORD_SPARK = r"\p{L}+"
#: Training rows per language, words and n-grams of the model, in equal parts for its
#: languages: they bound the broadcast.
SAMPLE_ROWS, MOST_WORDS, MOST_GRAMS = 4_000, 120_000, 120_000
LONGEST = 5
#: Scores of unseen words a worker remembers; the results do not depend on it.
WORDS_KEPT = 300_000


def grams(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def letters_only(counts: Counter) -> Counter:
    """Cut the few words at number signs such as superscripts, which WORD lets through."""
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


class Model:
    """Log probabilities of words and n-grams, one row of numbers per entry."""

    def __init__(self, words, pieces, shares: dict[str, int], longest: int) -> None:
        """words, pieces: rows (string, label, count)."""
        self.labels = sorted(shares)
        self.longest = longest
        total = sum(shares.values())
        self.prior = np.array([math.log(shares[k] / total) for k in self.labels])
        self.words = self._logs(words)
        self.pieces = {}
        for size in range(1, longest + 1):
            self.pieces |= self._logs([r for r in pieces if len(r[0]) == size])
        self.seen: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def _logs(self, rows) -> dict[str, tuple]:
        """Add-one-half smoothing over the entries of the table."""
        at = {label: i for i, label in enumerate(self.labels)}
        table: dict[str, list[float]] = {}
        sums = [0.0] * len(at)
        for entry, label, n in rows:
            table.setdefault(entry, [0.0] * len(at))[at[label]] += n
            sums[at[label]] += n
        rest = [math.log(s + 0.5 * len(table) + 1) for s in sums]
        return {
            k: tuple(math.log(c + 0.5) - r for c, r in zip(counts, rest))
            for k, counts in table.items()
        }

    def word_scores(self, word: str) -> tuple:
        scores = self.words.get(word) or self.seen.get(word)
        if scores is None:
            scores = self._backed_off(word)
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            if len(word) <= 40:
                self.seen[word] = scores
        return scores

    def _backed_off(self, word: str) -> tuple:
        for size in range(self.longest, 0, -1):
            found = [self.pieces[g] for g in grams(word, size) if g in self.pieces]
            if found:
                return tuple(sum(column) / len(found) for column in zip(*found))
        return (0.0,) * len(self.labels)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = letters_only(Counter(w.lower() for w in WORD.findall(text or "")))
        if not counts or not self.labels:
            return UNDETERMINED, 0.0
        rows = np.array([self.word_scores(w) for w in counts])
        scores = self.prior + np.array(list(counts.values()), dtype=float) @ rows
        best = int(np.argmax(scores))
        return self.labels[best], float(1.0 / np.exp(scores - scores[best]).sum())


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows_per_label: int = SAMPLE_ROWS,
    longest: int = LONGEST,
) -> Model:
    """Fit on a sample; words and n-grams are counted by Spark, their most frequent kept."""
    chosen = sample_by_label(labelled, id_col, text_col, label_col, rows_per_label)
    words = cut_lineage(
        chosen.select(
            "label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SPARK), F.lit(0)))
        )
        .groupBy("label", F.col("col").alias("entry"))
        .count()
    )
    pieces = cut_lineage(counted_grams(words, longest))
    shares = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
    return Model(
        most_frequent(words, MOST_WORDS, len(shares)), most_frequent(pieces, MOST_GRAMS, len(shares)), shares, longest
    )


def counted_grams(words: DataFrame, longest: int) -> DataFrame:
    """(label, entry, count) of the n-grams of the distinct words of every label."""
    marked = F.concat(F.lit("<"), F.col("entry"), F.lit(">"))

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (size - 1))
        return F.when(
            F.length(marked) >= size, F.transform(starts, lambda i: F.substr(marked, i, F.lit(size)))
        ).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[of_size(size) for size in range(1, longest + 1)])
    return words.select("label", F.explode(every).alias("entry")).groupBy("label", "entry").count()


def most_frequent(table: DataFrame, limit: int, labels: int) -> list[tuple[str, str, int]]:
    """The most frequent entries; every label has an equal part of ``limit``.

    Equal counts are taken in the order of the entries.
    """
    part = max(1, limit // max(1, labels))
    kept = top_n(table, ["label"], [F.desc("count"), F.col("entry")], part, "_at")
    return [(r["entry"], r["label"], r["count"]) for r in kept.collect()]


def predict(docs: DataFrame, model: Model, text: Column, lang_out: str, score_out: str) -> DataFrame:
    """Add the predicted language and its probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        found = [sent.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ],
            ["lang", "score"],
        )

    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    found = docs.select(whole_row(docs), guess(text).alias("guess"))
    new = {lang_out: F.col("guess.lang"), score_out: F.col("guess.score")}
    return unpacked(found, kept, **new)
