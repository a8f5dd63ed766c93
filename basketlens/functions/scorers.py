"""Hook for user models, and the built-in text features.

A model is any ``pandas -> pandas`` function; Spark feeds it Arrow batches, so a
GPU or ONNX encoder sees whole batches and never single rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def batch_scorer(fn: Callable, return_type: str) -> Callable[..., Column]:
    """Wrap a vectorised function (Series in, Series out) as a column function."""
    return F.pandas_udf(fn, return_type)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row: a lambda computes what it mentions
    from outside again for each of its elements."""
    return F.get(F.transform(F.array(value), use), 0)


def text_features(text, ngram: int = 0) -> Column:
    """Distinct tokens of a text, plus character n-grams when ``ngram`` > 0."""
    words = tokens(text)
    if not ngram:
        return words

    def grams(flat: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(flat) - (ngram - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit("#"), F.substring(flat, i, ngram)))

    return once(words, lambda w: F.array_distinct(F.concat(w, once(F.concat_ws(" ", w), grams))))


def hashed_counts(text, dim: int = 64) -> Column:
    """Words of a text counted in ``dim`` hashed columns; a vector without a model."""
    bucket = F.transform(
        F.split(F.lower(text), " "),
        lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dim,
    )
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return once(
        bucket,
        lambda found: F.transform(places, lambda j: F.size(F.filter(found, lambda b: b == j)).cast("double")),
    )


def weight_vector(text) -> Column:
    """Sparse lexical weights token -> 1/sqrt(#tokens) (unit length), as a map."""
    words = tokens(text)
    weight = 1.0 / F.sqrt(F.size(words).cast("double"))
    return F.map_from_arrays(words, F.transform(words, lambda _: weight))
