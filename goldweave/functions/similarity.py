"""String and vector similarity."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the code of this module with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the Jaro-Winkler measure.
PREFIX_WEIGHT = 0.1
MAX_PREFIX = 4
BOOST_ABOVE = 0.7


def edit_similarity(a: Column, b: Column) -> Column:
    """1 − distance / longer length; null if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))


def dot_product(a: Column, b: Column) -> Column:
    """Dot product of two float arrays of equal length, in doubles."""
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    flat = np.array([t.ljust(width, "\0") for t in texts], dtype=f"<U{width}")
    return flat.view(np.uint32).reshape(len(texts), width), lengths


def jaro_winkler_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Scores of a batch of pairs, position by position over all pairs at once."""
    a, len_a = _codes(left)
    b, len_b = _codes(right)
    rows = np.arange(len(left))
    at = np.arange(b.shape[1])[None, :]
    window = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)[:, None]
    free = at < len_b[:, None]
    hit_a = np.zeros(a.shape, dtype=bool)
    hit_b = np.zeros(b.shape, dtype=bool)
    for i in range(a.shape[1]):
        same = (b == a[:, i:i + 1]) & free & (np.abs(at - i) <= window) & (i < len_a)[:, None]
        spot = same.argmax(axis=1)
        got = same[rows, spot]
        hit_a[got, i] = True
        hit_b[got, spot[got]] = True
        free[got, spot[got]] = False
    m = hit_a.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    seq_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable"), axis=1)[:, :width]
    seq_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable"), axis=1)[:, :width]
    half = ((seq_a != seq_b) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    some = m > 0
    ms = np.where(some, m, 1)
    jaro = np.where(some, (m / np.maximum(len_a, 1) + m / np.maximum(len_b, 1) + (ms - half) / ms) / 3, 0.0)
    span = min(MAX_PREFIX, width)
    equal = (a[:, :span] == b[:, :span]) & (np.arange(span)[None, :] < np.minimum(len_a, len_b)[:, None])
    prefix = np.cumprod(equal, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + PREFIX_WEIGHT * prefix * (1 - jaro), jaro)


_CELLS, _PART = 4_000_000, 4096


@F.pandas_udf(DoubleType())
def jaro_winkler(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Jaro-Winkler of two text columns; null if either side is null."""
    for a, b in batches:
        out = np.full(len(a), np.nan)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        # equal pairs of a batch are scored once
        (at_a, texts_a), (at_b, texts_b) = (pd.factorize(c.iloc[known]) for c in (a, b))
        pairs, place = np.unique(at_a * max(len(texts_b), 1) + at_b, return_inverse=True)
        left, right = (list(texts[at]) for texts, at in zip((texts_a, texts_b), np.divmod(pairs, max(len(texts_b), 1))))
        scores = np.empty(len(pairs))
        size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), dtype=np.int64, count=len(pairs))
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):  # parts of similar length, so padding and memory stay small
            part = order[start:start + _PART]
            part = part[:max(1, _CELLS // max(1, int(size[part[-1]])))]
            scores[part] = jaro_winkler_batch([left[i] for i in part], [right[i] for i in part])
            start += len(part)
        out[known] = scores[place]
        yield pd.Series(out).astype(object).where(~np.isnan(out), None)


# Otherwise a filter on the score would be pushed below and compute every score twice.
jaro_winkler = jaro_winkler.asNondeterministic()
