"""Matching of precomputed vectors by cosine."""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.similarity import dot_product, norm
from goldweave.operators import block_pairs
from goldweave.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Unrelated vectors a bucket holds on average, at most.
PER_BUCKET = 4
#: Pairs drawn to estimate how often a pair at the minimum meets.
_DRAWN = 20_000
#: Vectors of a block at most where all pairs are compared.
BLOCK_ROWS = 32_768
#: Products of two components that take as long as one row written to a bucket and sorted into it.
_PRODUCTS = 32_000


def rotations(band: int, functions: int, dimensions: int) -> np.ndarray:
    """The random directions of a band, the same on every machine: ``functions`` sets of as many as dimensions."""
    return np.random.default_rng([band, functions, dimensions]).standard_normal((functions, dimensions, dimensions)).astype(np.float32)


def vertices(unit: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector and function of a band the nearest and second nearest vertex of the turned cross-polytope.

    A vertex is a direction and a sign, as one number.
    """
    turned = np.einsum("nd,fkd->nfk", unit, band, optimize=True)
    size = np.abs(turned)
    best = np.argpartition(-size, 1, axis=2)[:, :, :2] if turned.shape[2] > 1 else np.zeros((*turned.shape[:2], 2), np.int64)
    order = np.argsort(-np.take_along_axis(size, best, 2), axis=2, kind="stable")
    best = np.take_along_axis(best, order, 2)
    signed = best * 2 + (np.take_along_axis(turned, best, 2) < 0)
    return signed[:, :, 0], signed[:, :, 1]


def probes(first: np.ndarray, second: np.ndarray, dimensions: int) -> np.ndarray:
    """The buckets a vector looks into: its own, and those where one function gives the second nearest vertex."""
    weights = (2 * dimensions) ** np.arange(first.shape[1], dtype=np.int64)
    own = (first * weights).sum(axis=1)
    return np.column_stack([own, own[:, None] + (second - first) * weights])


@functools.lru_cache(maxsize=32)
def meeting_probability(minimum: float, functions: int, dimensions: int) -> float:
    """How often two vectors at the cosine ``minimum`` meet in a band, measured on drawn pairs."""
    rng, met = np.random.default_rng(7), 0
    for band in range(8):
        a = rng.standard_normal((_DRAWN // 8, dimensions))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = minimum * a + math.sqrt(max(1 - minimum * minimum, 0)) * b
        turn = rotations(band, functions, dimensions)
        seek, own = probes(*vertices(a, turn), dimensions), probes(*vertices(b, turn), dimensions)
        met += int(((seek == own[:, :1]) | (own == seek[:, :1])).any(axis=1).sum())
    return max(met, 1) / (_DRAWN // 8 * 8)


def plan_bands(rows: int, dimensions: int, minimum: float, recall: float) -> tuple[int, int]:
    """``bands, functions``: buckets of ``PER_BUCKET`` unrelated vectors at most, and as many bands as bring a pair at
    ``minimum`` together with probability ``recall``. No minimum is refused; a low one takes many bands."""
    functions = max(1, math.ceil(math.log(max(rows / PER_BUCKET, 1)) / math.log(max(2 * dimensions, 2))))
    meet = meeting_probability(minimum, functions, dimensions)
    return (1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))), functions


def _bucketed(distinct: DataFrame, bands: int, functions: int, dimensions: int) -> DataFrame:
    """``rep, band, bucket, own``: the bucket every vector stands in, and those it looks into besides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for batch in batches:
            if turns is None and batch.num_rows:
                turns = [rotations(b, functions, dimensions) for b in range(bands)]
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                unit = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                for band, turn in enumerate(turns):
                    seek = probes(*vertices(unit, turn), dimensions)
                    n, k = seek.shape
                    at = pa.array(np.repeat(np.arange(n), k))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("rep").take(at), pa.array(np.full(n * k, band, np.int32)), pa.array(seek.ravel()),
                         pa.array(np.tile(np.arange(k) == 0, n))], names=["rep", "band", "bucket", "own"])

    kind = distinct.schema["rep"].dataType.simpleString()
    return distinct.select("rep", "v").mapInArrow(run, f"rep {kind}, band int, bucket long, own boolean")


def all_in_blocks(rows: int, dimensions: int, bands: int, functions: int) -> bool:
    """Whether comparing all pairs of vectors is less work than writing every vector to the buckets of all bands."""
    return rows / 2 * dimensions <= _PRODUCTS * bands * (functions + 2)


def compared_pairs(distinct: DataFrame, minimum: float, rows: int, dimensions: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rep_a < rep_b, n_a, n_b, score``: all pairs with cosine ≥ ``minimum``, compared block by block (``block_pairs``).

    Single precision finds what may reach the minimum, double precision decides; only pairs that reach it
    leave the task, once each. What is shuffled are the vectors, once per block.
    """
    blocks = block_pairs.count_blocks(rows, block_rows)
    low = np.float32(minimum - 1e-5 - 1e-6 * dimensions)

    def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
        size = np.sqrt(np.einsum("nd,nd->n", v, v))
        return v, size, (v / size[:, None]).astype(np.float32), batch.column("node").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for block, some, own in block_pairs.meetings(batches, blocks):
            if block is not last:
                last, (v, size_v, unit_v, node_v) = block, vectors_of(block)
            w, size_w, unit_w, node_w = vectors_of(some)
            q, x = np.nonzero(unit_w @ unit_v.T >= low)
            if own:  # a block against itself: each pair once
                once = node_w[q] < node_v[x]
                q, x = q[once], x[once]
            for k in range(0, len(q), 65_536):
                i, j = q[k:k + 65_536], x[k:k + 65_536]
                score = np.einsum("nd,nd->n", w[i], v[j]) / (size_w[i] * size_v[j])
                reach = score >= minimum
                i, j = pa.array(i[reach]), pa.array(j[reach])
                yield pa.RecordBatch.from_arrays(
                    [some.column("rep").take(i), block.column("rep").take(j), some.column("n").take(i), block.column("n").take(j), pa.array(score[reach])],
                    names=["rep_1", "rep_2", "n_1", "n_2", "score"])

    kind = distinct.schema["rep"].dataType.simpleString()
    dealt = block_pairs.cells(distinct.select("node", "rep", "n", "v"), blocks)
    found = dealt.mapInArrow(run, f"rep_1 {kind}, rep_2 {kind}, n_1 long, n_2 long, score double").filter("rep_1 <> rep_2")
    first = F.col("rep_1") < F.col("rep_2")
    return found.select(F.least("rep_1", "rep_2").alias("rep_a"), F.greatest("rep_1", "rep_2").alias("rep_b"),
                        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
                        F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"), "score")


def bucket_pairs(distinct: DataFrame, minimum: float, recall: float, rows: int, dimensions: int) -> DataFrame:
    """``rep_a < rep_b``: the pairs that meet in some band, where one looks into the bucket the other stands in."""
    bands, functions = plan_bands(rows, dimensions, minimum, recall)
    placed = _bucketed(distinct, bands, functions, dimensions)
    seek = placed.select("band", "bucket", F.col("rep").alias("rep_s"))
    own = placed.filter("own").select("band", "bucket", F.col("rep").alias("rep_o"))
    # The bands multiply the vectors, which size estimates do not see: no side may be broadcast.
    met = seek.join(own.hint("merge"), ["band", "bucket"]).filter("rep_s <> rep_o")
    return met.select(F.least("rep_s", "rep_o").alias("rep_a"), F.greatest("rep_s", "rep_o").alias("rep_b")).distinct()


def vector_pairs(df: DataFrame, record_id: str, vector: str, minimum: float, recall: float = 0.999) -> DataFrame:
    """Pairs of distinct vectors with cosine ≥ ``minimum``, each found with probability ``recall`` at least.

    ``rep_a < rep_b`` are the smallest ids that carry the two vectors, ``n_a`` and ``n_b`` how
    many do, so copies are compared once. Buckets are the vertices of randomly turned cross-polytopes, of which a
    vector also probes its second nearest ones; ``plan_bands`` derives functions per band from
    the number of vectors and bands from the measured chance to meet and the recall. Only ids and buckets are joined;
    the vectors are fetched for the pairs that meet. Where the bands would be more work than comparing all pairs
    (``all_in_blocks``), all are compared, which finds every one. A zero vector has no cosine and no pairs, nor has
    one with a component that is no number; vectors of different lengths are not compared.
    """
    grouped = df.groupBy(F.col(vector).alias("v")).agg(F.min(record_id).alias("rep"), F.count(F.lit(1)).alias("n"))
    known = grouped.filter(F.col("v").isNotNull()).withColumn("norm", norm(F.col("v"))).filter("norm > 0 and not isnan(norm)")
    distinct, _ = materialise(known.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = distinct.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows")).collect()  # a row per length
    out = None
    for r in lengths or [None]:
        own = distinct.filter(F.size("v") == r["d"]) if r else distinct
        pairs = _pairs(own, minimum, recall, r["rows"] if r else 1, r["d"] if r else 1)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _pairs(distinct: DataFrame, minimum: float, recall: float, rows: int, dimensions: int) -> DataFrame:
    if all_in_blocks(rows, dimensions, *plan_bands(rows, dimensions, minimum, recall)):
        return compared_pairs(distinct, minimum, rows, dimensions)
    met = bucket_pairs(distinct, minimum, recall, rows, dimensions)
    for s in ("a", "b"):
        met = met.join(distinct.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "v", "n", "norm")]), f"rep_{s}")
    score = dot_product(F.col("v_a"), F.col("v_b")) / (F.col("norm_a") * F.col("norm_b"))
    return met.select("rep_a", "rep_b", "n_a", "n_b", score.alias("score")).filter(F.col("score") >= minimum)


def vector_band(score: Column, match: float, review: float) -> Column:
    return F.when(score >= match, "Match").when(score >= review, "Review").otherwise("No Match")
