"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.session import materialise

# Fixed value: upper-case A-Z to lower case, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_SLICE = 1 << 20


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    values = batch.column(column).cast(pa.large_binary()).to_pylist()
    return [v or b"" for v in values]


def slices(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about 1 MB that end at white space, so that splitting one never holds a huge list."""
    start = 0
    while len(text) - start > 2 * _SLICE:
        cut = _SPACE.search(text, start + _SLICE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def text_or_empty(column: str) -> Column:
    """The text, with the empty text for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def rank_of(value: Column, cuts: list[int], inclusive: bool = False) -> Column:
    """How many of the sorted ``cuts`` are below the value (or equal to it too), by bisection."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.lit([int(c) for c in cuts]).cast("array<long>")

    def further(low: Column, step: Column) -> Column:
        cut = F.get(table, low + step - 1)  # null beyond the end
        return F.when(cut <= value if inclusive else cut < value, low + step).otherwise(low)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` of every node with an edge (columns ``a``, ``b``); the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014). Both aggregate one minimum per node with map-side combine and
    join it back, one row per node on the right, so a hub is left to adaptive skew splitting. Each
    round is written to the shared folder. It ends when a round changes nothing; ``rounds`` bounds
    the loop (it raises, it never returns a partial result).
    """
    sums = {"checksum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    forest, seen = materialise(start, "stars", **sums)
    for _ in range(rounds):
        if not seen["rows"]:
            break
        after, now = materialise(_small_star(_large_star(forest)), "stars", **sums)
        if now == seen:
            break
        forest, seen = after, now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    leaves = forest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(forest.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
