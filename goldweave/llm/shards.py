"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.common import text_or_empty
from goldweave.session import materialise

#: Rows permuted together: the size of a block before the exchange and of a run of slots after it.
ROWS_PER_BLOCK = 200_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def draw_hypergeometric(rng: random.Random, good: int, total: int, drawn: int) -> int:
    """How many of ``drawn`` rows, taken from ``total`` without replacement, are among the ``good``.

    Inverts the distribution outwards from its mode, so the steps are a few standard deviations
    whatever the counts.
    """
    low, high = max(0, drawn + good - total), min(drawn, good)
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    at = math.exp(_log_choose(good, mode) + _log_choose(total - good, drawn - mode) - _log_choose(total, drawn))
    left = rng.random() - at
    up, down, p_up, p_down = mode, mode, at, at
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (total - good - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(blocks: dict[int, int], capacities: list[int], seed: int) -> dict[int, list[int]]:
    """Rows each block sends to each shard: every block sends all it has, every shard fills exactly."""
    rng, free, matrix = random.Random(seed), list(capacities), {}
    for block, rows in sorted(blocks.items()):
        left, room, sent = rows, sum(free), []
        for shard, capacity in enumerate(free):
            take = draw_hypergeometric(rng, capacity, room, left) if left and capacity else 0
            sent.append(take)
            room -= capacity
            left -= take
            free[shard] -= take
        matrix[block] = sent
    return matrix


def shuffled(docs: DataFrame, n_shards: int = 16, seed: int = 17, id_column: str = "doc_id", text_column: str = "text",
             rows_per_block: int = ROWS_PER_BLOCK, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row; ``carry`` adds the row itself as ``row``.

    Rows fall into blocks by a random number that is written once, so that every later task sees
    the same. The counts from block to shard are drawn exactly from the multivariate
    hypergeometric law, which is what a uniform shuffle into shards of these sizes would send. Each
    block is permuted and cut by its counts, the rows go to their shards, and runs of slots
    are permuted again. Shard sizes differ by one row at most (law ``rows``); slots are gapless
    from 0. No task holds more than about ``rows_per_block`` rows; the driver sees a count per block.

    A null text has no bytes (size 1, CRC 0); null ids and repeated rows are rows like any other; an
    empty table gives no rows; other columns are only carried.
    """
    text = text_or_empty(text_column)
    kept = [F.struct("*").alias("row")] if carry else []
    drawn = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *kept,
        *[F.rand(seed + i).alias(name) for i, name in enumerate(("by_block", "first", "by_run", "second"))])
    rows, seen = materialise(drawn, "shard-rows")
    total = seen["rows"]
    n_blocks = max(1, -(-total // rows_per_block))
    rows = rows.withColumn("block", F.floor(F.col("by_block") * n_blocks).cast("int"))

    blocks = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    capacities = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(blocks, capacities, seed)
    ends = docs.sparkSession.createDataFrame(
        [(b, [sum(sent[:s + 1]) for s in range(n_shards)]) for b, sent in matrix.items()],
        "block int, ends array<long>")

    place = F.row_number().over(Window.partitionBy("block").orderBy("first", "second", "doc_id"))
    dealt = (rows.withColumn("place", place).join(ends, "block")
             .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("place"))).cast("int"))
             .drop("ends", "place", "block", "by_block", "first"))

    n_runs = max(1, -(-total // (n_shards * rows_per_block)))
    dealt = dealt.withColumn("run", F.floor(F.col("by_run") * n_runs).cast("int"))
    sizes = dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "run").orderBy("second", "by_run", "doc_id"))
    return (dealt.withColumn("inner", inner).join(starts, ["shard", "run"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("start") + F.col("inner") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    *(["row"] if carry else [])))
