"""All pairs of the rows of a table, block against block, so that no task holds more than a block of it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Blocks a small table is cut into, to give every core some, and the rows of a block at least.
_BLOCKS, _LEAST_ROWS = 12, 1_024


def count_blocks(rows: int, block_rows: int) -> int:
    """Blocks of ``block_rows`` rows at most."""
    return max(-(-rows // min(max(rows // _BLOCKS, _LEAST_ROWS), block_rows)), 1)


def cells(df: DataFrame, blocks: int) -> DataFrame:
    """``df`` dealt into ``blocks`` by a hash of its unique number ``node``: a cell for each pair of blocks.

    In the cell of two blocks the rows of the earlier one have role 0, those of the later one role 1; a block against
    itself has its rows in both. Rows come once per block, sorted by cell and role.
    """
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    earlier = F.transform(F.sequence(block, F.lit(blocks - 1)), lambda k: F.struct(F.lit(0).alias("role"), (block * blocks + k).alias("cell")))
    later = F.transform(F.sequence(F.lit(0), block), lambda k: F.struct(F.lit(1).alias("role"), (k * blocks + block).alias("cell")))
    placed = df.select("*", F.inline(F.concat(earlier, later)))
    return placed.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell", "role")


def meetings(batches: Iterator[pa.RecordBatch], blocks: int, rows: int = 1_024) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch, bool]]:
    """The rows of role 0 of a cell, some rows of role 1, and whether the cell holds one block only."""
    cell, held, block = None, [], None
    for batch in batches:
        of, roles = (batch.column(c).to_numpy() for c in ("cell", "role"))
        cuts = ((of[1:] != of[:-1]) | (roles[1:] != roles[:-1])).nonzero()[0] + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
            if start == end:
                continue
            if of[start] != cell:
                cell, held, block = int(of[start]), [], None
            if roles[start] == 0:
                held.append(batch.slice(start, end - start))
            elif held:
                block = block or pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                for at in range(start, end, rows):
                    yield block, batch.slice(at, min(rows, end - at)), cell // blocks == cell % blocks
