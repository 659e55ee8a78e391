"""Incremental loads by a high-water mark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from goldweave.session import path_exists
from goldweave.sources.writers import merge_rows


def high_water_mark(target: DataFrame, column: str):
    """Largest mark loaded so far; answered from file statistics where the format has them."""
    return target.agg(F.max(column)).first()[0]


def newer_than(source: DataFrame, column: str, mark: Column | None) -> DataFrame:
    """Rows strictly above the mark; rows without a mark are never newer. Reaches the scan."""
    known = source.filter(F.col(column).isNotNull())
    return known if mark is None else known.filter(mark.isNull() | (F.col(column) > mark))


def incremental_rows(source: DataFrame, target: DataFrame | None, column: str, keys: list[str] | None = None,
                     lookback: Column | None = None) -> DataFrame:
    """The target after a load, as a plan: old rows and rows above the mark.

    ``lookback`` (an interval) re-reads a window below the mark and merges it by ``keys``, for
    sources whose rows arrive late; of several changes to one key the newest wins. A target
    that is empty or has no mark yet takes every row that has one.
    """
    if target is None:
        return newer_than(source, column, None)
    mark = target.agg(F.max(column)).scalar()
    if lookback is None:
        return target.unionByName(newer_than(source, column, mark).select(*target.columns))
    if not keys:
        raise ValueError("a load with lookback merges by key: keys are mandatory")
    changes = source.filter(F.col(column).isNotNull() & (mark.isNull() | (F.col(column) > mark - lookback)))
    return merge_rows(target, changes, keys, newest=column)


@dataclass
class LoadResult:
    mode: str
    loaded: int
    without_mark: int


def load_table(spark: SparkSession, source: DataFrame, path: str, load_type: str = "full",
               watermark_column: str | None = None) -> LoadResult:
    """Full (replace) or incremental (append above the mark) load into a parquet folder."""
    if load_type not in ("full", "incremental"):
        raise ValueError(f"unknown load type {load_type!r}; known: full, incremental")
    if load_type == "incremental" and not watermark_column:
        raise ValueError("an incremental load needs a watermark column")
    seen = Observation()
    if load_type == "full":
        source.observe(seen, F.count(F.lit(1)).alias("loaded")).write.mode("overwrite").parquet(path)
        return LoadResult("full", seen.get["loaded"], 0)
    mark = high_water_mark(spark.read.parquet(path), watermark_column) if path_exists(spark, path) else None
    without = source.filter(F.col(watermark_column).isNull()).count()
    rows = newer_than(source, watermark_column, None if mark is None else F.lit(mark))
    rows.observe(seen, F.count(F.lit(1)).alias("loaded")).write.mode("append").parquet(path)
    return LoadResult("incremental", seen.get["loaded"], without)
