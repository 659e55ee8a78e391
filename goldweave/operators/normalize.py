"""Header normalisation, alignment and the common predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the metadata columns.
INGEST_TIME = "_ingest_timestamp"
SOURCE = "_source_system"

SEPARATOR = "\u0001"


def header_names(columns: list[str]) -> list[str]:
    """Lower-case snake names; empty names become ``col_<position>``, repeats get ``_2``, ``_3``…"""
    out: list[str] = []
    for position, raw in enumerate(columns, start=1):
        base = re.sub(r"[^a-z0-9]+", "_", raw.strip().lower()).strip("_") or f"col_{position}"
        name, n = base, 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


def add_ingest_metadata(df: DataFrame, source_name: str) -> DataFrame:
    return df.withColumns({INGEST_TIME: F.current_timestamp(), SOURCE: F.lit(source_name)})


def align_union(frames: list[DataFrame], keep_all: bool = False) -> DataFrame:
    """Union by name over the common columns, in the order of the first frame.

    ``keep_all`` keeps every column and fills the missing ones with null.
    """
    if keep_all:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(DataFrame.unionByName, [f.select(*common) for f in frames])


def equals_ignoring_case(column: str | Column, value: str) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.lower(col) == F.lower(F.lit(value))


def contains_anywhere(term: str, columns: list[str]) -> Column:
    """True where any column contains ``term``, read literally and ignoring case."""
    joined = F.concat_ws(SEPARATOR, *[F.col(c).cast("string") for c in columns])
    return F.lower(joined).contains(term.lower())
