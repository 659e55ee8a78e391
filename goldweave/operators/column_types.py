"""Semantic type of whole columns, and the report of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from goldweave.functions.semantic import infer_type, registry_frame


def melt_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value)`` rows in one pass over the input."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def type_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, type_name, matched, non_null, share`` for every type seen in a column.

    The type is inferred before grouping, so only (column, type) pairs reach the shuffle.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    cells = melt_strings(df, names).filter(F.col("value").isNotNull())
    hits = (cells.select("column_name", infer_type(F.col("value")).alias("type_name"))
            .groupBy("column_name", "type_name").agg(F.count(F.lit(1)).alias("matched")))
    # A column has at most one row per known type and one for the rest.
    non_null = F.sum("matched").over(Window.partitionBy("column_name"))
    return (hits.withColumn("non_null", non_null).filter(F.col("type_name").isNotNull())
            .withColumn("share", F.col("matched") / F.col("non_null")))


def infer_column_types(df: DataFrame, threshold: float = 0.8, columns: list[str] | None = None) -> DataFrame:
    """The winning type per column, where its share reaches ``threshold``."""
    best = F.min_by(F.struct("type_name", "matched", "non_null", "share"),
                    F.struct((-F.col("matched")).alias("w"), F.col("type_name")))
    return (type_shares(df, columns).groupBy("column_name").agg(best.alias("b"))
            .select("column_name", "b.*").filter(F.col("share") >= threshold))


def pii_report(df: DataFrame, threshold: float = 0.8, columns: list[str] | None = None) -> DataFrame:
    """Columns whose inferred type is personal data."""
    types = F.broadcast(registry_frame(df.sparkSession))  # six rows by definition
    return (infer_column_types(df, threshold, columns).join(types, "type_name")
            .filter("is_pii").select("column_name", "type_name", "description", "share"))
