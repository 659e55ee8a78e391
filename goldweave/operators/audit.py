"""Audit events and reports over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.operators.normalize import contains_anywhere

# Fixed value: columns of the audit table.
AUDIT_SCHEMA = "timestamp timestamp, user string, action string, module string, status string, details string"


def audit_events(df: DataFrame, at: Column, user: Column, action: Column, module: Column, status: Column,
                 details: Column) -> DataFrame:
    """Audit rows from a table of facts; a struct or map of details becomes JSON."""
    kind = df.select(details.alias("d")).schema["d"].dataType.typeName()
    text = F.to_json(details) if kind in ("struct", "map", "array") else details.cast("string")
    return df.select(at.alias("timestamp"), user.alias("user"), action.alias("action"), module.alias("module"),
                     status.alias("status"), text.alias("details"))


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def stage_event(spark: SparkSession, module: str, action: str, status: str, metrics: Mapping | None = None,
                user: str = "system") -> DataFrame:
    """One event for a finished stage, with its metrics as details."""
    row = spark.range(1).select(F.current_timestamp().alias("at"),
                                *[F.lit(v).alias(k) for k, v in (metrics or {}).items()])
    body = F.struct(*metrics) if metrics else F.lit(None).cast("string")
    return audit_events(row, F.col("at"), F.lit(user), F.lit(action), F.lit(module), F.lit(status), body)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, rows`` for each stage's output, one aggregate per stage."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
             for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(df: DataFrame, term: str | None = None, columns: list[str] | None = None, statuses: list[str] | None = None,
           start: str | None = None, end: str | None = None, time: str = "timestamp",
           status: str = "status") -> DataFrame:
    """Rows that contain the term, have one of the states, and lie within whole days
    ``start``..``end``. The date and status filters come first and reach the scan."""
    out = df
    if start:
        out = out.filter(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    if end:
        day_after = F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[time].dataType)
        out = out.filter(F.col(time) < day_after)
    if statuses:
        out = out.filter(F.lower(F.col(status)).isin(*[s.lower() for s in statuses]))
    if term:
        out = out.filter(contains_anywhere(term, columns or df.columns))
    return out


def latest_first(df: DataFrame, time: str, record_id: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(record_id))


def audit_kpis(df: DataFrame, status: str = "status", user: str = "user",
               success: tuple[str, ...] = ("success",), flags: tuple[str, ...] = ("warning", "failed")) -> DataFrame:
    """Events in all, percentage of successes, flagged events, active users."""
    s = F.lower(F.col(status))
    per_user = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.count_if(s.isin(*success)).alias("ok"),
                                    F.count_if(s.isin(*flags)).alias("flagged"))
    return per_user.agg(F.sum("n").alias("total_events"),
                        (F.sum("ok") * 100.0 / F.nullif(F.sum("n"), F.lit(0))).alias("health"),
                        F.sum("flagged").alias("flags"), F.count(user).alias("active_users"))


def daily_activity(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.window(time, "1 day").start.cast("date").alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("events"))
