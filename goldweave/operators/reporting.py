"""Executive reports and latest-row queries over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.operators.normalize import equals_ignoring_case
from goldweave.operators.survivorship import descending, percent_trust, trust_level

# Days per window of the time selector.
TIME_WINDOWS = {"7 days": 7, "30 days": 30, "quarter": 90, "year": 365}


def monthly_average(df: DataFrame, time: str, value: str, name: str) -> DataFrame:
    return df.groupBy(F.date_trunc("month", time).cast("date").alias("month")).agg(F.avg(value).alias(name))


def counts_by_month(df: DataFrame, time: str, kind: Column, kinds: list[str]) -> DataFrame:
    """One row per month, one count column per kind."""
    tagged = df.select(F.date_trunc("month", time).cast("date").alias("month"), kind.alias("kind"))
    return tagged.groupBy("month").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, variable, value)


def risk_counts(df: DataFrame, category: Column, severity: Column) -> DataFrame:
    return df.groupBy(category.alias("category"), severity.alias("severity")).agg(F.count(F.lit(1)).alias("risks"))


def source_coverage(df: DataFrame, source: str, trust_percent: Column) -> DataFrame:
    """Records, trust and trust level per source."""
    return (df.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.max(trust_percent).alias("trust_percent"))
            .withColumns({"trust": percent_trust(F.col("trust_percent")),
                          "level": trust_level(F.col("trust_percent"))}))


def er_kpis(records: DataFrame, cluster: str, value: str, time: str) -> DataFrame:
    """Records governed, golden consistency, duplicate risk and records per hour.

    Consistency is the share of clusters whose ``value`` does not vary; duplicate risk is the
    share of records beyond the first of their cluster.
    """
    per_cluster = records.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("same"),
        F.min(time).alias("t0"), F.max(time).alias("t1"))
    hours = F.timestamp_diff("SECOND", F.min("t0"), F.max("t1")) / 3600.0
    total, clusters = F.sum("n"), F.count(F.lit(1))
    return per_cluster.agg(total.alias("records_governed"), (F.count_if("same") / clusters).alias("golden_consistency"),
                           ((total - clusters) / total).alias("duplicate_risk"),
                           (total / F.nullif(hours, F.lit(0.0))).alias("records_per_hour"))


def hourly_throughput(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.window(time, "1 hour").start.alias("hour")).agg(F.count(F.lit(1)).alias("records"))


def within_window(df: DataFrame, time: str, window: str, until: Column) -> DataFrame:
    """Rows of the last days before ``until``."""
    if window not in TIME_WINDOWS:
        raise ValueError(f"unknown window {window!r}; known: {sorted(TIME_WINDOWS)}")
    start = F.date_sub(until.cast("date"), TIME_WINDOWS[window]).cast(df.schema[time].dataType)
    return df.filter((F.col(time) >= start) & (F.col(time) <= until))


# Keyed tables ---------------------------------------------------------------

def latest_per_key(df: DataFrame, key: str, time: str, record_id: str) -> DataFrame:
    """The newest row per key; ties go to the smallest id. Combined map-side, no window sort."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(time), descending(df, record_id).alias("id")))
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in others])


def latest_overall(df: DataFrame, time: str, record_id: str) -> DataFrame:
    """The newest row of a table (a top-1 query)."""
    return df.orderBy(F.col(time).desc(), F.col(record_id)).limit(1)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def exists_ignoring_case(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Number of rows whose columns equal the given values, ignoring case."""
    out = df
    for column, value in conditions.items():
        out = out.filter(equals_ignoring_case(column, value))
    return out.agg(F.count(F.lit(1)).alias("matches"))


def rows_of_owner(df: DataFrame, owner: str, value, time: str, record_id: str) -> DataFrame:
    """One owner's rows, newest first."""
    return lookup(df, owner, value).orderBy(F.col(time).desc(), F.col(record_id))
