"""Profiling and data quality."""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.semantic import is_valid
from goldweave.operators.column_types import melt_strings

# Values longer than this are grouped by their SHA-256 instead of the text itself.
LONG_VALUE = 64


def _distinct_rows(df: DataFrame) -> DataFrame:
    """Number of distinct rows, through row digests, so that whole rows are not shuffled."""
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in df.columns]
    digest = F.sha2(F.to_json(F.array(*cells)), 256)
    return df.select(digest.alias("d")).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def table_summary(df: DataFrame, table: str, types: dict[str, str] | None = None,
                  checks: list[Column] | None = None) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency and their mean, all in [0, 1].

    ``types`` maps columns to semantic types; ``checks`` are cross-field predicates.
    An empty table yields nulls.
    """
    total = F.count(F.lit(1))
    non_null = reduce(lambda a, b: a + b, [F.count(c) for c in df.columns])
    typed = list((types or {}).items())
    valid = reduce(lambda a, b: a + b, [F.count_if(is_valid(F.col(c), t)) for c, t in typed], F.lit(0))
    typed_cells = reduce(lambda a, b: a + b, [F.count(c) for c, _ in typed], F.lit(0))
    passes = reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in checks or []], F.lit(True))
    counts = df.agg(total.alias("total_rows"), non_null.alias("filled"), valid.alias("valid"),
                    typed_cells.alias("typed_cells"), F.count_if(passes).alias("consistent"))
    joined = counts.withColumn("n_distinct", _distinct_rows(df).scalar())
    rows = F.nullif(F.col("total_rows"), F.lit(0))
    ratios = {
        "completeness": F.col("filled") / (rows * len(df.columns)),
        "uniqueness": F.col("n_distinct") / rows,
        "validity": F.when(rows.isNotNull(), F.coalesce(F.try_divide("valid", "typed_cells"), F.lit(1.0))),
        "consistency": F.col("consistent") / rows,
    }
    scored = joined.select(F.lit(table).alias("table"), "total_rows", *[v.alias(k) for k, v in ratios.items()])
    return scored.withColumn("dq_score", reduce(lambda a, b: a + b, [F.col(k) for k in ratios]) / 4)


def column_profile(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """One row per column: type, null percentage, distinct count and null severity.

    Exact mode groups ``(column, value)`` with map-side combine, so a value that fills a
    third of a column reaches the shuffle as one partial row per task. Approximate mode is
    one aggregate of sketches.
    """
    types = dict(df.dtypes)
    if approximate:
        measured = df.agg(F.count(F.lit(1)).alias("_rows"),
                          *[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)],
                          *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(df.columns)])
        cells = [F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("rows"),
                          F.col(f"n_{i}").alias("filled"), F.col(f"d_{i}").alias("distinct_count"))
                 for i, c in enumerate(df.columns)]
        per_column = measured.select(F.inline(F.array(*cells)))
    else:
        value = F.col("value")
        short = F.when(F.length(value) > LONG_VALUE, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)
        per_value = (melt_strings(df, df.columns).select("column_name", short.alias("value"))
                     .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        per_column = per_value.groupBy("column_name").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
            F.count("value").alias("distinct_count"))
    type_of = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    null_pct = (F.col("rows") - F.col("filled")) * 100.0 / F.col("rows")
    return per_column.select(F.lit(table).alias("table"), "column_name",
                             type_of[F.col("column_name")].alias("data_type"),
                             null_pct.alias("null_percentage"), "distinct_count",
                             null_severity(null_pct).alias("severity"))


def null_severity(percentage: Column) -> Column:
    """Above 20 is red, above 5 amber, else green."""
    return F.when(percentage > 20, "red").when(percentage > 5, "amber").otherwise("green")


def null_check(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(names)]
    return counted.select(F.inline(F.array(*cells)))


def email_check(df: DataFrame, column: str) -> DataFrame:
    ok = is_valid(F.col(column), "EMAIL")
    return df.agg(F.count(column).alias("checked"), F.count_if(ok).alias("valid"),
                  F.count_if(F.col(column).isNotNull() & ~ok).alias("invalid"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def shape_of(c: Column) -> Column:
    """Character shape: upper case → A, lower case → a, digit → 9, the rest as it is."""
    out = F.regexp_replace(c, "[A-Z]", "A")
    return F.regexp_replace(F.regexp_replace(out, "[a-z]", "a"), "[0-9]", "9")


def pattern_histogram(df: DataFrame, column: str) -> DataFrame:
    return (df.filter(F.col(column).isNotNull()).groupBy(shape_of(F.col(column)).alias("pattern"))
            .agg(F.count(F.lit(1)).alias("count")))


def sample_rows(df: DataFrame, id_column: str, percent: int = 20) -> DataFrame:
    """Repeatable row sample: rows whose id digest falls into the first ``percent`` of 100 bins."""
    digest = F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.filter(F.pmod(digest, F.lit(100)) < percent)


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


# Order statistics -----------------------------------------------------------

#: Accuracy of the sketches: a rank is known to one part in this many.
_ACCURACY = 100_000
#: Values between all brackets that may be fetched; where there are more, each rank is bracketed again.
_FETCHED = 100_000


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact interpolated quantiles in three scans, without sorting the column or gathering it in one buffer.

    One scan brackets all ranks by a percentile sketch, which combines per task; one counts the rows below and on
    all brackets exactly and finds the values next to them; one fetches the values strictly inside, a few
    parts in ``_ACCURACY`` of the rows, which the filter on the brackets picks in the scan. Where these are
    more than ``_FETCHED``, the ranks that lie there are bracketed further, one after the other.
    """
    x = F.col("x")
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    slack = 2 / _ACCURACY
    wanted = [min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-slack, slack)]
    n, sketched = values.agg(F.count("x"), F.percentile_approx("x", wanted, _ACCURACY)).first()
    if not n:
        return [None] * len(probabilities)
    brackets = sorted(set(zip(sketched[::2], sketched[1::2])))
    counts = values.agg(*[c for low, high in brackets for c in (
        F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high), F.count_if(x <= high),
        F.max(F.when(x < low, x)), F.min(F.when(x > high, x)))]).first()
    stats = {b: counts[6 * k:6 * k + 6] for k, b in enumerate(brackets)}
    inside = sum(max(s[2] - s[1], 0) for s in stats.values())
    between = F.lit(False)
    for low, high in brackets:
        between = between | ((x > low) & (x < high))
    fetched = sorted(r[0] for r in values.filter(between).collect()) if 0 < inside <= _FETCHED else []

    def at(rank: int, bracket: tuple[float, float]) -> float:
        (low, high), (below, upto, under, all_high, before, after) = bracket, stats[bracket]
        if below <= rank < upto:
            return low
        if rank == below - 1:
            return before
        if under <= rank < all_high:
            return high
        if rank == all_high:
            return after
        if upto <= rank < under and inside <= _FETCHED:
            return fetched[bisect.bisect_right(fetched, low) + rank - upto]
        least, most, many = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
        return _order_statistic(values, rank, least, most, many)

    out = []
    for p, bracket in zip(probabilities, zip(sketched[::2], sketched[1::2])):
        h = p * (n - 1)
        a, b = at(math.floor(h), bracket), at(min(math.ceil(h), n - 1), bracket)
        out.append(a + (b - a) * (h - math.floor(h)))
    return out


def _order_statistic(values: DataFrame, rank: int, low: float, high: float, n: int) -> float:
    """The value at the zero-based ``rank`` of ``n`` values from ``low`` to ``high``."""
    inside = values
    while low < high:
        share, slack = (rank + 0.5) / n, 2 / _ACCURACY + 1 / n
        low, high = inside.agg(F.percentile_approx(
            "x", [max(share - slack, 0.0), min(share + slack, 1.0)], _ACCURACY)).first()[0]
        x = F.col("x")
        below, upto, under = inside.agg(F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high)).first()
        if below <= rank < upto:
            return low
        if rank >= under:
            return high
        inside = inside.filter((x > low) & (x < high))
        rank, (low, high, n) = rank - upto, inside.agg(F.min("x"), F.max("x"), F.count("x")).first()
    return low


def outliers(df: DataFrame, column: str, method: str = "iqr", k: float = 1.5) -> DataFrame:
    """Rows outside the fences: quartiles ± k·IQR, or mean ± k standard deviations (``zscore``)."""
    x = F.col(column)
    if method == "iqr":
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
        if q1 is None:
            return df.filter(F.lit(False))
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    elif method == "zscore":
        mean, sd = df.agg(F.avg(x), F.stddev_samp(x)).first()
        if mean is None or sd is None:
            return df.filter(F.lit(False))
        low, high = mean - k * sd, mean + k * sd
    else:
        raise ValueError(f"unknown method {method!r}; known: iqr, zscore")
    return df.filter((x < low) | (x > high))
