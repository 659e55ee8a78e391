"""Joins that stay balanced when one key holds a large share of the rows.

Two ways are used in this package. Where the rows per key are counted anyway, ``attach`` salts
the heavy keys. Elsewhere the joins have one row per key on their right side and leave a heavy
key to adaptive execution, which splits the left side of such a join at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may hold; a key with more is spread over as many tasks as it needs.
ROWS_PER_TASK = 1_000_000

# A salted key holds at least this share of all rows, so there are at most 1 / LEAST_SHARE of them and
# their list may be broadcast. A key below it is no larger than the tasks of a job with that many.
LEAST_SHARE = 1e-5


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(counts: DataFrame, key: str | list[str], rows: str = "n", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The heavy keys of a table of keys and their row counts, with the number of salts each needs (``_salts``)."""
    total = counts.agg(F.sum(rows)).scalar()
    heavy = (F.col(rows) > rows_per_task) & (F.col(rows) >= total * LEAST_SHARE)
    return counts.filter(heavy).select(*_names(key), F.ceil(F.col(rows) / rows_per_task).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], hot: DataFrame, spread: Column,
                how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` with the hot keys of ``left`` spread over as many sub-keys as ``hot`` says.

    Left rows of a hot key get a salt from the hash of ``spread``, which is stable under
    retries; the right rows of that key are repeated once per salt. Cold keys keep salt 0
    and one copy, so the extra volume is bounded by the right rows of the hot keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side is repeated, so only inner and left kinds keep their meaning")
    keys = _names(key)
    flagged = F.broadcast(hot.select(*keys, "_salts").dropDuplicates(keys))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    salted_left = left.join(flagged, keys, "left").withColumn("_salt", salt).drop("_salts")
    salted_right = right.join(flagged, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def attach(left: DataFrame, facts: DataFrame, key: str | list[str], spread: Column, rows: str = "n",
           how: str = "inner") -> DataFrame:
    """Join per-key facts back to the rows they were counted from, salting the heavy keys.

    ``facts`` has one row per key and the key's row count in ``rows``.
    """
    return salted_join(left, facts, key, hot_keys(facts, key, rows), spread, how)
