"""File sinks: full, append, replace, upsert, partitioned publishing, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from goldweave.session import discard, materialise, path_exists

# What the publishing form offers.
FORMATS = ("parquet", "csv", "json")
CODECS = ("snappy", "gzip", "lz4", "none")


def publish(df: DataFrame, path: str, fmt: str = "parquet", codec: str = "snappy",
            partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write files in a format and compression, optionally partitioned.

    The rows of a partition value are brought together before they are written, a value with many
    rows in several files: adaptive execution splits it. ``day:column`` partitions by the day of a
    timestamp, in a column ``column_day``.
    """
    fmt, codec = fmt.lower(), codec.lower()
    if fmt == "delta":
        raise ValueError("delta needs a table format library that is not on the class path")
    if fmt not in FORMATS or codec not in CODECS:
        raise ValueError(f"unknown format {fmt!r} or codec {codec!r}; known: {FORMATS}, {CODECS}")
    if fmt == "parquet" and codec == "lz4":
        codec = "lz4_raw"
    options = {"compression": codec}
    if fmt == "csv":
        options.update(header="true", quote='"', escape='"')
    names = [p.removeprefix("day:") + "_day" if p.startswith("day:") else p for p in partition_by or []]
    if names:
        days = {n: F.to_date(p.removeprefix("day:")) for n, p in zip(names, partition_by) if p.startswith("day:")}
        df = (df.withColumns(days) if days else df).hint("rebalance", *names)
    writer = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*names)
    writer.save(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Golden records as CSV, written by the tasks, never through the driver."""
    publish(df, path, "csv", "none", mode=mode)


def full_load(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate_and_load(df: DataFrame, path: str) -> None:
    full_load(df, path)


def merge_rows(target: DataFrame, changes: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Target rows whose key does not change, and the changed rows.

    Keys must be unique in ``changes``; with ``newest`` the last row per key is taken first.
    """
    if newest:
        others = [c for c in changes.columns if c not in keys]
        best = F.max_by(F.struct(*others), F.struct(newest, *[c for c in others if c != newest]))
        changes = changes.groupBy(*keys).agg(best.alias("_b")).select(
            *keys, *[F.col(f"_b.{c}").alias(c) for c in others])
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*target.columns))


#: Partition column of a keyed table: how many buckets it has, and which one a row's key falls into.
BUCKET = "key_bucket"
#: Bytes a bucket is meant to hold; a table with more than twice as many a bucket is dealt into more of them.
BUCKET_BYTES = 256 << 20


def _bytes(df: DataFrame) -> int:
    """Size of the files a DataFrame reads, from their listing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.concat(F.lit(f"{buckets}-"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a keyed table."""
    if not path_exists(spark, root):
        raise ValueError(f"no table at {root}")
    return spark.read.parquet(root).drop(BUCKET)


def upsert(changes: DataFrame, root: str, keys: list[str], newest: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Merge changes into a keyed table, a plain Parquet table partitioned by a bucket of its key.

    Only the partitions that hold a changed key are read and, from a staged copy, replaced by Spark's dynamic
    partition overwrite; returns how many. The number of buckets follows from bytes: a table that has grown beyond
    twice ``bucket_bytes`` a bucket is dealt anew, so the cost of that is spread over its growth. With ``newest`` the
    largest value of that column wins among old and new rows of a key, so a replayed or late batch changes
    nothing, also after a run that died between partitions; without it the changes win and must have unique
    keys. One writer at a time.
    """
    spark = changes.sparkSession
    changes, seen = materialise(changes, "upsert")
    if not seen["rows"]:
        return 0
    exists = path_exists(spark, root)
    table = spark.read.schema(StructType([*changes.schema.fields, StructField(BUCKET, StringType())])).parquet(root) if exists else None
    first = table.select(BUCKET).first() if exists else None
    buckets = int(first[0].split("-")[0]) if first else 0
    size = _bytes(changes) + (_bytes(table) if first else 0)
    grown = size > 2 * bucket_bytes * max(buckets, 1) or not buckets
    if grown:
        buckets = 1 << max(size // bucket_bytes, 1).bit_length() - 1
    touched = [r[0] for r in changes.select(_bucket(keys, buckets)).distinct().collect()]  # one per partition at most
    old = changes.filter(F.lit(False)) if not first else (table if grown else table.filter(F.col(BUCKET).isin(touched))).drop(BUCKET)
    merged = (merge_rows(changes.filter(F.lit(False)), old.unionByName(changes), keys, newest) if newest
              else merge_rows(old, changes, keys))
    staged, _ = materialise(merged.select(*changes.columns, _bucket(keys, buckets).alias(BUCKET)), "upsert-staged")
    (staged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static" if grown else "dynamic")
     .partitionBy(BUCKET).parquet(root))
    discard(staged)
    discard(changes)
    return buckets if grown and first else len(touched)


def fan_out(df: DataFrame, targets: list[Callable[[DataFrame], None]]) -> None:
    """Write to several targets from one computation of ``df``, kept in the shared folder meanwhile."""
    kept, _ = materialise(df, "fan-out")
    try:
        for write in targets:
            write(kept)
    finally:
        discard(kept)
