"""Batch, streaming and JDBC scans, and ingestion with metadata columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from goldweave.operators.normalize import add_ingest_metadata, normalize_headers

# Source type names.
FILE_TYPES = ("csv", "parquet", "json", "file")
JDBC_TYPES = ("oracle", "snowflake", "sqlserver", "jdbc")


def read_files(spark: SparkSession, path: str, fmt: str = "csv",
               schema: StructType | str | None = None, **options) -> DataFrame:
    """Scan files. CSV columns are strings unless a schema is given; nothing is inferred,
    so identifiers keep their leading zeros."""
    reader = spark.read.options(**_file_options(fmt, options))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def stream_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv",
                 **options) -> DataFrame:
    """Streaming scan of a folder; a schema is mandatory."""
    return spark.readStream.options(**_file_options(fmt, options)).schema(schema).format(fmt).load(path)


def _file_options(fmt: str, options: dict) -> dict:
    if fmt != "csv":
        return options
    return {"header": "true", "inferSchema": "false", "quote": '"', "escape": '"', **options}


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 1000) -> DataFrame:
    """Scan a database table, split over tasks by ``partition_column`` when one is given.

    A failing connection raises; no empty frame stands in for missing data.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        options.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                       upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return spark.read.format("jdbc").options(**options).load()


def read_source(spark: SparkSession, config: dict) -> DataFrame:
    """Dispatch on ``config['type']``; an unknown type is an error."""
    kind = config.get("type", "csv").lower()
    if kind in JDBC_TYPES:
        keys = ("partition_column", "lower_bound", "upper_bound", "num_partitions", "fetch_size")
        return read_jdbc(spark, config["url"], config["table"], config.get("properties"),
                         **{k: config[k] for k in keys if k in config})
    if kind not in FILE_TYPES:
        raise ValueError(f"unsupported source type: {kind!r}; known: {FILE_TYPES + JDBC_TYPES}")
    fmt = config.get("format", "csv" if kind == "file" else kind)
    options = config.get("options", {})
    if config.get("is_stream"):
        if "schema" not in config:
            raise ValueError("a streaming source needs a schema")
        return stream_files(spark, config["path"], config["schema"], fmt, **options)
    return read_files(spark, config["path"], fmt, config.get("schema"), **options)


def ingest(spark: SparkSession, config: dict) -> DataFrame:
    """Scan, normalise the headers, add the ingestion columns."""
    return add_ingest_metadata(normalize_headers(read_source(spark, config)), config.get("name", "Unknown"))
