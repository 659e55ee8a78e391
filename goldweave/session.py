"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app_name: str = "goldweave", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Similarity joins expand small inputs; without this their shuffles shrink to one task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared folder the session names.

    ``spark.checkpoint.dir`` decides. Where it is unset a local session gets a
    temporary folder; a cluster session is refused, since a machine-local
    folder is lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.conf.get("spark.app.id")
        root = _LOCAL_SCRATCH.setdefault(app, tempfile.mkdtemp(prefix="goldweave-"))
    return f"{root.rstrip('/')}/goldweave/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system the path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialise(df: DataFrame, purpose: str, **metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` to scratch, read it back, and return metrics taken in the same job.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    watched.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back, seen.get


def discard(df: DataFrame) -> None:
    """Remove the scratch table behind a DataFrame that ``materialise`` returned and nothing reads any more."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
