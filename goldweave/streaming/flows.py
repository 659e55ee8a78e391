"""Structured Streaming: cleanse, deduplicate, match against a master, feed of match bands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldweave.operators.ruleset import apply_rules
from goldweave.session import discard, materialise, path_exists
from goldweave.sources.writers import append, merge_rows, upsert


def start_file_sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                    partition_by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to parquet files; the checkpoint makes restarts exactly-once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def cleanse_stream(stream: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Row rules are stateless, so the batch functions serve unchanged."""
    return apply_rules(stream, rules)


def deduplicate_stream(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state older than that is dropped, so a repeat that
    comes later than ``delay`` is let through. State grows with the keys seen within the delay: a cluster
    session should keep it in the RocksDB state store (``build_session`` sets it)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def start_distinct_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append only rows whose key is not stored yet.

    Every micro-batch is joined with the keys written so far, so a repeat is left out however late it comes, and
    a replayed batch adds nothing. Of several rows of a key in one batch any one stays. No state is kept.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        fresh, spark = batch.dropDuplicates(keys), batch.sparkSession
        if path_exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            fresh = fresh.join(stored, same, "left_anti")
        staged, _ = materialise(fresh, "distinct")  # the folder that is read is the one that is written
        append(staged, path)
        discard(staged)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def band_feed(stream: DataFrame, time: str, band: Column, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Windowed counts of match bands.

    In append mode (``start_file_sink``) a window is emitted once the watermark has passed it, and windows still open
    stay in the checkpoint. ``start_feed_table`` keeps a table of all windows, open ones too.
    """
    counted = (stream.withWatermark(time, delay)
               .groupBy(F.window(time, width).alias("w"), band.alias("band")).agg(F.count(F.lit(1)).alias("matches")))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "band", "matches")


def start_feed_table(feed: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a keyed table of the feed: every batch updates the windows it has rows for.

    A window is in the table from its first row on, and rows that are late by less than the watermark's delay correct it. Counts
    only grow, so the largest one wins and a replayed batch changes nothing.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, root, ["window_start", "band"], "matches")

    writer = feed.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def match_batch(batch: DataFrame, master: DataFrame, key: str, record_id: str, time: str) -> DataFrame:
    """The master after one batch: the newest row per key wins, ties go to the larger id.

    Taking the maximum over old and new rows makes the step idempotent and independent of the
    order of batches, so a replayed batch changes nothing.
    """
    columns = master.columns
    others = [c for c in columns if c != key]
    both = master.unionByName(batch.select(*columns))
    best = F.max_by(F.struct(*others), F.struct(time, record_id))
    touched = both.join(batch.select(key).distinct(), key, "left_semi").groupBy(key).agg(best.alias("_b"))
    changes = touched.select(key, *[F.col(f"_b.{c}").alias(c) for c in others])
    return merge_rows(master, changes, [key])


def start_master_match(stream: DataFrame, read_master: Callable[[int], DataFrame],
                       write_master: Callable[[DataFrame, int], None], key: str, record_id: str, time: str,
                       checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Match every micro-batch to the stored master and upsert it.

    ``read_master`` gives the master as of the previous batch and ``write_master`` stores the
    version of this batch id, overwriting it on a replay.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        write_master(match_batch(batch, read_master(batch_id), key, record_id, time), batch_id)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_master_upsert(stream: DataFrame, root: str, keys: list[str], newest: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Upsert every micro-batch into a keyed master; a batch rewrites only the partitions its keys fall
    into, and the newest row per key wins whatever the order of the batches."""
    def step(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, root, keys, newest)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
