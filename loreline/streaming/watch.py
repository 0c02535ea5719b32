"""Watching a source tree: each tick lists it and refreshes the index if anything changed.

A file stream does not tell of changed or deleted files, so the ticks come from a rate stream and every micro-batch compares the listing (names, sizes,
times) with that of the index, and reads only what differs there. That is idempotent: replaying a batch after a failure does no harm. Files
that changed less than ``settle_s`` ago wait for a later tick, so a burst of writes is one refresh.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators import freshness
from loreline.options import IndexOptions
from loreline.plans import index_job


def watch(spark: SparkSession, root: str, store_root: str, interval_s: float = 2.0, options: IndexOptions = IndexOptions(), on_refresh: Callable | None = None, settle_s: float = 0.0):
    """A running StreamingQuery; stop() ends it."""
    options = replace(options, settle_s=settle_s or options.settle_s)

    def tick(_: DataFrame, batch_id: int) -> None:
        done = index_job.refresh_if_stale(spark, root, store_root, options)
        if done is not None and on_refresh:
            on_refresh(batch_id, done)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{max(0.1, interval_s)} seconds").start()


def watch_once(spark: SparkSession, root: str, store_root: str, options: IndexOptions = IndexOptions()):
    """One check; None if the index was current."""
    return index_job.refresh_if_stale(spark, root, store_root, options)


def refresh_snapshots(indexed: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """Fold a sequence of snapshots (path, hash) into the table, one tick each: path, hash, version (tick that brought the row)."""
    table = indexed.select("path", "hash", F.lit(0).alias("version"))
    for k, now in enumerate(batches, 1):
        table = freshness.merge_files(table, now.select("path", "hash", F.lit(k).alias("version")))
    return table


def change_stream(spark: SparkSession, folder: str, indexed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A stream of snapshot files (path, hash) against the indexed table: each micro-batch's differences go to ``sink``."""
    stream = spark.readStream.schema("path string, hash string").parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(freshness.diff(indexed, df), i))
    return (writer.trigger(availableNow=True) if once else writer).start()
