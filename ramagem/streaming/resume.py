"""Resumable processing as a stream over a folder of JSON Lines: each file once, late repeats of a message dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.sources.files import FOOTER, MESSAGE_SCHEMA


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def process_new(spark: SparkSession, source: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Run `work` over the files that came since the last call and append its rows to sink; safe to repeat after a crash.

    Repeats of an id are dropped, however much later they come; no row is dropped for its time, be it old, 0 or null.
    Footers and bad lines are left out. Returns when all files that are there are done. The ids met so far are kept on
    the executors' disks and in the checkpoint, one for each message.
    """
    rows = spark.readStream.schema(MESSAGE_SCHEMA).option("mode", "PERMISSIVE").json(source)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & ~F.coalesce(F.col("type") == FOOTER, F.lit(False))).drop("_corrupt_record")
    once = good.dropDuplicates(["id"])
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)  # the default one holds all ids in memory
    try:
        query = work(once).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    finally:
        spark.conf.set(_STATE_STORE, before)
    query.awaitTermination()


def activity_windows(messages: DataFrame, late: str = "7 days", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Messages and negatives per subreddit and time window, for streams and tables alike. An extension."""
    timed = messages.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return (
        timed.groupBy(F.window("at", size, slide) if slide else F.window("at", size), "subreddit")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "NEGATIVE").alias("negative"))
        .select(F.col("window.start").alias("start"), "subreddit", "n", "negative")
    )
