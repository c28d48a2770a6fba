"""The message model: one row per post or comment, from event rows or from the discussion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramagem.functions.keys import bare_id, label_key, subreddit_key, valid_time

#: Columns of a message frame.
COLUMNS = ("id", "type", "parent_id", "thread", "subreddit", "category", "author", "label", "timestamp", "score")
THREAD_SIZE, MIX = 25, 2654435761


def messages_from_events(events: DataFrame) -> DataFrame:
    """Reply threads derived from event rows by integer arithmetic: 25 events make a thread, each replies to an earlier one."""
    e = F.col("event_id")
    thread, pos = F.floor(e / THREAD_SIZE).cast("long"), e % THREAD_SIZE
    label = (
        F.when(F.col("event_type").isin("error", "click"), "NEGATIVE").when(F.col("event_type") == "view", "NEUTRAL").when(F.col("event_type") == "purchase", "POSITIVE").otherwise("REMOVED_BY_MOD")
    )
    return events.select(
        e.alias("id"),
        F.when(pos == 0, "post_header").otherwise("comment").alias("type"),
        F.when(pos != 0, thread * THREAD_SIZE + (e * MIX) % F.nullif(pos, F.lit(0))).alias("parent_id"),
        thread.alias("thread"),
        F.format_string("s%02d", thread % 20).alias("subreddit"),
        F.concat(F.lit("cat"), F.floor((thread % 20) / 5).cast("string")).alias("category"),
        F.concat(F.lit("u"), (thread % 40).cast("string"), F.lit("_"), (F.col("user_id") % 6).cast("string")).alias("author"),
        label.alias("label"),
        F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).cast("double").alias("timestamp"),
        F.col("value").alias("score"),
    )


def one_row_per_id(rows: DataFrame, arrived: str = "harvested_at") -> DataFrame:
    """Of repeated ids the last delivery (ties: the larger score); rows without id are dropped."""
    body = [c for c in rows.columns if c != "id"]
    newest = F.max_by(F.struct(*body), F.struct(F.col(arrived), F.coalesce(F.col("score"), F.lit(-(2**62)))))
    return rows.where("id is not null").groupBy("id").agg(newest.alias("m")).select("id", *[f"m.{c}" for c in body])


def messages_from_tables(comments: DataFrame, headers: DataFrame, categories: DataFrame) -> DataFrame:
    """Comments and headers as one message frame with bare ids; subreddits without a category keep a null one."""
    common = lambda df: df.select(
        bare_id(F.col("id")).alias("id"),
        "type",
        bare_id(F.col("parent_id")).alias("parent_id"),
        F.col("post_id").alias("thread"),
        subreddit_key(F.col("subreddit")).alias("subreddit"),
        "author",
        label_key(F.col("ai_analysis.label")).alias("label"),
        F.col("ai_analysis.confidence").alias("confidence"),
        valid_time(F.col("timestamp")).alias("timestamp"),
        F.col("metadata_score").alias("score"),
        "body",
        "depth",
        "harvested_at",
    )
    both = one_row_per_id(common(comments).unionByName(common(headers)))
    return both.join(F.broadcast(categories.select("subreddit", "category")), "subreddit", "left")  # one row per subreddit
