"""User tallies, homophily, lifetimes and stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramagem.functions.bins import quartile
from ramagem.functions.keys import DELETED_MARKERS, VALID_LABELS
from ramagem.operators.stats import quantiles, running
from ramagem.session import with_scalars

# Accounts left out, by the kind of analysis.
TALLY_ACCOUNTS = ("[deleted]", "deleted", "automoderator", "redditcaresresources")
SURVIVAL_ACCOUNTS = ("[deleted]", "automoderator", "redditcaresresources")


def drop_accounts(messages: DataFrame, names: Sequence[str] = TALLY_ACCOUNTS, any_case: bool = False) -> DataFrame:
    """Rows of authors not in names; rows without author stay out."""
    author = F.lower("author") if any_case else F.col("author")
    return messages.where(F.col("author").isNotNull() & ~author.isin(*names))


def sentiment_totals(messages: DataFrame) -> DataFrame:
    """(label, n, share in percent) of the valid labels."""
    counts = messages.where(F.col("label").isin(*VALID_LABELS)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)  # three rows


def user_negativity(messages: DataFrame, names: Sequence[str] = TALLY_ACCOUNTS, any_case: bool = False) -> DataFrame:
    """(author, total, negative, perc_negative, user_type) over valid labels."""
    tallied = drop_accounts(messages, names, any_case).where(F.col("label").isin(*VALID_LABELS)).groupBy("author").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "NEGATIVE").alias("negative")
    )
    share = F.col("negative") / F.col("total") * 100
    return tallied.withColumn("perc_negative", share).withColumn("user_type", quartile(share, "UQ"))


def quartile_table(df: DataFrame, kind: str, value: str) -> DataFrame:
    """(quartile, n, lowest, highest)."""
    return df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )


def typed_edges(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Reply edges with the types of both users; edges of untyped users drop out. A heavy replier is split by AQE."""
    s = users.select(F.col("author").alias("source"), F.col("user_type").alias("s_type"))
    t = users.select(F.col("author").alias("target"), F.col("user_type").alias("t_type"))
    # many edges per pair of users: pairs are counted before they are joined
    pairs = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(s, "source").join(t, "target")


def homophily_index(typed: DataFrame) -> DataFrame:
    """(user_type, n_users, mean, std, se) of the share of replies that go to one's own type."""
    h = typed.groupBy("source", "s_type").agg((F.sum(F.when(F.col("s_type") == F.col("t_type"), F.col("n")).otherwise(0)) / F.sum("n")).alias("h"))
    return h.groupBy(F.col("s_type").alias("user_type")).agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("h").alias("mean"), F.stddev_samp("h").alias("std"), (F.stddev_samp("h") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )


def homophily_matrix(typed: DataFrame) -> DataFrame:
    """Row percentages of replies from type to type, zeros filled in."""
    order = ["UQ1", "UQ2", "UQ3", "UQ4"]
    wide = typed.groupBy(F.col("s_type").alias("source_type")).pivot("t_type", order).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(t) for t in order[1:]), F.col(order[0]))
    return wide.select("source_type", *[(F.col(t) / total * 100).alias(t.lower()) for t in order])


def target_negativity(edges: DataFrame, users: DataFrame) -> DataFrame:
    """(user_type, n, mean): how negative those are that users of a type reply to."""
    typed = typed_edges(edges, users).join(users.select(F.col("author").alias("target"), "perc_negative"), "target")
    return typed.groupBy(F.col("s_type").alias("user_type")).agg(F.sum("n").alias("n"), (F.sum(F.col("perc_negative") * F.col("n")) / F.sum("n")).alias("mean"))


def stays(messages: DataFrame, names: Sequence[str] = SURVIVAL_ACCOUNTS, least: int = 10, gap: int = 5) -> DataFrame:
    """(thread, author, duration, event, exposure_ratio): how long users stay in threads of at least `least` messages.

    Positions are by time, then id. event: the thread went on for at least `gap` messages after the user's last.
    """
    used = drop_accounts(messages, names, any_case=True).where("timestamp is not null and thread is not null")
    narrow = used.select("thread", "author", "timestamp", "id", "label")
    negative = F.when(F.col("label") == "NEGATIVE", 1).otherwise(0)
    steps = narrow.groupBy("thread").agg(F.count(F.lit(1)).alias("steps")).where(F.col("steps") >= least)
    # a thread may hold a large part of all messages: positions come from ranges of (thread, time), not from one task
    seen = running(narrow, ["thread"], ["timestamp", "id"], {"at": F.lit(1), "neg": negative}).join(steps, "thread")
    spans = seen.groupBy("thread", "author").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("neg").alias("neg_first"), F.max("neg").alias("neg_last"), F.first("steps").alias("steps"))
    duration = F.col("last") - F.col("first") + 1
    return spans.where(duration > 1).select(
        "thread",
        "author",
        duration.cast("int").alias("duration"),
        (F.col("steps") - (F.col("last") - 1) >= gap).cast("int").alias("event"),
        ((F.col("neg_last") - F.col("neg_first")) / duration).alias("exposure_ratio"),
    )


def churn(messages: DataFrame, names: Sequence[str] = SURVIVAL_ACCOUNTS, least: int = 5, idle_days: float = 30.0) -> DataFrame:
    """(author, duration_days, event, neg_ratio, total_msgs, user_quartile): quartiles by the data's own cut points."""
    stamped = messages.where("timestamp is not null")
    last = stamped.agg(F.max("timestamp").alias("end"))
    lives = drop_accounts(stamped, names, any_case=True).groupBy("author").agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("z"), F.count(F.lit(1)).alias("total_msgs"), F.count_if(F.col("label") == "NEGATIVE").alias("neg")
    )
    rows = with_scalars(lives.where(F.col("total_msgs") >= least), last).select(
        "author",
        F.greatest((F.col("z") - F.col("a")) / 86400, F.lit(0.5)).alias("duration_days"),
        ((F.col("end") - F.col("z")) / 86400 > idle_days).cast("int").alias("event"),
        (F.col("neg") / F.col("total_msgs")).alias("neg_ratio"),
        "total_msgs",
    )
    cuts = quantiles(rows, None, "neg_ratio", {"c1": 0.25, "c2": 0.5, "c3": 0.75}).drop("g")
    value = F.col("neg_ratio")
    kind = F.when(value <= F.col("c1"), "UQ1").when(value <= F.col("c2"), "UQ2").when(value <= F.col("c3"), "UQ3").otherwise("UQ4")
    return with_scalars(rows, cuts).select(*rows.columns, kind.alias("user_quartile"))
