"""Queries of the operators on text (problems 6 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.functions.keys import bare_id, subreddit_key
from ramagem.llm import abuse, packing, pii, reading, tokens
from ramagem.session import cut_lineage
from ramagem.sources.tables import table


def _comment_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments").select(F.lit("comment").alias("record"), bare_id(F.col("id")).alias("id"), F.col("body").alias("text"))


def _title_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "post_header").select(F.lit("post_header").alias("record"), bare_id(F.col("id")).alias("id"), F.col("title").alias("text"))


def _scored(spark: SparkSession, folder: str, *extra: str, exact: bool = False) -> DataFrame:
    comments = table(spark, folder, "comments").withColumn("id", bare_id(F.col("id")))
    marks = table(spark, folder, "message_annotation").select(bare_id(F.col("id")).alias("id"), "content_flag")
    model = abuse.learn(comments.select("id", "body"), marks)
    return abuse.scored(comments.select("id", "body", *extra), model, extra, exact)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where((F.col("score") >= abuse.THRESHOLD) & F.col("id").isNotNull()).select("id").distinct()


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message: the score, the worst segment and the nearest flagged example."""
    best = F.max_by(F.struct("score", "segment", "example"), F.struct("score", "segment"))
    return _scored(spark, folder, exact=True).groupBy("id").agg(best.alias("s")).select("id", F.round("s.score", 6).alias("score"), "s.segment", "s.example")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and the share reported, by subreddit."""
    rows = _scored(spark, folder, "subreddit").where("id is not null")
    messages = rows.groupBy("id", subreddit_key(F.col("subreddit")).alias("subreddit")).agg(F.max("score").alias("score"))
    return messages.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("score") >= abuse.THRESHOLD).alias("n_flagged"), F.round(F.avg((F.col("score") >= abuse.THRESHOLD).cast("double")), 6).alias("rate")
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.kinds_found(_comment_texts(spark, folder).unionByName(_title_texts(spark, folder)).where("id is not null"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts with placeholders, one row for each delivered row."""
    return pii.redacted(_comment_texts(spark, folder).unionByName(_title_texts(spark, folder)))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(_documents(spark, folder))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the length of its encoding and whether decoding gives back its text."""
    texts = _documents(spark, folder).select("doc_id", "text")
    ids = cut_lineage(tokens.encoded(texts))
    back = tokens.decoded(ids).withColumnRenamed("text", "back")
    sized = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    return texts.join(back, "doc_id").join(sized, "doc_id").select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_documents(spark, folder)))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, folder))


def _levels(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    documents = _documents(spark, folder)
    model, counters = reading.fit(documents, table(spark, folder, "reading_label"))
    return reading.score(documents, model, counters, extra)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("p_hard >= 0.5").select("doc_id")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and mean level by source and language; languages by their first two letters in lower case."""
    lang = F.coalesce(F.nullif(F.lower(F.substring("lang", 1, 2)), F.lit("un")), F.lit("unknown"))
    scored = _levels(spark, folder, "source", "lang")
    return scored.groupBy("source", lang.alias("language")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.round(F.avg("level"), 4).alias("mean_level"),
        F.count_if(F.col("band") >= 4).alias("n_hard"),
        F.count_if(F.col("band").isNull()).alias("n_without_band"),
    )


QUERIES = {
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}

#: SQL cannot express these; their tests compare with brute force, round trips and held-out grades.
SQL: dict[str, str] = {}
