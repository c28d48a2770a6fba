"""Labels of messages: legacy label fields, rules that bypass the scorer, and pluggable scorers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEGACY_KEYS = ("label", "sentiment", "roberta_sentiment", "qwen_sentiment")
# Bodies with a label of their own.
BYPASS = (("[removed]", "REMOVED_BY_MOD"), ("[deleted]", "USER_DELETED"), ("[AutoModerator]", "AUTOMOD_WARNING"))
SCORE_TYPE = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])


def label_from_variant(row: Column) -> Column:
    """The label of a parsed record: ai_analysis.label, else the first legacy key, a string or an object with a label."""
    tries = ["$.ai_analysis.label", *(p for k in LEGACY_KEYS for p in (f"$.{k}.label", f"$.{k}"))]
    return F.coalesce(*[F.try_variant_get(row, p, "string") for p in tries])


def inference_text(kind: Column, title: Column, body: Column) -> Column:
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))
    return F.trim(F.when(kind == "post_header", both).otherwise(F.coalesce(body, F.lit(""))))


def bypass(body: Column, valid: Column, text: Column) -> Column:
    """(label, confidence) of messages that need no scorer, null for the others; tested in order on the original body."""
    make = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    out = None
    for marker, label in BYPASS:
        out = F.when(body == marker, make(label, 1.0)) if out is None else out.when(body == marker, make(label, 1.0))
    return out.when(~F.coalesce(valid, F.lit(True)) | (text == ""), make("BYPASS_EMPTY", 0.0))


class Scorer(Protocol):
    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        """Columns label (any case) and confidence for each text."""


class WordScorer:
    """A deterministic scorer by word lists, for tests and as a default without a model."""

    # Fixed word lists.
    POSITIVE = ("excelente", "incrível", "legal", "top", "great", "good", "genial")
    NEGATIVE = ("ruim", "triste", "difícil", "decepção", "bad", "sad", "desastre")

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        low = texts.fillna("").str.lower()
        good = sum((low.str.contains(w, regex=False).astype(int) for w in self.POSITIVE), pd.Series(0, index=low.index))
        bad = sum((low.str.contains(w, regex=False).astype(int) for w in self.NEGATIVE), pd.Series(0, index=low.index))
        label = pd.Series("neutral", index=low.index).mask(good > bad, "positive").mask(bad > good, "negative")
        return pd.DataFrame({"label": label, "confidence": ((good - bad).abs() + 1) / (good + bad + 2)})


def score(texts: DataFrame, column: str, scorer: Scorer) -> DataFrame:
    """Adds `score` (label, confidence) by the scorer; a batch that fails is labelled ERROR as a whole. One Python pass."""

    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in values:
            try:
                out = scorer(batch)
                yield pd.DataFrame({"label": out["label"].str.upper(), "confidence": out["confidence"].astype(float).round(3)})
            except Exception:
                yield pd.DataFrame({"label": ["ERROR"] * len(batch), "confidence": [0.0] * len(batch)})

    run.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, SCORE_TYPE)
    return texts.withColumn("score", udf(F.col(column)))


def label_messages(messages: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds ai_analysis to messages (type, title, body, is_valid_text): rules first, the scorer only on the rest."""
    text = inference_text(F.col("type"), F.col("title"), F.col("body"))
    ruled = messages.withColumn("__text", text).withColumn("ai_analysis", bypass(F.col("body"), F.col("is_valid_text"), F.col("__text")))
    done = ruled.where("ai_analysis is not null").drop("__text")
    open_ = score(ruled.where("ai_analysis is null"), "__text", scorer).withColumn("ai_analysis", F.col("score")).drop("score", "__text")
    return done.unionByName(open_)
