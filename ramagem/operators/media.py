"""Media of messages: descriptions by a pluggable describer, and enrichment from files named after messages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ramagem.functions.rewrite import MEDIA_FALLBACK, guard_loop

ATTEMPTS = 3


class Describer(Protocol):
    def __call__(self, content: bytes, extension: str) -> str:
        """A short text for the first frame of a picture."""


def describe(media: DataFrame, describer: Describer) -> DataFrame:
    """(link, text) for media (link, content); three attempts each, then a fixed phrase. Null content gets it at once.

    Apply to distinct links only: each costs a model call.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for links, contents in batches:
            out = []
            for link, content in zip(links, contents):
                text = MEDIA_FALLBACK
                for _ in range(ATTEMPTS if content is not None else 0):
                    try:
                        text = describer(bytes(content), link.rpartition(".")[2].partition("?")[0].lower())
                        break
                    except Exception:
                        continue
                out.append(text)
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    text = F.pandas_udf(run, T.StringType())(F.col("link"), F.col("content"))
    return media.select("link", guard_loop(text).alias("text"))


def enrich(messages: DataFrame, files: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Adds has_media and vision_description to messages whose id names a file (stem, path); descriptions: path, text."""
    told = files.select(F.col("stem").alias("id"), "path").join(descriptions.select("path", F.col("text").alias("vision_description")), "path", "left").drop("path")
    return messages.join(told.withColumn("has_media", F.lit(True)), "id", "left").withColumn("has_media", F.coalesce("has_media", F.lit(False)))
