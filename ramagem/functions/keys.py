"""Normal forms of ids, subreddits, labels and timestamps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED_MARKERS = ("[deleted]", "deleted")
BODY_MARKERS = ("[deleted]", "[removed]", "[AutoModerator]", "[empty]")
VALID_LABELS = ("POSITIVE", "NEUTRAL", "NEGATIVE")


def bare_id(column: Column) -> Column:
    """The text after the last underscore; null and empty ids give null."""
    return F.nullif(F.substring_index(column, "_", -1), F.lit(""))


def subreddit_key(column: Column) -> Column:
    """Lower case without a leading r/ and trailing slashes; null stays null."""
    return F.regexp_replace(F.lower(F.trim(column)), r"^/?r/|/+$", "")


def label_key(column: Column) -> Column:
    return F.upper(F.trim(column))


def valid_time(column: Column) -> Column:
    """Unix seconds; 0 counts as absent."""
    return F.nullif(column.cast("double"), F.lit(0.0))
