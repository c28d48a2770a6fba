"""Rewrites of message bodies: site markup to plain links, video and media links to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramagem.functions.keys import BODY_MARKERS

# Patterns and replacements, in the order in which they apply.
MARKUP = (
    (r"!\[(?:gif|img)\]\(giphy\|([a-zA-Z0-9]+)[^)]*\)", "https://i.giphy.com/$1.gif"),
    (r"!\[(?:img|gif)\]\(emote\|[^)]+\)", "[Reddit Emote]"),
    (r"!\[img\]\(([a-zA-Z0-9]{10,20})\)", "https://i.redd.it/$1.jpeg"),
    (r"!\[gif\]\(([a-zA-Z0-9]{10,20})\)", "https://i.redd.it/$1.gif"),
    (r"https?://preview\.redd\.it/([a-zA-Z0-9_-]+\.(?:jpeg|jpg|png|gif))(?:\?[^\s\])]*)?", "https://i.redd.it/$1"),
)
VIDEO_LINK = r"https?://(?:m\.|www\.)?(?:youtube\.com/(?:watch\?\S*v=|shorts/|embed/)|youtu\.be/)[a-zA-Z0-9_-]+[^\s\])]*"
MEDIA_LINK = r"https?://\S+\.(?:jpg|jpeg|png|gif|mp4)"
LOOPING_TEXT = r"(.{3,10})\1{3,}"
LOOP_FALLBACK = "Imagem de reação ou explicação"
VIDEO_FALLBACK = "Vídeo do YouTube (Título Indisponível)"
MEDIA_FALLBACK = "Imagem sem descrição"


def rewrite_markup(body: Column) -> Column:
    for pattern, replacement in MARKUP:
        body = F.regexp_replace(body, pattern, replacement.replace("$1", "$1"))
    return body


def needs_rewrite(body: Column, resumed: bool = False) -> Column:
    """Whether a body has anything to rewrite; resumed runs also look for bare video words."""
    gate = body.contains("http") | body.contains("![")
    low = F.lower(body)
    return gate | low.contains("youtube") | low.contains("youtu.be") if resumed else gate


def video_links(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(f"({VIDEO_LINK})"), F.lit(1)))


def media_links(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(f"({MEDIA_LINK})"), F.lit(1)))


def guard_loop(description: Column) -> Column:
    """Descriptions that repeat a unit of 3 to 10 characters four times or more give way to a fixed phrase."""
    return F.when(description.rlike(LOOPING_TEXT), LOOP_FALLBACK).otherwise(description)


def sanitize(author: Column, body: Column) -> Column:
    """Automatic moderators' bodies become their marker; an absent body is empty."""
    return F.when(F.lower(author) == "automoderator", "[AutoModerator]").otherwise(F.coalesce(body, F.lit("[empty]")))


def is_valid_text(body: Column) -> Column:
    return ~body.isin(*BODY_MARKERS)


def replace_links(messages: DataFrame, links: Column, lookup: DataFrame, form: str, fallback: str, key: str = "id") -> DataFrame:
    """Replace each distinct link of `body` by form % its text in lookup (link, text), else % the fallback.

    Longer links are replaced first, so that a link that begins another is not cut into it. Only rows with links are
    joined; the rest pass through.
    """
    marked = messages.withColumn("__links", links)
    found = marked.where(F.size("__links") > 0).select(key, F.explode("__links").alias("link"))
    texts = (
        found.join(lookup, "link", "left")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(F.length("link").alias("n"), "link", F.coalesce("text", F.lit(fallback)).alias("text"))), asc=False).alias("__swap"))
    )
    joined = marked.join(texts, key, "left")
    before, after = form.split("%s")
    swapped = F.aggregate("__swap", F.col("body"), lambda body, x: F.replace(body, x["link"], F.concat(F.lit(before), x["text"], F.lit(after))))
    return joined.withColumn("body", F.when(F.col("__swap").isNotNull(), F.trim(swapped)).otherwise(F.col("body"))).drop("__links", "__swap")
