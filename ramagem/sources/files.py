"""Files in and out: JSON Lines, raw post trees, mixed folders, media listings, lexicons, and tables kept as caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.sources import shared

MESSAGE_SCHEMA = (
    "type string, id string, parent_id string, post_id string, subreddit string, author string, timestamp double, title string, body string, depth int, metadata_score long, "
    "is_valid_text boolean, ai_analysis struct<label:string,confidence:double>, _corrupt_record string"
)
FOOTER = "metadata_footer"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON Lines files with one fixed schema; bad lines, footers and rows without id are left out."""
    rows = spark.read.schema(MESSAGE_SCHEMA).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    good = F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & ~F.coalesce(F.col("type") == FOOTER, F.lit(False))
    return rows.where(good).drop("_corrupt_record")


def write_jsonl(messages: DataFrame, path: str, mode: str = "append") -> None:
    """One object per line, other scripts kept as they are, null fields left out."""
    messages.write.mode(mode).json(path)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, path, doc) of JSON files below path; the number is a hash of the path."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(path, wholetext=True)
    return whole.select(F.xxhash64("_metadata.file_path").alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of JSON arrays, single objects (on one line or many) and JSON Lines.

    Every file is read line by line; a line that isn't an object of its own marks its file as a document, and only such
    files are then read whole, objects or arrays of objects. So a large JSON Lines file is never one row. A JSON Lines file
    with a broken line counts as a document that can't be read as one; its good lines are kept.
    """
    schema = MESSAGE_SCHEMA.replace(", _corrupt_record string", "")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
    lines = files.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    told = lines.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("own", F.trim("value").startswith("{") & F.trim("value").endswith("}") & F.get_json_object("value", "$").isNotNull())
    documents = told.where("not own").select("file").distinct()
    whole = files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(documents, "file", "left_semi")
    arrays = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>", {"mode": "PERMISSIVE"})
    single = F.array(F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    read = F.get_json_object("value", "$").isNotNull()
    parsed = whole.where(read).select("file", F.explode(F.when(F.ltrim("value").startswith("["), arrays).otherwise(single)).alias("m"))
    loose = told.where("own").join(parsed.select("file").distinct(), "file", "left_anti").select("file", "m")
    return loose.unionByName(parsed).select("m.*").where(F.col("id").isNotNull() & ~F.coalesce(F.col("type") == FOOTER, F.lit(False)))


def unify(*frames: DataFrame) -> DataFrame:
    """All messages of all datasets, fields by name, footers left out."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.where(~F.coalesce(F.col("type") == FOOTER, F.lit(False)))


def append_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet, one per key."""
    return df.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def unprocessed(df: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Rows still to do after an interrupted run."""
    return df.join(processed.select(key).distinct(), key, "left_anti")


def cached_table(spark: SparkSession, path: str, build, needs: tuple[str, ...] = ()) -> DataFrame:
    """A table kept as Parquet: read if complete (and with all needed columns), else built, written and read.

    A copy built for want of columns lies beside the first, under a number that goes up, and is found at the next call.
    """
    at, number = path, 0
    while shared.exists(spark, f"{at}/_SUCCESS"):
        held = spark.read.parquet(at)
        if set(needs) <= set(held.columns):
            return held
        number += 1
        at = f"{path}-{number}"  # a frame can't overwrite what it is read from
    build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


MEDIA_PRIORITY = ("jpg", "png", "jpeg", "gif")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, length) of downloaded media, one per stem by extension priority; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    rank = F.array_position(F.array(*map(F.lit, MEDIA_PRIORITY)), ext)
    ranked = listed.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "path", "length", rank.alias("rank")).where("rank > 0")
    return ranked.groupBy("stem").agg(F.min_by(F.struct("path", "length"), "rank").alias("f")).select("stem", "f.path", "f.length")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a lexicon file, for parse_lexicon."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("n", "line"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated files with a header; quotes inside values are doubled, nulls are empty."""
    df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def report_text(sections: dict[str, DataFrame], style: str = "text", most: int = 10_000) -> str:
    """Tables under titles, as aligned text or as LaTeX tables. For results of a few rows: more than `most` is an error."""
    out = []
    for title, df in sections.items():
        rows = [["" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{title}: a report is for at most {most} rows")
        if style == "latex":
            clean = lambda text: "".join("\\" + c if c in "&%$#_{}" else c for c in text)
            lines = [" & ".join(map(clean, r)) + " \\\\" for r in [df.columns, *rows]]
            begin = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{clean(title)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline"]
            out.append("\n".join([*begin, lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", r"\end{table}"]))
        else:
            wide = [max(len(r[i]) for r in [df.columns, *rows]) for i in range(len(df.columns))]
            lines = ["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [df.columns, *rows]]
            out.append("\n".join(["=" * 80, title, "=" * 80, *lines]))
    return "\n\n".join(out) + "\n"


def write_report(spark: SparkSession, path: str, sections: dict[str, DataFrame], style: str = "text") -> None:
    """report_text() as one file, in full or not at all."""
    shared.publish_text(spark, path, report_text(sections, style))
