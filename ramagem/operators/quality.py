"""Anonymisation with integrity checks, agreement of labels, samples for annotation, dataset footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_LABELS = {"POSITIVE": "POS", "NEUTRAL": "NEU", "NEGATIVE": "NEG"}
KEPT_AUTHORS = ("[deleted]", "[removed]", "deleted")


def author_hash(author: Column, salt: str) -> Column:
    """Hex SHA-256 of name and salt; markers of deleted accounts and nulls stay."""
    return F.when(author.isNull() | author.isin(*KEPT_AUTHORS), author).otherwise(F.sha2(F.concat_ws("_", author, F.lit(salt)), 256))


def anonymize(messages: DataFrame, salt: str, column: str = "author") -> DataFrame:
    """One projection, no pass to collect names. The salt is made on the driver per run and never written."""
    return messages.withColumn(column, author_hash(F.col(column), salt))


def validate_anonymization(before: DataFrame, after: DataFrame, key: str = "id", column: str = "author", kind: str = "type") -> DataFrame:
    """(check, passed, detail) over all rows: counts in all and by type, fields, ids, unchanged fields, hash form, collisions.

    Rows are compared as bags: sums of two independent hashes and the count, so that equal rows don't cancel out. The share
    of rows of the original whose other fields are found again, with their multiplicity, is told as field match.
    """
    spark = before.sparkSession
    rest = [c for c in before.columns if c != column]
    found = [c for c in rest if c in after.columns]
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    bag = lambda *c: F.concat_ws(":", wide(*c).cast("string"), F.sum(F.hash(*c).cast("decimal(38,0)")).cast("string"))
    hashed = F.col(column).isNull() | F.col(column).isin(*KEPT_AUTHORS) | F.col(column).rlike("^[0-9a-f]{64}$")
    figures = lambda df: df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(column).alias("authors"), bag(*found).alias("rest"), bag(key).alias("ids"), F.count_if(~hashed).alias("odd")
    ).first()
    a, b = figures(before), figures(after)
    kinds = lambda df: {r[0]: r[1] for r in df.groupBy(kind).count().collect()} if kind in df.columns else {}  # a few types
    ka, kb = kinds(before), kinds(after)
    same = a["rest"] == b["rest"] and found == rest
    matched = a["rows"]
    if not same and a["rows"]:
        count = lambda df, name: df.groupBy(F.xxhash64(*found).alias("h")).agg(F.count(F.lit(1)).alias(name))
        matched = count(before, "n").join(count(after, "m"), "h").agg(F.sum(F.least("n", "m"))).first()[0] or 0
    rows = [
        ("row count", a["rows"] == b["rows"], f"{a['rows']} and {b['rows']}"),
        ("rows by type", ka == kb, ", ".join(f"{k}: {ka.get(k, 0)} and {kb.get(k, 0)}" for k in sorted({*ka, *kb}, key=str) if ka.get(k) != kb.get(k))),
        ("fields", before.columns == after.columns, ", ".join(sorted(set(before.columns) ^ set(after.columns)))),
        ("ids", a["ids"] == b["ids"], ""),
        ("other fields", same, ""),
        ("field match", matched == a["rows"], f"{matched} of {a['rows']}"),
        ("hash form", b["odd"] == 0, str(b["odd"])),
        ("no collisions", a["authors"] == b["authors"], f"{a['authors']} and {b['authors']}"),
    ]
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def short_label(label: Column) -> Column:
    out = None
    for long, short in SHORT_LABELS.items():
        out = F.when(F.upper(label) == long, short) if out is None else out.when(F.upper(label) == long, short)
    return out


def agreement(pairs: DataFrame, truth: str, guess: str, by: str | None = None) -> DataFrame:
    """(grp, label, n, precision, recall, f1, accuracy, overall_accuracy) per class; with `by` per group, and over all as (all).

    Classes are those of either side; quotients without a denominator are 0. Rows with a null side are left out.
    """
    used = pairs.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    source = used.withColumn("__by", F.coalesce(F.col(by).cast("string"), F.lit("(none)")) if by else F.lit("(all)"))
    cells = source.groupBy("__by", F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        # per group and over all at once, on the few cells of the confusion tables
        every = cells.groupBy("t", "p").agg(F.sum("n").alias("n")).select(F.lit("(all)").alias("__by"), "t", "p", "n")
        cells = cells.unionByName(every)
    cells = cells.withColumnRenamed("__by", "grp")
    sides = cells.select("grp", "n", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"))
    per = sides.groupBy("grp", "s.label").agg(
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("n_true"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("n_guess"),
        F.sum(F.when(F.col("hit") & (F.col("s.side") == "t"), F.col("n")).otherwise(0)).alias("tp"),
    )
    totals = cells.groupBy("grp").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("n_guess")), ratio(F.col("tp"), F.col("n_true"))
    wrong = F.col("n_true") + F.col("n_guess") - 2 * F.col("tp")
    return per.join(totals, "grp").select(
        "grp",
        "label",
        F.col("n_true").alias("n"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        ((F.col("total") - wrong) / F.col("total")).alias("accuracy"),
        (F.col("hits") / F.col("total")).alias("overall_accuracy"),
    )


def confusion(pairs: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(label, one column per guess): counts over the given labels only, zeros filled in."""
    used = pairs.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels))
    return used.groupBy(F.col(truth).alias("label")).pivot(guess, labels).agg(F.count(F.lit(1))).na.fill(0)


def seeded_sample(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """n rows by the order of a seeded hash of their key: the same rows on any cluster, and in any other engine with MD5."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def annotation_merge(base: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows to annotate with what was annotated before; null labels are still to do."""
    return base.join(done.select(key, F.col("human_label").alias("__label")), key, "left").withColumn("human_label", F.col("__label")).drop("__label")


def footer(messages: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """One row: records, first and last time, days between (two decimals); times are null without any stamp."""
    s = F.col(stamp)
    return messages.agg(F.count(F.lit(1)).alias("total_records"), F.min(s).alias("first_ts"), F.max(s).alias("last_ts"), F.round((F.max(s) - F.min(s)) / 86400, 2).alias("days"))
