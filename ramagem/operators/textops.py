"""Text analytics: tokens, lexicon rates, contrastive valence, topic entropy and term tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramagem.operators.stats import quantiles
from ramagem.session import with_scalars
# Fixed word lists: words without content in Portuguese, Spanish and English, and words of the medium.
STOPWORDS = {
    "pt": "a o e as os um uma de do da dos das em no na nos nas que não com por para se eu meu minha ele ela isso é foi mais já".split(),
    "es": "el la los las un una de del en y que no con por para se yo mi su lo es fue más ya al".split(),
    "en": "the a an of in on and that not with by for if i my it is was more to this at".split(),
    "medium": "http https www com jpg png gif img removed deleted automoderator".split(),
    "noise": "kkk kkkk haha rs hein viu né".split(),
}
CYRILLIC = r"[\x{0400}-\x{04FF}]"
WORD = r"[a-zà-öø-ÿ]{2,}"


def usable_text(author: Column, body: Column, valid: Column, skip_visual: bool = False) -> Column:
    """Valid, not blank, not by deleted or moderating accounts, without Cyrillic. skip_visual also leaves out described media."""
    low = F.lower(F.coalesce(author, F.lit("")))
    text = F.trim(F.coalesce(body, F.lit("")))
    keep = F.coalesce(valid, F.lit(False)) & (text != "") & ~low.isin("[deleted]", "deleted", "automoderator") & ~low.contains("modteam") & ~text.rlike(CYRILLIC)
    return keep & ~text.contains("[CONTEUDO VISUAL:") if skip_visual else keep


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def all_tokens(text: Column) -> Column:
    """Every run of word characters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def stopwords(spark) -> DataFrame:
    return spark.createDataFrame(sorted({(w,) for words in STOPWORDS.values() for w in words}), "term string")


def document_terms(documents: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, group, term, n): counted per document before anything is shuffled by term."""
    return documents.select(key, group, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, group, "term").agg(F.count(F.lit(1)).alias("n"))


def term_valence(terms: DataFrame, group: str, g1: str, g2: str, stop: DataFrame, least_documents: int = 15, percentile: float = 0.85) -> DataFrame:
    """(term, valence, total): 2 f2 / (f1 + f2) - 1 of terms of 3 to 16 letters in enough documents, the frequent ones."""
    counted = (
        terms.where(F.col(group).isin(g1, g2))
        .groupBy("term")
        .agg(F.sum(F.when(F.col(group) == g1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col(group) == g2, F.col("n")).otherwise(0)).alias("c2"), F.count(F.lit(1)).alias("df"))
        .where((F.col("df") >= least_documents) & F.length("term").between(3, 16))
        .join(F.broadcast(stop), "term", "left_anti")
    )
    totals = counted.agg(F.sum("c1").alias("t1"), F.sum("c2").alias("t2"), F.count(F.lit(1)).alias("terms"))
    cut = quantiles(counted.withColumn("c", F.col("c1") + F.col("c2")), None, "c", {"cut": percentile}).drop("g")
    joined = with_scalars(with_scalars(counted, totals), cut)
    f1, f2 = F.col("c1") / F.nullif("t1", F.lit(0)), F.col("c2") / F.nullif("t2", F.lit(0))
    f1, f2 = F.coalesce(f1, F.lit(0.0)), F.coalesce(f2, F.lit(0.0))
    return joined.where(F.col("c1") + F.col("c2") >= F.col("cut")).select("term", (2 * f2 / (f1 + f2) - 1).alias("valence"), (F.col("c1") + F.col("c2")).alias("total"))


def extreme_terms(valence: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest and k highest, ties by term."""
    low = valence.orderBy("valence", "term").limit(k).withColumn("side", F.lit("low"))
    return low.unionByName(valence.orderBy(F.desc("valence"), "term").limit(k).withColumn("side", F.lit("high")))


def top_terms(terms: DataFrame, group: str, stop: DataFrame, k: int) -> DataFrame:
    """(group, term, n): the k most frequent terms of each group, ties by term."""
    counted = terms.join(F.broadcast(stop), "term", "left_anti").groupBy(group, "term").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def is_junk_term(term: Column) -> Column:
    return (F.length(term) < 3) | term.rlike(r"^\d+$") | term.rlike(r"(.)\1{4,}")


def class_terms(terms: DataFrame, group: str, stop: DataFrame, k: int) -> DataFrame:
    """(group, term, n, weight): the k terms that tell each class from the others, ties by term; junk and stop words left out.

    The weight is a term's count in its class times ln(1 + mean number of terms of a class / count of the term in all).
    """
    counted = terms.where(~is_junk_term(F.col("term"))).join(F.broadcast(stop), "term", "left_anti").groupBy(group, "term").agg(F.sum("n").alias("n"))
    every = counted.groupBy("term").agg(F.sum("n").alias("f"))
    mean = counted.agg((F.sum("n") / F.count_distinct(group)).alias("mean"))
    weighed = with_scalars(counted.join(every, "term"), mean).withColumn("weight", F.col("n") * F.ln(1 + F.col("mean") / F.col("f")))
    order = Window.partitionBy(group).orderBy(F.desc("weight"), "term")  # Spark keeps only the first k of each task before it shuffles
    return weighed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(group, "term", "n", "weight")


def parse_lexicon(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(category_id, category) and (term, wildcard, category_id) from rows (n, line) of a two-section text fenced by % lines.

    A byte-order mark and other line ends are dropped; a missing first fence is supplied.
    """
    clean = lines.select("n", F.regexp_replace(F.rtrim(F.regexp_replace("line", "[﻿\r]", "")), r"^\s*%\s*$", "%").alias("line")).where("line <> ''")
    first = clean.orderBy("n").limit(1)
    missing = first.where("line <> '%'").count()
    section = F.sum((F.col("line") == "%").cast("int")).over(Window.orderBy("n")) + missing
    cut = clean.withColumn("section", section).where("line <> '%'")
    parts = F.filter(F.split("line", r"\t"), lambda x: x != "")
    categories = cut.where("section = 1").select(parts[0].cast("int").alias("category_id"), F.lower(F.substring_index(parts[1], " ", 1)).alias("category"))
    entries = cut.where("section > 1").select(parts.alias("p"))
    terms = entries.select(F.regexp_replace(F.col("p")[0], r"\*$", "").alias("term"), F.col("p")[0].endswith("*").alias("wildcard"), F.explode(F.slice("p", 2, 1000)).alias("c"))
    return categories, terms.select("term", "wildcard", F.col("c").cast("int").alias("category_id"))


def match_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, category) for distinct tokens (token) and lexicon (term, wildcard, category).

    The shortest fitting wildcard wins over longer ones and over exact terms; without a wildcard the exact term counts.
    Prefixes are found by equality on every possible prefix length of the lexicon, not by comparing all with all.
    """
    wild = lexicon.where("wildcard").select(F.col("term").alias("stem"), "category")
    lengths = [r["n"] for r in wild.select(F.length("stem").alias("n")).distinct().collect()]  # a few lengths
    prefixed = words.select("token", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(None).cast("int")])).alias("n")).where("n <= length(token)")
    hits = prefixed.select("token", F.expr("substring(token, 1, n)").alias("stem"), "n").join(wild, "stem")
    best = hits.groupBy("token").agg(F.min("n").alias("n"))
    by_stem = hits.join(best, ["token", "n"]).select("token", "category").distinct()
    exact = lexicon.where("not wildcard").select(F.col("term").alias("token"), "category")
    return by_stem.unionByName(words.join(best, "token", "left_anti").join(exact, "token").select("token", "category").distinct())


def lexicon_rates(documents: DataFrame, key: str, text: str, lexicon: DataFrame, concepts: list[str]) -> DataFrame:
    """(key, one column per concept): percent of a document's tokens in each concept's category; 0 for empty texts.

    Texts with the same key count as one.
    """
    counted = documents.select(key, F.explode(all_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    matched = match_lexicon(counted.select("token").distinct(), lexicon)
    totals = counted.groupBy(key).agg(F.sum("n").alias("tokens"))
    hits = counted.join(matched, "token").groupBy(key).pivot("category", concepts).agg(F.sum("n"))
    joined = documents.select(key).distinct().join(totals, key, "left").join(hits, key, "left")
    return joined.select(key, *[(F.coalesce(F.col(c), F.lit(0)) * 100.0 / F.coalesce("tokens", F.lit(1))).alias(c) for c in concepts])


def topic_entropy(assigned: DataFrame, key: str, topic: str = "topic") -> DataFrame:
    """(key, entropy, scaled): Shannon entropy (natural) of the topics of each key, outliers (-1) left out; scaled to 0..1 over all."""
    counts = assigned.where(F.col(topic) != -1).groupBy(key, topic).agg(F.count(F.lit(1)).alias("n"))
    # sum over n ln n gives the entropy in one pass: ln N - sum(n ln n) / N
    e = counts.groupBy(key).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))
    e = e.withColumn("entropy", F.greatest(F.col("entropy"), F.lit(0.0)))
    ends = e.agg(F.min("entropy").alias("lo"), F.max("entropy").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("entropy") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("entropy"))
    return with_scalars(e, ends).select(key, "entropy", scaled.alias("scaled"))


def assign_topics(vectors: DataFrame, key: str, vector: str, k: int = 10, seed: int = 42, outlier_share: float = 0.05) -> DataFrame:
    """(key, topic): k-means topics, -1 for the vectors farthest from their centre. A stand-in for density clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic").fit(data)
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, center array<double>")
    placed = model.transform(data).select(key, "topic", vector_to_array("features").alias("v")).join(F.broadcast(centers), "topic")  # k rows
    far = placed.withColumn("d", F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    cut = far.agg(F.percentile_approx("d", 1 - outlier_share, 10_000).alias("cut"))
    return with_scalars(far, cut).select(key, F.when(F.col("d") > F.col("cut"), -1).otherwise(F.col("topic")).alias("topic"))
