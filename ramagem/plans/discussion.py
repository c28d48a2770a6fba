"""Cascade, homophily, survival and text queries over comments and post headers, by grouping and for interactive cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.functions import special
from ramagem.functions.bins import quartile
from ramagem.functions.keys import BODY_MARKERS
from ramagem.operators import forest, messages, motifs, social, stats, textops
from ramagem.plans import cascades
from ramagem.plans.cascades import MOTIFS, held
from ramagem.plans.records import CONCEPTS, lexicon_terms
from ramagem.session import with_scalars
from ramagem.sources.tables import table

#: What results are grouped by, and the column that holds it.
GROUPINGS = {"Categories": "category", "Quartiles": "quartile", "Sentiments": "dominant_sentiment"}
BY = ["grouping", "interactive", "grp"]


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    def build():
        made = messages.messages_from_tables(table(spark, folder, "comments"), table(spark, folder, "post_header"), table(spark, folder, "subreddit_category"))
        return made.select(*messages.COLUMNS, "body")

    return held(spark, folder, "discussion-messages", build)


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "discussion-nodes", lambda: forest.cascade_nodes(_messages(spark, folder).drop("body")))


def _motifs(spark: SparkSession, folder: str) -> DataFrame:
    return motifs.motif_counts(forest.interaction_edges(_nodes(spark, folder)))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    build = lambda: forest.cascade_features(_nodes(spark, folder), _motifs(spark, folder)).withColumn("quartile", quartile(F.col("perc_negative")))
    return held(spark, folder, "discussion-features", build)


def grouped(features: DataFrame) -> DataFrame:
    """Each cascade once for every grouping it has a group in, and once more among the interactive ones (those with a motif)."""
    groups = F.array(*[F.struct(F.lit(name).alias("grouping"), F.col(c).alias("grp")) for name, c in GROUPINGS.items()])
    kinds = F.when(F.col("total_motifs") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    each = features.withColumn("__g", F.explode(groups)).withColumn("interactive", F.explode(kinds))
    return each.withColumns({"grouping": F.col("__g.grouping"), "grp": F.col("__g.grp")}).drop("__g").where("grp is not null")


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(_features(spark, folder))


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "discussion-users", lambda: social.user_negativity(_messages(spark, folder)))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return social.typed_edges(forest.reply_edges(_nodes(spark, folder)), _users(spark, folder))


def d_message_cascade(spark, folder):
    return _nodes(spark, folder).select("id", "cascade_id", F.col("dist").cast("long").alias("dist"))


def d_motif_counts(spark, folder):
    return _motifs(spark, folder)


_ROUNDED = ("average_score", "duration_minutes", "perc_negative", "structural_virality", "longest_neg_run_ratio")


def d_cascade_features(spark, folder):
    f = _features(spark, folder)
    whole = ("cascade_id", "subreddit", "category", "cascade_size", "max_depth", "max_breadth", "unique_users", "dominant_sentiment", "total_motifs", "quartile")
    return f.select(*whole, *[F.round(c, 6).alias(c) for c in _ROUNDED])


def d_group_moments(spark, folder):
    """Mean and population deviation of the structure metrics by grouping, of all and of interactive cascades."""
    metrics = ("structural_virality", "cascade_size", "max_depth", "max_breadth", "unique_users")
    return _grouped(spark, folder).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(fn(c), 6).alias(f"{name}_{c}") for c in metrics for name, fn in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def d_motif_heatmap(spark, folder):
    s = _grouped(spark, folder).where("total_motifs > 0").select(*BY, *[(F.col(m) / F.col("total_motifs") * 100).alias(m) for m in MOTIFS])
    n = F.sqrt(F.count(F.lit(1)))
    return s.groupBy(*BY).agg(*[x for m in MOTIFS for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m) / n, 6).alias(f"{m}_se"))])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.to_json(F.struct(*BY)))


def _unkeyed(df: DataFrame, key: str = "g") -> list:
    parsed = F.from_json(F.col(key), "grouping string, interactive boolean, grp string")
    return [parsed[c].alias(c) for c in BY]


def d_ccdf(spark, folder):
    c = stats.ccdf(_keyed(_grouped(spark, folder)), "key", "cascade_size")
    return c.select(*_unkeyed(c), F.col("v").alias("cascade_size"), F.round("share", 6).alias("share"))


def d_triad_heatmap(spark, folder):
    """Percent of the named label triples of a grouping that are of a name and in a group."""
    triples = motifs.sentiment_triads(_nodes(spark, folder), "cascade_id")
    rows = triples.join(_grouped(spark, folder).select("cascade_id", *BY), "cascade_id").groupBy(*BY, "triad").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([("".join(map(motifs.code_of, t[:3])), t[3]) for t in motifs.NAMED_TRIADS], "triad string, name string")
    named = rows.join(F.broadcast(names), "triad")  # twelve names
    totals = named.groupBy("grouping", "interactive").agg(F.sum("n").alias("all"))  # six rows
    return named.join(F.broadcast(totals), ["grouping", "interactive"]).select(*BY, "triad", "name", F.round(F.col("n") / F.col("all") * 100, 6).alias("share"))


def d_taxonomy(spark, folder):
    """Median virality and mean negativity by subreddit, of all and of interactive cascades."""
    f = _grouped(spark, folder).where("grouping = 'Sentiments' and subreddit is not null").withColumn("key", F.to_json(F.struct("interactive", "subreddit")))
    median = stats.quantiles(f, "key", "structural_virality", {"m": 0.5}).select(F.col("g").alias("key"), F.round("m", 6).alias("median_virality"))
    mean = f.groupBy("key", "interactive", "subreddit").agg(F.round(F.avg("perc_negative"), 6).alias("mean_negativity"))
    return mean.join(median, "key").select("interactive", "subreddit", "median_virality", "mean_negativity")


def d_kruskal(spark, folder):
    rows = held(spark, folder, "discussion-grouped", lambda: _grouped(spark, folder))
    each = [(g, i) for g in GROUPINGS for i in (False, True)]
    tests = [stats.kruskal(rows.where((F.col("grouping") == g) & (F.col("interactive") == i)), "grp", "cascade_size").select(F.lit(g).alias("grouping"), F.lit(i).alias("interactive"), F.round("h", 6).alias("h"), "n", "groups") for g, i in each]
    return reduce(DataFrame.unionByName, tests)


def d_ks_pairwise(spark, folder):
    rows = held(spark, folder, "discussion-grouped", lambda: _grouped(spark, folder))
    tests = [stats.ks_pairwise(rows.where((F.col("grouping") == g) & ~F.col("interactive")), "grp", "structural_virality").withColumn("grouping", F.lit(g)) for g in GROUPINGS]
    return reduce(DataFrame.unionByName, tests).select("grouping", "g1", "g2", "n1", "n2", F.round("d", 9).alias("d"))


def d_quartile_differences(spark, folder):
    """Mean and median of the structure metrics in Q3 and Q4, and what Q4 has more."""
    f = _features(spark, folder).where("quartile in ('Q3', 'Q4')")
    out = []
    for c in ("structural_virality", "cascade_size", "max_depth", "max_breadth"):
        medians = stats.quantiles(f, "quartile", c, {"m": 0.5}).groupBy().agg(*[F.max(F.when(F.col("g") == q, F.col("m"))).alias(f"median_{q.lower()}") for q in ("Q3", "Q4")])
        means = f.groupBy().agg(*[F.avg(F.when(F.col("quartile") == q, F.col(c))).alias(f"mean_{q.lower()}") for q in ("Q3", "Q4")])
        both = with_scalars(means, medians).select(F.lit(c).alias("metric"), *[F.round(x, 6).alias(x) for x in ("mean_q3", "mean_q4", "median_q3", "median_q4")], F.round(F.col("mean_q4") - F.col("mean_q3"), 6).alias("more"))
        out.append(both)
    return reduce(DataFrame.unionByName, out)


def d_homophily_index(spark, folder):
    return social.homophily_index(_typed(spark, folder)).select("user_type", "n_users", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se")])


def d_homophily_matrix(spark, folder):
    return social.homophily_matrix(_typed(spark, folder)).select("source_type", *[F.round(f"uq{i}", 6).alias(f"uq{i}") for i in range(1, 5)])


def d_homophily_ks(spark, folder):
    """Gaps between the distributions of the users' homophily, for the pairs of types that are reported."""
    typed = _typed(spark, folder)
    h = typed.groupBy("source", "s_type").agg((F.sum(F.when(F.col("s_type") == F.col("t_type"), F.col("n")).otherwise(0)) / F.sum("n")).alias("h"))
    pairs = stats.ks_pairwise(h, "s_type", "h").where("(g1, g2) in (('UQ1', 'UQ4'), ('UQ3', 'UQ4'), ('UQ1', 'UQ3'))")
    return pairs.select("g1", "g2", "n1", "n2", F.round("d", 9).alias("d"))


def d_survival_rows(spark, folder):
    s = held(spark, folder, "discussion-stays", lambda: social.stays(_messages(spark, folder)))
    return s.select("thread", "author", "duration", "event", F.round("exposure_ratio", 9).alias("exposure_ratio"))


def d_km_curve(spark, folder):
    """Survival of stays by exposure, with 95 % bounds."""
    s = held(spark, folder, "discussion-stays", lambda: social.stays(_messages(spark, folder)))
    cut = stats.quantiles(s, None, "exposure_ratio", {"cut": 0.75}).drop("g")
    split = with_scalars(s, cut).withColumn("exposure", F.when(F.col("exposure_ratio") >= F.col("cut"), "high").otherwise("low"))
    k = stats.kaplan_meier(split, "exposure", "duration", "event")
    return k.select(F.col("g").alias("exposure"), "t", "at_risk", "events", *[F.round(c, 9).alias(c) for c in ("survival", "lower", "upper")])


def d_churn_users(spark, folder):
    c = held(spark, folder, "discussion-churn", lambda: social.churn(_messages(spark, folder)))
    return c.select("author", F.round("duration_days", 6).alias("duration_days"), "event", F.round("neg_ratio", 9).alias("neg_ratio"), "total_msgs", "user_quartile")


def d_trendlines(spark, folder):
    """Negativity on virality by dominant sentiment, with p-values."""
    t = stats.trend_p(stats.trendline(_features(spark, folder), "structural_virality", "perc_negative", "dominant_sentiment"))
    return t.select("dominant_sentiment", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "p")])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, cascade_id, author, body, quartile, user_type) of usable comments in kept cascades."""

    def build():
        kinds = _features(spark, folder).select("cascade_id", "quartile", "perc_negative")
        bodies = _messages(spark, folder).where("type = 'comment'").where(textops.usable_text(F.col("author"), F.col("body"), ~F.col("body").isin(*BODY_MARKERS))).select("id", "body")
        rows = _nodes(spark, folder).select("id", "cascade_id", "author").join(kinds, "cascade_id").join(bodies, "id")
        return rows.join(_users(spark, folder).select("author", "user_type"), "author", "left")

    return held(spark, folder, "discussion-texts", build)


#: The contrasts of vocabulary: of cascades and users, between the ends, the middle two, and the halves.
CONTRASTS = (
    ("quartile", "Q1", "Q4"), ("user_type", "UQ1", "UQ4"), ("quartile", "Q2", "Q3"),
    ("user_type", "UQ2", "UQ3"), ("cascade_half", "Q1+Q2", "Q3+Q4"), ("user_half", "UQ1+UQ2", "UQ3+UQ4"),
)


def d_term_valence(spark, folder):
    """The ten terms at either end of each contrast."""
    low = lambda c, a, b: F.when(F.col(c).isin(a, b), f"{a}+{b}")
    half = lambda c, p: low(c, f"{p}1", f"{p}2").otherwise(F.when(F.col(c).isin(f"{p}3", f"{p}4"), f"{p}3+{p}4"))
    texts = _texts(spark, folder).withColumns({"cascade_half": half("quartile", "Q"), "user_half": half("user_type", "UQ")})
    stop = textops.stopwords(spark)
    out = []
    for column, g1, g2 in CONTRASTS:
        terms = textops.document_terms(texts.where(F.col(column).isin(g1, g2)), "id", column, "body")
        both = textops.extreme_terms(textops.term_valence(terms, column, g1, g2, stop), 10)
        out.append(both.select(F.lit(f"{g1} / {g2}").alias("contrast"), "term", F.round("valence", 6).alias("valence"), "total"))
    return reduce(DataFrame.unionByName, out)


def d_term_clouds(spark, folder):
    """The 200 most frequent terms of each quartile of cascades."""
    terms = textops.document_terms(_texts(spark, folder).where("quartile is not null"), "id", "quartile", "body")
    return textops.top_terms(terms, "quartile", textops.stopwords(spark), 200)


def d_topic_words(spark, folder):
    """The ten words that tell each category's comments from the others', by class TF-IDF, without junk terms."""
    kept = _features(spark, folder).select("cascade_id", "category").where("category is not null")
    terms = textops.document_terms(_texts(spark, folder).join(kept, "cascade_id"), "id", "category", "body")
    words = textops.class_terms(terms, "category", textops.stopwords(spark), 10)
    return words.select("category", "term", "n", F.round("weight", 6).alias("weight"))


def _lexicon_rates(spark: SparkSession, folder: str) -> DataFrame:
    def build():
        texts = _texts(spark, folder)
        # all texts of a cascade are read as one: its rate is that of all its tokens
        rates = textops.lexicon_rates(texts, "cascade_id", "body", lexicon_terms(spark), CONCEPTS)
        return rates.join(_features(spark, folder).select("cascade_id", "quartile", "perc_negative"), "cascade_id")

    return held(spark, folder, "discussion-lexicon", build)


def d_lexicon_by_quartile(spark, folder):
    """Mean rates of the lexicon's concepts in the cascades of each quartile, with standard errors."""
    n = F.sqrt(F.count(F.lit(1)))
    return _lexicon_rates(spark, folder).groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), *[x for c in CONCEPTS for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c) / n, 6).alias(f"{c}_se"))]
    )


def d_lexicon_negativity(spark, folder):
    """Rank correlation of each concept's rate with the negativity of cascades, in falling order, with p-values."""
    rates = _lexicon_rates(spark, folder)
    found = [(c, r["rho"], r["n"]) for c in CONCEPTS for r in stats.spearman(rates, "perc_negative", c).collect()]  # one row a concept
    rows = [(c, rho, None if rho is None else special.correlation_p(rho, n), n) for c, rho, n in found]
    df = spark.createDataFrame(rows, "concept string, rho double, p double, n long")
    return df.select("concept", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"), "n").orderBy(F.desc_nulls_last("rho"))


QUERIES = {
    f.__name__: f
    for f in (
        d_message_cascade, d_motif_counts, d_cascade_features, d_group_moments, d_motif_heatmap, d_ccdf, d_triad_heatmap, d_taxonomy, d_kruskal, d_ks_pairwise, d_quartile_differences, d_homophily_index,
        d_homophily_matrix, d_homophily_ks, d_survival_rows, d_km_curve, d_churn_users, d_trendlines, d_term_valence, d_term_clouds, d_topic_words, d_lexicon_by_quartile, d_lexicon_negativity,
    )
}

_VALID = "label IN ('POSITIVE', 'NEUTRAL', 'NEGATIVE')"
_M = """
raw AS (SELECT nullif(regexp_replace(id, '^.*_', ''), '') AS id, type, nullif(regexp_replace(parent_id, '^.*_', ''), '') AS parent_id, post_id AS thread,
        regexp_replace(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '/+$', '') AS subreddit, author, upper(trim(ai_analysis.label)) AS label, nullif("timestamp", 0) AS stamp, metadata_score AS score, body, harvested_at
        FROM (SELECT type, id, parent_id, post_id, subreddit, author, ai_analysis, "timestamp", metadata_score, body, harvested_at FROM comments
              UNION ALL SELECT type, id, parent_id, post_id, subreddit, author, ai_analysis, "timestamp", metadata_score, body, harvested_at FROM post_header)),
m AS (SELECT r.*, category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC, coalesce(score, -4611686018427387904) DESC) AS rn FROM raw WHERE id IS NOT NULL) r
      LEFT JOIN subreddit_category USING (subreddit) WHERE rn = 1)"""


def _on_tables(sql: str) -> str:
    """A statement over the derived messages, turned to those of the tables."""
    for old, new in (
        (cascades._M, _M),
        ("parent_id % 25 = 0", "parent_id IN (SELECT id FROM m WHERE type = 'post_header')"),
        ("label <> 'REMOVED_BY_MOD'", _VALID),
        ("WHERE label <> 'NEGATIVE'", "WHERE coalesce(label, '') <> 'NEGATIVE'"),
        ("FROM n a JOIN m p ON a.parent_id = p.id WHERE a.dist > 0", "FROM n a JOIN n p ON a.parent_id = p.id WHERE a.dist > 0 AND a.author NOT IN ('[deleted]', 'deleted') AND p.author NOT IN ('[deleted]', 'deleted')"),
        ("greatest(count(DISTINCT author), 1)", "greatest(count(DISTINCT CASE WHEN author NOT IN ('[deleted]', 'deleted') THEN author END), 1)"),
        ("avg(score)", "avg(coalesce(score, 0))"),
        ("CASE WHEN count(*) >= 2 THEN", "CASE WHEN count(stamp) >= 2 THEN"),
    ):
        sql = sql.replace(old, new)
    return sql


_W = "WITH RECURSIVE "
_C, _CV, _CE, _F = (_on_tables(x) for x in (cascades._C, cascades._C + cascades._V, cascades._C + cascades._E, cascades._F))
_U = """,
u AS (SELECT author, count(*) AS total, count(*) FILTER (label = 'NEGATIVE') * 100.0::DOUBLE / count(*) AS perc_negative FROM m
      WHERE label IN ('POSITIVE', 'NEUTRAL', 'NEGATIVE') AND author NOT IN ('[deleted]', 'deleted', 'automoderator', 'redditcaresresources') GROUP BY 1),
ut AS (SELECT *, CASE WHEN perc_negative <= 25 THEN 'UQ1' WHEN perc_negative <= 50 THEN 'UQ2' WHEN perc_negative <= 75 THEN 'UQ3' ELSE 'UQ4' END AS user_type FROM u)"""
_TE = cascades._TE
_G = """,
x AS (SELECT 'Categories' AS grouping, category AS grp, * FROM g UNION ALL SELECT 'Quartiles', quartile, * FROM g UNION ALL SELECT 'Sentiments', dominant_sentiment, * FROM g),
y AS (SELECT false AS interactive, * FROM x WHERE grp IS NOT NULL UNION ALL SELECT true, * FROM x WHERE grp IS NOT NULL AND total_motifs > 0)"""
_OUT = "lower(author) NOT IN ('[deleted]', 'automoderator', 'redditcaresresources')"
_STAY = f""",
sq AS (SELECT thread, author, row_number() OVER w AS p, sum(CASE WHEN label = 'NEGATIVE' THEN 1 ELSE 0 END) OVER w AS neg, count(*) OVER (PARTITION BY thread) AS steps FROM m
       WHERE stamp IS NOT NULL AND thread IS NOT NULL AND {_OUT} WINDOW w AS (PARTITION BY thread ORDER BY stamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sy AS (SELECT thread, author, CAST(max(p) - min(p) + 1 AS INTEGER) AS duration, CAST(any_value(steps) - (max(p) - 1) >= 5 AS INTEGER) AS event,
       (max(neg) - min(neg)) * 1.0::DOUBLE / (max(p) - min(p) + 1) AS exposure_ratio FROM sq WHERE steps >= 10 GROUP BY 1, 2 HAVING max(p) - min(p) + 1 > 1)"""
_CHURN = f""",
cu AS (SELECT author, greatest((max(stamp) - min(stamp)) / 86400, 0.5) AS duration_days, CAST(((SELECT max(stamp) FROM m) - max(stamp)) / 86400 > 30.0 AS INTEGER) AS event,
       count(*) FILTER (label = 'NEGATIVE') * 1.0::DOUBLE / count(*) AS neg_ratio, count(*) AS total_msgs FROM m WHERE stamp IS NOT NULL AND {_OUT} GROUP BY 1 HAVING count(*) >= 5),
cq AS (SELECT quantile_cont(neg_ratio, 0.25) AS a, quantile_cont(neg_ratio, 0.5) AS b, quantile_cont(neg_ratio, 0.75) AS c FROM cu)"""
_KM = cascades._KM.replace("survival FROM kr", "survival, exp(sum(ln(greatest(1 - events * 1.0::DOUBLE / at_risk, 1e-300))) OVER w) AS raw, sum(ln(greatest(1 - events * 1.0::DOUBLE / at_risk, 1e-300))) OVER w AS logs,\n       sum(CASE WHEN at_risk > events THEN events * 1.0::DOUBLE / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS spread FROM kr")


def _bound(sign: str) -> str:
    return f"round(CASE WHEN survival > 0 AND logs < 0 THEN exp(logs * exp({sign}1.959963984540054 * sqrt(spread) / logs)) ELSE survival END, 9)"


_RANKED = "SELECT *, rank() OVER (PARTITION BY grouping, interactive ORDER BY cascade_size) + (count(*) OVER (PARTITION BY grouping, interactive, cascade_size) - 1) / 2.0::DOUBLE AS r FROM y"
_DIFF = " UNION ALL ".join(
    f"SELECT '{c}' AS metric, round(avg({c}) FILTER (quartile = 'Q3'), 6) AS mean_q3, round(avg({c}) FILTER (quartile = 'Q4'), 6) AS mean_q4, round(median({c}) FILTER (quartile = 'Q3'), 6) AS median_q3, "
    f"round(median({c}) FILTER (quartile = 'Q4'), 6) AS median_q4, round(avg({c}) FILTER (quartile = 'Q4') - avg({c}) FILTER (quartile = 'Q3'), 6) AS more FROM g"
    for c in ("structural_virality", "cascade_size", "max_depth", "max_breadth")
)
SQL = {
    "d_message_cascade": f"{_W}{_C} SELECT id, cascade_id, CAST(dist AS BIGINT) AS dist FROM c",
    "d_motif_counts": f"{_W}{_CE} SELECT * FROM mo",
    "d_cascade_features": f"{_W}{_F} SELECT cascade_id, subreddit, category, cascade_size, max_depth, max_breadth, unique_users, dominant_sentiment, total_motifs, quartile, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)
    + " FROM g",
    "d_group_moments": f"{_W}{_F}{_G} SELECT grouping, interactive, grp, count(*) AS n, "
    + ", ".join(f"round({fn}({c}), 6) AS {name}_{c}" for c in ("structural_virality", "cascade_size", "max_depth", "max_breadth", "unique_users") for name, fn in (("mean", "avg"), ("std", "stddev_pop")))
    + " FROM y GROUP BY 1, 2, 3",
    "d_motif_heatmap": f"{_W}{_F}{_G} SELECT grouping, interactive, grp, "
    + ", ".join(f"round(avg({x} * 100.0::DOUBLE / total_motifs), 6) AS {x}_mean, round(stddev_samp({x} * 100.0::DOUBLE / total_motifs) / sqrt(count(*)), 6) AS {x}_se" for x in MOTIFS)
    + " FROM y WHERE total_motifs > 0 GROUP BY 1, 2, 3",
    "d_ccdf": f"""{_W}{_F}{_G}, s AS (SELECT grouping, interactive, grp, cascade_size, count(*) AS k FROM y GROUP BY 1, 2, 3, 4)
SELECT grouping, interactive, grp, CAST(cascade_size AS DOUBLE) AS cascade_size, round((1 - coalesce(sum(k) OVER (PARTITION BY grouping, interactive, grp ORDER BY cascade_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1.0::DOUBLE
/ sum(k) OVER (PARTITION BY grouping, interactive, grp)) * 100, 6) AS share FROM s""",
    "d_triad_heatmap": f"""{_W}{_F}{_G},
co AS (SELECT *, CASE label WHEN 'POSITIVE' THEN 'P' WHEN 'NEUTRAL' THEN 'U' WHEN 'NEGATIVE' THEN 'N' END AS z FROM n),
nm AS (SELECT * FROM (VALUES ('NNN', 'Negative Persistence'), ('PPP', 'Positive Persistence'), ('PNN', 'Negative Convergence (from pos)'), ('UNN', 'Negative Convergence (from neu)'),
       ('NPP', 'Positive Convergence (from neg)'), ('UPP', 'Positive Convergence (from neu)'), ('PPN', 'Shift (to neg)'), ('NNP', 'Shift (to pos)'), ('PNP', 'Oscillation (a)'), ('NPN', 'Oscillation (b)'),
       ('PUN', 'Mixed Transition (to neg)'), ('NUP', 'Mixed Transition (to pos)')) v(triad, name)),
tt AS (SELECT q.cascade_id, w.z || p.z || q.z AS triad FROM co q JOIN co p ON q.parent_id = p.id JOIN co w ON p.parent_id = w.id WHERE q.dist >= 2),
tg AS (SELECT grouping, interactive, grp, triad, name, count(*) AS k FROM tt JOIN nm USING (triad) JOIN y USING (cascade_id) GROUP BY 1, 2, 3, 4, 5)
SELECT grouping, interactive, grp, triad, name, round(k * 100.0::DOUBLE / sum(k) OVER (PARTITION BY grouping, interactive), 6) AS share FROM tg""",
    "d_taxonomy": f"{_W}{_F}{_G} SELECT interactive, subreddit, round(median(structural_virality), 6) AS median_virality, round(avg(perc_negative), 6) AS mean_negativity FROM y WHERE grouping = 'Sentiments' AND subreddit IS NOT NULL GROUP BY 1, 2",
    "d_kruskal": f"""{_W}{_F}{_G}, rk AS ({_RANKED}),
q AS (SELECT grouping, interactive, sum(rs * rs / k) AS q, sum(k) AS n, count(*) AS groups FROM (SELECT grouping, interactive, grp, sum(r) AS rs, count(*) AS k FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2),
ti AS (SELECT grouping, interactive, sum(k * 1.0::DOUBLE * k * k - k) AS ties FROM (SELECT grouping, interactive, cascade_size, count(*) AS k FROM y GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT grouping, interactive, round((12 / (n * (n + 1.0::DOUBLE)) * q - 3 * (n + 1)) / (1 - ties / (n * 1.0::DOUBLE * n * n - n)), 6) AS h, CAST(n AS BIGINT) AS n, groups FROM q JOIN ti USING (grouping, interactive)""",
    "d_ks_pairwise": f"""{_W}{_F}{_G}, d AS (SELECT grouping, grp, round(structural_virality, 12) AS x FROM y WHERE NOT interactive),
kk AS (SELECT grouping, grp, count(*) AS k FROM d GROUP BY 1, 2), xs AS (SELECT DISTINCT grouping, x FROM d),
cf AS (SELECT grouping, grp, x, (SELECT count(*) FROM d WHERE d.grouping = kk.grouping AND d.grp = kk.grp AND d.x <= xs.x) * 1.0::DOUBLE / kk.k AS f FROM kk JOIN xs USING (grouping))
SELECT grouping, a.grp AS g1, b.grp AS g2, ka.k AS n1, kb.k AS n2, round(max(abs(a.f - b.f)), 9) AS d FROM cf a JOIN cf b USING (grouping, x) JOIN kk ka USING (grouping) JOIN kk kb USING (grouping)
WHERE a.grp < b.grp AND ka.grp = a.grp AND kb.grp = b.grp GROUP BY 1, 2, 3, 4, 5""",
    "d_quartile_differences": f"{_W}{_F} {_DIFF}",
    "d_homophily_index": f"""{_W}{_CE}{_U}{_TE}, h AS (SELECT source, s_type, count(*) FILTER (s_type = t_type) * 1.0::DOUBLE / count(*) AS h FROM te GROUP BY 1, 2)
SELECT s_type AS user_type, count(*) AS n_users, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(stddev_samp(h) / sqrt(count(*)), 6) AS se FROM h GROUP BY 1""",
    "d_homophily_matrix": f"{_W}{_CE}{_U}{_TE} SELECT s_type AS source_type, " + ", ".join(f"round(count(*) FILTER (t_type = 'UQ{i}') * 100.0::DOUBLE / count(*), 6) AS uq{i}" for i in range(1, 5)) + " FROM te GROUP BY 1",
    "d_homophily_ks": f"""{_W}{_CE}{_U}{_TE}, d AS (SELECT s_type AS grp, round(count(*) FILTER (s_type = t_type) * 1.0::DOUBLE / count(*), 12) AS x FROM te GROUP BY source, s_type),
k2 AS (SELECT grp, count(*) AS k FROM d GROUP BY 1), xs AS (SELECT DISTINCT x FROM d), cf AS (SELECT grp, k, x, (SELECT count(*) FROM d WHERE d.grp = k2.grp AND d.x <= xs.x) * 1.0::DOUBLE / k AS f FROM k2, xs)
SELECT a.grp AS g1, b.grp AS g2, a.k AS n1, b.k AS n2, round(max(abs(a.f - b.f)), 9) AS d FROM cf a JOIN cf b USING (x)
WHERE (a.grp = 'UQ1' AND b.grp = 'UQ4') OR (a.grp = 'UQ3' AND b.grp = 'UQ4') OR (a.grp = 'UQ1' AND b.grp = 'UQ3') GROUP BY 1, 2, 3, 4""",
    "d_survival_rows": f"WITH {_M}{_STAY} SELECT thread, author, duration, event, round(exposure_ratio, 9) AS exposure_ratio FROM sy",
    "d_km_curve": f"""WITH {_M}{_STAY}, ksrc AS (SELECT CASE WHEN exposure_ratio >= (SELECT quantile_cont(exposure_ratio, 0.75) FROM sy) THEN 'high' ELSE 'low' END AS g, CAST(duration AS DOUBLE) AS t, event FROM sy){_KM}
SELECT g AS exposure, t, at_risk, events, round(survival, 9) AS survival, {_bound('-')} AS lower, {_bound('')} AS upper FROM kp""",
    "d_churn_users": f"""WITH {_M}{_CHURN} SELECT author, round(duration_days, 6) AS duration_days, event, round(neg_ratio, 9) AS neg_ratio, total_msgs,
CASE WHEN neg_ratio <= a THEN 'UQ1' WHEN neg_ratio <= b THEN 'UQ2' WHEN neg_ratio <= c THEN 'UQ3' ELSE 'UQ4' END AS user_quartile FROM cu, cq""",
}
