"""Queries over reply cascades of the event-derived message fixture, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.functions.bins import quartile
from ramagem.functions.keys import VALID_LABELS
from ramagem.operators import forest, messages, motifs, social, stats
from ramagem.session import cut_lineage, with_scalars
from ramagem.sources.shared import fingerprint
from ramagem.sources.tables import table

_HELD: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def held(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Silver and gold tables, written once per application and source folder and shared by all queries on it.

    Built anew if the files of the folder have changed.
    """
    key, now = (spark.sparkContext.applicationId, folder, name), fingerprint(spark, folder)
    if key not in _HELD or _HELD[key][0] != now:
        _HELD[key] = (now, cut_lineage(build()))
    return _HELD[key][1]


def forget() -> None:
    """Let the shared tables be built anew."""
    _HELD.clear()


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages.messages_from_events(table(spark, folder, "events"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "nodes", lambda: forest.cascade_nodes(_messages(spark, folder)))


def _motifs(spark: SparkSession, folder: str) -> DataFrame:
    return motifs.motif_counts(forest.interaction_edges(_nodes(spark, folder)))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    build = lambda: forest.cascade_features(_nodes(spark, folder), _motifs(spark, folder)).withColumn("quartile", quartile(F.col("perc_negative")))
    return held(spark, folder, "features", build)


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return social.user_negativity(_messages(spark, folder))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return forest.reply_edges(_nodes(spark, folder))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return social.typed_edges(_edges(spark, folder), _users(spark, folder))


def message_cascade(spark, folder):
    return _nodes(spark, folder).select("id", "cascade_id", F.col("dist").cast("long").alias("dist"))


def thread_root(spark, folder):
    return _nodes(spark, folder).select("id", F.col("thread").alias("root"))


def cascade_structure(spark, folder):
    return forest.structure(_nodes(spark, folder))


def structural_virality(spark, folder):
    v = forest.virality(_nodes(spark, folder))
    return v.select("cascade_id", "wiener", F.round("structural_virality", 9).alias("structural_virality"), F.round("mean_distance", 9).alias("mean_distance"))


def longest_neg_run(spark, folder):
    r = forest.longest_negative_run(_nodes(spark, folder))
    return r.select("cascade_id", "longest_neg_run", F.round("longest_neg_run_ratio", 9).alias("longest_neg_run_ratio"))


def interaction_edges(spark, folder):
    return forest.interaction_edges(_nodes(spark, folder))


def reply_edges(spark, folder):
    return _edges(spark, folder).groupBy("cascade_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def motif_counts(spark, folder):
    return _motifs(spark, folder)


def cascade_features(spark, folder):
    f = _features(spark, folder)
    rounded = ("average_score", "duration_minutes", "perc_negative", "structural_virality", "longest_neg_run_ratio")
    return f.select(
        "cascade_id", "subreddit", "category", "cascade_size", "max_depth", "max_breadth", "unique_users", "dominant_sentiment", "total_motifs", "quartile", *[F.round(c, 6).alias(c) for c in rounded]
    )


def interactive_only(spark, folder):
    return _features(spark, folder).where("total_motifs > 0").select("cascade_id", "total_motifs")


def cascade_quartiles(spark, folder):
    return social.quartile_table(_features(spark, folder), "quartile", "perc_negative").select("quartile", "n", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


DESCRIBED = ("structural_virality", "cascade_size", "max_depth")


def quartile_descriptives(spark, folder):
    f = _features(spark, folder)
    total = f.agg(F.count(F.lit(1)).alias("all"))
    d = f.where("quartile is not null").groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(fn(c), 6).alias(f"{name}_{c}") for c in DESCRIBED for name, fn in (("mean", F.avg), ("std", F.stddev_samp))],
    )
    for c in DESCRIBED:
        d = d.join(stats.quantiles(f, "quartile", c, {"m": 0.5}).select(F.col("g").alias("quartile"), F.round("m", 6).alias(f"median_{c}")), "quartile", "left")
    return with_scalars(d, total).withColumn("share", F.round(F.col("n") / F.col("all") * 100, 6)).drop("all")


def group_moments(spark, folder):
    """Mean and population deviation of the structure metrics by category."""
    return _features(spark, folder).groupBy("category").agg(
        *[F.round(fn(c), 6).alias(f"{name}_{c}") for c in ("structural_virality", "cascade_size", "max_breadth", "average_score") for name, fn in (("mean", F.avg), ("std", F.stddev_pop))]
    )


MOTIFS = ("dyad", "mutual_dyad", "chain", "fan_in", "fan_out", "triangle", "recip_triangle")


def motif_heatmap(spark, folder):
    f = _features(spark, folder).where("total_motifs > 0")
    share = [(F.col(m) / F.col("total_motifs") * 100).alias(m) for m in MOTIFS]
    s = f.select("category", *share)
    n = F.sqrt(F.count(F.lit(1)))
    return s.groupBy("category").agg(*[x for m in MOTIFS for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m) / n, 6).alias(f"{m}_se"))])


def taxonomy(spark, folder):
    f = _features(spark, folder).withColumn("place", F.to_json(F.struct("subreddit", "category")))
    median = stats.quantiles(f, "place", "structural_virality", {"m": 0.5}).select(F.col("g").alias("place"), F.round("m", 6).alias("median_virality"))
    mean = f.groupBy("place", "subreddit", "category").agg(F.round(F.avg("perc_negative"), 6).alias("mean_negativity"))
    return mean.join(median, "place").select("subreddit", "category", "median_virality", "mean_negativity")


def triad_heatmap(spark, folder):
    t = motifs.sentiment_triads(_nodes(spark, folder))
    return _triad_shares(spark, t, [f"cat{i}" for i in range(4)])


def _triad_shares(spark, triads, groups, group="category"):
    """Percent of all named triples, by name and group."""
    names = spark.createDataFrame([(motifs.code_of(a) + motifs.code_of(b) + motifs.code_of(c), name) for a, b, c, name in motifs.NAMED_TRIADS], "triad string, name string")
    named = triads.join(F.broadcast(names), "triad")  # twelve names
    wide = named.groupBy("triad", "name").pivot(group, groups).agg(F.sum("n")).na.fill(0)
    return with_scalars(wide, named.agg(F.sum("n").alias("all"))).select("triad", "name", *[F.round(F.col(f"`{g}`") / F.col("all") * 100, 6).alias(g) for g in groups])


def sentiment_triples(spark, folder):
    return motifs.sentiment_triads(_nodes(spark, folder))


def ccdf_metrics(spark, folder):
    c = stats.ccdf(_features(spark, folder), "category", "structural_virality")
    return c.select(F.col("g").alias("category"), F.round("v", 9).alias("virality"), F.round("share", 6).alias("share"))


def trendline_dominant(spark, folder):
    t = stats.trendline(_features(spark, folder), "structural_virality", "perc_negative", "dominant_sentiment")
    return t.select("dominant_sentiment", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


def trendline_taxonomy(spark, folder):
    f = _features(spark, folder)
    median = stats.quantiles(f, "subreddit", "structural_virality", {"x": 0.5}).withColumnRenamed("g", "subreddit")
    by = f.groupBy("subreddit").agg(F.avg("perc_negative").alias("y")).join(median, "subreddit")
    return stats.trendline(by, "x", "y").select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


def kruskal(spark, folder):
    k = stats.kruskal(_features(spark, folder), "category", "structural_virality")
    return k.select(F.round("h", 6).alias("h"), "n", "groups")


def ks_pairwise(spark, folder):
    return stats.ks_pairwise(_features(spark, folder), "category", "structural_virality").select("g1", "g2", "n1", "n2", F.round("d", 9).alias("d"))


def cliffs_delta(spark, folder):
    return stats.cliffs_delta(_features(spark, folder), "category", "structural_virality", "cat0", "cat3").select(F.round("u", 6).alias("u"), F.round("delta", 9).alias("delta"))


def _spearman(x: str, y: str):
    return lambda spark, folder: stats.spearman(_features(spark, folder), x, y).select(F.round("rho", 6).alias("rho"), "n")


def statistical_report(spark, folder):
    """All tests over categories with p-values, for the metrics that are reported."""
    rows = []
    for metric in ("structural_virality", "cascade_size", "max_depth", "max_breadth"):
        f = _features(spark, folder)
        k = stats.kruskal(f, "category", metric).first()
        rows.append((metric, "kruskal", "all", k["h"], stats.kruskal_p(k["h"], k["groups"])))
        rows += [(metric, "ks", f"{r['g1']}-{r['g2']}", r["d"], stats.ks_p(r["d"], r["n1"], r["n2"])) for r in stats.ks_pairwise(f, "category", metric).collect()]  # pairs of groups
        s = stats.spearman(f, "perc_negative", metric).first()
        rows.append((metric, "spearman", "negativity", s["rho"], stats.special.correlation_p(s["rho"], s["n"])))
    return spark.createDataFrame(rows, "metric string, test string, pair string, statistic double, p double")


def sentiment_totals(spark, folder):
    return social.sentiment_totals(_messages(spark, folder)).select("label", "n", F.round("share", 6).alias("share"))


def user_negativity(spark, folder):
    return _users(spark, folder).select("author", "total", "negative", F.round("perc_negative", 6).alias("perc_negative"), "user_type")


def user_quartiles(spark, folder):
    return social.quartile_table(_users(spark, folder), "user_type", "perc_negative").select("quartile", "n", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


def dataset_overview(spark, folder):
    m = _messages(spark, folder)
    counts = m.agg(
        F.count_if(F.col("type") == "post_header").alias("posts"),
        F.count_if((F.col("type") == "comment") & F.col("label").isin(*VALID_LABELS)).alias("valid_comments"),
        F.count_distinct("author").alias("users"),
        F.count_if(F.col("label") == "NEGATIVE").alias("negative"),
    )
    cascades = _features(spark, folder).agg(F.count(F.lit(1)).alias("cascades"), F.sum("cascade_size").alias("messages_in_cascades"))
    return with_scalars(counts, cascades)


def homophily_index(spark, folder):
    h = social.homophily_index(_typed(spark, folder))
    return h.select("user_type", "n_users", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se")])


def homophily_matrix(spark, folder):
    return social.homophily_matrix(_typed(spark, folder)).select("source_type", *[F.round(f"uq{i}", 6).alias(f"uq{i}") for i in range(1, 5)])


def target_negativity(spark, folder):
    return social.target_negativity(_edges(spark, folder), _users(spark, folder)).select("user_type", "n", F.round("mean", 6).alias("mean"))


def structure_by_user_quartile(spark, folder):
    kinds = _users(spark, folder).select("author", F.substring("user_type", 3, 1).cast("int").alias("k"))
    mean = _nodes(spark, folder).join(kinds, "author").groupBy("cascade_id").agg(F.avg("k").alias("k"))
    kind = F.when(F.col("k") <= 1.5, "UQ1").when(F.col("k") <= 2.5, "UQ2").when(F.col("k") <= 3.5, "UQ3").otherwise("UQ4")
    joined = _features(spark, folder).join(mean, "cascade_id").withColumn("user_quartile", kind)
    return joined.groupBy("user_quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("structural_virality"), 6).alias("mean_virality"), F.round(F.avg("cascade_size"), 6).alias("mean_size"))


def survival_rows(spark, folder):
    s = social.stays(_messages(spark, folder))
    return s.select("thread", "author", "duration", "event", F.round("exposure_ratio", 9).alias("exposure_ratio"))


def km_curve(spark, folder):
    s = held(spark, folder, "stays", lambda: social.stays(_messages(spark, folder)))
    cut = stats.quantiles(s, None, "exposure_ratio", {"cut": 0.75}).drop("g")
    split = with_scalars(s, cut).withColumn("exposure", F.when(F.col("exposure_ratio") >= F.col("cut"), "high").otherwise("low"))
    k = stats.kaplan_meier(split, "exposure", "duration", "event")
    return k.select(F.col("g").alias("exposure"), "t", "at_risk", "events", F.round("survival", 9).alias("survival"))


#: The fixture spans a month, so that users count as gone after a day.
IDLE_DAYS = 1.0


def _churn(spark, folder):
    m = _messages(spark, folder).drop("author").join(table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("author")), "id")
    return held(spark, folder, "churn", lambda: social.churn(m, idle_days=IDLE_DAYS))


def churn_users(spark, folder):
    return _churn(spark, folder).select("author", F.round("duration_days", 6).alias("duration_days"), "event", F.round("neg_ratio", 9).alias("neg_ratio"), "total_msgs", "user_quartile")


def churn_quartiles(spark, folder):
    k = stats.kaplan_meier(_churn(spark, folder), "user_quartile", "duration_days", "event")
    return k.select(F.col("g").alias("user_quartile"), F.round("t", 6).alias("t"), "at_risk", "events", F.round("survival", 9).alias("survival"))


def cox_churn(spark, folder):
    df = _churn(spark, folder).withColumn("neg_percent", F.col("neg_ratio") * 100)
    return spark.createDataFrame([stats.cox_one(df, "duration_days", "event", "neg_percent")], "coefficient double, hazard_ratio double, p double")


def cox_survival(spark, folder):
    df = held(spark, folder, "stays", lambda: social.stays(_messages(spark, folder))).withColumn("exposure_percent", F.col("exposure_ratio") * 100)
    return spark.createDataFrame([stats.cox_one(df, "duration", "event", "exposure_percent")], "coefficient double, hazard_ratio double, p double")


QUERIES = {
    f.__name__: f
    for f in (
        message_cascade, thread_root, cascade_structure, structural_virality, longest_neg_run, interaction_edges, reply_edges, motif_counts, cascade_features, interactive_only, cascade_quartiles,
        quartile_descriptives, group_moments, motif_heatmap, taxonomy, triad_heatmap, sentiment_triples, ccdf_metrics, trendline_dominant, trendline_taxonomy, kruskal, ks_pairwise, cliffs_delta,
        statistical_report, sentiment_totals, user_negativity, user_quartiles, dataset_overview, homophily_index, homophily_matrix, target_negativity, structure_by_user_quartile, survival_rows, km_curve,
        churn_users, churn_quartiles, cox_churn, cox_survival,
    )
}
QUERIES |= {
    "spearman_virality": _spearman("perc_negative", "structural_virality"),
    "spearman_size": _spearman("cascade_size", "perc_negative"),
    "spearman_users": _spearman("unique_users", "perc_negative"),
}

_M = """
m AS (SELECT event_id AS id, CASE WHEN event_id % 25 = 0 THEN 'post_header' ELSE 'comment' END AS type,
       CASE WHEN event_id % 25 <> 0 THEN (event_id // 25) * 25 + (event_id * 2654435761) % nullif(event_id % 25, 0) END AS parent_id,
       event_id // 25 AS thread, 's' || lpad(CAST((event_id // 25) % 20 AS VARCHAR), 2, '0') AS subreddit, 'cat' || CAST(((event_id // 25) % 20) // 5 AS VARCHAR) AS category,
       'u' || ((event_id // 25) % 40) || '_' || (user_id % 6) AS author, CAST(user_id AS VARCHAR) AS plain_user,
       CASE WHEN event_type IN ('error', 'click') THEN 'NEGATIVE' WHEN event_type = 'view' THEN 'NEUTRAL' WHEN event_type = 'purchase' THEN 'POSITIVE' ELSE 'REMOVED_BY_MOD' END AS label,
       CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS stamp, value AS score FROM events)"""
_C = (
    _M
    + """,
c AS (SELECT id, id AS cascade_id, 0 AS dist, thread FROM m WHERE type = 'comment' AND parent_id % 25 = 0
      UNION ALL SELECT m.id, c.cascade_id, c.dist + 1, m.thread FROM m JOIN c ON m.parent_id = c.id),
n AS (SELECT m.*, c.cascade_id, c.dist FROM c JOIN m USING (id)),
up AS (SELECT id, cascade_id, id AS ancestor, dist AS a_dist, dist AS d FROM n
       UNION ALL SELECT up.id, up.cascade_id, m.parent_id, up.a_dist - 1, up.d FROM up JOIN m ON up.ancestor = m.id WHERE up.a_dist > 0)"""
)
_V = """,
lv AS (SELECT cascade_id, dist, count(*) AS k FROM n GROUP BY 1, 2),
st AS (SELECT cascade_id, CAST(sum(k) AS BIGINT) AS cascade_size, CAST(max(dist) AS BIGINT) AS max_depth, max(k) AS max_breadth FROM lv GROUP BY 1),
sz AS (SELECT cascade_id, ancestor, count(*) AS s FROM up GROUP BY 1, 2),
vi AS (SELECT sz.cascade_id, CAST(sum(s * (cascade_size - s)) AS BIGINT) AS wiener, any_value(cascade_size) AS sz FROM sz JOIN st USING (cascade_id) GROUP BY 1),
vr AS (SELECT cascade_id, wiener, CASE WHEN sz > 1 THEN wiener * 1.0::DOUBLE / (sz * (sz - 1)) ELSE 1.0::DOUBLE END AS virality FROM vi),
br AS (SELECT up.id, max(a_dist) AS stop FROM up JOIN m ON up.ancestor = m.id WHERE label <> 'NEGATIVE' GROUP BY 1),
lr AS (SELECT cascade_id, CAST(max(dist - coalesce(stop, -1)) AS BIGINT) AS longest, count(CASE WHEN label = 'NEGATIVE' THEN 1 END) AS neg FROM n LEFT JOIN br ON n.id = br.id GROUP BY 1),
lrr AS (SELECT cascade_id, longest, CASE WHEN neg > 0 THEN longest * 1.0::DOUBLE / neg ELSE 0.0::DOUBLE END AS ratio FROM lr)"""
_E = """,
re AS (SELECT a.cascade_id, a.author AS source, p.author AS target FROM n a JOIN m p ON a.parent_id = p.id WHERE a.dist > 0),
e AS (SELECT DISTINCT cascade_id, source, target FROM re WHERE source <> target),
k AS (SELECT e.*, EXISTS (SELECT 1 FROM e r WHERE r.cascade_id = e.cascade_id AND r.source = e.target AND r.target = e.source) AS mutual FROM e),
a AS (SELECT cascade_id, source AS x, target AS y FROM k WHERE NOT mutual),
b AS (SELECT cascade_id, source AS x, target AS y FROM k WHERE mutual AND source < target),
th AS (SELECT DISTINCT cascade_id, least(source, target) AS x, greatest(source, target) AS y FROM e),
tr AS (SELECT p.cascade_id, 'chain' AS motif, p.x AS o, q.y AS w FROM a p JOIN a q ON p.cascade_id = q.cascade_id AND p.y = q.x WHERE p.x <> q.y
       UNION ALL SELECT p.cascade_id, 'fan_in', p.x, q.x FROM a p JOIN a q ON p.cascade_id = q.cascade_id AND p.y = q.y WHERE p.x < q.x
       UNION ALL SELECT p.cascade_id, 'fan_out', p.y, q.y FROM a p JOIN a q ON p.cascade_id = q.cascade_id AND p.x = q.x WHERE p.y < q.y),
al AS (SELECT cascade_id, 'dyad' AS motif FROM a UNION ALL SELECT cascade_id, 'mutual_dyad' FROM b
       UNION ALL SELECT cascade_id, motif FROM tr WHERE NOT EXISTS (SELECT 1 FROM th WHERE th.cascade_id = tr.cascade_id AND th.x = least(o, w) AND th.y = greatest(o, w))
       UNION ALL SELECT p.cascade_id, 'triangle' FROM a p JOIN a q ON p.cascade_id = q.cascade_id AND p.y = q.x JOIN a r ON r.cascade_id = p.cascade_id AND r.x = p.x AND r.y = q.y
       UNION ALL SELECT p.cascade_id, 'recip_triangle' FROM b p JOIN b q ON p.cascade_id = q.cascade_id AND p.y = q.x JOIN b r ON r.cascade_id = p.cascade_id AND r.x = p.x AND r.y = q.y),
mo AS (SELECT cascade_id, count(*) FILTER (motif = 'dyad') AS dyad, CAST(count(*) FILTER (motif = 'mutual_dyad') AS DOUBLE) AS mutual_dyad, count(*) FILTER (motif = 'chain') AS chain,
       count(*) FILTER (motif = 'fan_in') AS fan_in, count(*) FILTER (motif = 'fan_out') AS fan_out, count(*) FILTER (motif = 'triangle') AS triangle,
       count(*) FILTER (motif = 'recip_triangle') AS recip_triangle, CAST(count(*) AS DOUBLE) AS total_motifs FROM al GROUP BY 1)"""
_F = (
    _C
    + _V
    + _E
    + """,
ba AS (SELECT cascade_id, max(subreddit) FILTER (dist = 0) AS subreddit, max(category) FILTER (dist = 0) AS category, greatest(count(DISTINCT author), 1) AS unique_users, avg(score) AS average_score,
       CASE WHEN count(*) >= 2 THEN (max(stamp) - min(stamp)) / 60.0 ELSE 0.0 END AS duration_minutes, count(*) FILTER (label <> 'REMOVED_BY_MOD') AS n_valid,
       count(*) FILTER (label = 'POSITIVE') AS pos, count(*) FILTER (label = 'NEUTRAL') AS neu, count(*) FILTER (label = 'NEGATIVE') AS neg FROM n GROUP BY 1),
f AS (SELECT st.*, ba.subreddit, ba.category, unique_users, average_score, duration_minutes, neg * 100.0::DOUBLE / n_valid AS perc_negative, virality AS structural_virality, ratio AS longest_neg_run_ratio,
       CASE WHEN pos >= neu AND pos >= neg THEN 'POSITIVE' WHEN neu >= neg THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS dominant_sentiment,
       coalesce(dyad, 0) AS dyad, coalesce(mutual_dyad, 0) AS mutual_dyad, coalesce(chain, 0) AS chain, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
       coalesce(triangle, 0) AS triangle, coalesce(recip_triangle, 0) AS recip_triangle, coalesce(total_motifs, 0.0::DOUBLE) AS total_motifs
       FROM st JOIN ba USING (cascade_id) JOIN vr USING (cascade_id) JOIN lrr USING (cascade_id) LEFT JOIN mo USING (cascade_id) WHERE cascade_size >= 3 AND n_valid > 0),
g AS (SELECT *, CASE WHEN perc_negative <= 25 THEN 'Q1' WHEN perc_negative <= 50 THEN 'Q2' WHEN perc_negative <= 75 THEN 'Q3' ELSE 'Q4' END AS quartile FROM f)"""
)
_U = """,
u AS (SELECT author, count(*) AS total, count(*) FILTER (label = 'NEGATIVE') AS negative, count(*) FILTER (label = 'NEGATIVE') * 100.0::DOUBLE / count(*) AS perc_negative FROM m
      WHERE label <> 'REMOVED_BY_MOD' GROUP BY 1),
ut AS (SELECT *, CASE WHEN perc_negative <= 25 THEN 'UQ1' WHEN perc_negative <= 50 THEN 'UQ2' WHEN perc_negative <= 75 THEN 'UQ3' ELSE 'UQ4' END AS user_type FROM u)"""
_TE = """,
te AS (SELECT re.source, re.target, s.user_type AS s_type, t.user_type AS t_type, t.perc_negative AS t_neg FROM re JOIN ut s ON re.source = s.author JOIN ut t ON re.target = t.author)"""
_RANK = """,
rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM src)"""
_STAY = """,
sq AS (SELECT thread, author, row_number() OVER w AS p, sum(CASE WHEN label = 'NEGATIVE' THEN 1 ELSE 0 END) OVER w AS neg, count(*) OVER (PARTITION BY thread) AS steps FROM m
       WINDOW w AS (PARTITION BY thread ORDER BY stamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sy AS (SELECT thread, author, CAST(max(p) - min(p) + 1 AS INTEGER) AS duration, CAST(any_value(steps) - (max(p) - 1) >= 5 AS INTEGER) AS event,
       (max(neg) - min(neg)) * 1.0::DOUBLE / (max(p) - min(p) + 1) AS exposure_ratio FROM sq WHERE steps >= 10 GROUP BY 1, 2 HAVING max(p) - min(p) + 1 > 1)"""
_CHURN = """,
cu AS (SELECT plain_user AS author, greatest((max(stamp) - min(stamp)) / 86400, 0.5) AS duration_days, CAST(((SELECT max(stamp) FROM m) - max(stamp)) / 86400 > 1.0 AS INTEGER) AS event,
       count(*) FILTER (label = 'NEGATIVE') * 1.0::DOUBLE / count(*) AS neg_ratio, count(*) AS total_msgs FROM m GROUP BY 1 HAVING count(*) >= 5),
cq AS (SELECT quantile_cont(neg_ratio, 0.25) AS a, quantile_cont(neg_ratio, 0.5) AS b, quantile_cont(neg_ratio, 0.75) AS c FROM cu),
ch AS (SELECT cu.*, CASE WHEN neg_ratio <= a THEN 'UQ1' WHEN neg_ratio <= b THEN 'UQ2' WHEN neg_ratio <= c THEN 'UQ3' ELSE 'UQ4' END AS user_quartile FROM cu, cq)"""
_KM = """,
ks AS (SELECT g, t, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM ksrc GROUP BY 1, 2),
kr AS (SELECT *, CAST(sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS BIGINT) AS at_risk FROM ks),
kp AS (SELECT g, t, at_risk, events, CASE WHEN min(1 - events * 1.0::DOUBLE / at_risk) OVER w <= 0 THEN 0.0::DOUBLE
       ELSE exp(sum(ln(greatest(1 - events * 1.0::DOUBLE / at_risk, 1e-300))) OVER w) END AS survival FROM kr WINDOW w AS (PARTITION BY g ORDER BY t))"""
_W = "WITH RECURSIVE "


def _means(columns, pairs):
    return ", ".join(f"round({fn}({c}), 6) AS {name}_{c}" for c in columns for name, fn in pairs)


def _rho(x, y):
    return f"""{_W}{_F},
p AS (SELECT rank() OVER (ORDER BY round({x}, 12)) + (count(*) OVER (PARTITION BY round({x}, 12)) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (ORDER BY round({y}, 12)) + (count(*) OVER (PARTITION BY round({y}, 12)) - 1) / 2.0::DOUBLE AS ry FROM g)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM p"""


SQL = {
    "message_cascade": f"{_W}{_C} SELECT id, cascade_id, CAST(dist AS BIGINT) AS dist FROM c",
    "thread_root": f"{_W}{_C} SELECT id, thread AS root FROM c",
    "cascade_structure": f"{_W}{_C}{_V} SELECT * FROM st",
    "structural_virality": f"{_W}{_C}{_V} SELECT cascade_id, wiener, round(virality, 9) AS structural_virality, round(virality * 2, 9) AS mean_distance FROM vr",
    "longest_neg_run": f"{_W}{_C}{_V} SELECT cascade_id, longest AS longest_neg_run, round(ratio, 9) AS longest_neg_run_ratio FROM lrr",
    "interaction_edges": f"{_W}{_C}{_E} SELECT cascade_id, source, target FROM e",
    "reply_edges": f"{_W}{_C}{_E} SELECT cascade_id, source, target, count(*) AS n FROM re GROUP BY 1, 2, 3",
    "motif_counts": f"{_W}{_C}{_E} SELECT * FROM mo",
    "cascade_features": f"""{_W}{_F} SELECT cascade_id, subreddit, category, cascade_size, max_depth, max_breadth, unique_users, dominant_sentiment, total_motifs, quartile,
round(average_score, 6) AS average_score, round(duration_minutes, 6) AS duration_minutes, round(perc_negative, 6) AS perc_negative, round(structural_virality, 6) AS structural_virality,
round(longest_neg_run_ratio, 6) AS longest_neg_run_ratio FROM g""",
    "interactive_only": f"{_W}{_F} SELECT cascade_id, total_motifs FROM g WHERE total_motifs > 0",
    "cascade_quartiles": f"{_W}{_F} SELECT quartile, count(*) AS n, round(min(perc_negative), 6) AS lowest, round(max(perc_negative), 6) AS highest FROM g GROUP BY 1",
    "quartile_descriptives": f"{_W}{_F} SELECT quartile, count(*) AS n, {_means(('structural_virality', 'cascade_size', 'max_depth'), (('mean', 'avg'), ('median', 'median'), ('std', 'stddev_samp')))}, "
    "round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1",
    "group_moments": f"{_W}{_F} SELECT category, {_means(('structural_virality', 'cascade_size', 'max_breadth', 'average_score'), (('mean', 'avg'), ('std', 'stddev_pop')))} FROM g GROUP BY 1",
    "motif_heatmap": f"{_W}{_F} SELECT category, "
    + ", ".join(f"round(avg({x} * 100.0::DOUBLE / total_motifs), 6) AS {x}_mean, round(stddev_samp({x} * 100.0::DOUBLE / total_motifs) / sqrt(count(*)), 6) AS {x}_se" for x in MOTIFS)
    + " FROM g WHERE total_motifs > 0 GROUP BY 1",
    "taxonomy": f"{_W}{_F} SELECT subreddit, category, round(median(structural_virality), 6) AS median_virality, round(avg(perc_negative), 6) AS mean_negativity FROM g GROUP BY 1, 2",
    "sentiment_triples": f"""{_W}{_C},
co AS (SELECT *, CASE label WHEN 'POSITIVE' THEN 'P' WHEN 'NEUTRAL' THEN 'U' WHEN 'NEGATIVE' THEN 'N' END AS z FROM n)
SELECT x.category, w.z || p.z || x.z AS triad, count(*) AS n FROM co x JOIN co p ON x.parent_id = p.id JOIN co w ON p.parent_id = w.id WHERE x.dist >= 2 AND w.z || p.z || x.z IS NOT NULL GROUP BY 1, 2""",
    "triad_heatmap": f"""{_W}{_C},
co AS (SELECT *, CASE label WHEN 'POSITIVE' THEN 'P' WHEN 'NEUTRAL' THEN 'U' WHEN 'NEGATIVE' THEN 'N' END AS z FROM n),
nm AS (SELECT * FROM (VALUES ('NNN', 'Negative Persistence'), ('PPP', 'Positive Persistence'), ('PNN', 'Negative Convergence (from pos)'), ('UNN', 'Negative Convergence (from neu)'),
       ('NPP', 'Positive Convergence (from neg)'), ('UPP', 'Positive Convergence (from neu)'), ('PPN', 'Shift (to neg)'), ('NNP', 'Shift (to pos)'), ('PNP', 'Oscillation (a)'), ('NPN', 'Oscillation (b)'),
       ('PUN', 'Mixed Transition (to neg)'), ('NUP', 'Mixed Transition (to pos)')) v(triad, name)),
tr AS (SELECT x.category, nm.triad, nm.name FROM co x JOIN co p ON x.parent_id = p.id JOIN co w ON p.parent_id = w.id JOIN nm ON nm.triad = w.z || p.z || x.z WHERE x.dist >= 2)
SELECT triad, name, {", ".join(f"round(count(*) FILTER (category = 'cat{i}') * 100.0::DOUBLE / (SELECT count(*) FROM tr), 6) AS cat{i}" for i in range(4))} FROM tr GROUP BY 1, 2""",
    "ccdf_metrics": f"""{_W}{_F}, s AS (SELECT category, round(structural_virality, 9) AS virality, row_number() OVER (PARTITION BY category ORDER BY structural_virality) - 1 AS i, count(*) OVER (PARTITION BY category) AS k FROM g)
SELECT category, virality, round(max((1 - i * 1.0::DOUBLE / k) * 100), 6) AS share FROM s GROUP BY 1, 2""",
    "trendline_dominant": f"{_W}{_F} SELECT dominant_sentiment, CAST(regr_count(perc_negative, structural_virality) AS BIGINT) AS n, round(regr_slope(perc_negative, structural_virality), 6) AS slope, "
    "round(regr_intercept(perc_negative, structural_virality), 6) AS intercept, round(regr_r2(perc_negative, structural_virality), 6) AS r2 FROM g GROUP BY 1",
    "trendline_taxonomy": f"{_W}{_F}, t AS (SELECT median(structural_virality) AS x, avg(perc_negative) AS y FROM g GROUP BY subreddit) "
    "SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM t",
    "kruskal": f"""{_W}{_F}, src AS (SELECT category AS grp, round(structural_virality, 12) AS x FROM g){_RANK},
q AS (SELECT sum(rs * rs / k) AS q, sum(k) AS n, count(*) AS groups FROM (SELECT grp, sum(r) AS rs, count(*) AS k FROM rk GROUP BY 1)),
ti AS (SELECT sum(k * 1.0::DOUBLE * k * k - k) AS ties FROM (SELECT x, count(*) AS k FROM src GROUP BY 1))
SELECT round((12 / (n * (n + 1.0::DOUBLE)) * q - 3 * (n + 1)) / (1 - ties / (n * 1.0::DOUBLE * n * n - n)), 6) AS h, CAST(n AS BIGINT) AS n, groups FROM q, ti""",
    "ks_pairwise": f"""{_W}{_F}, d AS (SELECT category AS grp, round(structural_virality, 12) AS x FROM g),
pr AS (SELECT a.grp AS g1, b.grp AS g2, a.k AS n1, b.k AS n2 FROM (SELECT grp, count(*) AS k FROM d GROUP BY 1) a JOIN (SELECT grp, count(*) AS k FROM d GROUP BY 1) b ON a.grp < b.grp),
xs AS (SELECT DISTINCT x FROM d)
SELECT g1, g2, n1, n2, round(max(abs((SELECT count(*) FROM d WHERE grp = g1 AND d.x <= xs.x) * 1.0::DOUBLE / n1 - (SELECT count(*) FROM d WHERE grp = g2 AND d.x <= xs.x) * 1.0::DOUBLE / n2)), 9) AS d
FROM pr, xs GROUP BY 1, 2, 3, 4""",
    "cliffs_delta": f"""{_W}{_F}, src AS (SELECT category AS grp, round(structural_virality, 12) AS x FROM g WHERE category IN ('cat0', 'cat3')){_RANK},
s AS (SELECT sum(r) FILTER (grp = 'cat0') AS rs, count(*) FILTER (grp = 'cat0') AS n1, count(*) FILTER (grp = 'cat3') AS n2 FROM rk)
SELECT round(rs - n1 * (n1 + 1) / 2.0::DOUBLE, 6) AS u, round(2 * (rs - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n2) - 1, 9) AS delta FROM s""",
    "spearman_virality": _rho("perc_negative", "structural_virality"),
    "spearman_size": _rho("cascade_size", "perc_negative"),
    "spearman_users": _rho("unique_users", "perc_negative"),
    "sentiment_totals": f"WITH {_M} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM m WHERE label <> 'REMOVED_BY_MOD'), 6) AS share FROM m WHERE label <> 'REMOVED_BY_MOD' GROUP BY 1",
    "user_negativity": f"WITH {_M}{_U} SELECT author, total, negative, round(perc_negative, 6) AS perc_negative, user_type FROM ut",
    "user_quartiles": f"WITH {_M}{_U} SELECT user_type AS quartile, count(*) AS n, round(min(perc_negative), 6) AS lowest, round(max(perc_negative), 6) AS highest FROM ut GROUP BY 1",
    "dataset_overview": f"""{_W}{_F} SELECT count(*) FILTER (type = 'post_header') AS posts, count(*) FILTER (type = 'comment' AND label <> 'REMOVED_BY_MOD') AS valid_comments, count(DISTINCT author) AS users,
count(*) FILTER (label = 'NEGATIVE') AS negative, (SELECT count(*) FROM g) AS cascades, (SELECT CAST(sum(cascade_size) AS BIGINT) FROM g) AS messages_in_cascades FROM m""",
    "homophily_index": f"""{_W}{_C}{_E}{_U}{_TE}, h AS (SELECT source, s_type, count(*) FILTER (s_type = t_type) * 1.0::DOUBLE / count(*) AS h FROM te GROUP BY 1, 2)
SELECT s_type AS user_type, count(*) AS n_users, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(stddev_samp(h) / sqrt(count(*)), 6) AS se FROM h GROUP BY 1""",
    "homophily_matrix": f"{_W}{_C}{_E}{_U}{_TE} SELECT s_type AS source_type, " + ", ".join(f"round(count(*) FILTER (t_type = 'UQ{i}') * 100.0::DOUBLE / count(*), 6) AS uq{i}" for i in range(1, 5)) + " FROM te GROUP BY 1",
    "target_negativity": f"{_W}{_C}{_E}{_U}{_TE} SELECT s_type AS user_type, count(*) AS n, round(avg(t_neg), 6) AS mean FROM te GROUP BY 1",
    "structure_by_user_quartile": f"""{_W}{_F}{_U}, k2 AS (SELECT n.cascade_id, avg(CAST(substr(user_type, 3, 1) AS INTEGER)) AS k FROM n JOIN ut USING (author) GROUP BY 1)
SELECT CASE WHEN k <= 1.5 THEN 'UQ1' WHEN k <= 2.5 THEN 'UQ2' WHEN k <= 3.5 THEN 'UQ3' ELSE 'UQ4' END AS user_quartile, count(*) AS n, round(avg(structural_virality), 6) AS mean_virality,
round(avg(cascade_size), 6) AS mean_size FROM g JOIN k2 USING (cascade_id) GROUP BY 1""",
    "survival_rows": f"WITH {_M}{_STAY} SELECT thread, author, duration, event, round(exposure_ratio, 9) AS exposure_ratio FROM sy",
    "km_curve": f"""WITH {_M}{_STAY}, ksrc AS (SELECT CASE WHEN exposure_ratio >= (SELECT quantile_cont(exposure_ratio, 0.75) FROM sy) THEN 'high' ELSE 'low' END AS g, CAST(duration AS DOUBLE) AS t, event FROM sy){_KM}
SELECT g AS exposure, t, at_risk, events, round(survival, 9) AS survival FROM kp""",
    "churn_users": f"WITH {_M}{_CHURN} SELECT author, round(duration_days, 6) AS duration_days, event, round(neg_ratio, 9) AS neg_ratio, total_msgs, user_quartile FROM ch",
    "churn_quartiles": f"""WITH {_M}{_CHURN}, ksrc AS (SELECT user_quartile AS g, duration_days AS t, event FROM ch){_KM}
SELECT g AS user_quartile, round(t, 6) AS t, at_risk, events, round(survival, 9) AS survival FROM kp""",
}
