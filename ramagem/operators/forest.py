"""Reply cascades: assignment, structure, virality and negative runs, from the exact paths of the link solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramagem.functions.keys import DELETED_MARKERS, VALID_LABELS
from ramagem.operators import hierarchy
from ramagem.session import cut_lineage


def cascade_nodes(messages: DataFrame) -> DataFrame:
    """Comments with their cascade (the comment directly under the post), distance from its root, and path below the post.

    Comments whose links do not reach a post belong to no cascade. Ids keep their type.
    """
    kind = dict(messages.dtypes)["id"]
    comments = messages.where("type = 'comment'").select(
        F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("thread").cast("string").alias("post_id"), F.lit(None).cast("int").alias("depth")
    )
    posts = messages.where("type = 'post_header'").select(F.col("id").cast("string").alias("id"))
    solved = hierarchy.solve_links(hierarchy.link_nodes(comments, posts), paths=True).where("root_kind = 'post'")
    below = F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))
    placed = solved.select(
        F.col("id").cast(kind).alias("id"), F.element_at(below, 1).cast(kind).alias("cascade_id"), (F.size(below) - 1).alias("dist"), below.cast(f"array<{kind}>").alias("path")
    )
    return cut_lineage(placed.join(messages.where("type = 'comment'"), "id"))


def structure(nodes: DataFrame) -> DataFrame:
    """Size, depth and breadth of every cascade; the root has distance 0."""
    levels = nodes.groupBy("cascade_id", "dist").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("cascade_id").agg(
        F.sum("n").alias("cascade_size"), F.max("dist").cast("long").alias("max_depth"), F.max("n").alias("max_breadth")
    )


#: Ancestor pairs are listed only where paths hold fewer nodes on the average than this times the rounds of doubling.
PAIRS_PER_ROUND = 2.0


def _depths(nodes: DataFrame) -> tuple[int, float]:
    """Nodes on the longest path, and on the average one."""
    row = nodes.agg(F.max(F.size("path")).alias("most"), F.avg(F.size("path")).alias("mean")).first()
    return row["most"] or 0, row["mean"] or 0.0


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(cascade_id, id, s): how many nodes hang below each, itself included; from (cascade_id, id, path).

    Short paths are counted node by node. Else in rounds: what hangs less than 2^k links below a node is known, and what
    hangs less than 2^(k+1) below follows from the nodes that lie exactly 2^k below, found by their paths. So the rows of a
    round are those of the nodes, and the rounds the logarithm of the depth, also for one long chain.
    """
    most, mean = _depths(nodes)
    rounds = max(most - 1, 0).bit_length()
    if mean <= PAIRS_PER_ROUND * rounds:
        return nodes.select("cascade_id", F.explode("path").alias("id")).groupBy("cascade_id", "id").agg(F.count(F.lit(1)).alias("s"))
    above = [F.when(F.size("path") > (1 << k), F.element_at("path", -1 - (1 << k))).alias(f"p{k}") for k in range(rounds)]
    sizes = cut_lineage(nodes.select("cascade_id", "id", F.lit(1).cast("long").alias("s"), *above))
    for k in range(rounds):
        gained = sizes.where(F.col(f"p{k}").isNotNull()).groupBy(F.col(f"p{k}").alias("id")).agg(F.sum("s").alias("more"))
        rest = [f"p{j}" for j in range(k + 1, rounds)]
        sizes = cut_lineage(sizes.join(gained, "id", "left").select("cascade_id", "id", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"), *rest))
    return sizes


def virality(nodes: DataFrame) -> DataFrame:
    """Wiener index over n (n - 1), by subtree sizes: each link is crossed by s (n - s) pairs. Also the mean distance, twice that."""
    n = F.max("s")
    crossing = subtree_sizes(nodes).groupBy("cascade_id").agg(n.alias("n"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    wiener = F.col("s1") * F.col("n") - F.col("s2")  # the root adds n * n - n * n = 0
    value = F.when(F.col("n") > 1, wiener / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return crossing.select("cascade_id", wiener.alias("wiener"), value.alias("structural_virality"), (value * 2).alias("mean_distance"))


def negative_runs(nodes: DataFrame) -> DataFrame:
    """(cascade_id, run) of every negative node: how many negative labels follow each other up its path, itself included.

    In rounds: a run that fills the 2^k nodes looked at so far goes on with that of the node 2^k above. Only such rows are
    looked at again, so that the rounds are the logarithm of the longest run.
    """
    runs = cut_lineage(nodes.where("label = 'NEGATIVE'").select("cascade_id", "id", "path", F.lit(1).alias("run")))
    span = 1
    while True:
        filled = (F.col("run") == span) & (F.size("path") > span)
        going = runs.where(filled).withColumn("above", F.element_at("path", -1 - span))
        if going.isEmpty():
            return runs.select("cascade_id", "run")
        up = runs.select(F.col("id").alias("above"), F.col("run").alias("more"))
        longer = going.join(up, "above", "left").select("cascade_id", "id", "path", (F.col("run") + F.coalesce("more", F.lit(0))).alias("run"))
        runs = cut_lineage(runs.where(~filled).unionByName(longer))
        span *= 2


def longest_negative_run(nodes: DataFrame) -> DataFrame:
    """Longest run of negative labels down any path, and its ratio to all negatives (0 without any)."""
    run = negative_runs(nodes).groupBy("cascade_id").agg(F.max("run").cast("long").alias("run"), F.count(F.lit(1)).alias("negatives"))
    every = nodes.select("cascade_id").distinct().join(run, "cascade_id", "left")
    return every.select("cascade_id", F.coalesce("run", F.lit(0)).cast("long").alias("longest_neg_run"), F.coalesce(F.col("run") / F.col("negatives"), F.lit(0.0)).alias("longest_neg_run_ratio"))


def interaction_edges(nodes: DataFrame) -> DataFrame:
    """Distinct (cascade, replier, replied-to) without self-replies and deleted accounts."""
    edges = reply_edges(nodes)
    return edges.where("source <> target").select("cascade_id", "source", "target").distinct()


def reply_edges(nodes: DataFrame) -> DataFrame:
    """Every reply inside a cascade as (cascade, replier, replied-to), repeated and self-replies kept."""
    gone = [*DELETED_MARKERS]
    over = nodes.select(F.col("id").alias("parent_id"), F.col("author").alias("target"))
    return (
        nodes.where("dist > 0")
        .select("cascade_id", "parent_id", F.col("author").alias("source"))
        .join(over, "parent_id")
        .where(F.col("source").isNotNull() & F.col("target").isNotNull() & ~F.col("source").isin(gone) & ~F.col("target").isin(gone))
        .select("cascade_id", "source", "target")
    )


def basics(nodes: DataFrame) -> DataFrame:
    """Per cascade: users, score, sentiment and duration. Ties of the dominant label go to POSITIVE, then NEUTRAL."""
    count = lambda label: F.count_if(F.col("label") == label)
    valid = F.count_if(F.col("label").isin(*VALID_LABELS))
    user = F.when(~F.col("author").isin(*DELETED_MARKERS), F.col("author"))
    stamp = F.nullif(F.col("timestamp"), F.lit(0.0))
    pos, neu, neg = (count(x) for x in VALID_LABELS)
    return nodes.groupBy("cascade_id").agg(
        F.min_by("subreddit", "dist").alias("subreddit"),  # that of the root
        F.min_by("category", "dist").alias("category"),
        F.greatest(F.count_distinct(user), F.lit(1)).alias("unique_users"),
        F.avg(F.coalesce("score", F.lit(0))).alias("average_score"),
        F.when(F.count(stamp) >= 2, (F.max(stamp) - F.min(stamp)) / 60.0).otherwise(0.0).alias("duration_minutes"),
        valid.alias("n_valid"),
        (neg / F.nullif(valid, F.lit(0)) * 100).alias("perc_negative"),
        F.when((pos >= neu) & (pos >= neg), "POSITIVE").when(neu >= neg, "NEUTRAL").otherwise("NEGATIVE").alias("dominant_sentiment"),
    )


def cascade_features(nodes: DataFrame, motifs: DataFrame) -> DataFrame:
    """The cascade table: cascades of at least 3 messages with a valid label."""
    kept = structure(nodes).where("cascade_size >= 3").join(basics(nodes).where("n_valid > 0"), "cascade_id")
    return (
        kept.join(virality(nodes), "cascade_id")
        .join(longest_negative_run(nodes), "cascade_id")
        .join(motifs, "cascade_id", "left")
        .na.fill(0, ["dyad", "chain", "fan_in", "fan_out", "triangle", "recip_triangle"])
        .na.fill(0.0, ["mutual_dyad", "total_motifs"])
    )
