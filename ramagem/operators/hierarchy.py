"""Parent-child links to full hierarchies: splitters, a reduced pointer graph and exact paths.

Every link chain is cut at splitters, nodes chosen by a hash of their id, so that each node is a short walk away from
the next one. All walks are done at once by pointer jumping that stops at splitters. The splitters with their walks
form a much smaller pointer graph, solved the same way without stops; a last join gives every node its root, depth
and path. A round in which no walk ends proves that all that remain run into a cycle: those are settled apart.
Only nodes that have children take part in the rounds; leaves, most of a forest, join once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramagem.session import cut_lineage, shuffle_tasks

#: One node in so many is a splitter; the mean walk is as long.
SPLIT_EVERY = 8
#: End of the chain: where the links stop.
AT_POST, AT_NULL, AT_MISSING, AT_CYCLE = "post", "null", "missing", "cycle"


def _is_splitter(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SPLIT_EVERY)) == 0


def _hot(df: DataFrame, key: str) -> DataFrame:
    """Values of key on more than a quarter of one task's share of rows: at most 4 * tasks values, so broadcast."""
    tasks = shuffle_tasks(df.sparkSession)
    rows = df.count()
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).count()
    return counts.where(F.col("count") > max(1000.0, rows / tasks / 4)).select("__hot", F.lit(min(64, 4 * tasks)).alias("__copies"))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join on `key` (unique in right). Rows of hot keys are dealt over copies of their one match."""
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__copies")), F.lit(0)).cast("int")
    many = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot", "__copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies"), F.lit(1)) - 1))
    one = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", copies).drop("__hot", "__copies")
    return many.join(one, [key, "__salt"], "left").drop("__salt")


def link_nodes(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct comments with what their parent link meets.

    comments: id, parent_id, post_id, depth (bare ids); posts: id. Repeated rows of an id count once: the smallest
    non-null value of each field. Gives id, post_id, depth, up (the parent if it is a comment), stop and stop_id
    (where the links end, if here). Rows without id are no nodes.
    """
    seen = comments.where("id is not null").select("id", "parent_id", "post_id", F.col("depth").cast("int").alias("depth"), F.lit(False).alias("is_post"))
    headers = posts.where("id is not null").select(
        "id", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("int").alias("depth"), F.lit(True).alias("is_post")
    )
    every = cut_lineage(
        seen.unionByName(headers)
        .groupBy("id")
        .agg(
            F.min("parent_id").alias("parent_id"),
            F.min("post_id").alias("post_id"),
            F.min("depth").alias("depth"),
            F.max("is_post").alias("is_post"),
            F.max(~F.col("is_post")).alias("is_comment"),
        )
    )
    targets = every.select(F.col("id").alias("parent_id"), F.col("is_post").alias("to_post"))
    nodes = every.where("is_comment").select("id", "parent_id", "post_id", "depth")
    met = salted_lookup(nodes, targets, "parent_id", _hot(nodes, "parent_id"))
    stop = F.when(F.col("parent_id").isNull(), AT_NULL).when(F.col("to_post").isNull(), AT_MISSING).when(F.col("to_post"), AT_POST)
    return cut_lineage(
        met.select("id", "post_id", "depth", F.when(~F.col("to_post"), F.col("parent_id")).alias("up"), stop.alias("stop"), F.col("parent_id").alias("stop_id"))
    )


def _jump(moving: DataFrame, settled: DataFrame, paths: bool) -> DataFrame:
    """One round of pointer jumping: every moving node takes over the pointer of the node it points to.

    Both frames: id, ptr, dist, done and path (the nodes after id up to ptr) if paths.
    """
    ahead = settled.unionByName(moving).select(
        F.col("id").alias("ptr"), F.col("ptr").alias("n_ptr"), F.col("dist").alias("n_dist"), F.col("done").alias("n_done"), *([F.col("path").alias("n_path")] if paths else [])
    )
    joined = moving.join(ahead, "ptr", "left")
    return joined.select(
        "id",
        F.coalesce("n_ptr", "ptr").alias("ptr"),
        (F.col("dist") + F.coalesce("n_dist", F.lit(0))).alias("dist"),
        F.coalesce("n_done", F.lit(True)).alias("done"),
        *([F.concat("path", F.coalesce("n_path", F.array().cast("array<string>"))).alias("path")] if paths else []),
    )


def _run_to_end(state: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
    """Jump until all are done, or until a round ends no walk: the rest leads into cycles. Gives (done, endless)."""
    done, moving = state.where("done"), state.where("not done")
    left = moving.count()
    while left:
        after = cut_lineage(_jump(moving, done, paths))
        done = done.unionByName(after.where("done"))
        moving = after.where("not done")
        now = moving.count()
        if now == left:
            return done, moving
        left = now
    return done, moving


def _on_cycles(links: DataFrame) -> DataFrame:
    """The ids of links (id, up), all of which lead into cycles, that lie on one: the image of long enough walks.

    The image of 2^r steps loses its tails as r grows; once it keeps its size, only cycles are left.
    """
    state = cut_lineage(links.select("id", F.col("up").alias("ptr")))
    size = state.select("ptr").distinct().count()
    while size:
        step = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("n"))
        state = cut_lineage(state.join(step, "ptr").select("id", F.col("n").alias("ptr")))
        now = state.select("ptr").distinct().count()
        if now == size:
            break
        size = now
    return state.select(F.col("ptr").alias("id")).distinct()


def solve_links(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """For every node of link_nodes: root_kind, root (where its links end), n_links to it, on_cycle, path if asked.

    root_kind is post, null, missing or cycle. n_links counts the links up to the post or, where there is none, up to
    the last node that exists; nodes that lead into a cycle have null root, n_links and path. path runs from the
    root (the post, or the topmost comment) down to the node itself.
    """
    hot = cut_lineage(_hot(nodes, "up"))
    parents = nodes.where("up is not null").select(F.col("up").alias("id")).distinct()
    inner = cut_lineage(nodes.join(parents, "id", "left_semi").select("id", "up", "stop"))
    # walk to the next splitter; a node whose links stop ends every walk as well
    halt = inner.select("id", (F.col("up").isNull() | _is_splitter(F.col("id"))).alias("halt"))
    walkers = inner.where("up is not null")
    begin = walkers.join(halt.withColumnRenamed("id", "up").withColumnRenamed("halt", "done"), "up").select(
        "id", F.col("up").alias("ptr"), F.lit(1).alias("dist"), F.coalesce("done", F.lit(True)).alias("done"), *([F.array("up").alias("path")] if paths else [])
    )
    walked, endless = _run_to_end(cut_lineage(begin), paths)
    # the reduced graph: splitters only, each with its walk; ends are tops (nodes without up)
    tops = inner.where("up is null").select(F.col("id").alias("ptr"), F.lit(True).alias("at_top"))
    reduced = walked.where(_is_splitter(F.col("id"))).join(tops, "ptr", "left").select(
        "id", "ptr", "dist", F.coalesce("at_top", F.lit(False)).alias("done"), *(["path"] if paths else [])
    )
    lost = endless.where(_is_splitter(F.col("id"))).select("id")  # splitters that walk into a splitterless cycle
    blocked = reduced.join(lost.withColumnRenamed("id", "ptr"), "ptr", "left_semi")
    solved, circling = _run_to_end(cut_lineage(reduced.join(blocked.select("id"), "id", "left_anti")), paths)
    # a splitter that still points to an unsolved one was ended by a missing entry: it is unsolved as well
    solved = cut_lineage(solved.join(tops, "ptr", "left_semi"))
    end = solved.select(F.col("id").alias("ptr"), F.col("ptr").alias("end"), F.col("dist").alias("e_dist"), *([F.col("path").alias("e_path")] if paths else []))
    ended = walked.join(tops, "ptr", "left").join(end, "ptr", "left")
    known = ended.where("at_top is not null or end is not null").select(
        "id",
        F.coalesce("end", "ptr").alias("top"),
        (F.col("dist") + F.coalesce("e_dist", F.lit(0))).alias("to_top"),
        *([F.concat("path", F.coalesce("e_path", F.array().cast("array<string>"))).alias("path")] if paths else []),
    )
    top_rows = inner.where("up is null").select("id", F.col("id").alias("top"), F.lit(0).alias("to_top"), *([F.array().cast("array<string>").alias("path")] if paths else []))
    known = cut_lineage(known.unionByName(top_rows))
    rest = cut_lineage(inner.where("up is not null").join(known, "id", "left_anti").select("id", "up"))
    cycles = _on_cycles(rest).withColumn("on_cycle", F.lit(True))
    # every node takes over from its parent: inner nodes hold their own answer, leaves look one link up
    stops = nodes.where("up is null").select(F.col("id").alias("top"), F.col("stop").alias("top_stop"), "stop_id")
    known = known.join(stops, "top")
    ahead = known.select(F.col("id").alias("up"), "top", "top_stop", F.col("stop_id").alias("top_stop_id"), F.col("to_top").alias("u_to_top"), *([F.col("path").alias("u_path")] if paths else []))
    seen = salted_lookup(nodes, ahead, "up", hot).join(cycles, "id", "left")
    kind = F.when(F.col("up").isNull(), F.col("stop")).otherwise(F.coalesce("top_stop", F.lit(AT_CYCLE)))
    to_top = F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("u_to_top") + 1)
    post = F.when(F.col("up").isNull(), F.col("stop_id")).otherwise(F.col("top_stop_id"))
    top = F.when(F.col("up").isNull(), F.col("id")).otherwise(F.col("top"))
    out = seen.select(
        "id",
        "post_id",
        "depth",
        kind.alias("root_kind"),
        F.when(kind == AT_POST, post).when(kind != AT_CYCLE, top).alias("root"),
        F.when(kind == AT_POST, to_top + 1).when(kind != AT_CYCLE, to_top).alias("n_links"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
        *(
            [
                F.when(F.col("up").isNull(), F.array("id")).otherwise(F.concat(F.array("id", "up"), "u_path")).alias("upward"),
                post.alias("__post"),
            ]
            if paths
            else []
        ),
    )
    if not paths:
        return out
    down = F.reverse("upward")
    full = F.when(F.col("root_kind") == AT_POST, F.concat(F.array("__post"), down)).when(F.col("root_kind") != AT_CYCLE, down)
    return out.withColumn("path", full).drop("upward", "__post")


def link_faults(solved: DataFrame) -> DataFrame:
    """(id, kind) for every node whose links run in a circle or lead nowhere, or whose post_id or depth disagrees."""
    kinds = F.array(
        F.when((F.col("root_kind") == AT_CYCLE) & F.col("on_cycle"), "on_cycle"),
        F.when((F.col("root_kind") == AT_CYCLE) & ~F.col("on_cycle"), "under_cycle"),
        F.when(F.col("root_kind").isin(AT_NULL, AT_MISSING), "no_root"),
        F.when((F.col("root_kind") == AT_POST) & ~F.col("root").eqNullSafe(F.col("post_id")), "other_post"),
        F.when((F.col("root_kind") == AT_POST) & F.col("depth").isNotNull() & (F.col("depth") != F.col("n_links")), "wrong_depth"),
    )
    return solved.select("id", F.explode(F.array_compact(kinds)).alias("kind"))


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor, id, distance) for every comment above every comment; needs paths. The output is the sum of depths."""
    up = F.when(F.col("root_kind") == AT_POST, F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).otherwise(
        F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    )
    return solved.where("path is not null").select("id", F.posexplode(F.reverse(up)).alias("pos", "ancestor")).select("ancestor", "id", (F.col("pos") + 1).alias("distance"))
