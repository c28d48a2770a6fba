"""Queries of the general data-preparation operators (problems 1 to 5) with their DuckDB statements."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.functions.keys import bare_id, label_key, subreddit_key, valid_time
from ramagem.operators import balance, compact, features, forest, hierarchy, nested
from ramagem.session import drop_later, scratch_path, shared_folder
from ramagem.sources.tables import table

DAY = 86_400
#: A value is reported as dominant from this part of all rows on.
DOMINANT_SHARE = 0.02


def _post_totals(spark: SparkSession, folder: str):
    rows = table(spark, folder, "comments").select("post_id", "metadata_score", valid_time(F.col("timestamp")).alias("ts"))
    headers = (
        table(spark, folder, "post_header")
        .select(bare_id(F.col("id")).alias("post_id"), valid_time(F.col("timestamp")).alias("post_ts"))
        .where("post_id is not null")
        .groupBy("post_id")
        .agg(F.min("post_ts").alias("post_ts"), F.lit(True).alias("has_header"))
    )
    partial = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("metadata_score").alias("score_total"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("ts") - F.col("post_ts") > DAY).alias("n_after_a_day"),
        F.max("has_header").alias("has_header"),
    ]
    merge = [
        F.sum("n_rows").alias("n_rows"),
        F.sum("score_total").alias("score_total"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n_after_a_day").alias("n_after_a_day"),
        F.coalesce(F.max("has_header"), F.lit(False)).alias("has_header"),
    ]
    return balance.fragment_replicate_totals(rows, "post_id", headers, partial, merge)


def _author_totals(spark: SparkSession, folder: str):
    rows = table(spark, folder, "comments").select("author", "metadata_score", valid_time(F.col("timestamp")).alias("ts"))
    started = (
        table(spark, folder, "post_header")
        .where("author is not null")
        .groupBy("author")
        .agg(F.min(valid_time(F.col("timestamp"))).alias("first_post_ts"), F.count_distinct(bare_id(F.col("id"))).alias("n_posts"))
    )
    partial = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("metadata_score").alias("score_total"),
        F.count_if(F.col("ts") < F.col("first_post_ts")).alias("n_before_first_post"),
        F.max("n_posts").alias("n_posts"),
    ]
    merge = [
        F.sum("n_rows").alias("n_rows"),
        F.sum("score_total").alias("score_total"),
        F.sum("n_before_first_post").alias("n_before_first_post"),
        F.coalesce(F.max("n_posts"), F.lit(0)).alias("n_posts"),
    ]
    return balance.fragment_replicate_totals(rows, "author", started, partial, merge)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of post_id and author on at least 2 % of all rows, from the exact totals of both."""
    found = []
    for field, totals in (("post_id", _post_totals), ("author", _author_totals)):
        per_key, plan = totals(spark, folder)
        heavy = per_key.where(F.col(field).isNotNull() & (F.col("n_rows") >= DOMINANT_SHARE * plan.rows))
        found.append(heavy.select(F.lit(field).alias("field"), F.col(field).alias("key_value")))
    return found[0].unionByName(found[1])


def p1_post_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _post_totals(spark, folder)[0]


def p1_author_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _author_totals(spark, folder)[0]


def author_events(spark: SparkSession, folder: str) -> DataFrame:
    """Comments as events: the type is the subreddit and the label, absent parts written (none)."""
    kind = F.concat_ws("|", F.coalesce(subreddit_key(F.col("subreddit")), F.lit("(none)")), F.coalesce(label_key(F.col("ai_analysis.label")), F.lit("(none)")))
    return table(spark, folder, "comments").select(
        bare_id(F.col("id")).alias("message"),
        F.col("author").alias("entity"),
        kind.alias("type"),
        valid_time(F.col("timestamp")).alias("ts"),
        F.col("metadata_score").alias("score"),
        F.col("harvested_at").alias("arrived"),
    )


def _store(spark: SparkSession, folder: str) -> features.BucketStore:
    name = hashlib.sha1(os.path.abspath(folder).encode()).hexdigest()[:16]
    return features.BucketStore(spark, f"{shared_folder(spark).rstrip('/')}/ramagem-store/author-{name}")


def _feature_columns(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("entity", "author")


def p2_author_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per author with an array of (type, n, total, last_ts)."""
    store = _store(spark, folder)
    store.refresh(author_events(spark, folder))
    return _feature_columns(store.features())


def p2_author_types(spark: SparkSession, folder: str) -> DataFrame:
    """The same features as rows of (author, type)."""
    store = _store(spark, folder)
    store.refresh(author_events(spark, folder))
    return _feature_columns(store.by_type())


#: The window of p2_window_types cuts a bucket at both ends.
WINDOW = (1_690_000_000.0, 1_700_000_123.0)


def p2_window_types(spark: SparkSession, folder: str) -> DataFrame:
    events = author_events(spark, folder)
    store = _store(spark, folder)
    store.refresh(events)
    return _feature_columns(store.by_type(events, *WINDOW))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    comments = table(spark, folder, "comments").select(
        bare_id(F.col("id")).alias("id"), bare_id(F.col("parent_id")).alias("parent_id"), bare_id(F.col("post_id")).alias("post_id"), "depth"
    )
    posts = table(spark, folder, "post_header").select(bare_id(F.col("id")).alias("id"))
    return hierarchy.link_nodes(comments, posts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.link_faults(hierarchy.solve_links(_links(spark, folder)))


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every comment with its path, true depth, root and number of descendants."""
    solved = hierarchy.cut_lineage(hierarchy.solve_links(_links(spark, folder), paths=True))
    placed = solved.where("path is not null").select(F.col("root").alias("cascade_id"), "id", "path")
    below = forest.subtree_sizes(placed).select("id", (F.col("s") - 1).alias("n_descendants"))
    return solved.join(below, "id", "left").select(
        "id",
        F.array_join("path", "/").alias("path"),
        F.col("n_links").alias("true_depth"),
        "root",
        "root_kind",
        "on_cycle",
        F.when(F.col("root_kind") != hierarchy.AT_CYCLE, F.coalesce("n_descendants", F.lit(0))).alias("n_descendants"),
    )


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.solve_links(_links(spark, folder), paths=True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.comment_links(table(spark, folder, "raw_post")).select("post_id", "id", "parent_id").distinct()


def _objects(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    return nested.flat_objects(table(spark, folder, "raw_post"), kinds, wanted)


def p4_posts(spark: SparkSession, folder: str) -> DataFrame:
    field = F.col("fields")
    return _objects(spark, folder, ("post",), ("subreddit", "author", "created_utc", "title", "selftext", "score")).where("kind = 'post'").select(
        "file_no",
        "obj",
        "id",
        field["subreddit"].alias("subreddit"),
        field["author"].alias("author"),
        F.expr("try_cast(fields['created_utc'] as double)").alias("created_utc"),
        field["title"].alias("title"),
        field["selftext"].alias("selftext"),
        F.expr("try_cast(fields['score'] as bigint)").alias("score"),
    )


def p4_comments(spark: SparkSession, folder: str) -> DataFrame:
    field = F.col("fields")
    return _objects(spark, folder, ("comment",), ("author", "created_utc", "body", "score")).where("kind = 'comment'").select(
        "file_no",
        "obj",
        "parent_obj",
        "depth",
        "post_id",
        "id",
        "parent_id",
        field["author"].alias("author"),
        F.expr("try_cast(fields['created_utc'] as double)").alias("created_utc"),
        field["body"].alias("body"),
        F.expr("try_cast(fields['score'] as bigint)").alias("score"),
    )


def p4_objects(spark: SparkSession, folder: str) -> DataFrame:
    """All other objects: awards, gallery items, polls, flairs, crossposts, links to more comments."""
    return _objects(spark, folder).where("kind not in ('post', 'comment')")


def _compacted(spark: SparkSession, folder: str) -> compact.Compacted:
    files = table(spark, folder, "raw_post").select("file_no", "path", "subreddit", "post_id", "harvested_at", "doc")
    return compact.compact(files, drop_later(spark, scratch_path(spark, "compact")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compact.same_post_pairs(_compacted(spark, folder).index)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with the file that stands for its post: the copy kept, and how many copies there are."""
    index = _compacted(spark, folder).index
    best = index.where("kept").select("post", F.col("file_no").alias("kept_file"))
    size = index.groupBy("post").agg(F.count(F.lit(1)).alias("n_copies"))
    return index.select("file_no", "post").join(best, "post").join(size, "post").select("file_no", "kept_file", "n_copies")


def p5_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per output file."""
    groups = _compacted(spark, folder).manifest["groups"]
    rows = [(g["group_no"], g["rows"], g["size"]) for g in groups]
    return spark.createDataFrame(rows, "group_no int, n_records long, n_bytes long")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records held, one per post."""
    done = _compacted(spark, folder)
    return done.index.where("kept").select("file_no", "sub_key", "post_key", "readable")


QUERIES = {
    "p1_found": p1_found,
    "p1_post_totals": p1_post_totals,
    "p1_author_totals": p1_author_totals,
    "p2_author_features": p2_author_features,
    "p2_author_types": p2_author_types,
    "p2_window_types": p2_window_types,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p4_posts": p4_posts,
    "p4_comments": p4_comments,
    "p4_objects": p4_objects,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_manifest": p5_manifest,
    "p5_records": p5_records,
}

_BARE = "nullif(regexp_replace({0}, '^.*_', ''), '')"
_TS = "nullif(\"timestamp\", 0)"
_EVENTS = f"""
messages AS (
  SELECT author, lower_type AS type, ts, metadata_score FROM (
    SELECT author, {_TS} AS ts, metadata_score,
           coalesce(regexp_replace(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '/+$', ''), '(none)') || '|' || coalesce(upper(trim(ai_analysis.label)), '(none)') AS lower_type,
           row_number() OVER (PARTITION BY {_BARE.format('id')} ORDER BY harvested_at DESC, coalesce(metadata_score, -4611686018427387904) DESC) AS rn
    FROM comments) WHERE rn = 1)
"""
_TREE = f"""
n0 AS (SELECT {_BARE.format('id')} AS id, min({_BARE.format('parent_id')}) AS parent_id, min({_BARE.format('post_id')}) AS post_id, min(depth) AS depth
       FROM comments WHERE id IS NOT NULL GROUP BY 1),
posts AS (SELECT DISTINCT {_BARE.format('id')} AS pid FROM post_header),
start AS (SELECT n0.id, n0.post_id, n0.depth, CASE WHEN p.pid IS NULL AND q.id IS NOT NULL THEN n0.parent_id END AS up,
       CASE WHEN n0.parent_id IS NULL THEN 'null' WHEN p.pid IS NOT NULL THEN 'post' WHEN q.id IS NULL THEN 'missing' END AS stop, n0.parent_id AS stop_id
       FROM n0 LEFT JOIN posts p ON n0.parent_id = p.pid LEFT JOIN n0 q ON n0.parent_id = q.id),
down AS (
  SELECT id, id AS top, 0 AS k, stop, stop_id, id AS path, post_id, depth FROM start WHERE stop IS NOT NULL
  UNION ALL
  SELECT s.id, d.top, d.k + 1, d.stop, d.stop_id, d.path || '/' || s.id, s.post_id, s.depth FROM start s JOIN down d ON s.up = d.id),
cyc AS (SELECT s.id, s.up FROM start s WHERE s.id NOT IN (SELECT id FROM down)),
hops AS (SELECT id, up AS spot, 1 AS k FROM cyc UNION ALL SELECT h.id, c.up, h.k + 1 FROM hops h JOIN cyc c ON h.spot = c.id WHERE h.spot <> h.id AND h.k < 400),
oncyc AS (SELECT DISTINCT id FROM hops WHERE spot = id)
"""

_PATHS = """
k AS (SELECT file_no, lower(split_part(path, '/', -2)) AS s, lower(regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.json.*$', ''), '^.*_', '')) AS p FROM raw_post)
"""
_KEPT = """
parts AS (SELECT file_no, path, harvested_at, doc, split_part(path, '/', -1) AS leaf, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', -2) END AS folder FROM raw_post),
keyed AS (SELECT *, nullif(lower(trim(folder)), '') AS sub, nullif(regexp_replace(lower(regexp_replace(leaf, '\\.json.*$', '')), '^.*_', ''), '') AS po FROM parts),
named AS (SELECT *, CASE WHEN sub IS NOT NULL AND po IS NOT NULL THEN sub END AS sub_key, CASE WHEN sub IS NOT NULL AND po IS NOT NULL THEN po END AS post_key,
          coalesce(CASE WHEN json_valid(doc) THEN json_type(CAST(doc AS JSON)) = 'ARRAY' AND json_array_length(CAST(doc AS JSON)) = 2 AND json_extract_string(doc, '$[0].kind') = 'Listing'
          AND json_extract_string(doc, '$[1].kind') = 'Listing' AND json_extract(doc, '$[0].data') IS NOT NULL AND json_extract(doc, '$[1].data') IS NOT NULL END, false) AS readable FROM keyed),
ranked AS (SELECT *, coalesce(sub_key || '/' || post_key, '#' || file_no) AS post, row_number() OVER (PARTITION BY coalesce(sub_key || '/' || post_key, '#' || file_no)
           ORDER BY readable DESC, coalesce(harvested_at, TIMESTAMP '1900-01-01') DESC, coalesce(strlen(doc), 0) DESC, file_no DESC) AS r FROM named)
"""
_JSON = """
docs AS (SELECT file_no, CAST(doc AS JSON) AS j FROM (SELECT file_no, doc FROM raw_post WHERE json_valid(doc))
         WHERE json_array_length(CAST(doc AS JSON)) = 2 AND json_extract_string(doc, '$[0].kind') = 'Listing' AND json_extract_string(doc, '$[1].kind') = 'Listing'),
post AS (SELECT file_no, regexp_replace(json_extract_string(j, '$[0].data.children[0].data.id'), '^.*_', '') AS pid, j FROM docs),
walk AS (
  SELECT file_no, pid, pid AS parent, unnest(json_extract(j, '$[1].data.children[*]')) AS node FROM post
  UNION ALL
  SELECT file_no, pid, coalesce(json_extract_string(node, '$.data.id'), parent), unnest(json_extract(node, '$.data.replies.data.children[*]'))
  FROM walk WHERE json_extract_string(node, '$.kind') = 't1'),
hits AS (SELECT file_no, pid AS post_id, regexp_replace(json_extract_string(node, '$.data.id'), '^.*_', '') AS id, parent AS parent_id, node
         FROM walk WHERE json_extract_string(node, '$.kind') = 't1')
"""

SQL = {
    "p1_found": """
WITH n AS (SELECT count(*) AS n FROM comments),
k AS (SELECT 'post_id' AS field, post_id AS key_value FROM comments UNION ALL SELECT 'author', author FROM comments)
SELECT field, key_value FROM k, n WHERE key_value IS NOT NULL GROUP BY field, key_value, n.n HAVING count(*) >= 0.02 * n.n
""",
    "p1_post_totals": f"""
WITH h AS (SELECT {_BARE.format('id')} AS post_id, min({_TS}) AS post_ts FROM post_header GROUP BY 1 HAVING {_BARE.format('id')} IS NOT NULL)
SELECT c.post_id, count(*) AS n_rows, CAST(sum(metadata_score) AS BIGINT) AS score_total, min({_TS.replace('"timestamp"', 'c."timestamp"')}) AS first_ts,
       max({_TS.replace('"timestamp"', 'c."timestamp"')}) AS last_ts,
       count(CASE WHEN {_TS.replace('"timestamp"', 'c."timestamp"')} - post_ts > 86400 THEN 1 END) AS n_after_a_day, bool_or(h.post_id IS NOT NULL) AS has_header
FROM comments c LEFT JOIN h ON c.post_id = h.post_id GROUP BY c.post_id
""",
    "p1_author_totals": f"""
WITH h AS (SELECT author, min({_TS}) AS first_post_ts, count(DISTINCT {_BARE.format('id')}) AS n_posts FROM post_header WHERE author IS NOT NULL GROUP BY 1)
SELECT c.author, count(*) AS n_rows, CAST(sum(metadata_score) AS BIGINT) AS score_total,
       count(CASE WHEN {_TS.replace('"timestamp"', 'c."timestamp"')} < first_post_ts THEN 1 END) AS n_before_first_post, coalesce(max(n_posts), 0) AS n_posts
FROM comments c LEFT JOIN h ON c.author = h.author GROUP BY c.author
""",
    "p2_author_types": f"""
WITH {_EVENTS}
SELECT author, type, count(*) AS n, CAST(sum(metadata_score) AS BIGINT) AS total, max(ts) AS last_ts FROM messages GROUP BY 1, 2
""",
    "p4_posts": f"""
WITH RECURSIVE {_JSON}, first AS (SELECT file_no, json_extract(j, '$[0].data.children[0]') AS node FROM docs)
SELECT file_no, 1 AS obj, nullif(regexp_replace(json_extract_string(node, '$.data.id'), '^.*_', ''), '') AS id, json_extract_string(node, '$.data.subreddit') AS subreddit, json_extract_string(node, '$.data.author') AS author,
TRY_CAST(json_extract_string(node, '$.data.created_utc') AS DOUBLE) AS created_utc, json_extract_string(node, '$.data.title') AS title, json_extract_string(node, '$.data.selftext') AS selftext,
TRY_CAST(json_extract_string(node, '$.data.score') AS BIGINT) AS score FROM first WHERE json_extract_string(node, '$.kind') = 't3'
""",
    "p5_records": f"WITH {_KEPT} SELECT file_no, sub_key, post_key, readable FROM ranked WHERE r = 1",
    "p5_groups": f"WITH {_KEPT} SELECT file_no, first_value(file_no) OVER w AS kept_file, count(*) OVER (PARTITION BY post) AS n_copies FROM ranked WINDOW w AS (PARTITION BY post ORDER BY r)",
    "p2_window_types": f"""
WITH {_EVENTS}
SELECT author, type, count(*) AS n, CAST(sum(metadata_score) AS BIGINT) AS total, max(ts) AS last_ts FROM messages
WHERE ts >= {WINDOW[0]} AND ts < {WINDOW[1]} GROUP BY 1, 2
""",
    "p3_found": f"""
WITH RECURSIVE {_TREE}
SELECT id, 'on_cycle' AS kind FROM oncyc
UNION ALL SELECT id, 'under_cycle' FROM cyc WHERE id NOT IN (SELECT id FROM oncyc)
UNION ALL SELECT id, 'no_root' FROM down WHERE stop <> 'post'
UNION ALL SELECT id, 'other_post' FROM down WHERE stop = 'post' AND stop_id IS DISTINCT FROM post_id
UNION ALL SELECT id, 'wrong_depth' FROM down WHERE stop = 'post' AND depth IS NOT NULL AND depth <> k + 1
""",
    "p3_paths": f"""
WITH RECURSIVE {_TREE},
above AS (SELECT id AS node, up AS anc FROM start WHERE up IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT a.node, s.up FROM above a JOIN start s ON a.anc = s.id WHERE s.up IS NOT NULL),
cnt AS (SELECT anc AS id, count(*) AS n FROM above GROUP BY 1)
SELECT d.id, CASE WHEN stop = 'post' THEN stop_id || '/' ELSE '' END || path AS path, CAST(CASE WHEN stop = 'post' THEN k + 1 ELSE k END AS INTEGER) AS true_depth,
       CASE WHEN stop = 'post' THEN stop_id ELSE top END AS root, stop AS root_kind, false AS on_cycle, coalesce(cnt.n, 0) AS n_descendants
FROM down d LEFT JOIN cnt ON d.id = cnt.id
UNION ALL
SELECT id, NULL, NULL, NULL, 'cycle', id IN (SELECT id FROM oncyc), NULL FROM cyc
""",
    "p3_descendants": f"""
WITH RECURSIVE {_TREE},
above AS (SELECT up AS ancestor, id, 1 AS distance FROM start WHERE up IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT s.up, a.id, a.distance + 1 FROM above a JOIN start s ON a.ancestor = s.id WHERE s.up IS NOT NULL)
SELECT ancestor, id, CAST(distance AS INTEGER) AS distance FROM above
""",
    "p4_found": f"""
WITH RECURSIVE {_JSON}
SELECT DISTINCT post_id, id, parent_id FROM hits WHERE id IS NOT NULL
""",
    "p5_found": f"""
WITH {_PATHS}
SELECT a.file_no AS file_a, b.file_no AS file_b FROM k a JOIN k b ON a.s = b.s AND a.p = b.p AND a.file_no < b.file_no
""",
}
