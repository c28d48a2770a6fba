"""Queries over the discussion tables: normalisation, labels, text, agreement and privacy, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.functions import rewrite
from ramagem.functions.bins import quartile
from ramagem.functions.keys import bare_id, label_key, subreddit_key, valid_time
from ramagem.operators import labels, messages, nested, quality, social, stats, textops
from ramagem.plans.cascades import held
from ramagem.session import scratch_path
from ramagem.sources import files
from ramagem.sources.tables import table
from ramagem.streaming import resume

SALT = "fixed-salt-for-comparison"
#: An invented lexicon with an exact term and overlapping wildcards.
LEXICON_TEXT = "%\n1\tanger\n2\tcertain\n3\tpower\n4\tsocial\n5\tplace\n%\nruim\t1\ndecep*\t1\nnada\t2\nsempre\t2\nchef*\t3\nche*\t4\nprefeitura\t3\nminha\t4\nmeu\t4\nrua*\t5\nloja\t5\nbairro\t5\nbad\t1\nschool\t5\n"
CONCEPTS = ["anger", "certain", "power", "social", "place"]


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments")


def _messages(spark, folder):
    build = lambda: messages.messages_from_tables(_comments(spark, folder), table(spark, folder, "post_header"), table(spark, folder, "subreddit_category"))
    return held(spark, folder, "table-messages", build)


def norm_ids(spark, folder):
    c = _comments(spark, folder)
    return c.select(bare_id(F.col("id")).alias("id"), bare_id(F.col("parent_id")).alias("parent_id"), F.coalesce(F.col("parent_id").startswith("t3_"), F.lit(False)).alias("is_post_reply")).distinct()


def ts_coalesce(spark, folder):
    c = _comments(spark, folder).select(bare_id(F.col("id")).alias("id"), valid_time(F.col("timestamp")).alias("ts"))
    return c.groupBy("id").agg(F.max("ts").alias("ts"))


def label_extract(spark, folder):
    """Labels out of records as JSON text, through the polymorphic reader."""
    packed = _comments(spark, folder).select(bare_id(F.col("id")).alias("id"), F.to_json(F.struct("ai_analysis")).alias("doc"))
    got = packed.select("id", F.upper(labels.label_from_variant(F.parse_json("doc"))).alias("label"))
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def category_map(spark, folder):
    c = _comments(spark, folder).withColumn("subreddit", subreddit_key(F.col("subreddit")))
    return c.join(F.broadcast(table(spark, folder, "subreddit_category")), "subreddit").groupBy("category").agg(F.count(F.lit(1)).alias("n"))  # a fixed table


def validity_flag(spark, folder):
    body = rewrite.sanitize(F.col("author"), F.col("body"))
    c = _comments(spark, folder).select(bare_id(F.col("id")).alias("id"), body.alias("body")).withColumn("is_valid_text", rewrite.is_valid_text(F.col("body")))
    return c.distinct()


def markup_rewrite(spark, folder):
    c = _comments(spark, folder).where(rewrite.needs_rewrite(F.col("body")))
    return c.select(bare_id(F.col("id")).alias("id"), rewrite.rewrite_markup(F.col("body")).alias("body")).distinct()


def loop_guard(spark, folder):
    """Bodies with what the guard against looping descriptions makes of them, where it changes them."""
    c = _comments(spark, folder).where("body is not null").select(bare_id(F.col("id")).alias("id"), "body", rewrite.guard_loop(F.col("body")).alias("kept"))
    return c.where("body <> kept").select("id", "kept").distinct()


def _links(column):
    def query(spark, folder):
        c = _comments(spark, folder).where("body is not null").select(bare_id(F.col("id")).alias("id"), F.explode(column(F.col("body"))).alias("link"))
        return c.distinct()

    return query


def media_replaced(spark, folder):
    """Bodies with media links replaced by descriptions; without a describer all get the fallback."""
    c = _comments(spark, folder).select(bare_id(F.col("id")).alias("id"), "body", "harvested_at").where("body is not null")
    c = c.groupBy("id").agg(F.max_by("body", F.struct("harvested_at", "body")).alias("body"))  # the last delivery
    with_links = c.withColumn("body", rewrite.rewrite_markup(F.col("body")))
    lookup = spark.createDataFrame([], "link string, text string")
    return rewrite.replace_links(with_links, rewrite.media_links(F.col("body")), lookup, "[CONTEUDO VISUAL: %s]", rewrite.MEDIA_FALLBACK)


def infer_text(spark, folder):
    h = table(spark, folder, "post_header")
    return h.select(bare_id(F.col("id")).alias("id"), labels.inference_text(F.col("type"), F.col("title"), F.col("body")).alias("text")).distinct()


def bypass_rules(spark, folder):
    text = labels.inference_text(F.col("type"), F.lit(None).cast("string"), F.col("body"))
    c = _comments(spark, folder).select(labels.bypass(F.col("body"), F.col("is_valid_text"), text).alias("s"))
    return c.groupBy(F.col("s.label").alias("label"), F.col("s.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def score_stub(spark, folder):
    """The whole labelling pass with the word-list scorer."""
    c = _comments(spark, folder).withColumn("title", F.lit(None).cast("string")).select("type", "title", "body", "is_valid_text")
    return labels.label_messages(c, labels.WordScorer()).groupBy(F.col("ai_analysis.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def metadata_footer(spark, folder):
    return quality.footer(_comments(spark, folder).withColumn("timestamp", valid_time(F.col("timestamp"))))


def union_messages(spark, folder):
    both = files.unify(_comments(spark, folder), table(spark, folder, "post_header"))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("with_title"), F.count("is_valid_text").alias("with_flag"))


def account_filter(spark, folder):
    c = _comments(spark, folder)
    ways = (("tally", social.TALLY_ACCOUNTS, False), ("edges", ("[deleted]", "deleted"), False), ("survival", social.SURVIVAL_ACCOUNTS, True))
    one = [social.drop_accounts(c, names, any_case).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, names, any_case in ways]
    return one[0].unionByName(one[1]).unionByName(one[2])


def _usable(spark, folder):
    return _comments(spark, folder).where(textops.usable_text(F.col("author"), F.col("body"), F.col("is_valid_text")))


def usable_text(spark, folder):
    return _usable(spark, folder).select(bare_id(F.col("id")).alias("id")).distinct()


def sink_dedup(spark, folder):
    """Posts of the harvested files that no header row has."""
    from ramagem.operators.compact import post_of_path

    posts = post_of_path(table(spark, folder, "raw_post")).where("post_key is not null").select(F.col("post_key").alias("id"))
    return files.append_new(posts, table(spark, folder, "post_header").select(bare_id(F.col("id")).alias("id")), "id")


def resume_anti(spark, folder):
    c = _comments(spark, folder).select(bare_id(F.col("id")).alias("id")).distinct()
    return files.unprocessed(c, table(spark, folder, "message_annotation").select(bare_id(F.col("id")).alias("id")))


def scan_raw_json(spark, folder):
    doc = F.col("doc")
    size = F.when(F.try_parse_json(doc).isNotNull(), F.json_array_length(doc))
    return table(spark, folder, "raw_post").select("file_no", size.cast("int").alias("listings"))


def scan_jsonl(spark, folder):
    """Comments written as JSON Lines with a footer and read back by the tolerant reader."""
    path = scratch_path(spark, "jsonl")
    rows = _comments(spark, folder).drop("harvested_at")
    files.write_jsonl(rows, path)
    files.write_jsonl(spark.createDataFrame([(files.FOOTER, 1)], "type string, total_records long"), path)
    back = files.read_jsonl(spark, path)
    return back.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"), F.sum("metadata_score").alias("score"), F.count("ai_analysis.label").alias("labelled"))


def flatten_tree(spark, folder):
    o = nested.flat_objects(table(spark, folder, "raw_post"), ("comment",), ()).where("kind = 'comment' and id is not null")
    return o.groupBy("file_no", "id").agg(F.min("parent_id").alias("parent_id"), F.min("depth").alias("depth"))


def resume_stream(spark, folder):
    """The comments as files, processed as a stream in two calls; the second finds nothing new."""
    base = scratch_path(spark, "stream")
    files.write_jsonl(_comments(spark, folder).drop("harvested_at"), f"{base}/in")
    for _ in range(2):
        resume.process_new(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    return spark.read.schema("id string, type string").json(f"{base}/out").groupBy("type").agg(F.count_distinct("id").alias("n"))


def activity_by_day(spark, folder):
    m = _messages(spark, folder).where("timestamp is not null")
    return resume.activity_windows(m).select(F.unix_timestamp("start").alias("start"), "subreddit", "n", "negative")


def table_sentiment(spark, folder):
    return social.sentiment_totals(_messages(spark, folder).where("type = 'comment'")).select("label", "n", F.round("share", 6).alias("share"))


def _users(spark, folder):
    return social.user_negativity(_messages(spark, folder).where("type = 'comment'"))


def comment_user_type(spark, folder):
    users = _users(spark, folder).select("author", "user_type")
    c = _messages(spark, folder).where("type = 'comment'").select("author")
    # users grow with the data: the side is not broadcast by hand; counting first leaves one row per author to join
    per = c.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return per.join(users, "author", "left").groupBy("user_type").agg(F.sum("n").alias("n"))


def neg_quartile(spark, folder):
    return _users(spark, folder).groupBy(F.col("user_type").alias("quartile")).agg(F.count(F.lit(1)).alias("n"))


def valence_halves(spark, folder):
    half = F.when(F.col("user_type").isin("UQ1", "UQ2"), "low").otherwise("high")
    return _users(spark, folder).groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n"))


def tokenize(spark, folder):
    d = table(spark, folder, "documents").select(F.explode(textops.tokens(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _terms(spark, folder):
    d = table(spark, folder, "documents").withColumn("lang", F.lower(F.substring("lang", 1, 2)))
    return textops.document_terms(d, "doc_id", "lang", "text")


def term_clouds(spark, folder):
    return textops.top_terms(_terms(spark, folder).where("lang is not null"), "lang", textops.stopwords(spark), 200)


def term_valence(spark, folder):
    v = textops.term_valence(_terms(spark, folder), "lang", "pt", "es", textops.stopwords(spark), 5)
    return v.select("term", F.round("valence", 9).alias("valence"), "total")


def term_extremes(spark, folder):
    v = textops.term_valence(_terms(spark, folder), "lang", "pt", "es", textops.stopwords(spark), 5).select("term", F.round("valence", 9).alias("valence"), "total")
    return textops.extreme_terms(v)


def lexicon_terms(spark):
    lines = spark.createDataFrame(list(enumerate(LEXICON_TEXT.split("\n"))), "n int, line string")
    categories, terms = textops.parse_lexicon(lines)
    return terms.join(categories, "category_id").select("term", "wildcard", "category")


def lexicon_load(spark, folder):
    return lexicon_terms(spark)


def lexicon_match(spark, folder):
    words = table(spark, folder, "documents").select(F.explode(textops.tokens(F.col("text"))).alias("token")).distinct()
    return textops.match_lexicon(words, lexicon_terms(spark))


def _rates(spark, folder):
    d = _usable(spark, folder).select(bare_id(F.col("id")).alias("id"), "body").groupBy("id").agg(F.min("body").alias("body"))
    return held(spark, folder, "lexicon-rates", lambda: textops.lexicon_rates(d, "id", "body", lexicon_terms(spark), CONCEPTS))


def lexicon_rates(spark, folder):
    return _rates(spark, folder).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in CONCEPTS])


def lexicon_spearman(spark, folder):
    joined = _rates(spark, folder).join(_messages(spark, folder).select("id", "confidence"), "id")
    rows = [(c, *[x if x is None else x for x in stats.spearman(joined, "confidence", c).first()]) for c in CONCEPTS]
    df = spark.createDataFrame(rows, "concept string, rho double, n long")
    return df.select("concept", F.round("rho", 6).alias("rho"), "n").orderBy(F.desc_nulls_last("rho"))


def stopwords(spark, folder):
    return textops.stopwords(spark)


def _topics(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id"), (F.col("label") - 1).alias("topic"))
    return e.withColumn("grp", F.col("vec_id") % 37)


def topic_entropy(spark, folder):
    return textops.topic_entropy(_topics(spark, folder), "grp").select("grp", F.round("entropy", 9).alias("entropy"), F.round("scaled", 9).alias("scaled"))


def topics_per_class(spark, folder):
    t = _topics(spark, folder).where("topic <> -1").withColumn("quartile", F.concat(F.lit("Q"), (F.col("vec_id") % 4 + 1).cast("string")))
    n = t.groupBy("quartile", F.col("topic").cast("string").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return textops.top_terms(n, "quartile", spark.createDataFrame([], "term string"), 5)


def topic_assign(spark, folder):
    return textops.assign_topics(table(spark, folder, "embeddings"), "vec_id", "embedding").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, folder):
    human = table(spark, folder, "message_annotation").select(bare_id(F.col("id")).alias("id"), F.col("human_label").alias("human"), F.col("sampled_quartile").alias("quartile"))
    m = _messages(spark, folder).select("id", quality.short_label(F.col("label")).alias("guess"), "confidence")
    return human.join(m, "id")


def label_alignment(spark, folder):
    return _pairs(spark, folder).where("human is not null and guess is not null").groupBy("human", "guess").agg(F.count(F.lit(1)).alias("n"))


def label_intersect(spark, folder):
    a = _messages(spark, folder).where("label = 'NEGATIVE'").select("id")
    return a.intersect(table(spark, folder, "message_annotation").where("human_label = 'NEG'").select(bare_id(F.col("id")).alias("id")))


def ablation_matrix(spark, folder):
    return quality.confusion(_pairs(spark, folder), "human", "guess", ["POS", "NEU", "NEG"])


_METRICS = ("precision", "recall", "f1", "accuracy", "overall_accuracy")


def agreement_metrics(spark, folder):
    return quality.agreement(_pairs(spark, folder), "human", "guess").select("label", "n", *[F.round(c, 9).alias(c) for c in _METRICS])


def agreement_by_quartile(spark, folder):
    return quality.agreement(_pairs(spark, folder), "human", "guess", "quartile").select("grp", "label", "n", *[F.round(c, 9).alias(c) for c in _METRICS])


def confidence_means(spark, folder):
    per = _pairs(spark, folder).where("human is not null").groupBy(F.col("human").alias("label")).agg(F.avg("confidence").alias("m"))
    return per.select("label", F.round("m", 9).alias("mean")).unionByName(per.agg(F.lit("(all)").alias("label"), F.round(F.avg("m"), 9).alias("mean")))


def annotation_merge(spark, folder):
    base = _messages(spark, folder).where("type = 'comment'").select("id")
    done = table(spark, folder, "message_annotation").select(bare_id(F.col("id")).alias("id"), "human_label").groupBy("id").agg(F.min("human_label").alias("human_label"))
    return quality.annotation_merge(base, done).groupBy("human_label").agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(spark, folder):
    return quality.seeded_sample(_messages(spark, folder).where("type = 'comment'"), "id").select("id", "label")


def anonymize(spark, folder):
    """Whole records, with every delivery."""
    done = quality.anonymize(_comments(spark, folder), SALT)
    flat = [c for c in done.columns if c not in ("ai_analysis", "harvested_at")]
    return done.select(*flat, F.col("ai_analysis.label").alias("label"), F.col("ai_analysis.confidence").alias("confidence"), F.unix_micros(F.col("harvested_at").cast("timestamp")).alias("harvested_us"))


def anon_validation(spark, folder):
    c = _comments(spark, folder).select("type", "id", "post_id", "author", "body")
    return quality.validate_anonymization(c, quality.anonymize(c, SALT)).select("check", "passed")


def record_counts(spark, folder):
    return _messages(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def distinct_authors(spark, folder):
    a = _comments(spark, folder)
    return a.agg(F.count_distinct("author").alias("authors"), F.count_distinct(quality.author_hash(F.col("author"), SALT)).alias("hashes"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_ids, ts_coalesce, label_extract, category_map, validity_flag, markup_rewrite, loop_guard, media_replaced, infer_text, bypass_rules, score_stub, metadata_footer, union_messages, account_filter, usable_text,
        sink_dedup, resume_anti, scan_raw_json, scan_jsonl, flatten_tree, resume_stream, activity_by_day, table_sentiment, comment_user_type, neg_quartile, valence_halves, tokenize, term_clouds,
        term_valence, term_extremes, lexicon_load, lexicon_match, lexicon_rates, lexicon_spearman, stopwords, topic_entropy, topics_per_class, topic_assign, label_alignment, label_intersect, ablation_matrix,
        agreement_metrics, agreement_by_quartile, confidence_means, annotation_merge, seeded_sample, anonymize, anon_validation, record_counts, distinct_authors,
    )
}
QUERIES |= {"video_links": _links(rewrite.video_links), "media_links": _links(rewrite.media_links)}

_ID = "nullif(regexp_replace({0}, '^.*_', ''), '')"
_SUB = "regexp_replace(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '/+$', '')"
_MSG = f"""
raw AS (SELECT {_ID.format('id')} AS id, type, author, upper(trim(ai_analysis.label)) AS label, ai_analysis.confidence AS confidence, nullif("timestamp", 0) AS ts, metadata_score AS score, subreddit, harvested_at FROM comments
        UNION ALL SELECT {_ID.format('id')}, type, author, upper(trim(ai_analysis.label)), ai_analysis.confidence, nullif("timestamp", 0), metadata_score, subreddit, harvested_at FROM post_header),
msg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC, coalesce(score, -4611686018427387904) DESC) AS rn FROM raw WHERE id IS NOT NULL) WHERE rn = 1)"""
_SHORT = "CASE label WHEN 'POSITIVE' THEN 'POS' WHEN 'NEUTRAL' THEN 'NEU' WHEN 'NEGATIVE' THEN 'NEG' END"
_PAIR = f"""{_MSG},
pair AS (SELECT a.human_label AS human, a.sampled_quartile AS quartile, {_SHORT} AS guess, confidence FROM (SELECT {_ID.format('id')} AS id, human_label, sampled_quartile FROM message_annotation) a JOIN msg USING (id))"""
_USERS = f"""{_MSG},
u AS (SELECT author, count(*) FILTER (label = 'NEGATIVE') * 100.0::DOUBLE / count(*) AS p FROM msg WHERE type = 'comment' AND label IN ('POSITIVE', 'NEUTRAL', 'NEGATIVE')
      AND author NOT IN ('[deleted]', 'deleted', 'automoderator', 'redditcaresresources') GROUP BY 1),
ut AS (SELECT author, CASE WHEN p <= 25 THEN 'UQ1' WHEN p <= 50 THEN 'UQ2' WHEN p <= 75 THEN 'UQ3' ELSE 'UQ4' END AS user_type FROM u)"""


def _agree(by: str) -> str:
    return f"""{_PAIR},
ok AS (SELECT {by} AS grp, human AS t, guess AS p FROM pair WHERE human IS NOT NULL AND guess IS NOT NULL{" UNION ALL SELECT '(all)', human, guess FROM pair WHERE human IS NOT NULL AND guess IS NOT NULL" if by != "'(all)'" else ""}),
cl AS (SELECT grp, t AS label FROM ok UNION SELECT grp, p FROM ok),
cn AS (SELECT cl.grp, label, count(*) FILTER (t = label) AS nt, count(*) FILTER (p = label) AS np, count(*) FILTER (t = label AND p = label) AS tp, count(*) AS total, count(*) FILTER (t = p) AS hits
       FROM cl JOIN ok ON cl.grp = ok.grp GROUP BY 1, 2),
mt AS (SELECT *, CASE WHEN np > 0 THEN tp * 1.0::DOUBLE / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN tp * 1.0::DOUBLE / nt ELSE 0 END AS rc FROM cn)
SELECT {"grp, " if by != "'(all)'" else ""}label, nt AS n, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1,
round((total - nt - np + 2 * tp) * 1.0::DOUBLE / total, 9) AS accuracy, round(hits * 1.0::DOUBLE / total, 9) AS overall_accuracy FROM mt"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _rewritten(column: str) -> str:
    """Literal patterns, written apart from those of the operator."""
    for pattern, replacement in (
        (r"!\[(gif|img)\]\(giphy\|([A-Za-z0-9]+)[^)]*\)", r"https://i.giphy.com/\2.gif"),
        (r"!\[(gif|img)\]\(emote\|[^)]+\)", r"[Reddit Emote]"),
        (r"!\[img\]\(([A-Za-z0-9]{10,20})\)", r"https://i.redd.it/\1.jpeg"),
        (r"!\[gif\]\(([A-Za-z0-9]{10,20})\)", r"https://i.redd.it/\1.gif"),
        (r"https?://preview\.redd\.it/([A-Za-z0-9_-]+\.(jpe?g|png|gif))(\?[^\s\])]*)?", r"https://i.redd.it/\1"),
    ):
        column = f"regexp_replace({column}, '{_quoted(pattern)}', '{_quoted(replacement)}', 'g')"
    return column


_TOKENS = f"regexp_extract_all(lower(text), '{textops.WORD}')"
_STOP = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in sorted({w for ws in textops.STOPWORDS.values() for w in ws})) + ") v(term))"
_TERMS = f"""{_STOP},
tm AS (SELECT doc_id, lower(substr(lang, 1, 2)) AS lang, unnest({_TOKENS}) AS term FROM documents),
tc AS (SELECT doc_id, lang, term, count(*) AS n FROM tm GROUP BY 1, 2, 3)"""
_VAL = f"""{_TERMS},
c AS (SELECT term, CAST(sum(CASE WHEN lang = 'pt' THEN n ELSE 0 END) AS BIGINT) AS c1, CAST(sum(CASE WHEN lang = 'es' THEN n ELSE 0 END) AS BIGINT) AS c2 FROM tc WHERE lang IN ('pt', 'es')
      AND length(term) BETWEEN 3 AND 16 AND term NOT IN (SELECT term FROM st) GROUP BY 1 HAVING count(*) >= 5),
w AS (SELECT term, c1 * 1.0::DOUBLE / (SELECT sum(c1) FROM c) AS f1, c2 * 1.0::DOUBLE / (SELECT sum(c2) FROM c) AS f2, c1 + c2 AS total FROM c),
v AS (SELECT term, round(2 * f2 / (f1 + f2) - 1, 9) AS valence, total FROM w WHERE total >= (SELECT quantile_cont(total, 0.85) FROM w))"""
_LEX_ROWS = [(t.rstrip("*"), t.endswith("*"), c) for line in LEXICON_TEXT.split("%\n")[2].strip().split("\n") for t, *cs in [line.split("\t")] for c in (dict(zip("12345", CONCEPTS))[x] for x in cs)]
_LEX = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(w).lower()}, '{c}')" for t, w, c in _LEX_ROWS) + ") v(term, wildcard, category))"
_HIT = """bw AS (SELECT token, min(length(term)) AS k FROM wd JOIN lx ON wildcard AND starts_with(token, term) GROUP BY 1),
hit AS (SELECT DISTINCT bw.token, category FROM bw JOIN lx ON wildcard AND starts_with(token, term) AND length(term) = k
        UNION SELECT token, category FROM wd JOIN lx ON NOT wildcard AND token = term WHERE token NOT IN (SELECT token FROM bw))"""
_TOPIC = "t AS (SELECT vec_id, label - 1 AS topic, vec_id % 37 AS grp FROM embeddings WHERE label <> 0)"
_USABLE = """coalesce(is_valid_text, false) AND trim(coalesce(body, '')) <> '' AND lower(coalesce(author, '')) NOT IN ('[deleted]', 'deleted', 'automoderator')
AND NOT contains(lower(coalesce(author, '')), 'modteam') AND NOT regexp_matches(body, '[\\x{0400}-\\x{04FF}]')"""

SQL = {
    "norm_ids": f"SELECT DISTINCT {_ID.format('id')} AS id, {_ID.format('parent_id')} AS parent_id, coalesce(starts_with(parent_id, 't3_'), false) AS is_post_reply FROM comments",
    "ts_coalesce": f"SELECT {_ID.format('id')} AS id, max(nullif(\"timestamp\", 0)) AS ts FROM comments GROUP BY 1",
    "label_extract": "SELECT upper(ai_analysis.label) AS label, count(*) AS n FROM comments GROUP BY 1",
    "category_map": f"SELECT category, count(*) AS n FROM (SELECT {_SUB} AS s FROM comments) c JOIN subreddit_category k ON c.s = k.subreddit GROUP BY 1",
    "validity_flag": f"""SELECT DISTINCT id, body, body NOT IN ('[deleted]', '[removed]', '[AutoModerator]', '[empty]') AS is_valid_text FROM (
SELECT {_ID.format('id')} AS id, CASE WHEN lower(author) = 'automoderator' THEN '[AutoModerator]' ELSE coalesce(body, '[empty]') END AS body FROM comments)""",
    "markup_rewrite": f"SELECT DISTINCT {_ID.format('id')} AS id, {_rewritten('body')} AS body FROM comments WHERE contains(body, 'http') OR contains(body, '![')",
    "video_links": f"SELECT DISTINCT id, unnest(regexp_extract_all(body, '{_quoted(rewrite.VIDEO_LINK)}')) AS link FROM (SELECT {_ID.format('id')} AS id, body FROM comments WHERE body IS NOT NULL)",
    "media_links": f"SELECT DISTINCT id, unnest(regexp_extract_all(body, '{_quoted(rewrite.MEDIA_LINK)}')) AS link FROM (SELECT {_ID.format('id')} AS id, body FROM comments WHERE body IS NOT NULL)",
    "infer_text": f"SELECT DISTINCT {_ID.format('id')} AS id, trim(CASE WHEN type = 'post_header' THEN coalesce(title, '') || '. ' || coalesce(body, '') ELSE coalesce(body, '') END, ' ') AS text FROM post_header",
    "bypass_rules": """SELECT label, CASE WHEN label = 'BYPASS_EMPTY' THEN 0.0::DOUBLE WHEN label IS NOT NULL THEN 1.0::DOUBLE END AS confidence, count(*) AS n FROM (
SELECT CASE WHEN body = '[removed]' THEN 'REMOVED_BY_MOD' WHEN body = '[deleted]' THEN 'USER_DELETED' WHEN body = '[AutoModerator]' THEN 'AUTOMOD_WARNING'
       WHEN NOT coalesce(is_valid_text, true) OR trim(coalesce(body, ''), ' ') = '' THEN 'BYPASS_EMPTY' END AS label FROM comments) GROUP BY 1, 2""",
    "score_stub": f"""WITH b AS (SELECT body, CASE WHEN body = '[removed]' THEN 'REMOVED_BY_MOD' WHEN body = '[deleted]' THEN 'USER_DELETED' WHEN body = '[AutoModerator]' THEN 'AUTOMOD_WARNING'
WHEN NOT coalesce(is_valid_text, true) OR trim(coalesce(body, ''), ' ') = '' THEN 'BYPASS_EMPTY' END AS label,
{' + '.join(f"CAST(contains(lower(body), '{w}') AS INTEGER)" for w in labels.WordScorer.POSITIVE)} AS g, {' + '.join(f"CAST(contains(lower(body), '{w}') AS INTEGER)" for w in labels.WordScorer.NEGATIVE)} AS d FROM comments)
SELECT coalesce(label, CASE WHEN g > d THEN 'POSITIVE' WHEN d > g THEN 'NEGATIVE' ELSE 'NEUTRAL' END) AS label, count(*) AS n FROM b GROUP BY 1""",
    "metadata_footer": 'SELECT count(*) AS total_records, min(nullif("timestamp", 0)) AS first_ts, max(nullif("timestamp", 0)) AS last_ts, round((max(nullif("timestamp", 0)) - min(nullif("timestamp", 0))) / 86400, 2) AS days FROM comments',
    "union_messages": "SELECT type, count(*) AS n, count(title) AS with_title, count(flag) AS with_flag FROM (SELECT type, NULL AS title, is_valid_text AS flag FROM comments UNION ALL SELECT type, title, NULL FROM post_header) GROUP BY 1",
    "account_filter": """SELECT 'tally' AS kind, count(*) AS n FROM comments WHERE author NOT IN ('[deleted]', 'deleted', 'automoderator', 'redditcaresresources')
UNION ALL SELECT 'edges', count(*) FROM comments WHERE author NOT IN ('[deleted]', 'deleted') UNION ALL SELECT 'survival', count(*) FROM comments WHERE lower(author) NOT IN ('[deleted]', 'automoderator', 'redditcaresresources')""",
    "usable_text": f"SELECT DISTINCT {_ID.format('id')} AS id FROM comments WHERE {_USABLE}",
    "sink_dedup": f"""SELECT DISTINCT id FROM (SELECT lower(regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.json.*$', ''), '^.*_', '')) AS id FROM raw_post)
WHERE id NOT IN (SELECT {_ID.format('id')} FROM post_header WHERE id IS NOT NULL)""",
    "resume_anti": f"SELECT DISTINCT {_ID.format('id')} AS id FROM comments WHERE {_ID.format('id')} NOT IN (SELECT {_ID.format('id')} FROM message_annotation WHERE id IS NOT NULL)",
    "scan_raw_json": "SELECT file_no, CASE WHEN json_valid(doc) AND starts_with(trim(doc), '[') THEN CAST(json_array_length(doc) AS INTEGER) END AS listings FROM raw_post",
    "scan_jsonl": "SELECT subreddit, count(*) AS n, CAST(sum(metadata_score) AS BIGINT) AS score, count(ai_analysis.label) AS labelled FROM comments WHERE id IS NOT NULL GROUP BY 1",
    "flatten_tree": r"""WITH RECURSIVE docs AS (SELECT file_no, CAST(doc AS JSON) AS j FROM (SELECT file_no, doc FROM raw_post WHERE json_valid(doc))
  WHERE json_array_length(CAST(doc AS JSON)) = 2 AND json_extract_string(doc, '$[0].kind') = 'Listing' AND json_extract_string(doc, '$[1].kind') = 'Listing'),
walk AS (SELECT file_no, json_extract_string(j, '$[0].data.children[0].data.id') AS parent, 1 AS depth, unnest(json_extract(j, '$[1].data.children[*]')) AS node FROM docs
  UNION ALL SELECT file_no, coalesce(json_extract_string(node, '$.data.id'), parent), depth + 1, unnest(json_extract(node, '$.data.replies.data.children[*]')) FROM walk WHERE json_extract_string(node, '$.kind') = 't1')
SELECT file_no, json_extract_string(node, '$.data.id') AS id, min(parent) AS parent_id, CAST(min(depth) AS INTEGER) AS depth FROM walk
WHERE json_extract_string(node, '$.kind') = 't1' AND json_extract_string(node, '$.data.id') IS NOT NULL GROUP BY 1, 2""",
    "activity_by_day": f"""WITH {_MSG} SELECT CAST(floor(ts / 86400) * 86400 AS BIGINT) AS start, {_SUB} AS subreddit, count(*) AS n, count(*) FILTER (label = 'NEGATIVE') AS negative FROM msg WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "table_sentiment": f"WITH {_MSG}, v AS (SELECT label FROM msg WHERE type = 'comment' AND label IN ('POSITIVE', 'NEUTRAL', 'NEGATIVE')) SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v), 6) AS share FROM v GROUP BY 1",
    "comment_user_type": f"WITH {_USERS} SELECT user_type, count(*) AS n FROM msg LEFT JOIN ut USING (author) WHERE type = 'comment' GROUP BY 1",
    "neg_quartile": f"WITH {_USERS} SELECT user_type AS quartile, count(*) AS n FROM ut GROUP BY 1",
    "valence_halves": f"WITH {_USERS} SELECT CASE WHEN user_type IN ('UQ1', 'UQ2') THEN 'low' ELSE 'high' END AS half, count(*) AS n FROM ut GROUP BY 1",
    "tokenize": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY 1",
    "term_clouds": f"""WITH {_TERMS}, c AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM tc WHERE lang IS NOT NULL AND term NOT IN (SELECT term FROM st) GROUP BY 1, 2)
SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c) WHERE r <= 200""",
    "term_valence": f"WITH {_VAL} SELECT term, valence, total FROM v",
    "term_extremes": f"""WITH {_VAL} SELECT * FROM (SELECT term, valence, total, 'low' AS side FROM v ORDER BY valence, term LIMIT 10)
UNION ALL SELECT * FROM (SELECT term, valence, total, 'high' AS side FROM v ORDER BY valence DESC, term LIMIT 10)""",
    "lexicon_load": f"WITH {_LEX} SELECT term, wildcard, category FROM lx",
    "lexicon_match": f"WITH {_LEX}, wd AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents), {_HIT} SELECT token, category FROM hit",
    "stopwords": f"WITH {_STOP} SELECT term FROM st",
    "topic_entropy": f"""WITH {_TOPIC}, c AS (SELECT grp, topic, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT grp, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY grp) AS p FROM c),
e AS (SELECT grp, greatest(-sum(p * ln(p)), 0.0) AS e FROM p GROUP BY 1)
SELECT grp, round(e, 9) AS entropy, round((e - (SELECT min(e) FROM e)) / ((SELECT max(e) FROM e) - (SELECT min(e) FROM e)), 9) AS scaled FROM e""",
    "topics_per_class": f"""WITH {_TOPIC}, c AS (SELECT 'Q' || (vec_id % 4 + 1) AS quartile, CAST(topic AS VARCHAR) AS term, count(*) AS n FROM t GROUP BY 1, 2)
SELECT quartile, term, n FROM (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY n DESC, term) AS r FROM c) WHERE r <= 5""",
    "label_alignment": f"WITH {_PAIR} SELECT human, guess, count(*) AS n FROM pair WHERE human IS NOT NULL AND guess IS NOT NULL GROUP BY 1, 2",
    "label_intersect": f"WITH {_MSG} SELECT id FROM msg WHERE label = 'NEGATIVE' INTERSECT SELECT {_ID.format('id')} FROM message_annotation WHERE human_label = 'NEG'",
    "ablation_matrix": f'WITH {_PAIR} SELECT human AS label, count(*) FILTER (guess = \'POS\') AS "POS", count(*) FILTER (guess = \'NEU\') AS "NEU", count(*) FILTER (guess = \'NEG\') AS "NEG" FROM pair WHERE human IS NOT NULL AND guess IS NOT NULL GROUP BY 1',
    "agreement_metrics": "WITH " + _agree("'(all)'"),
    "agreement_by_quartile": "WITH " + _agree("coalesce(quartile, '(none)')"),
    "confidence_means": f"WITH {_PAIR}, p AS (SELECT human AS label, avg(confidence) AS m FROM pair WHERE human IS NOT NULL GROUP BY 1) SELECT label, round(m, 9) AS mean FROM p UNION ALL SELECT '(all)', round(avg(m), 9) FROM p",
    "annotation_merge": f"WITH {_MSG}, d AS (SELECT {_ID.format('id')} AS id, min(human_label) AS human_label FROM message_annotation GROUP BY 1) SELECT human_label, count(*) AS n FROM msg LEFT JOIN d USING (id) WHERE type = 'comment' GROUP BY 1",
    "anonymize": f"SELECT type, id, parent_id, post_id, subreddit, CASE WHEN author IS NULL OR author IN ('[deleted]', '[removed]', 'deleted') THEN author ELSE sha256(author || '_{SALT}') END AS author, \"timestamp\", body, "
    "depth, metadata_score, is_valid_text, ai_analysis.label AS label, ai_analysis.confidence AS confidence, epoch_us(harvested_at) AS harvested_us FROM comments",
    "anon_validation": "SELECT * FROM (VALUES ('row count', true), ('rows by type', true), ('fields', true), ('ids', true), ('other fields', true), ('field match', true), ('hash form', true), ('no collisions', true)) v(\"check\", passed)",
    "seeded_sample": f"WITH {_MSG} SELECT id, label FROM msg WHERE type = 'comment' ORDER BY md5(id || '-42'), id LIMIT 100",
    "record_counts": f"WITH {_MSG} SELECT type, count(*) AS n FROM msg GROUP BY 1",
    "distinct_authors": "SELECT count(DISTINCT author) AS authors, count(DISTINCT author) AS hashes FROM comments",
}
