"""The reference's operators: golden values, hand fixtures, identities against brute force."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ramagem.functions import rewrite, special
from ramagem.functions.bins import quartile
from ramagem.operators import forest, labels, messages, motifs, quality, social, stats, textops
from ramagem.plans import cascades
from ramagem.sources import files
from ramagem.sources.tables import table
from ramagem.streaming import resume


@pytest.fixture(scope="module")
def nodes(spark, sf):
    return cascades._nodes(spark, sf)


@pytest.fixture(scope="module")
def features(spark, sf):
    return cascades._features(spark, sf).toPandas()


def test_golden_values(spark, sf, nodes, features):
    assert messages.messages_from_events(table(spark, sf, "events")).count() == 1000
    assert nodes.where("dist = 0").count() == 226
    assert len(features) == 117 and features.cascade_size.sum() == 822
    assert (features.cascade_size.max(), features.max_depth.max(), features.max_breadth.max()) == (18, 6, 10)
    assert features.structural_virality.sum() == pytest.approx(114.852077, abs=1e-6)
    assert features.longest_neg_run_ratio.sum() == pytest.approx(74.588095, abs=1e-6)
    assert [int(features[m].sum()) for m in ("dyad", "mutual_dyad", "chain", "fan_in", "fan_out", "triangle", "recip_triangle")] == [369, 46, 75, 183, 10, 35, 0]
    assert [(features.quartile == f"Q{i}").sum() for i in range(1, 5)] == [18, 44, 36, 19]
    triples = motifs.sentiment_triads(nodes)
    assert triples.where("triad = 'NNN'").agg(F.sum("n")).first()[0] == 24


def test_structure_against_brute_force(nodes, features):
    parent = {r["id"]: (r["parent_id"] if r["dist"] else None, r["cascade_id"]) for r in nodes.collect()}
    members: dict[int, list[int]] = {}
    for i, (_, c) in parent.items():
        members.setdefault(c, []).append(i)

    def line(i):
        out = [i]
        while parent[out[-1]][0] is not None:
            out.append(parent[out[-1]][0])
        return out

    for f in features.to_dict("records")[:40]:
        lines = {i: line(i) for i in members[f["cascade_id"]]}
        n = len(lines)
        distance = lambda a, b: len(set(lines[a]) ^ set(lines[b]))
        wiener = sum(distance(a, b) for a, b in itertools.combinations(lines, 2))
        assert f["structural_virality"] == pytest.approx(wiener / (n * (n - 1)))


def test_five_node_tree(spark):
    tree = [(0, "post_header", None), (1, "comment", 0), (2, "comment", 1), (3, "comment", 1), (4, "comment", 3)]
    rows = [(i, k, p, 0, "s", "c", f"u{i}", x, 10.0 * i, 1.0) for (i, k, p), x in zip(tree, ["NEUTRAL", "NEGATIVE", "POSITIVE", "NEGATIVE", "NEGATIVE"])]
    m = spark.createDataFrame(rows, "id long, type string, parent_id long, thread long, subreddit string, category string, author string, label string, timestamp double, score double")
    n = forest.cascade_nodes(m)
    v = forest.virality(n).first()
    assert v["wiener"] == 10 and v["structural_virality"] == pytest.approx(10 / 12) and v["mean_distance"] == pytest.approx(20 / 12)
    assert tuple(forest.longest_negative_run(n).first())[1:] == (3, 1.0)
    assert forest.cascade_nodes(m.limit(0)).count() == 0


def census(edges):
    """Brute force over pairs and triples of users."""
    users = sorted({u for e in edges for u in e})
    has = set(edges)
    out = dict.fromkeys(("dyad", "mutual_dyad", "chain", "fan_in", "fan_out", "triangle", "recip_triangle"), 0)
    for a, b in itertools.combinations(users, 2):
        k = ((a, b) in has) + ((b, a) in has)
        out["dyad"] += k == 1
        out["mutual_dyad"] += k == 2
    for trio in itertools.combinations(users, 3):
        inside = [(a, b) for a in trio for b in trio if (a, b) in has]
        pairs = {frozenset(e) for e in inside}
        if len(inside) == 6:
            out["recip_triangle"] += 1
        elif len(inside) == 3 and len(pairs) == 3:
            out["triangle"] += sorted(sum(a == u for a, _ in inside) for u in trio) == [0, 1, 2]
        elif len(inside) == 2 and len(pairs) == 2:
            (a, b), (c, d) = inside
            out["fan_in"] += b == d
            out["fan_out"] += a == c
            out["chain"] += b == c or d == a
    return out


def test_motifs_against_brute_force(spark):
    rng = random.Random(5)
    edges = {(c, f"u{a}", f"u{b}") for c in range(6) for _ in range(14) for a, b in [rng.sample(range(6), 2)]}
    got = {r["cascade_id"]: r for r in motifs.motif_counts(spark.createDataFrame(sorted(edges), "cascade_id long, source string, target string")).collect()}
    for c in range(6):
        want = census([(a, b) for k, a, b in edges if k == c])
        assert {m: int(got[c][m]) for m in want} == want
        assert got[c]["total_motifs"] == sum(want.values())


def test_quartiles_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 25.0, 25.1, 50.0, 75.0, 75.5, 100.0, 101.0, None)], "x double")
    assert [r[0] for r in df.select(quartile(F.col("x"))).collect()] == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q4", "Q4", None, None]


def test_dominant_label_ties(spark):
    make = lambda c, *ls: [(i, c, 0, "a", x, None, None, "s", "k") for i, x in enumerate(ls)]
    rows = make(1, "NEGATIVE", "NEUTRAL", "POSITIVE") + make(2, "NEGATIVE", "NEUTRAL", "NEGATIVE", "NEUTRAL") + make(3, "NEGATIVE", "ODD", None)
    df = spark.createDataFrame(rows, "id long, cascade_id long, dist int, author string, label string, timestamp double, score double, subreddit string, category string")
    got = {r["cascade_id"]: r for r in forest.basics(df).collect()}
    assert [got[i]["dominant_sentiment"] for i in (1, 2, 3)] == ["POSITIVE", "NEUTRAL", "NEGATIVE"]
    assert got[3]["perc_negative"] == 100.0 and got[3]["duration_minutes"] == 0.0


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(16.918977604620448, 9) == pytest.approx(0.05, abs=1e-10)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-9)
    assert special.kolmogorov_sf(0.5) == pytest.approx(0.9639452436648751, abs=1e-9)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_rank_tests_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", 2.0), (None, 9.0), ("a", None)], "g string, v double")
    # ranks: 1, 3, 3, 5, 6, 3; sums 7 and 14; ties of three
    assert stats.kruskal(df, "g", "v").first()["h"] == pytest.approx((12 / 42 * (49 / 3 + 196 / 3) - 21) / (1 - 24 / 210))
    assert stats.ks_pairwise(df, "g", "v").first()["d"] == pytest.approx(2 / 3)
    c = stats.cliffs_delta(df, "g", "v", "a", "b").first()
    assert c["u"] == pytest.approx(1.0) and c["delta"] == pytest.approx(2 / 9 - 1)
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert stats.kruskal(same, "g", "v").first()["h"] is None
    assert stats.spearman(same.withColumn("w", F.rand(1)), "v", "w").first()["rho"] is None
    steps = [tuple(r) for r in stats.ccdf(df, "g", "v").orderBy("g", "v").collect()]
    assert steps[0] == ("a", 1.0, 100.0) and all(x[2] >= y[2] for x, y in zip(steps, steps[1:]) if x[0] == y[0])


def test_survival_curve_reaches_zero(spark):
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 0), ("g", 3.0, 1)], "g string, t double, e int")
    got = [(r["t"], r["at_risk"], r["survival"]) for r in stats.kaplan_meier(df, "g", "t", "e").orderBy("t").collect()]
    assert got[0] == (1.0, 3, pytest.approx(2 / 3)) and got[1][2] == pytest.approx(2 / 3) and got[2] == (3.0, 1, 0.0)


def test_cox_by_hand(spark):
    # three distinct events; the score equation of the partial likelihood is solved by bisection
    data = [(1.0, 1, 1.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 0, 0.0)]
    score = lambda b: sum(x - sum(z * math.exp(b * z) for t2, _, z in data if t2 >= t) / sum(math.exp(b * z) for t2, _, z in data if t2 >= t) for t, e, x in data if e)
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    beta, ratio, p = stats.cox_one(spark.createDataFrame(data, "t double, e int, x double"), "t", "e", "x")
    assert beta == pytest.approx(lo, abs=1e-7) and ratio == pytest.approx(math.exp(lo)) and 0 < p < 1
    # tied events by Efron's weights: two of two at once, one covariate each
    tied = [(1.0, 1, 1.0), (1.0, 1, 0.0), (2.0, 0, 1.0)]
    a = lambda b: (math.exp(b) * 2 + 1, math.exp(b) * 2)
    d = lambda b: (math.exp(b) + 1, math.exp(b))
    score = lambda b: 1 - sum((a(b)[1] - j / 2 * d(b)[1]) / (a(b)[0] - j / 2 * d(b)[0]) for j in (0, 1))
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    assert stats.cox_one(spark.createDataFrame(tied, "t double, e int, x double"), "t", "e", "x")[0] == pytest.approx(lo, abs=1e-6)
    assert stats.cox_one(spark.createDataFrame([(1.0, 0, 1.0)], "t double, e int, x double"), "t", "e", "x") == (0.0, 1.0, 1.0)


def test_bodies(spark):
    cases = {
        "a ![gif](giphy|abc123|x) b": "a https://i.giphy.com/abc123.gif b",
        "![img](emote|t5_x|852)": "[Reddit Emote]",
        "![img](mvv0yl8plgnf1)": "https://i.redd.it/mvv0yl8plgnf1.jpeg",
        "![gif](mvv0yl8plgnf1)": "https://i.redd.it/mvv0yl8plgnf1.gif",
        "(https://preview.redd.it/x-1.png?width=640&s=64)": "(https://i.redd.it/x-1.png)",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "body string").coalesce(1)
    assert [r[0] for r in df.select(rewrite.rewrite_markup(F.col("body"))).collect()] == [*cases.values(), None]
    posts = spark.createDataFrame([(1, "see https://a.b/x.jpg and https://a.b/x.jpg, https://youtu.be/q1 "), (2, " none "), (3, None)], "id int, body string")
    lookup = spark.createDataFrame([("https://a.b/x.jpg", "a cat")], "link string, text string")
    media = rewrite.replace_links(posts, rewrite.media_links(F.col("body")), lookup, "[CONTEUDO VISUAL: %s]", rewrite.MEDIA_FALLBACK)
    both = rewrite.replace_links(media, rewrite.video_links(F.col("body")), lookup, "[VIDEO: %s]", rewrite.VIDEO_FALLBACK)
    got = {r["id"]: r["body"] for r in both.collect()}
    assert got == {1: f"see [CONTEUDO VISUAL: a cat] and [CONTEUDO VISUAL: a cat], [VIDEO: {rewrite.VIDEO_FALLBACK}]", 2: " none ", 3: None}
    loops = spark.createDataFrame([("abcabcabcabc x",), ("fine text",)], "d string").select(rewrite.guard_loop(F.col("d")))
    assert [r[0] for r in loops.collect()] == [rewrite.LOOP_FALLBACK, "fine text"]


def test_labels(spark):
    docs = ['{"ai_analysis":{"label":"NEGATIVE"}}', '{"sentiment":"pos"}', '{"qwen_sentiment":{"label":"x"}}', '{"ai_analysis":null}', "{}"]
    got = spark.createDataFrame([(d,) for d in docs], "d string").coalesce(1).select(labels.label_from_variant(F.parse_json("d"))).collect()
    assert [r[0] for r in got] == ["NEGATIVE", "pos", "x", None, None]
    rows = [("comment", None, "[removed]", False), ("comment", None, "[AutoModerator]", True), ("comment", None, "", True), ("post_header", "t", None, None), ("comment", None, "que legal", True), ("comment", None, "x", False)]
    m = spark.createDataFrame(rows, "type string, title string, body string, is_valid_text boolean")
    out = {(r["title"], r["body"]): r["ai_analysis"]["label"] for r in labels.label_messages(m, labels.WordScorer()).collect()}
    assert out == {
        (None, "[removed]"): "REMOVED_BY_MOD",
        (None, "[AutoModerator]"): "AUTOMOD_WARNING",
        (None, ""): "BYPASS_EMPTY",
        ("t", None): "NEUTRAL",
        (None, "que legal"): "POSITIVE",
        (None, "x"): "BYPASS_EMPTY",
    }

    def broken(texts: pd.Series) -> pd.DataFrame:
        raise ValueError

    assert {r["score"]["label"] for r in labels.score(m, "body", broken).collect()} == {"ERROR"}


def test_lexicon_precedence(spark):
    text = "﻿1\tanger\n2\tpower\n%\nking*\t2\nkin*\t1\nkingdom\t2\nhate\t1\t2\nk\t2\n"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")
    categories, terms = textops.parse_lexicon(lines)
    lexicon = terms.join(categories, "category_id")
    words = spark.createDataFrame([(w,) for w in ("kingdom", "kin", "hate", "k", "none", "king")], "token string")
    got = sorted((r["token"], r["category"]) for r in textops.match_lexicon(words, lexicon).collect())
    assert got == [("hate", "anger"), ("hate", "power"), ("k", "power"), ("kin", "anger"), ("king", "anger"), ("kingdom", "anger")]
    docs = spark.createDataFrame([(1, "hate hate x y"), (2, None), (3, "")], "id int, text string")
    rates = {r["id"]: (r["anger"], r["power"]) for r in textops.lexicon_rates(docs, "id", "text", lexicon, ["anger", "power"]).collect()}
    assert rates == {1: (50.0, 50.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_anonymisation(spark):
    m = spark.createDataFrame([("1", "ana", "x"), ("2", "ana", "y"), ("3", "[deleted]", "z"), ("4", None, "w")], "id string, author string, body string")
    done = quality.anonymize(m, "salt")
    assert all(r["passed"] for r in quality.validate_anonymization(m, done).collect())
    authors = [r["author"] for r in done.orderBy("id").collect()]
    assert authors[0] == authors[1] and len(authors[0]) == 64 and authors[2:] == ["[deleted]", None]
    assert not all(r["passed"] for r in quality.validate_anonymization(m, done.withColumn("body", F.lit("x"))).collect())
    # two equal rows replaced by two other equal rows
    pairs = spark.createDataFrame([("1", "ana", "x"), ("1", "ana", "x"), ("2", "rui", "y")], "id string, author string, body string")
    damaged = spark.createDataFrame([("1", "ana", "z"), ("1", "ana", "z"), ("2", "rui", "y")], "id string, author string, body string")
    told = {r["check"]: (r["passed"], r["detail"]) for r in quality.validate_anonymization(pairs, quality.anonymize(damaged, "salt")).collect()}
    assert not told["other fields"][0] and told["field match"] == (False, "1 of 3") and told["row count"][0] and told["ids"][0]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type":"comment","id":"t1_a","timestamp":5,"ai_analysis":null}\nnot json\n{"type":"metadata_footer","total_records":2}\n{"type":"comment","body":"no id"}\n')
    (tmp_path / "in" / "b.json").write_text('[{"type":"comment","id":"b"},{"type":"comment","id":"t1_a"}]')
    assert {r["id"] for r in files.read_mixed(spark, str(tmp_path / "in")).collect()} == {"t1_a", "b"}
    (tmp_path / "in" / "d.json").write_text(json.dumps({"type": "comment", "id": "pretty", "body": "a\n{b"}, indent=2))
    (tmp_path / "in" / "e.json").write_text(json.dumps([{"type": "comment", "id": "p1"}, {"type": "comment", "id": "p2"}], indent=1))
    (tmp_path / "in" / "f.json").write_text('{"type":"comment","id":"one"}')
    (tmp_path / "in" / "g.json").write_text("")
    assert sorted(r["id"] for r in files.read_mixed(spark, str(tmp_path / "in")).collect()) == ["b", "one", "p1", "p2", "pretty", "t1_a", "t1_a"]
    assert {r["doc"].count("\n") for r in files.read_raw_posts(spark, str(tmp_path / "in")).where("path like '%d.json'").collect()} == {4}
    (tmp_path / "words.dic").write_text("%\n1\tanger\n%\nhate\t1\n")
    assert sorted(r["n"] for r in files.read_lexicon(spark, str(tmp_path / "words.dic")).collect()) == [0, 1, 2, 3, 4]
    for name in "bdefg":
        (tmp_path / "in" / f"{name}.json").unlink()
    assert [r["id"] for r in files.read_jsonl(spark, str(tmp_path / "in")).collect()] == ["t1_a"]
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    resume.process_new(spark, *where)
    (tmp_path / "in" / "c.jsonl").write_text('{"type":"comment","id":"t1_a","timestamp":5}\n{"type":"comment","id":"c","timestamp":6}\n')
    resume.process_new(spark, *where)
    resume.process_new(spark, *where)
    assert sorted(r["id"] for r in spark.read.schema("id string").json(where[1]).collect()) == ["c", "t1_a"]
    one = files.cached_table(spark, f"file://{tmp_path}/cache", lambda: spark.range(3).toDF("a"))
    again = files.cached_table(spark, f"file://{tmp_path}/cache", lambda: 1 / 0)
    assert one.count() == again.count() == 3
    wider = files.cached_table(spark, f"file://{tmp_path}/cache", lambda: spark.range(3).selectExpr("id a", "id b"), needs=("b",))
    assert wider.columns == ["a", "b"]
    assert files.cached_table(spark, f"file://{tmp_path}/cache", lambda: 1 / 0, needs=("b",)).columns == ["a", "b"]


def test_stream_keeps_late_and_timeless_rows(spark, tmp_path):
    now, months = 1.7e9, 200 * 86400
    calls = [
        [("a", now), ("none", None), ("zero", 0), ("old", now - months), ("none", None)],
        [("new none", None), ("new zero", 0), ("late", now - months), ("none", None), ("zero", 0), ("old", now + months), ("a", now)],
    ]
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    (tmp_path / "in").mkdir()
    seen = []
    for i, rows in enumerate(calls):
        (tmp_path / "in" / f"{i}.jsonl").write_text("".join(json.dumps({"type": "comment", "id": k, "timestamp": t}) + "\n" for k, t in rows))
        resume.process_new(spark, *where)
        seen.append(sorted(r["id"] for r in spark.read.schema("id string").json(where[1]).collect()))
    assert seen == [["a", "none", "old", "zero"], ["a", "late", "new none", "new zero", "none", "old", "zero"]]


def test_stays_and_churn(spark):
    rows = [(i, f"u{i % 3}", "t", float(i // 2), "NEGATIVE" if i % 4 == 0 else "NEUTRAL") for i in range(12)] + [(99, "AutoModerator", "t", 3.0, "NEGATIVE"), (98, None, "t", 3.0, "NEGATIVE"), (97, "u0", "t", None, "NEGATIVE")]
    m = spark.createDataFrame(rows, "id long, author string, thread string, timestamp double, label string")
    got = {r["author"]: (r["duration"], r["event"]) for r in social.stays(m).collect()}
    assert got == {"u0": (10, 0), "u1": (10, 0), "u2": (10, 0)}
    assert social.churn(m, least=4).count() == 3 and social.churn(m.limit(0)).count() == 0


def test_media(spark, tmp_path):
    from ramagem.operators import media

    for name in ("a.png", "a.jpg", "b.gif", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.media_files(spark, str(tmp_path))
    assert {r["stem"]: r["path"].rsplit("/", 1)[1] for r in found.collect()} == {"a": "a.jpg", "b": "b.gif"}

    def describer(content: bytes, extension: str) -> str:
        if content == b"bad":
            raise OSError
        return "abcabcabcabcabc" if content == b"loop" else f"{extension} of {len(content)}"

    links = spark.createDataFrame([("x/1.PNG?s=1", b"1234"), ("x/2.gif", b"bad"), ("x/3.gif", None), ("x/4.gif", b"loop")], "link string, content binary")
    got = {r["link"]: r["text"] for r in media.describe(links, describer).collect()}
    assert got == {"x/1.PNG?s=1": "png of 4", "x/2.gif": rewrite.MEDIA_FALLBACK, "x/3.gif": rewrite.MEDIA_FALLBACK, "x/4.gif": rewrite.LOOP_FALLBACK}
    told = found.select("path", F.lit("t").alias("text")).limit(1)
    rows = media.enrich(spark.createDataFrame([("a",), ("z",)], "id string"), found, told).collect()
    assert {r["id"]: r["has_media"] for r in rows} == {"a": True, "z": False}


def test_pipeline_state(spark, tmp_path):
    from ramagem.sources.state import PipelineState

    state = PipelineState(spark, f"file://{tmp_path}/state.json")
    assert state.phase("s") == 0
    state.finish("s", 2, flat="x")
    state.finish("s", 1)
    assert PipelineState(spark, f"file://{tmp_path}/state.json").phase("s") == 2 and state.todo(["s", "t"], 2) == ["t"]
    with pytest.raises(ValueError):
        state.finish("s", 9)


def paths_of(parent):
    """(cascade_id, id, path) rows of a forest given as id -> parent id."""

    def up(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out[::-1]

    return [(up(i)[0], i, up(i)) for i in parent]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_subtree_sizes_and_runs_on_any_shape(spark, shape):
    rng = random.Random(7)
    parent = {0: None} | {i: i - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(max(0, i - 4), i) for i in range(1, 150)}
    rows = paths_of(parent)
    sizes = {i: sum(i in p for *_, p in rows) for i in parent}
    bad = {i: rng.random() < (0.9 if shape == "chain" else 0.6) for i in parent}
    nodes = spark.createDataFrame([(c, i, p, "NEGATIVE" if bad[i] else rng.choice(["NEUTRAL", None])) for c, i, p in rows], "cascade_id long, id long, path array<long>, label string")
    assert {r["id"]: r["s"] for r in forest.subtree_sizes(nodes).collect()} == sizes

    def run(path):
        n = 0
        for i in path[::-1]:
            if not bad[i]:
                break
            n += 1
        return n

    got = forest.longest_negative_run(nodes).first()
    assert got["longest_neg_run"] == max(run(p) for *_, p in rows)
    assert got["longest_neg_run_ratio"] == pytest.approx(got["longest_neg_run"] / sum(bad.values()))
    assert forest.subtree_sizes(nodes.limit(0)).count() == 0 and forest.longest_negative_run(nodes.limit(0)).count() == 0


def test_motifs_of_a_star_and_a_clique(spark):
    star = [("s", f"u{i:05d}", "hub") for i in range(3000)]
    clique = [("k", f"v{a}", f"v{b}") for a in range(6) for b in range(6) if a != b]
    got = {r["cascade_id"]: r for r in motifs.motif_counts(spark.createDataFrame(star + clique, "cascade_id string, source string, target string")).collect()}
    assert (got["s"]["dyad"], got["s"]["fan_in"], got["s"]["total_motifs"]) == (3000, 3000 * 2999 // 2, 3000 + 3000 * 2999 / 2)
    assert (got["k"]["mutual_dyad"], got["k"]["recip_triangle"], got["k"]["total_motifs"]) == (15, 20, 35)
    assert motifs.motif_counts(spark.createDataFrame([], "cascade_id string, source string, target string")).count() == 0


def test_running_sums_and_quantiles(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), rng.choice([-1.5, 0.0, 2.0, float(rng.randrange(50))]), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame([(g, v, n, i) for i, (g, v, n) in enumerate(data)], "g string, v double, n long, i long")
    for falling in (False, True):
        for r in stats.running(df, ["g"], ["v", "i"], {"upto": F.col("n")}, falling).collect():
            place = lambda v, i: (-v, -i) if falling else (v, i)
            assert r["upto"] == sum(n for i, (g, v, n) in enumerate(data) if g == r["g"] and place(v, i) <= place(r["v"], r["i"]))
    got = {r["g"]: r for r in stats.quantiles(df, "g", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for g in "ab":
        values = np.array([v for h, v, _ in data if h == g])
        assert [got[g][k] for k in ("low", "mid", "top")] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 1.0])))
    assert stats.quantiles(df.limit(0), None, "v", {"mid": 0.5}).count() == 0
    plan = stats.running(df, [], ["v"], {"upto": F.col("n")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # one row a range only


def test_report_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5, None), ("c", None, 2)], "name string, x double, n int")
    files.write_report(spark, f"file://{tmp_path}/r.txt", {"Things": df, "Nothing": df.limit(0)})
    text = (tmp_path / "r.txt").read_text().splitlines()
    assert text[1] == "Things" and text[3].split() == ["name", "x", "n"] and text[4].split() == ["a_b", "1.5"] and text[5].split() == ["c", "2"]
    latex = files.report_text({"Share in %": df}, "latex")
    assert r"\caption{Share in \%}" in latex and r"a\_b & 1.5 &  \\" in latex and r"\begin{tabular}{lll}" in latex
    with pytest.raises(ValueError):
        files.report_text({"Things": df}, most=1)
    files.write_csv(spark.createDataFrame([('say "a, b"', None)], "t string, u string"), f"file://{tmp_path}/csv")
    assert pd.read_csv(next((tmp_path / "csv").glob("*.csv"))).t.tolist() == ['say "a, b"']


def test_shared_tables_follow_the_folder(spark, tmp_path):
    where, build = f"file://{tmp_path}", lambda: spark.read.parquet(f"file://{tmp_path}/t.parquet")
    spark.range(3).write.parquet(f"{where}/t.parquet")
    assert cascades.held(spark, where, "x", build).count() == 3
    spark.range(5).write.mode("append").parquet(f"{where}/t.parquet")
    assert cascades.held(spark, where, "x", build).count() == 8
    assert cascades.held(spark, where, "x", lambda: 1 / 0).count() == 8
