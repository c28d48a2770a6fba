"""Problems 1 to 5 on small fixtures: brute force, nulls, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ramagem.operators import balance, compact, features, hierarchy, nested
from ramagem.sources import shared
from ramagem.sources.tables import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1 ---------------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_packing_is_even(loads, bins):
    place = balance.pack_longest_first(loads, bins)
    sums = [sum(n for n, p in zip(loads, place) if p == b) for b in range(bins)]
    assert max(sums) <= sum(loads) / bins + max(loads)


def test_totals_with_a_hot_key_nulls_and_matches(spark):
    data = [("hot", 1)] * 500 + [(f"k{i % 40}", i) for i in range(300)] + [(None, 7)] * 60
    df = spark.createDataFrame(data, "key string, x long").withColumn("__extra", F.lit(1)).repartition(3)
    matches = spark.createDataFrame([("hot", 10), ("k1", 20), ("unused", 5), (None, 1)], "key string, m long")
    partial = [F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.max("m").alias("m")]
    merge = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m")]
    out, plan = balance.fragment_replicate_totals(df, "key", matches, partial, merge, tasks=4)
    want = {}
    for k, x in data:
        n, s, m = want.get(k, (0, 0, {"hot": 10, "k1": 20}.get(k)))
        want[k] = (n + 1, s + x, m)
    assert {r["key"]: (r["n"], r["s"], r["m"]) for r in out.collect()} == want
    assert len(set(plan.heavy["hot"])) > 1
    assert max(plan.task_load) <= 1.5 * sum(plan.task_load) / 4


def test_totals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key string, x long")
    out, plan = balance.fragment_replicate_totals(df, "key", None, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], tasks=3)
    assert out.collect() == [] and plan.heavy == {}


# 2 ---------------------------------------------------------------------------------------------------------------

EVENT = "message string, entity string, type string, ts double, score long, arrived long"


def brute_features(events, start=None, end=None):
    last = {}
    plain = []
    for e in events:
        if e[0] is None:
            plain.append(e)
        elif e[0] not in last or (e[5], e[4] if e[4] is not None else -(2**62), e[2] or "") > (last[e[0]][5], last[e[0]][4] if last[e[0]][4] is not None else -(2**62), last[e[0]][2] or ""):
            last[e[0]] = e
    out = {}
    for _, entity, kind, ts, score, _ in [*last.values(), *plain]:
        if (start is not None or end is not None) and (ts is None or start is not None and ts < start or end is not None and ts >= end):
            continue
        n, total, when = out.get((entity, kind), (0, None, None))
        out[entity, kind] = (n + 1, total if score is None else (total or 0) + score, max((x for x in (when, ts) if x is not None), default=None))
    return out


def test_features_follow_changes_and_cut_buckets(spark, tmp_path):
    rng = random.Random(4)
    make = lambda i: (None if i % 50 == 0 else f"m{i % 180}", rng.choice(["a", "b", None]), rng.choice(["x|POS", "y|NEG", None]), (i % 180) * 10.0 if i % 7 else None, rng.choice([None, 1, 5]), i)
    events = [make(i) for i in range(200)]
    fixed = {}
    events = [(m, *fixed.setdefault(m, (e, k, t)), s, a) if m else (m, e, k, t, s, a) for m, e, k, t, s, a in events]
    store = features.BucketStore(spark, f"file://{tmp_path}/store", width=300)
    source = spark.createDataFrame(events, EVENT).withColumn("bucket", F.lit("clash"))
    first = store.refresh(source)
    assert first.kept == [] and len(first.recomputed) > 3
    got = {(r["entity"], r["type"]): (r["n"], r["total"], r["last_ts"]) for r in store.by_type().collect()}
    assert got == brute_features(events)
    assert store.refresh(source).recomputed == []
    more = [*events, ("late", "a", "x|POS", 455.0, 9, 999)]
    again = store.refresh(spark.createDataFrame(more, EVENT))
    assert again.recomputed == [1]
    window = store.by_type(spark.createDataFrame(more, EVENT), 123.0, 1500.0)
    assert {(r["entity"], r["type"]): (r["n"], r["total"], r["last_ts"]) for r in window.collect()} == brute_features(more, 123.0, 1500.0)
    wide = store.features().collect()
    assert len(wide) == len({e[1] for e in more}) and all([f["type"] or "" for f in r["features"]] == sorted(f["type"] or "" for f in r["features"]) for r in wide)


def test_a_message_delivered_again_in_another_bucket_counts_once(spark, tmp_path):
    store = features.BucketStore(spark, f"file://{tmp_path}/moved", width=300)
    fill = [(f"f{i}", "b", "x|POS", i * 300.0 + 1, 1, i) for i in range(6)]
    steps = [
        [*fill, ("m", "a", "x|POS", 10.0, 3, 50)],
        [*fill, ("m", "a", "x|POS", 10.0, 3, 50), ("m", "a", "x|POS", 1000.0, 6, 60)],  # moves to a later bucket
        [*fill, ("m", "a", "x|POS", 10.0, 3, 50), ("m", "a", "x|POS", 1000.0, 6, 60), ("m", "a", "x|POS", None, 7, 70)],  # to the one without time
        [*fill, ("m", "a", "x|POS", 10.0, 3, 50)],  # and back
    ]
    recomputed = []
    for events in steps:
        source = spark.createDataFrame(events, EVENT)
        recomputed.append(store.refresh(source).recomputed)
        whole = {(r["entity"], r["type"]): (r["n"], r["total"], r["last_ts"]) for r in store.by_type().collect()}
        assert whole == brute_features(events)
        window = {(r["entity"], r["type"]): (r["n"], r["total"], r["last_ts"]) for r in store.by_type(source, 5.0, 1400.0).collect()}
        assert window == brute_features(events, 5.0, 1400.0)
    assert recomputed[1] == [0, 3] and len(recomputed[0]) == 6
    assert store.refresh(spark.createDataFrame(steps[-1], EVENT)).recomputed == []


def test_features_of_nothing(spark, tmp_path):
    store = features.BucketStore(spark, f"file://{tmp_path}/none")
    store.refresh(spark.createDataFrame([], EVENT))
    assert store.features().collect() == []


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_links(comments, posts):
    parent = {}
    for i, p, *_ in comments:
        if i is not None and (i not in parent or p is not None and (parent[i] is None or p < parent[i])):
            parent[i] = p
    out = {}
    for i in parent:
        seen, at = [i], parent[i]
        while True:
            if at is None:
                out[i] = ("null", seen[-1], len(seen) - 1, False)
            elif at in posts:
                out[i] = ("post", at, len(seen), False)
            elif at not in parent:
                out[i] = ("missing", seen[-1], len(seen) - 1, False)
            elif at in seen:
                out[i] = ("cycle", None, None, at == i)
            else:
                seen.append(at)
                at = parent[at]
                continue
            break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_against_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 150
    comments = []
    for i in range(n):
        p = rng.choice(["p1", "p2", None, "gone", *(f"c{rng.randrange(n)}" for _ in range(12)), f"c{max(0, i - 1)}"])
        comments.append((f"c{i}", p, "p1", rng.choice([None, 1, 2])))
    comments += [(f"d{i}", f"d{i - 1}" if i else "p1", "p1", i + 1) for i in range(70)]  # a long chain
    comments += [(f"e{i}", f"e{(i + 1) % 5}", "p1", 1) for i in range(5)] + [("tail", "e0", "p1", 1), ("self", "self", "p1", 1)]
    comments += comments[:5] + [(None, "p1", "p1", 1)]
    df = spark.createDataFrame(comments, "id string, parent_id string, post_id string, depth int").withColumn("up", F.lit("clash"))
    posts = spark.createDataFrame([("p1",), ("p2",), ("p1",), (None,)], "id string")
    nodes = hierarchy.link_nodes(df, posts)
    solved = hierarchy.solve_links(nodes, paths=True).collect()
    want = brute_links(comments, {"p1", "p2"})
    assert {r["id"]: (r["root_kind"], r["root"], r["n_links"], r["on_cycle"]) for r in solved} == want
    parents = {c[0]: c[1] for c in comments if c[0]}
    for r in solved:
        if r["root_kind"] == "cycle":
            assert r["path"] is None
        else:
            assert r["path"][-1] == r["id"] and all(parents[b] == a for a, b in zip(r["path"], r["path"][1:]))
    plain = hierarchy.solve_links(nodes)
    assert {r["id"]: (r["root_kind"], r["root"], r["n_links"], r["on_cycle"]) for r in plain.collect()} == want


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], "id string, parent_id string, post_id string, depth int")
    assert hierarchy.solve_links(hierarchy.link_nodes(none, spark.createDataFrame([], "id string"))).collect() == []


# 4 ---------------------------------------------------------------------------------------------------------------


def walk(text):
    try:
        two = json.loads(text)
    except (ValueError, TypeError):
        return None
    listing = lambda x: isinstance(x, dict) and x.get("kind") == "Listing" and isinstance(x.get("data"), dict)
    if not (isinstance(two, list) and len(two) == 2 and all(map(listing, two))):
        return None
    inside = lambda x: c if isinstance(x, dict) and isinstance(x.get("data"), dict) and isinstance(c := x["data"].get("children"), list) else []
    posts = [x for x in inside(two[0]) if isinstance(x, dict) and x.get("kind") == "t3"]
    post = (posts[0].get("data") or {}).get("id") if posts else None
    out, todo = [], [(x, post) for x in inside(two[1])]
    while todo:
        x, up = todo.pop()
        if isinstance(x, dict) and x.get("kind") == "t1":
            own = (x.get("data") or {}).get("id")
            if own:
                out.append((post, own, up))
            todo += [(y, own or up) for y in inside((x.get("data") or {}).get("replies"))]
    return sorted(out, key=str)


def indexed(texts):
    out = [None] * len(texts)
    for row, data, starts in nested._chunks(pa.array(texts, pa.string())):
        if len(data):
            posts = nested._Posts(data, starts)
            for d in range(len(starts) - 1):
                if posts.readable[d]:
                    out[row + d] = []
            for d, post, own, up in posts.links():
                if own is not None:
                    out[row + d].append((post, own, up))
    return [sorted(x, key=str) if x is not None else None for x in out]


def test_damaged_documents_against_a_parser(sf):
    import duckdb

    docs = [r[0] for r in duckdb.connect().execute(f"select doc from '{sf}/raw_post.parquet' where doc is not null").fetchall()]
    rng = random.Random(7)
    texts = [*docs, None, "", " ", "[]", "{}", "null", '"x"', "[1,2]", "[[],[]]"]
    for d in [d for d in docs if 0 < len(d) < 4000]:
        for _ in range(12):
            k, c = rng.randrange(len(d)), rng.choice('{}[]:,"\\ 0tn\n')
            texts.append(rng.choice([d[:k] + d[k + 1 :], d[:k] + c + d[k:], d[:k] + c + d[k + 1 :], d[:k]]))
        if walk(d) is not None:
            texts.append(json.dumps(json.loads(d), indent=2))
    assert indexed(texts) == [walk(t) for t in texts]


def test_objects_name_their_parents(spark):
    comment = lambda i, replies="", **more: {"kind": "t1", "data": {"id": i, "body": 'q "x" \\ é', "replies": replies, **more}}
    listing = lambda *c: {"kind": "Listing", "data": {"children": list(c)}}
    doc = json.dumps([listing({"kind": "t3", "data": {"id": "t3_p", "poll": {"options": [{"text": "a"}, {"text": "b"}]}}}), listing(comment("a", listing(comment("b"), {"kind": "more", "data": {"count": 2}}), awards=[{"n": 1}]), comment(None))])
    files = spark.createDataFrame([(1, doc, "x"), (2, None, "y"), (3, doc[:-3], "z")], "file_no long, doc string, obj string")
    got = {r["obj"]: r for r in nested.flat_objects(files).collect()}
    assert [(got[i]["kind"], got[i]["name"], got[i]["id"], got[i]["parent_id"], got[i]["depth"]) for i in sorted(got)] == [
        ("post", "children", "p", "p", 0),
        ("object", "poll", None, "p", 0),
        ("object", "options", None, "p", 0),
        ("object", "options", None, "p", 0),
        ("comment", "children", "a", "p", 1),
        ("comment", "children", "b", "a", 2),
        ("more", "children", None, "a", 1),
        ("object", "awards", None, "a", 1),
        ("comment", "children", None, "p", 1),
    ]
    assert got[5]["fields"]["body"] == 'q "x" \\ é' and got[3]["parent_obj"] == 2 and got[6]["parent_obj"] == 5


def test_links_to_more_comments_are_kept(spark):
    more = {"kind": "more", "data": {"count": 2, "id": "m", "children": ["x", "y"]}}
    post = {"kind": "t3", "data": {"id": "p"}}
    inner = {"kind": "Listing", "data": {"children": [{"kind": "more", "data": {"id": "n", "children": []}}]}}
    comments = [{"kind": "t1", "data": {"id": "a", "replies": inner}}, more]
    doc = json.dumps([{"kind": "Listing", "data": {"children": c}} for c in ([post], comments)])
    got = nested.flat_objects(spark.createDataFrame([(1, doc)], "file_no long, doc string")).collect()
    assert [(r["kind"], {k: json.loads(v) for k, v in r["lists"].items()}) for r in sorted(got, key=lambda r: r["obj"])] == [
        ("post", {}), ("comment", {}), ("more", {"children": []}), ("more", {"children": ["x", "y"]}),
    ]


def test_pruned_objects_are_those_of_the_whole(spark):
    files = table(spark, "/root/testdata/sf0.001", "raw_post")
    every = nested.flat_objects(files)
    names = ("author", "body", "score")
    want = every.where("kind = 'comment'").select("file_no", "obj", "parent_obj", "name", "place", "depth", "post_id", "id", "parent_id", F.map_filter("fields", lambda k, _: k.isin(*names)).alias("fields"))
    got = nested.flat_objects(files, ("comment",), names).select(want.columns)
    plain = lambda df: sorted(str((*r[:-1], sorted(r["fields"].items()))) for r in df.collect())
    assert plain(got) == plain(want)


# 5 ---------------------------------------------------------------------------------------------------------------

FILE = "file_no long, path string, subreddit string, post_id string, harvested_at timestamp_ntz, doc string"


def test_compaction_keeps_each_post_once(spark, tmp_path):
    good = json.dumps([{"kind": "Listing", "data": {"children": []}}] * 2)
    data = []
    for i in range(60):
        post = i % 40
        data.append((i, f"dump/{'Sub' if i % 3 else 'sub'}{post % 4}/{'t3_' if i % 2 else ''}x{post}.json{'.1' if i > 50 else ''}", None, None, None, good + " " * (i * 50) if i % 5 else "cut["))
    data += [(100, None, None, None, None, None), (101, "loose.json", "s", "p", None, ""), (102, "loose.json", "s", "p", None, "")]
    files = spark.createDataFrame(data, FILE).withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1)).select(*[c.strip().split(" ")[0] for c in FILE.split(",")])
    done = compact.compact(files, f"file://{tmp_path}/out", groups=4)
    back = compact.read_compacted(spark, f"file://{tmp_path}/out").collect()
    key = lambda p: tuple(p.lower().split("/")[1:2]) + (p.split("/")[-1].split(".json")[0].split("_")[-1],) if p and "/" in p else None
    held = Counter(key(r["path"]) for r in back if key(r["path"]))
    assert held == Counter({key(p) for _, p, *_ in data if key(p)}) and sum(key(r["path"]) is None for r in back) == 3
    texts = {n: d for n, _, _, _, _, d in data}
    assert all(texts[r["file_no"]] == r["doc"] for r in back)
    assert all(r["readable"] for r in back if any(texts[n].startswith("[") for n, p, *_ in data if key(p) == key(r["path"]) and key(p)))
    sizes = [g["size"] for g in done.manifest["groups"]]
    assert len(sizes) == 4 and max(sizes) <= 1.4 * sum(sizes) / 4
    pairs = rows(compact.same_post_pairs(done.index))
    assert pairs == sorted([(a, b) for a, pa_, *_ in data for b, pb, *_ in data if a < b and key(pa_) and key(pa_) == key(pb)], key=str)


def test_compaction_planned_in_shelves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compact, "SHELF_GROUPS", 2)
    monkeypatch.setattr(compact, "MOST_BROADCAST_ITEMS", 0)
    files = spark.createDataFrame([(i, f"d/s/x{i % 150}.json", "s", None, None, "y" * (100 + i % 7)) for i in range(200)], FILE)
    done = compact.compact(files, f"file://{tmp_path}/out", groups=7)
    back = compact.read_compacted(spark, f"file://{tmp_path}/out")
    assert back.count() == back.select("path").distinct().count() == 150 and 5 <= len(done.manifest["groups"]) <= 9
    assert done.index.count() == 200 and done.index.where("kept and group_no is null or not kept and group_no is not null").count() == 0


def test_compaction_of_nothing_and_of_damage(spark, tmp_path, monkeypatch):
    none = compact.compact(spark.createDataFrame([], FILE), f"file://{tmp_path}/none")
    assert none.manifest["rows"] == 0 and compact.read_compacted(spark, f"file://{tmp_path}/none").count() == 0
    files = spark.createDataFrame([(1, "a/b/c.json", None, None, None, "x")], FILE)
    monkeypatch.setattr(compact, "_mark", lambda prints: 1)  # as if a task had written something else
    with pytest.raises(compact.ManifestError):
        compact.compact(files, f"file://{tmp_path}/bad", groups=1)
    assert not shared.exists(spark, f"file://{tmp_path}/bad/manifest.json")
