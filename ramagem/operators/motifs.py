"""Dyads and induced triads of the interaction graph of each cascade, and sentiment triads along reply chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The named label triples (grandparent, parent, child).
NAMED_TRIADS = (
    ("NEGATIVE", "NEGATIVE", "NEGATIVE", "Negative Persistence"),
    ("POSITIVE", "POSITIVE", "POSITIVE", "Positive Persistence"),
    ("POSITIVE", "NEGATIVE", "NEGATIVE", "Negative Convergence (from pos)"),
    ("NEUTRAL", "NEGATIVE", "NEGATIVE", "Negative Convergence (from neu)"),
    ("NEGATIVE", "POSITIVE", "POSITIVE", "Positive Convergence (from neg)"),
    ("NEUTRAL", "POSITIVE", "POSITIVE", "Positive Convergence (from neu)"),
    ("POSITIVE", "POSITIVE", "NEGATIVE", "Shift (to neg)"),
    ("NEGATIVE", "NEGATIVE", "POSITIVE", "Shift (to pos)"),
    ("POSITIVE", "NEGATIVE", "POSITIVE", "Oscillation (a)"),
    ("NEGATIVE", "POSITIVE", "NEGATIVE", "Oscillation (b)"),
    ("POSITIVE", "NEUTRAL", "NEGATIVE", "Mixed Transition (to neg)"),
    ("NEGATIVE", "NEUTRAL", "POSITIVE", "Mixed Transition (to pos)"),
)
KINDS = ("dyad", "mutual_dyad", "chain", "fan_in", "fan_out", "triangle", "recip_triangle")


def motif_counts(edges: DataFrame) -> DataFrame:
    """Counts per cascade from distinct edges (cascade_id, source, target), source and target distinct and not null.

    Triads are induced: chain, fan-in and fan-out need the outer two unconnected; triangle is three one-way edges that do
    not run in a circle, recip_triangle three mutual pairs. Two edges at one user are counted by the user's degrees, never
    listed; those that are closed by a third are found from the triangles, which are listed from their user of least
    degree, so that a user with very many edges brings up no pairs of them.
    """
    ahead = F.col("source") < F.col("target")
    pairs = edges.groupBy("cascade_id", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(
        F.max(ahead.cast("int")).alias("xy"), F.max((~ahead).cast("int")).alias("yx")
    )  # one row a pair of users; xy and yx tell the directions
    one_way = F.col("xy") + F.col("yx") == 1
    ends = pairs.select(
        "cascade_id",
        F.explode(
            F.array(
                F.struct(F.col("x").alias("user"), (one_way & (F.col("xy") == 1)).cast("long").alias("o"), (one_way & (F.col("yx") == 1)).cast("long").alias("i")),
                F.struct(F.col("y").alias("user"), (one_way & (F.col("yx") == 1)).cast("long").alias("o"), (one_way & (F.col("xy") == 1)).cast("long").alias("i")),
            )
        ).alias("e"),
    )
    users = ends.groupBy("cascade_id", "e.user").agg(F.count(F.lit(1)).alias("degree"), F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    i, o = F.col("i"), F.col("o")
    wedges = users.groupBy("cascade_id").agg(
        F.sum(i * o).alias("chain"), F.sum((i * (i - 1) / 2).cast("long")).alias("fan_in"), F.sum((o * (o - 1) / 2).cast("long")).alias("fan_out"), F.sum(i).alias("dyad"),
        ((F.sum("degree") - F.sum(i) - F.sum(o)) / 2).cast("long").alias("mutual_dyad"),
    )
    closed = _triangles(pairs, users)
    joined = wedges.join(closed, "cascade_id", "left").na.fill(0)
    counts = {
        "dyad": F.col("dyad"), "mutual_dyad": F.col("mutual_dyad"), "chain": F.col("chain") - F.col("c_chain"), "fan_in": F.col("fan_in") - F.col("c_fan_in"), "fan_out": F.col("fan_out") - F.col("c_fan_out"),
        "triangle": F.col("triangle"), "recip_triangle": F.col("recip_triangle"),
    }
    counted = joined.select("cascade_id", *[c.alias(k) for k, c in counts.items()])
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return counted.withColumn("total_motifs", total.cast("double")).withColumn("mutual_dyad", F.col("mutual_dyad").cast("double"))


def _triangles(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """(cascade_id, triangle, recip_triangle, c_chain, c_fan_in, c_fan_out): triangles, and the pairs of one-way edges they close."""
    able = users.where("degree > 1").select("cascade_id", "user", "degree")
    end = lambda side: able.select("cascade_id", F.col("user").alias(side), F.struct("degree", "user").alias(f"r{side}"))
    ranked = pairs.join(end("x"), ["cascade_id", "x"]).join(end("y"), ["cascade_id", "y"])
    up = F.col("rx") < F.col("ry")
    # from the end of lower degree (ties by name) to the other; fw and bw tell the directions from there
    led = ranked.select(
        "cascade_id", F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b"), F.greatest("rx", "ry").alias("rb"),
        F.when(up, F.col("xy")).otherwise(F.col("yx")).alias("fw"), F.when(up, F.col("yx")).otherwise(F.col("xy")).alias("bw"),
    )
    named = lambda names: [F.col(c).alias(n) for c, n in zip(("a", "b", "rb", "fw", "bw"), names)]
    first = led.select("cascade_id", *named(("a", "b", "rb", "ab", "ba")))
    second = led.select("cascade_id", *named(("a", "c", "rc", "ac", "ca")))
    third = led.select("cascade_id", *[F.col(c).alias(n) for c, n in (("a", "b"), ("b", "c"), ("fw", "bc"), ("bw", "cb"))])
    found = first.join(second, ["cascade_id", "a"]).where("rb < rc").join(third, ["cascade_id", "b", "c"])
    single = {"ab": "ab + ba = 1", "ac": "ac + ca = 1", "bc": "bc + cb = 1"}
    hubs = (("ab", "ac", "ab + ac"), ("ab", "bc", "ba + bc"), ("ac", "bc", "ca + cb"))  # both edges of a hub, and how many lead out
    closing = lambda out: sum((F.expr(f"sum(int({single[e]} and {single[f]} and {n} = {out}))") for e, f, n in hubs[1:]), F.expr(f"sum(int({single[hubs[0][0]]} and {single[hubs[0][1]]} and {hubs[0][2]} = {out}))"))
    every = " and ".join(single.values())
    circle = " and ".join(f"{n} = 1" for *_, n in hubs)
    return found.groupBy("cascade_id").agg(
        F.expr(f"sum(int({every} and not ({circle})))").alias("triangle"), F.expr("sum(int(ab + ba + ac + ca + bc + cb = 6))").alias("recip_triangle"),
        closing(1).alias("c_chain"), closing(0).alias("c_fan_in"), closing(2).alias("c_fan_out"),
    )


def code_of(label: str) -> str:
    """One letter: P, U (neutral) or N."""
    return "U" if label == "NEUTRAL" else label[0]


def sentiment_triads(nodes: DataFrame, by: str = "category") -> DataFrame:
    """(by, triad, n): label triples (grandparent, parent, child) inside cascades, valid labels only."""
    code = F.when(F.col("label") == "POSITIVE", "P").when(F.col("label") == "NEUTRAL", "U").when(F.col("label") == "NEGATIVE", "N")
    coded = nodes.select("id", "parent_id", "dist", by, code.alias("code"))
    parent = coded.select(F.col("id").alias("parent_id"), F.col("code").alias("p_code"), F.col("parent_id").alias("g_id"))
    grand = coded.select(F.col("id").alias("g_id"), F.col("code").alias("g_code"))
    triples = coded.where("dist >= 2").join(parent, "parent_id").join(grand, "g_id").where("code is not null and p_code is not null and g_code is not null")
    return triples.groupBy(by, F.concat("g_code", "p_code", "code").alias("triad")).agg(F.count(F.lit(1)).alias("n"))
