"""Rank tests, distribution functions and regressions over (group, value) frames.

Raw rows are never ranked: they are reduced to distinct values with counts first, and cumulative counts over those give
average ranks and step functions. Null values are left out; groups without values do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramagem.functions import special
from ramagem.session import cut_lineage, shuffle_tasks, with_scalars


def running(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column], falling: bool = False) -> DataFrame:
    """df with running sums by group in the given order, own row included, without a task that holds a whole group.

    Rows are dealt to tasks by ranges of (group, order); sums run inside each range, and what the ranges before it add up
    to in the same group is put on top. Groups must not be null; `order` should tell rows of a group apart, else equal rows
    follow each other in any order. falling: from the largest down.
    """
    keys = [F.desc(c) if falling else F.asc(c) for c in order]
    dealt = df.repartitionByRange(shuffle_tasks(df.sparkSession), *groups, *keys).withColumns({"__range": F.spark_partition_id(), **{f"__{k}": c for k, c in sums.items()}})
    dealt = cut_lineage(dealt)  # the ranges are drawn from a sample and must not be drawn again
    inside = Window.partitionBy("__range", *groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums})
    # a row for each range and group in it; a group has no more of them than there are ranges
    parts = dealt.groupBy("__range", *groups).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("__range", *groups, *[F.sum(f"__{k}").over(earlier).alias(f"__b_{k}") for k in sums])
    joined = local.join(before, ["__range", *groups])
    return joined.select(*df.columns, *[(F.col(k) + F.coalesce(f"__b_{k}", F.lit(0))).alias(k) for k in sums])


def quantiles(df: DataFrame, group: str | None, value: str, points: dict[str, float]) -> DataFrame:
    """(g, one column per point): exact quantiles with linear interpolation, per group or (without) over all; nulls left out."""
    counts = value_counts(df.withColumn("__g", F.lit("") if group is None else F.col(group)), "__g", value)
    upto = running(counts, ["g"], ["v"], {"upto": F.col("n")})
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    placed = upto.join(totals, "g")
    picks = []
    for name, q in points.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        picks.append(F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias(f"__hi_{name}"))
    picked = placed.groupBy("g").agg(F.first("total").alias("total"), *picks)
    part = lambda q: (F.col("total") - 1) * F.lit(float(q)) - F.floor((F.col("total") - 1) * F.lit(float(q)))
    return picked.select("g", *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * part(q)).alias(n) for n, q in points.items()])


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v, n): how often each group has each value."""
    # negative zero is zero
    v = F.col(value).cast("double") + F.lit(0.0)
    return df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(counts: DataFrame) -> DataFrame:
    """(v, n, rank): of each distinct value over all groups, the number of rows and their average rank."""
    values = counts.groupBy("v").agg(F.sum("n").alias("n"))
    upto = running(values, [], ["v"], {"upto": F.col("n")})
    return upto.select("v", "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (h, n, groups): the tie-corrected Kruskal-Wallis statistic; null when all values are equal."""
    counts = value_counts(df, group, value)
    ranks = average_ranks(counts)
    by = counts.alias("c").join(ranks.alias("r"), F.col("c.v") == F.col("r.v")).groupBy("g").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("rank")).alias("rs"))
    total = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    fix = 1 - F.col("ties") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(fix, F.lit(0.0))
    return with_scalars(total, ties).select(h.alias("h"), "n", "groups")


def kruskal_p(h: float | None, groups: int) -> float | None:
    return None if h is None or groups < 2 else special.chi2_sf(h, groups - 1)


def step_functions(counts: DataFrame, g1: str, g2: str) -> DataFrame:
    """(v, f1, f2): the empirical distribution functions of two groups at every value of either."""
    two = counts.where(F.col("g").isin(g1, g2)).groupBy("v").agg(
        F.sum(F.when(F.col("g") == g1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("g") == g2, F.col("n")).otherwise(0)).alias("n2")
    )
    totals = two.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    upto = running(two, [], ["v"], {"u1": F.col("n1"), "u2": F.col("n2")})
    return with_scalars(upto, totals).select("v", (F.col("u1") / F.col("t1")).alias("f1"), (F.col("u2") / F.col("t2")).alias("f2"))


def ks_pairwise(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g1, g2, d, n1, n2) for every pair of groups, g1 < g2: the largest gap between their distribution functions."""
    counts = value_counts(df, group, value)
    groups = counts.groupBy("g").agg(F.sum("n").alias("total"))
    pairs = groups.alias("a").join(groups.alias("b"), F.col("a.g") < F.col("b.g")).select(
        F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), F.col("a.total").alias("n1"), F.col("b.total").alias("n2")
    )  # pairs of groups: a handful
    first = pairs.join(counts.withColumnRenamed("g", "g1"), "g1").select("g1", "g2", "n1", "n2", "v", F.col("n").alias("c1"), F.lit(0).cast("long").alias("c2"))
    second = pairs.join(counts.withColumnRenamed("g", "g2"), "g2").select("g1", "g2", "n1", "n2", "v", F.lit(0).cast("long").alias("c1"), F.col("n").alias("c2"))
    merged = first.unionByName(second).groupBy("g1", "g2", "n1", "n2", "v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    upto = running(merged, ["g1", "g2"], ["v"], {"u1": F.col("c1"), "u2": F.col("c2")})
    gaps = upto.select("g1", "g2", "n1", "n2", F.abs(F.col("u1") / F.col("n1") - F.col("u2") / F.col("n2")).alias("gap"))
    return gaps.groupBy("g1", "g2", "n1", "n2").agg(F.max("gap").alias("d"))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value."""
    return special.kolmogorov_sf(d * (n1 * n2 / (n1 + n2)) ** 0.5)


def cliffs_delta(df: DataFrame, group: str, value: str, g1: str, g2: str) -> DataFrame:
    """One row (u, delta): Mann-Whitney U of the first group and 2 U / (n1 n2) - 1."""
    counts = value_counts(df.where(F.col(group).isin(g1, g2)), group, value)
    ranks = average_ranks(counts)
    joined = counts.alias("c").join(ranks.alias("r"), F.col("c.v") == F.col("r.v"))
    n1, n2 = (F.sum(F.when(F.col("g") == g, F.col("c.n")).otherwise(0)).alias(name) for g, name in ((g1, "n1"), (g2, "n2")))
    rs = F.sum(F.when(F.col("g") == g1, F.col("c.n") * F.col("rank")).otherwise(0.0)).alias("rs")
    one = joined.agg(n1, n2, rs)
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    return one.select(u.alias("u"), (2 * u / F.nullif(F.col("n1") * F.col("n2"), F.lit(0)) - 1).alias("delta"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n): correlation of average ranks; null when a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    rx = average_ranks(counted.select(F.col("x").alias("v"), "n")).select(F.col("v").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(counted.select(F.col("y").alias("v"), "n")).select(F.col("v").alias("y"), F.col("rank").alias("ry"))
    n = F.col("n").cast("double")
    s = counted.join(rx, "x").join(ry, "y").agg(
        F.sum("n").alias("n"), *[F.sum(n * e).alias(k) for k, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")), ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))]
    )
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(vx * vy), F.lit(0.0))
    return s.select(rho.alias("rho"), "n")


def trendline(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Slope, intercept, R2 and n of y on x, per group or over all; null for a constant x. trend_p() adds the p-value."""
    keys = [by] if by else []
    r2 = F.regr_r2(y, x)
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"), F.regr_count(y, x).alias("n")
    )


def trend_p(trend: DataFrame) -> DataFrame:
    """The frame of trendline() with p: two-sided, of a slope of 0. One row a group, so it is worked out on the driver."""
    rows = trend.collect()  # one row a group
    told = [(*r, None if r["r2"] is None or r["n"] < 3 else special.correlation_p(max(0.0, min(1.0, r["r2"])) ** 0.5, r["n"])) for r in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trend.schema.fields)
    return trend.sparkSession.createDataFrame(told, f"{schema}, p double")


def ccdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v, share): percent of a group at or above each distinct value, the first point of each step."""
    counts = value_counts(df, group, value)
    upto = running(counts, ["g"], ["v"], {"upto": F.col("n")})
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    return upto.join(totals, "g").select("g", "v", ((1 - (F.col("upto") - F.col("n")) / F.col("total")) * 100).alias("share"))


def kaplan_meier(df: DataFrame, group: str, duration: str, event: str) -> DataFrame:
    """(g, t, at_risk, events, survival, lower, upper) at every distinct duration of each group, with 95 % bounds."""
    steps = df.groupBy(F.col(group).alias("g"), F.col(duration).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    risk = running(steps, ["g"], ["t"], {"at_risk": F.col("n")}, falling=True)
    left = 1 - F.col("events") / F.col("at_risk")
    # the product as a sum of logarithms; one step that leaves nobody makes it 0 from there on
    logs = F.when(left > 0, F.ln(F.when(left > 0, left).otherwise(1.0))).otherwise(0.0)
    # Greenwood's sum, for the interval
    spread = F.when(left > 0, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0)
    upto = running(risk, ["g"], ["t"], {"logs": logs, "gone": (left <= 0).cast("long"), "spread": spread})
    survival = F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("logs"))
    # interval on the log-minus-log scale, which stays between 0 and 1
    wide = F.lit(special.NORMAL_95) * F.sqrt("spread") / F.col("logs")
    inner = (F.col("gone") == 0) & (F.col("logs") < 0)
    bound = lambda sign: F.when(inner, F.exp(F.col("logs") * F.exp(sign * wide))).otherwise(survival)
    return upto.select("g", "t", "at_risk", "events", survival.alias("survival"), bound(-1).alias("lower"), bound(1).alias("upper"))


def cox_one(df: DataFrame, duration: str, event: str, covariate: str, steps: int = 30) -> tuple[float, float, float]:
    """(coefficient, hazard ratio, p) of a proportional-hazards model with one covariate, Efron ties.

    Each Newton step is one aggregate over distinct durations and reverse running sums over those, in ranges; the driver gets
    one row per step. Gives zeros when there are no events or the covariate is constant.
    """
    base = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(covariate).cast("double").alias("x")).where("t is not null and x is not null")
    beta = 0.0
    info = 0.0
    for _ in range(steps):
        w = F.exp(F.col("x") * beta)
        s = base.groupBy("t").agg(
            *[F.sum(w * p).alias(f"r{k}") for k, p in enumerate((F.lit(1.0), F.col("x"), F.col("x") * F.col("x")))],
            *[F.sum(F.when(F.col("e") == 1, w * p).otherwise(0.0)).alias(f"d{k}") for k, p in enumerate((F.lit(1.0), F.col("x"), F.col("x") * F.col("x")))],
            F.sum("e").alias("d"),
            F.sum(F.when(F.col("e") == 1, F.col("x")).otherwise(0.0)).alias("sx"),
        )
        s = running(s, [], ["t"], {f"later{k}": F.col(f"r{k}") for k in range(3)}, falling=True)
        s = cut_lineage(s.select("d", "sx", "d0", "d1", "d2", *[F.col(f"later{k}").alias(f"r{k}") for k in range(3)]).where("d > 0"))
        part = F.col("j") / F.col("d")
        each = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
        a, b, c = (F.col(f"r{k}") - part * F.col(f"d{k}") for k in range(3))
        moved = each.agg(F.sum(b / a).alias("g"), F.sum(c / a - (b / a) * (b / a)).alias("h"))
        moved = with_scalars(moved, s.agg(F.sum("sx").alias("sx"))).first()
        if not moved["h"]:
            return 0.0, 1.0, 1.0
        info = moved["h"]
        move = (moved["sx"] - moved["g"]) / info
        beta += max(-5.0, min(5.0, move))
        if abs(move) < 1e-9:
            break
    import math

    return beta, math.exp(beta), special.normal_two_sided(beta * math.sqrt(info))
