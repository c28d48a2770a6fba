"""Per-key work over keys of very unequal size: fragment and replicate by estimated load.

1. Loads. A frequent-items sketch names every key that may hold more than half a task's share; all other keys are
   counted in a fixed number of hash buckets. Both are bounded by the number of tasks, whatever the data.
2. Plan. Heavy keys are cut into shards in proportion to their load; shards and buckets are packed longest first on
   the least loaded task.
3. Run. Rows go straight to the partition of their task; the matching side is copied only to the tasks that hold a
   shard of its key. Per-key results of the shards are merged at the end: at most one row per key and task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramagem.session import shuffle_tasks

TASK = "__task"
BUCKETS_PER_TASK = 8
#: A key is cut into shards once its load passes this part of one task's even share.
HEAVY_SHARE = 0.5


def pack_longest_first(loads: Sequence[float], bins: int) -> list[int]:
    """The bin of each item: heaviest item first, always into the least loaded bin (lowest number on ties)."""
    heap = [(0.0, b) for b in range(max(1, bins))]
    place = [0] * len(loads)
    for item in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, b = heapq.heappop(heap)
        place[item] = b
        heapq.heappush(heap, (load + loads[item], b))
    return place


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go. heavy: the tasks of each large key's shards; bucket_task: the task of each hash bucket."""

    rows: int
    tasks: int
    heavy: dict[str, list[int]]
    bucket_task: list[int]
    task_load: list[float]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Estimate the loads of df by key and pack them. Two narrow scans; the driver gets O(tasks) numbers.

    Null keys are not planned: they are dealt round to all tasks. An empty frame gives a plan without heavy keys.
    """
    tasks = tasks or shuffle_tasks(df.sparkSession)
    buckets = tasks * BUCKETS_PER_TASK
    keys = df.select(F.col(key).cast("string").alias("k"))
    rows = keys.count()
    most = 4 * tasks
    # error of the sketch: under rows * 3.5 / tracked, well below the share that makes a key heavy
    tracked = max(10_000, 64 * tasks)
    top = keys.where("k is not null").agg(F.expr(f"approx_top_k(k, {most}, {tracked})").alias("top")).first()["top"] or []
    share = max(1.0, rows / tasks)
    heavy = {x["item"]: x["count"] for x in top if x["item"] is not None and x["count"] > share * HEAVY_SHARE}
    counted = keys.where("k is not null").groupBy(_bucket(F.col("k"), buckets).alias("b")).count()
    light = dict.fromkeys(range(buckets), 0.0)
    light.update({r["b"]: float(r["count"]) for r in counted.collect()})  # at most `buckets` rows
    if heavy:
        homes = df.sparkSession.createDataFrame([(k,) for k in heavy], "k string").select("k", _bucket(F.col("k"), buckets).alias("b"))
        for r in homes.collect():
            light[r["b"]] = max(0.0, light[r["b"]] - heavy[r["k"]])
    shards = {k: min(tasks, max(1, math.ceil(n / (share * HEAVY_SHARE)))) for k, n in heavy.items()}
    items: list[tuple[object, float]] = [(b, n) for b, n in light.items()]
    for k, s in shards.items():
        items += [(k, heavy[k] / s)] * s
    place = pack_longest_first([n for _, n in items], tasks)
    load = [0.0] * tasks
    spread: dict[str, list[int]] = {k: [] for k in heavy}
    bucket_task = [0] * buckets
    for (what, n), t in zip(items, place):
        load[t] += n
        if isinstance(what, str):
            spread[what].append(t)
        else:
            bucket_task[what] = t
    return LoadPlan(rows, tasks, spread, bucket_task, load)


def _light_task(key: Column, plan: LoadPlan) -> Column:
    # a literal that the optimizer folds once, instead of thousands of expressions
    places = F.split(F.lit(",".join(map(str, plan.bucket_task))), ",").cast("array<int>")
    return F.element_at(places, _bucket(key, len(plan.bucket_task)) + 1)


def _with_shards(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    rows = [(k, t) for k, t in plan.heavy.items()]  # at most 2 * tasks rows
    shards = df.sparkSession.createDataFrame(rows, "__k string, __shards array<int>")
    return df.join(F.broadcast(shards), F.col(key).cast("string") == F.col("__k"), "left").drop("__k")


def place_rows(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """Send each row to the partition of its task; adds the column __task."""
    turn = F.monotonically_increasing_id()
    task = (
        F.when(F.col(key).isNull(), F.pmod(turn, F.lit(plan.tasks)))
        .when(F.col("__shards").isNotNull(), F.element_at("__shards", (F.pmod(turn, F.size("__shards")) + 1).cast("int")))
        .otherwise(_light_task(F.col(key).cast("string"), plan))
    )
    return _with_shards(df, key, plan).withColumn(TASK, task.cast("int")).drop("__shards").repartitionById(plan.tasks, F.col(TASK))


def place_matches(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """Copy each row of the matching side to the tasks that hold a shard of its key; rows without key go nowhere."""
    tasks = F.coalesce(F.array_distinct("__shards"), F.array(_light_task(F.col(key).cast("string"), plan)))
    placed = _with_shards(df.where(F.col(key).isNotNull()), key, plan).withColumn(TASK, F.explode(tasks)).drop("__shards")
    return placed.repartitionById(plan.tasks, F.col(TASK))


def fragment_replicate_totals(
    df: DataFrame,
    key: str,
    matches: DataFrame | None,
    partial: Sequence[Column],
    merge: Sequence[Column],
    tasks: int | None = None,
) -> tuple[DataFrame, LoadPlan]:
    """Per-key totals of df joined to `matches` (at most one row per key), no task holding much more than its share.

    `partial` are aggregates over joined rows, `merge` aggregates over their results. Rows without a match keep null
    match columns; rows with a null key form one group of their own, never matched. Empty input gives no rows.
    """
    plan = plan_loads(df, key, tasks)
    placed = place_rows(df, key, plan)
    if matches is not None:
        placed = placed.join(place_matches(matches, key, plan).hint("shuffle_hash"), [TASK, key], "left")
    pieces = placed.groupBy(TASK, key).agg(*partial)  # in place: rows of one task are in one partition
    return pieces.groupBy(key).agg(*merge), plan
