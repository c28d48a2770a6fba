"""Filling containers of fixed capacity: exact complements by hashed length sums, then best fit.

All decisions are made on the histogram of lengths, at most one number per length up to the capacity, however many
items there are. A container is opened with the longest length left; its gap is closed exactly by a single length, a
pair or a triple, looked up by their sum, and the combination is used as often as its members' counts allow. What has no
exact complement is filled by best fit. Items then learn their container from their rank among the items of their
length: ranks are counted in place and offset by the counts of the partitions before, so that a length that most
items share is never brought together.

Items longer than the capacity are cut into full containers and a rest; others are never cut. Items of length 0 take no
room and are dealt over the containers in turn. Null lengths count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramagem.session import cut_lineage

CAPACITY = 2048


@dataclass(frozen=True)
class Recipe:
    """`times` containers that each hold items of these lengths."""

    lengths: tuple[int, ...]
    times: int


class _SumIndex:
    """Which single lengths, pairs and triples of lengths in stock add up to a wanted sum."""

    def __init__(self, stock: np.ndarray):
        self.stock = stock
        self.lengths = np.zeros(0, np.int64)
        self.pair_sums = np.zeros(0, bool)
        self.pair_of: dict[int, tuple[int, int]] = {}
        self.triple_of: dict[int, tuple[int, int, int]] = {}

    def _holds(self, parts: tuple[int, ...]) -> bool:
        return all(self.stock[p] >= parts.count(p) for p in parts)

    def refresh(self) -> None:
        """Hash all pair sums again once a length has run out: a bit for every sum that two lengths in stock make."""
        lengths = np.flatnonzero(self.stock)
        if len(lengths) == len(self.lengths):
            return
        self.lengths = lengths
        bits = sum(1 << n for n in lengths.tolist())
        sums = 0
        for n in lengths.tolist():
            sums |= bits << n
        size = len(self.stock)
        raw = (sums & ((1 << size) - 1)).to_bytes(size // 8 + 1, "little")
        self.pair_sums = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:size].astype(bool)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.stock[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        held = self.pair_of.get(gap)
        if held and self._holds(held):
            return held
        low = np.arange(1, gap // 2 + 1)
        fits = (self.stock[low] > 0) & (self.stock[gap - low] > 0)
        if gap % 2 == 0 and gap and fits[-1] and self.stock[gap // 2] < 2:
            fits[-1] = False
        at = np.flatnonzero(fits)
        if not at.size:
            self.pair_of.pop(gap, None)
            return None
        # the pair that can be used most often
        use = np.minimum(self.stock[low[at]], self.stock[gap - low[at]])
        best = int(low[at[np.argmax(use)]])
        self.pair_of[gap] = (gap - best, best)
        return self.pair_of[gap]

    def triple(self, gap: int) -> tuple[int, ...] | None:
        held = self.triple_of.get(gap)
        if held and self._holds(held):
            return held
        firsts = self.lengths[self.lengths <= gap - 2]
        for first in firsts[self.pair_sums[gap - firsts]][::-1].tolist():
            if not self.stock[first]:
                continue
            self.stock[first] -= 1
            rest = self.pair(gap - first) if gap - first >= 2 else None
            self.stock[first] += 1
            if rest and self._holds((first, *rest)):
                self.triple_of[gap] = (first, *rest)
                return self.triple_of[gap]
        self.triple_of.pop(gap, None)
        return None


def plan_recipes(histogram: dict[int, int], capacity: int) -> list[Recipe]:
    """Recipes that use up the histogram of lengths 1..capacity exactly."""
    stock = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        stock[length] += count
    index = _SumIndex(stock)
    recipes: list[Recipe] = []

    def use(parts: tuple[int, ...]) -> None:
        times = min(int(stock[p]) // parts.count(p) for p in set(parts))
        for p in parts:
            stock[p] -= times
        recipes.append(Recipe(parts, times))

    longest = capacity
    while True:
        while longest and not stock[longest]:
            longest -= 1
        if not longest:
            return recipes
        index.refresh()
        parts = (longest,)
        gap = capacity - longest
        while gap:
            stock[longest] -= 1  # the opened container's own item is not in stock
            for p in parts[1:]:
                stock[p] -= 1
            exact = index.single(gap) or index.pair(gap) or (index.triple(gap) if gap >= 3 else None)
            small = np.flatnonzero(stock[1 : gap + 1]) if not exact else ()
            for p in parts:
                stock[p] += 1
            if exact:
                parts += exact
                break
            if not len(small):
                break
            # no exact complement: the longest that fits, then look again for the smaller gap
            best = int(small[-1]) + 1
            parts += (best,)
            gap -= best
        use(parts)


def _intervals(recipes: list[Recipe]) -> tuple[dict[str, np.ndarray], int]:
    """For each length its runs of ranks: from `first` on, item r goes to container base + r - first."""
    rows: list[tuple[int, int, int]] = []
    used: dict[int, int] = {}
    base = 0
    for recipe in recipes:
        for length in recipe.lengths:
            first = used.get(length, 0)
            rows.append((length, first, base))
            used[length] = first + recipe.times
        base += recipe.times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return {"length": table[:, 0], "first": table[:, 1], "base": table[:, 2]}, base


def pack(items: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, n_pieces, size, container) for items (key, size); containers are numbered from 0.

    Each item within the capacity is one row; a longer one has a row for each piece. Repeated keys are items of their
    own. An empty frame gives no rows. With only empty items all are in container 0.
    """
    spark = items.sparkSession
    whole = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = F.greatest(F.ceil(whole / capacity), F.lit(1)).cast("int")
    cut = (
        items.select(F.col(key).cast("long").alias("item"), whole.alias("whole"), pieces.alias("n_pieces"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("length", F.least(F.col("whole") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("long"))
        .select("item", "piece", "n_pieces", "length")
    )
    # part and rank are written with the rows: a later pass may split the files in another way
    held = cut_lineage(cut.mapInArrow(_rank_in_place, "item bigint, piece int, n_pieces int, length bigint, part int, rank bigint"))
    counts = cut_lineage(held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    table, containers = _intervals(plan_recipes(histogram, capacity))
    before = F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)")
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = held.join(offsets, ["part", "length"]).select("item", "piece", "n_pieces", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    shared = spark.sparkContext.broadcast((table, containers))  # a few rows per length at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, containers = shared.value
        code = table["length"] * (1 << 42) + table["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(code, length * (1 << 42) + rank, side="right") - 1
            real = length > 0
            where = np.where(real, rank % max(1, containers), 0)
            if len(code):
                where = np.where(real, table["base"][at] + rank - table["first"][at], rank % max(1, containers))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column("length"), pa.array(where, pa.int64())], names=[key, "piece", "n_pieces", size, "container"])

    return placed.mapInArrow(place, f"{key} bigint, piece int, n_pieces int, {size} bigint, container bigint")


def _rank_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank among the rows of the same length within the partition, in order of reading."""
    part = TaskContext.get().partitionId()
    seen = np.zeros(1, np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy()
        if len(length) and length.max() >= len(seen):
            seen = np.concatenate((seen, np.zeros(int(length.max()) + 1 - len(seen), np.int64)))
        order = np.argsort(length, kind="stable")
        sorted_length = length[order]
        first = np.searchsorted(sorted_length, sorted_length, side="left")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - first
        rank += seen[length]
        np.add.at(seen, length, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], names=[*batch.schema.names, "part", "rank"])


def fill_report(packed: DataFrame, capacity: int = CAPACITY, size: str = "n_tokens") -> DataFrame:
    """(container, n_items, used, unused) per container."""
    return packed.groupBy("container").agg(
        F.count_if(F.col(size) > 0).alias("n_items"), F.sum(size).alias("used"), (F.lit(capacity) - F.sum(size)).alias("unused")
    )
