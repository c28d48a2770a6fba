"""One row per entity from events: time-bucketed partial aggregates that persist and are merged into features.

The store keeps, for each time bucket, one row per (entity, type) with count, total and first and last time. A refresh
fingerprints the buckets of the source, recomputes those whose fingerprint changed and publishes a manifest; a feature
query merges whole buckets and adds the events of the two buckets that its window cuts.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramagem.sources import shared

#: Width of a bucket in seconds (about a month) and the bucket of events without a time.
BUCKET_SECONDS = 30 * 86_400
NO_TIME = -(2**40)
STORE_FORMAT = 2


def bucket_of(ts: Column, width: int) -> Column:
    return F.coalesce(F.floor(ts / width), F.lit(NO_TIME)).cast("long")


def one_per_message(events: DataFrame) -> DataFrame:
    """Drop repeat deliveries: of each message the last to arrive, whatever its time; ties go to the larger score, then the
    later time, then the type. Rows without id stay."""
    newest = F.max_by(
        F.struct("bucket", "entity", "type", "ts", "score"),
        F.struct("arrived", F.coalesce("score", F.lit(-(2**62))), F.coalesce("ts", F.lit(float("-inf"))), F.coalesce("type", F.lit(""))),
    )
    kept = events.where("message is not null").groupBy("message").agg(newest.alias("e")).select("e.*")
    return kept.unionByName(events.where("message is null").select("bucket", "entity", "type", "ts", "score"))


def _partials(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("total"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@dataclass
class Refresh:
    recomputed: list[int] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)


class BucketStore:
    """Persisted partial aggregates below `path`.

    Source frames have the columns message, entity, type (strings), ts (double seconds, null when absent), score (long)
    and arrived (orderable). Null entities and types are kept as groups of their own; an empty source gives an empty
    store. Other columns are ignored.
    """

    COLUMNS = ("message", "entity", "type", "ts", "score", "arrived")
    SCHEMA = "bucket long, entity string, type string, n long, total long, first_ts double, last_ts double"

    def __init__(self, spark: SparkSession, path: str, width: int = BUCKET_SECONDS):
        self.spark, self.path, self.width = spark, path, width

    @property
    def _manifest_path(self) -> str:
        return f"{self.path}/manifest.json"

    def _load(self) -> dict:
        text = shared.read_text(self.spark, self._manifest_path)
        held = json.loads(text) if text else {}
        return held if held.get("format") == STORE_FORMAT and held.get("width") == self.width else {}

    def manifest(self) -> dict[str, dict]:
        """By bucket: its fingerprint, the version that holds it, and the buckets with other deliveries of its messages."""
        return self._load().get("buckets", {})

    def _bucketed(self, source: DataFrame) -> DataFrame:
        return source.select(*self.COLUMNS).withColumn("bucket", bucket_of(F.col("ts"), self.width))

    def refresh(self, source: DataFrame) -> Refresh:
        """Bring the store up to the source; only buckets with other contents than last time are computed."""
        events = self._bucketed(source)
        row = F.xxhash64("message", "entity", "type", "ts", "score", "arrived")
        # the number of buckets follows the span of time, not the number of events
        prints = events.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(row.cast("decimal(20,0)")).cast("string").alias("sum"),
            F.bit_xor(row).alias("xor"),
        )
        now = {str(r["bucket"]): f"{r['n']}:{r['sum']}:{r['xor']}" for r in prints.collect()}
        before = self._load()
        held = before.get("buckets", {})
        fresh = {int(b) for b, p in now.items() if held.get(b, {}).get("print") != p}
        removed = {int(b) for b in held if b not in now}
        if not fresh and not removed and before:
            return Refresh([], sorted(map(int, now)), [])
        # a message delivered again in another bucket counts in one of them only: those that share messages go together
        links = {int(b): set(map(int, held[b]["links"])) - removed for b in held if int(b) not in fresh | removed}
        for b in fresh:
            links[b] = set()
        for r in self._shared(events, fresh, len(fresh) == len(now)).collect():  # pairs of buckets
            links[r["a"]].add(r["b"])
        touched = set(fresh).union(*(links[b] for b in fresh), *(map(int, held[str(b)]["links"]) for b in (fresh | removed) if str(b) in held)) & set(map(int, now))
        for b in links:
            links[b] = {x for x in links[b] if x not in fresh or b in links[x]}
        version = f"v={uuid.uuid4().hex[:12]}"
        if touched:
            part = self._with_links(events, touched, links, len(now))
            rows = _partials(one_per_message(part).where(F.col("bucket").isin(sorted(touched))), "bucket", "entity", "type")
            rows.withColumn("at", F.col("bucket")).write.partitionBy("at").parquet(f"{self.path}/{version}")
        buckets = {b: {"print": p, "in": version if int(b) in touched else held[b]["in"], "links": sorted(links[int(b)])} for b, p in now.items()}
        retired = {b["in"] for b in held.values()} - {b["in"] for b in buckets.values()}
        shared.make_folder(self.spark, self.path)
        shared.publish_text(self.spark, self._manifest_path, json.dumps({"format": STORE_FORMAT, "width": self.width, "buckets": buckets, "retired": sorted(retired)}))
        # frames made before this refresh may still be read until the next one
        for gone in before.get("retired", []):
            shared.delete(self.spark, f"{self.path}/{gone}")
        return Refresh(sorted(touched), sorted(int(b) for b in now if int(b) not in touched), sorted(removed))

    @staticmethod
    def _shared(events: DataFrame, fresh: set[int], every: bool) -> DataFrame:
        """(a, b): pairs of buckets that hold deliveries of one message, one of them fresh."""
        named = events.where("message is not null").select("message", "bucket")
        if not every:
            named = named.join(named.where(F.col("bucket").isin(sorted(fresh))).select("message").distinct(), "message", "left_semi")
        spread = named.groupBy("message").agg(F.sort_array(F.collect_set("bucket")).alias("at")).where("size(at) > 1")
        return spread.select("at").distinct().select(F.explode("at").alias("a"), "at").select("a", F.explode("at").alias("b")).where("a <> b").distinct()

    @staticmethod
    def _with_links(events: DataFrame, buckets: set[int], links: dict[int, set[int]], known: int) -> DataFrame:
        """The events of some buckets and of those that share messages with them."""
        wide = set(buckets).union(*(links.get(b, set()) for b in buckets))
        return events if len(wide) == known else events.where(F.col("bucket").isin(sorted(wide)))

    def partials(self, first: int | None = None, last: int | None = None, timeless: bool = True) -> DataFrame:
        """Stored rows of the buckets first..last (both included)."""
        wanted: dict[str, list[int]] = {}
        for b, at in self.manifest().items():
            inside = timeless if int(b) == NO_TIME else (first is None or int(b) >= first) and (last is None or int(b) <= last)
            if inside:
                wanted.setdefault(at["in"], []).append(int(b))
        frames = [
            self.spark.read.schema(self.SCHEMA + ", at long").parquet(f"{self.path}/{version}").where(F.col("at").isin(buckets)).drop("at")
            for version, buckets in wanted.items()
        ]
        if not frames:
            return self.spark.createDataFrame([], self.SCHEMA)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def by_type(self, source: DataFrame | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
        """(entity, type, n, total, last_ts) over start <= ts < end; without bounds over everything, timeless events too.

        Buckets wholly inside come from the store, the cut ones at the ends from the source's own rows.
        """
        if start is None and end is None:
            parts = self.partials()
        else:
            first = None if start is None else math.ceil(start / self.width)
            last = None if end is None else math.floor(end / self.width) - 1
            parts = self.partials(first, last, timeless=False)
            cut = {math.floor(x / self.width) for x in (start, end) if x is not None and x % self.width}
            if cut:
                if source is None:
                    raise ValueError("a window that cuts buckets needs the source for its boundary events")
                held = self.manifest()
                links = {int(b): set(map(int, at["links"])) for b, at in held.items()}
                edge = one_per_message(self._with_links(self._bucketed(source), cut, links, len(held))).where(F.col("bucket").isin(sorted(cut)))
                if start is not None:
                    edge = edge.where(F.col("ts") >= start)
                if end is not None:
                    edge = edge.where(F.col("ts") < end)
                parts = parts.unionByName(_partials(edge, "bucket", "entity", "type"))
        return parts.groupBy("entity", "type").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_ts").alias("last_ts")
        )

    def features(self, source: DataFrame | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
        """One row per entity: totals and an array of its types, sorted by type; types without events take no room."""
        return self.by_type(source, start, end).groupBy("entity").agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.max("last_ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n_types"),
            F.array_sort(F.collect_list(F.struct("type", "n", "total", "last_ts"))).alias("features"),
        )
