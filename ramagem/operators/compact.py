"""Many tiny files to few even ones: longest-first scheduling, streamed writes, a manifest published at the end.

Files of the same post are told by their path; of each post the best copy is kept. Kept files are dealt to a fixed
number of output groups: every large file is an item of its own, small ones are gathered in hash buckets, and a
least-loaded heap places the items, heaviest first. Items are first dealt to shelves of at most SHELF_GROUPS groups by
hash, and a task packs each shelf, so that no task and no driver holds the plan of all. The texts are read twice, to
choose copies and to write, and shuffled once, straight to their group's task, which streams them through a pyarrow
writer. Nothing counts until the counts and checksums of all groups agree with the source and the manifest has been
renamed into place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ramagem.operators.balance import pack_longest_first
from ramagem.operators.nested import readable_rows
from ramagem.session import cut_lineage
from ramagem.sources import shared

#: Bytes of text aimed at in one output file, and the bytes buffered before a row group is written.
GROUP_BYTES = 128 << 20
ROW_GROUP_BYTES = 8 << 20
BUCKETS_PER_GROUP = 32
#: A file is an item of its own from this part of an even group on.
LARGE_SHARE = 1 / 16
#: Groups that one task plans, with SHELF_GROUPS * (BUCKETS_PER_GROUP + 1 / LARGE_SHARE) items at most on the average.
SHELF_GROUPS = 64
#: The plan is broadcast up to so many items (of about 24 bytes), else joined.
MOST_BROADCAST_ITEMS = 1_000_000


def post_of_path(files: DataFrame) -> DataFrame:
    """Adds sub_key and post_key, told by the path alone: the last two of its parts, without case, prefix and endings.

    A null path, or one without both parts, gives null keys: such a file is a post of its own.
    """
    leaf = F.regexp_replace(F.substring_index("path", "/", -1), r"\.json.*$", "")
    folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    post = F.nullif(F.substring_index(F.lower(leaf), "_", -1), F.lit(""))
    sub = F.nullif(F.lower(F.trim(folder)), F.lit(""))
    named = F.col("path").contains("/") & post.isNotNull() & sub.isNotNull()
    return files.withColumn("sub_key", F.when(named, sub)).withColumn("post_key", F.when(named, post))


def _size():
    return F.coalesce(F.octet_length("doc"), F.lit(0)).cast("long")


def _print():
    return F.xxhash64("file_no", "path", "subreddit", "post_id", "harvested_at", "doc")


@F.pandas_udf(T.BooleanType())
def _readable(doc: pd.Series) -> pd.Series:
    return pd.Series(readable_rows(pa.array(doc, pa.string(), from_pandas=True)))


def choose_copies(files: DataFrame) -> DataFrame:
    """All files with their post, a hash of their contents and whether they are the copy kept: readable before not, then the
    latest, the longest, the last number."""
    sized = post_of_path(files).select(
        "file_no", "path", "sub_key", "post_key", "harvested_at", _size().alias("size"), _print().alias("print"), _readable("doc").alias("readable")
    )
    named = F.coalesce(F.concat_ws("/", "sub_key", "post_key"), F.lit(""))
    sized = sized.withColumn("post", F.when(F.col("sub_key").isNull(), F.concat(F.lit("#"), F.col("file_no"))).otherwise(named))
    sized = cut_lineage(sized)
    rank = F.struct("readable", F.coalesce("harvested_at", F.lit("1900-01-01").cast("timestamp_ntz")), "size", "file_no")
    # the best of each post by an aggregate, so that a post of many copies is never gathered in one place
    best = sized.groupBy("post").agg(F.max_by("file_no", rank).alias("file_no")).select("file_no", F.lit(True).alias("kept"))
    return sized.join(best, "file_no", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@dataclass(frozen=True)
class Plan:
    items: DataFrame  # item, group_no
    n_items: int
    groups: int
    buckets: int
    large: float

    def item(self):
        """The item of a file, from file_no and size."""
        bucket = F.pmod(F.xxhash64("file_no"), F.lit(self.buckets)).cast("int")
        return F.when(F.col("size") >= self.large, F.concat(F.lit("f"), F.col("file_no"))).otherwise(F.concat(F.lit("b"), bucket))

    def placed(self, files: DataFrame) -> DataFrame:
        """Adds group_no to files (file_no, size); those whose item holds no kept file drop out."""
        items = F.broadcast(self.items) if self.n_items <= MOST_BROADCAST_ITEMS else self.items
        return files.withColumn("item", self.item()).join(items, "item").drop("item")


def plan_groups(copies: DataFrame, groups: int | None = None, group_bytes: int = GROUP_BYTES) -> Plan:
    """Deal the kept files to groups of about group_bytes, or to about the given number of groups (exactly that up to SHELF_GROUPS)."""
    kept = copies.where("kept")
    total = kept.agg(F.sum("size").alias("s")).first()["s"] or 0
    if groups:
        group_bytes = max(1, -(-total // groups))
    wanted = groups or max(1, -(-total // group_bytes))
    shelves = -(-wanted // SHELF_GROUPS)
    plan = Plan(kept, 0, wanted, wanted * BUCKETS_PER_GROUP, max(1.0, min(group_bytes, total / wanted) * LARGE_SHARE))
    loads = kept.withColumn("item", plan.item()).groupBy("item").agg(F.sum("size").cast("double").alias("load")).withColumn("shelf", F.pmod(F.xxhash64("item"), F.lit(shelves)).cast("int"))

    def pack(key: tuple, shelf: pd.DataFrame) -> pd.DataFrame:
        shelf = shelf.sort_values("item")
        count = wanted if shelves == 1 else max(1, round(shelf["load"].sum() / group_bytes))
        return pd.DataFrame({"item": shelf["item"], "shelf": key[0], "place": pack_longest_first(shelf["load"].tolist(), count), "count": count})

    packed = cut_lineage(loads.groupBy("shelf").applyInPandas(pack, "item string, shelf int, place int, count int"))
    # a row for each shelf, of SHELF_GROUPS groups
    counts = packed.groupBy("shelf").agg(F.max("count").alias("count"), F.count(F.lit(1)).alias("items")).orderBy("shelf").collect()
    starts, at = [], 0
    for r in counts:
        starts.append((r["shelf"], at))
        at += r["count"]
    first = copies.sparkSession.createDataFrame(starts, "shelf int, start int")
    items = packed.join(F.broadcast(first), "shelf").select("item", (F.col("start") + F.col("place")).alias("group_no"))
    return Plan(items, sum(r["items"] for r in counts), max(1, at), plan.buckets, plan.large)


RECORD = pa.schema(
    [("file_no", pa.int64()), ("path", pa.string()), ("subreddit", pa.string()), ("post_id", pa.string()), ("harvested_at", pa.timestamp("us")), ("readable", pa.bool_()), ("doc", pa.string())]
)
_WRITTEN = "group_no int, file string, rows long, bytes long, checksum decimal(20,0), size long"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        open_now: dict = {}
        held: list[pa.RecordBatch] = []
        totals: dict[int, list[int]] = {}
        chosen: dict[int, pa.ChunkedArray] = {}  # of each group the numbers of its kept files, which come first

        def flush() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held)
            held.clear()
            for group in table.column("group_no").unique().to_pylist():
                part = table.filter(pa.compute.equal(table.column("group_no"), group))
                told = part.filter(pa.compute.invert(part.column("is_record")))
                if told.num_rows:
                    chosen[group] = pa.concat_tables([*([chosen[group]] if group in chosen else []), told.select(["file_no", "readable"])]).combine_chunks()
                part = part.filter(part.column("is_record"))
                keys = chosen[group].column("file_no") if group in chosen else pa.chunked_array([], pa.int64())
                at = pa.compute.index_in(part.column("file_no"), keys)
                part = part.filter(pa.compute.is_valid(at))
                if not part.num_rows:
                    continue
                known = chosen[group].column("readable").take(at.drop_null())
                part = part.set_column(part.schema.get_field_index("readable"), "readable", known)
                if group not in open_now:
                    name = f"group-{group:05d}-{context.taskAttemptId()}.parquet"
                    open_now[group] = (name, pq.ParquetWriter(f"{root}/{name}", RECORD, compression="zstd", filesystem=fs))
                    totals[group] = [0, 0, 0]
                open_now[group][1].write_table(part.select(RECORD.names).cast(RECORD))
                t = totals[group]
                t[0] += part.num_rows
                t[1] += pa.compute.sum(part.column("size")).as_py() or 0
                t[2] = (t[2] + _mark(part.column("print"))) % (1 << 64)

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.nbytes
            if waiting >= ROW_GROUP_BYTES:
                flush()
                waiting = 0
        flush()
        rows = []
        for group, (name, writer) in sorted(open_now.items()):
            writer.close()
            n, size, mark = totals[group]
            rows.append((group, name, n, fs.get_file_info(f"{root}/{name}").size, Decimal(mark), size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.int64()))], names=["group_no", "file", "rows", "bytes", "checksum", "size"])

    return run


def _mark(prints: pa.ChunkedArray) -> int:
    return int(prints.to_numpy().astype("uint64").sum(dtype="uint64"))


@dataclass(frozen=True)
class Compacted:
    folder: str
    manifest: dict
    index: DataFrame


class ManifestError(RuntimeError):
    """The written groups do not hold exactly the records they should."""


def compact(files: DataFrame, folder: str, groups: int | None = None, group_bytes: int = GROUP_BYTES) -> Compacted:
    """Write the kept copy of every post of `files` into few files below folder and publish the manifest.

    files: file_no (unique), path, subreddit, post_id, harvested_at, doc; other columns are ignored. Null and empty
    docs are records like others (unreadable). An empty frame gives an empty manifest. A failed or repeated task leaves
    a file that no manifest names. The index tells of every file, kept or not, its post and group.
    """
    spark = files.sparkSession
    run = uuid.uuid4().hex[:12]
    stage = f"{folder.rstrip('/')}/{run}"
    shared.make_folder(spark, f"{stage}/data")
    copies = choose_copies(files)
    plan = plan_groups(copies, groups, group_bytes)
    kept = plan.placed(copies.where("kept"))
    copies.where("not kept").withColumn("group_no", F.lit(None).cast("int")).unionByName(kept).write.option("compression", "zstd").parquet(f"{stage}/index")
    index = spark.read.schema(T.StructType([*copies.schema.fields, T.StructField("group_no", T.IntegerType())])).parquet(f"{stage}/index")
    # each group's task first gets the numbers of its kept files, then the records of all files of its items
    told = index.where("kept").select("group_no", F.lit(False).alias("is_record"), "file_no", "readable")
    record = ("path", "subreddit", "post_id", "harvested_at", "doc")
    sized = files.select("file_no", *record, _size().alias("size"), _print().alias("print"))
    records = plan.placed(sized).withColumns({"is_record": F.lit(True), "readable": F.lit(None).cast("boolean")})
    both = told.unionByName(records, allowMissingColumns=True).repartitionById(plan.groups, F.col("group_no")).sortWithinPartitions("group_no", "is_record")
    written = both.mapInArrow(_writer(f"{stage}/data"), _WRITTEN)
    rows = sorted(written.collect(), key=lambda r: r["group_no"])  # one row per group
    want = index.where("kept").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("print").cast("decimal(38,0)")), F.lit(0)).alias("mark"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")
    ).first()
    got = (sum(r["rows"] for r in rows), sum(int(r["checksum"]) for r in rows) % (1 << 64), sum(r["size"] for r in rows))
    if got != (want["rows"], int(want["mark"]) % (1 << 64), want["size"]):
        raise ManifestError(f"written {got}, wanted {tuple(want)}")
    back = spark.read.parquet(*[f"{stage}/data/{r['file']}" for r in rows]).select("file_no") if rows else None
    if back is not None and back.agg(F.count_distinct("file_no").alias("n")).first()["n"] != want["rows"]:
        raise ManifestError("the files read back do not hold every record once")
    manifest = {"run": run, "groups": [r.asDict() | {"checksum": int(r["checksum"])} for r in rows], "rows": got[0], "size": got[2]}
    shared.publish_text(spark, f"{folder.rstrip('/')}/manifest.json", json.dumps(manifest))
    return Compacted(stage, manifest, index)


def read_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the published manifest."""
    manifest = json.loads(shared.read_text(spark, f"{folder.rstrip('/')}/manifest.json"))
    names = [f"{folder.rstrip('/')}/{manifest['run']}/data/{g['file']}" for g in manifest["groups"]]
    return spark.read.parquet(*names) if names else spark.createDataFrame([], "file_no bigint")


def same_post_pairs(index: DataFrame) -> DataFrame:
    """(file_a, file_b), a < b, of the files of one post: an equi-join; AQE splits a post of very many files."""
    named = index.where("post_key is not null")
    many = named.groupBy("sub_key", "post_key").count().where("count > 1").drop("count")
    side = named.join(many, ["sub_key", "post_key"], "left_semi").select("sub_key", "post_key", "file_no")
    return (
        side.withColumnRenamed("file_no", "file_a")
        .join(side.withColumnRenamed("file_no", "file_b"), ["sub_key", "post_key"])
        .where("file_a < file_b")
        .select("file_a", "file_b")
    )
