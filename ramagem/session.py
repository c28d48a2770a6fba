"""Session builder and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings given from outside win."""
    builder = (
        SparkSession.builder.appName("ramagem")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where the setting is missing and the master is local.

    On a cluster without the setting this raises: a folder of one machine would not be there for the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("RAMAGEM_SHARED_DIR")
    context = spark.sparkContext
    if named is None:
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return str(set_already.get())
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"ramagem-{os.getuid()}")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/ramagem/{purpose}-{uuid.uuid4().hex[:12]}"


_SCRATCH: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and go on from there; survives the loss of an executor.

    Columnar and compressed, so a fraction of what checkpoint() would write. Removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_later(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the driver's Python ends."""
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def drop_scratch() -> None:
    """Delete the tables that cut_lineage wrote and what drop_later named; frames built on them can no longer be read."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:
            # the session is gone already; the folder's owner clears it
            return


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate as constants; the aggregate is computed now. Nulls if it has no row."""
    row = one.first()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in one.schema.fields})


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, for clusters where it isn't installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ramagem-ship-")) / "ramagem.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
