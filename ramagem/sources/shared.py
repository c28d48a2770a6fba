"""Small files in the shared folder, through Hadoop's file system API so that any scheme works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of what lies in a folder of tables, and in the tables themselves if they are folders."""
    fs, out = _fs(spark, path), []
    for status in fs.listStatus(_path(spark, path)):
        parts = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f"{p.getPath().getName()}:{p.getLen()}:{p.getModificationTime()}" for p in parts]
    return "|".join(sorted(out))


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the old text or the new one, never a part: written aside, then renamed over."""
    staged = f"{path}.{uuid.uuid4().hex}"
    out = _fs(spark, staged).create(_path(spark, staged), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, staged), _path(spark, path), overwrite)
