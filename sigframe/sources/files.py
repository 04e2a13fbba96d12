"""Moving and listing files of any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, old)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"can't rename {old} to {new}")


def size(spark: SparkSession, path: str) -> int:
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def make(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.mkdirs(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in place of any other."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
