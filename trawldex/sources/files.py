"""File system access through Spark's own layer, so that any store that Spark reads works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, made at once."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file that nobody has made before; False if there is one."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    return fs.createNewFile(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def signature(spark: SparkSession, path: str) -> tuple:
    """Path, length and time of the files of a table."""
    fs, p = _at(spark, path)
    return (path, *sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
