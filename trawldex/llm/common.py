"""What the operators of this subpackage share: table access and the shared scratch folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.sources.scratch import scratch_dir

__all__ = ["WS_CHARS", "WS_CLASS", "discard", "materialize", "scope", "scratch_dir", "table", "text_bytes"]

#: White space between words, as a Java regular expression and as plain characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Scratch tables that are written inside are removed at the end, but for those taken out of the list that this gives."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        discard(spark, made)


def materialize(df: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
    """Write df to a new folder of the shared scratch space and read it back.

    This cuts the lineage: a lost executor costs only a re-read of the table. `keep`, if given,
    receives the path, so that the caller can remove the table when nothing needs it any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/trawldex/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")
