"""Tables in the scratch folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trawldex.sources import files


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder on one machine, and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="trawldex-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write df to the scratch folder and read it back: this cuts the lineage and survives lost executors. `made` gets the path."""
    path = f"{scratch_dir(df.sparkSession)}/trawldex/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str], last: int = 0) -> None:
    """Remove the tables at the paths in made, but for the last ones, and take them out of the list."""
    for path in made[: len(made) - last]:
        files.delete(spark, path)
    del made[: len(made) - last]
