"""op4: all documents in 24 shards, and their shards among 25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import sharding
from trawldex.llm.common import materialize, table, text_bytes

SHARDS = 24


def shard_documents(docs: DataFrame) -> DataFrame:
    """Narrow rows (no text) with their shards; the text is read once for its size and checksum.

    The narrow rows are written, so that the number that parts repeated rows stays the same when they are read again.
    """
    rows = docs.select("doc_id", (text_bytes() + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = materialize(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))), "sizes")
    out = sharding.assign(rows, "doc_id", SHARDS, SHARDS + 1, ["doc_id", "text_crc32", "size"], sharding.blocks_for(rows.count(), SHARDS), "part")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
