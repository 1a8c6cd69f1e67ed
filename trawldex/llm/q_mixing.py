"""op6: rates of all documents for fixed target weights of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import mixing
from trawldex.llm.common import table

WEIGHTS = {"good": 0.84, "poor": 0.11, "toxic": 0.05}


def op6_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # where soft posteriors allow no exact match, the columns asked and achieved say so
    rows = mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, carry=["doc_id"], allow_gap=True)
    parts = [F.round(F.col("posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return rows.select(F.col("__doc.doc_id").alias("doc_id"), "tokens", *parts, F.round("rate", 6).alias("rate"), "copies", *[f"{kind}_{d}" for kind in ("asked", "achieved") for d in mixing.DOMAINS])
