"""op7: token rollup of all documents after an insert, a delete and a revision batch, the first of them committed twice.

Batch `load` inserts every document; `toxic` deletes those labelled toxic; `ends` revises those labelled low in quality
(and not toxic) to carry one end-of-text token more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import tokens
from trawldex.llm.common import materialize, scratch_dir, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
#: Fixed value: the pre-tokenizing pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op7_token_rollup(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = materialize(tokens.count_tokens(docs, path, PATTERN).withColumn("version", F.lit(VERSION)), "tokens")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    change = lambda df, op, n, old: df.select(F.lit(op).alias("op"), "source", "lang", "version", n.alias("tokens"), old.alias("old_tokens"))
    n, none = F.col("tokens"), F.lit(None).cast("long")
    ledger = tokens.Ledger(spark, f"{scratch_dir(spark)}/trawldex/ledger-{uuid.uuid4().hex}")
    load = change(counted, "insert", n, none)
    ledger.commit("load", load)
    ledger.commit("toxic", change(counted.join(labels.filter("toxic > 0"), "doc_id", "left_semi"), "delete", n, none))
    ledger.commit("ends", change(counted.join(labels.filter("coalesce(toxic, 0) <= 0 AND quality <= 0"), "doc_id", "left_semi"), "revise", n + 1, n))
    ledger.commit("load", load)  # a replay changes nothing
    return ledger.rollup()
