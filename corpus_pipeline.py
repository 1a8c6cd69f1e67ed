"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run` writes each
stage's result as Parquet into the shared scratch folder and reads it back as the next one's input.

Defined results: documents with a null or empty text fail the quality rules; rows without an id pass every stage by their text (they are not
taken as copies) and are rated alike by the mix; repeated rows of an id are one document, so they stay or go together; ties between near
copies go to the least id; an empty table stays empty; extra columns are carried, whatever their names, up to the last stage, which returns
narrow rows without the text; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawldex.llm import decontam, mixing, ngram_join, q_decontam, q_mixing, q_sharding, quality
from trawldex.llm.common import materialize, scope, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, quality.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word shingles of five and a similarity of 0.8 or more; the least id of each group stays."""
    return ngram_join.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), q_decontam.WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is repeated, so a domain that has less than its share gets all it has; what was asked and what came out is logged."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), q_mixing.WEIGHTS, max_rate=1.0, allow_gap=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return q_sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Mixing trains a classifier, which SQL cannot express; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope(spark) as made:  # what a stage writes on its way goes, and so does its input
            own: list[str] = []
            docs = materialize(stage(spark, docs, sf_dir), name, own)
            made[:] = [p for p in made if p not in own] + before
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
