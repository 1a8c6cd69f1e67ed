"""Inverted index: term and document frequencies, postings, incremental replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_freq(lemmas: DataFrame) -> DataFrame:
    """site, page_id, lemma, rank: occurrences on the page (combined before the shuffle). Rows with a count `n` stand for so many."""
    times = F.col("n") if "n" in lemmas.columns else F.lit(1)
    return lemmas.groupBy("site", "page_id", "lemma").agg(F.sum(times).cast("double").alias("rank"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """site, lemma, frequency: pages of the site that hold the lemma."""
    return tf.groupBy("site", "lemma").agg(F.count("*").alias("frequency"))


def postings(tf: DataFrame, df: DataFrame) -> DataFrame:
    return tf.join(df, ["site", "lemma"]).select("site", "page_id", "lemma", "rank", "frequency")


def replace_pages(old: DataFrame, new: DataFrame, keys: list[str], page_keys: DataFrame) -> DataFrame:
    """Rows of an index table after the pages in page_keys are replaced by what `new` has of them."""
    return old.join(page_keys.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def update_doc_freq(df: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Document frequencies after term rows `gone` and `come` (site, page_id, lemma): signed sums, lemmas at 0 go."""
    parts = df.select("site", "lemma", "frequency")
    for rows, sign in ((gone, -1), (come, 1)):
        parts = parts.unionByName(rows.select("site", "lemma", F.lit(sign).cast("long").alias("frequency")))
    return parts.groupBy("site", "lemma").agg(F.sum("frequency").alias("frequency")).filter("frequency > 0")
