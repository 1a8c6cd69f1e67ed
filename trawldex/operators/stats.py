"""Counts by site and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.functions.numbers import epoch_millis


def pages_per_site(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site").agg(F.count("*").alias("n_pages"))


def lemmas_per_site(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(F.count("*").alias("n_lemmas"))


def total_stats(sites: DataFrame, counts: DataFrame, indexing: bool = False) -> DataFrame:
    """Configured sites, and the sums of what is counted for each stored site (site, pages, lemmas)."""
    none = F.lit(0).cast("long")
    both = sites.select(F.lit(1).cast("long").alias("sites"), none.alias("pages"), none.alias("lemmas")).unionByName(counts.select(none.alias("sites"), "pages", "lemmas"))
    return both.agg(*[F.coalesce(F.sum(n), none).alias(n) for n in both.columns]).withColumn("indexing", F.lit(indexing))


def site_stats(configured: DataFrame, stored: DataFrame, counts: DataFrame, now=None) -> DataFrame:
    """Every configured site (url, name) with status, counts (site, pages, lemmas) and last error; sites that are not stored get defaults."""
    rows = configured.join(stored.select("url", "status", "status_time", "last_error"), "url", "left")
    rows = rows.join(counts.select(F.col("site").alias("url"), F.col("pages").alias("n_pages"), F.col("lemmas").alias("n_lemmas")), "url", "left")
    has = F.col("status").isNotNull()
    zero = lambda c: F.when(has, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "url", "name", F.coalesce("status", F.lit("NOT INDEXED")).alias("status"),
        epoch_millis(F.coalesce("status_time", F.current_timestamp() if now is None else now)).alias("status_time"),
        F.coalesce("last_error", F.lit("")).alias("error"), zero("n_pages").alias("pages"), zero("n_lemmas").alias("lemmas"),
    )
