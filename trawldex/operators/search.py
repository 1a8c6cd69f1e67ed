"""Ranked search for pages that hold all lemmas of a query that their site keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.functions.numbers import round_half_up
from trawldex.functions.urls import HTTP_URL


class SearchError(ValueError):
    """A request that cannot be answered."""


def validate(query: str, site: str | None, offset: int, limit: int) -> None:
    import re

    if site is not None and not re.fullmatch(HTTP_URL, site):
        raise SearchError("the site is not a valid url")
    if limit < 0:
        raise SearchError("limit must not be negative")
    if offset < 0:
        raise SearchError("offset must not be negative")
    if not query:
        raise SearchError("the query is empty")


def keep_rare(df: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """Lemma rows whose share of their site's pages (counts: site, n_pages) is at most `most`."""
    return df.join(counts, "site").filter(F.col("frequency") / F.col("n_pages") <= most).drop("n_pages")


def rare_first(df: DataFrame) -> DataFrame:
    return df.orderBy("frequency", "lemma", "site")


def pages_with_all(tf: DataFrame, kept: DataFrame) -> DataFrame:
    """site, page_id, total and top rank of pages that hold every kept lemma of their site."""
    wanted = kept.groupBy("site").agg(F.count("*").alias("k"))
    hits = tf.join(kept.select("site", "lemma"), ["site", "lemma"], "left_semi")
    pages = hits.groupBy("site", "page_id").agg(F.count("*").alias("n"), F.sum("rank").alias("total"), F.max("rank").alias("top"))
    return pages.join(wanted, "site").filter("n = k").drop("n", "k")


def relevance(pages: DataFrame) -> DataFrame:
    return pages.select("site", "page_id", (F.col("total") / F.col("top")).alias("relevance"))


def ranked(scores: DataFrame, offset: int = 0, limit: int | None = 20) -> DataFrame:
    """Rounded before sorting; equal scores by site and page."""
    rows = in_order(scores.withColumn("relevance", round_half_up(F.col("relevance"))))
    return rows if limit is None else rows.offset(offset).limit(limit)


def in_order(rows: DataFrame) -> DataFrame:
    """Best first. Joins lose an order, so this comes last."""
    return rows.orderBy(F.desc("relevance"), "site", "page_id")
