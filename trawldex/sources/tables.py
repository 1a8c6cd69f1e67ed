"""Reading crawled pages and documents, and writing and replacing index tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.functions import html, urls
from trawldex.sources.config import Site


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site_pages(pages: DataFrame, code: Column | None = None) -> DataFrame:
    """site, page_id, url, path, title, content, html of the pages that can be indexed.

    Pages with an answer of 302 and pages without text are left out.
    """
    rows = pages.withColumn("code", F.lit(200) if code is None else code.cast("int")).filter("code IS NULL OR code <> 302")
    site = urls.site_of(F.col("url"))
    # a generator over one text or none: as a filter, the text would be worked out twice
    content = F.explode(F.filter(F.array(html.text(F.col("html"))), lambda t: t != ""))
    rows = rows.filter(site != "").select(site.alias("site"), "page_id", "url", "code", urls.path_of(F.col("url"), site).alias("path"), html.title(F.col("html")).alias("title"), content.alias("content"), "html")
    return rows


def one_of_each(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, ...) without those that are given twice: of leniently equal addresses the least page id stays, of rows of
    one page id of a site the one with the least address. Only addresses are compared; of equal rows any one stays."""
    spread = pages.select(site_of_pages().alias("site"), "page_id", urls.key(F.col("url")).alias("key"), F.struct("page_id", "url").alias("id"))
    # addresses that occur again, and page ids that do: few as a rule
    first = spread.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = spread.groupBy("site", "page_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    if first.isEmpty() and again.isEmpty():
        return pages
    rows = pages.withColumns({"_key": urls.key(F.col("url")), "_id": F.struct("page_id", "url"), "_site": site_of_pages()})
    rows = rows.join(first.select(F.col("key").alias("_key"), F.col("first").alias("_first")), "_key", "left")
    rows = rows.join(again.select(F.col("site").alias("_site"), "page_id", F.col("first").alias("_again")), ["_site", "page_id"], "left")
    kept = rows.filter("(_first IS NULL OR _first = _id) AND (_again IS NULL OR _again = _id)")
    alone = kept.filter("_first IS NULL AND _again IS NULL").select(*pages.columns)
    return alone.unionByName(kept.filter("_first IS NOT NULL OR _again IS NOT NULL").dropDuplicates(["page_id", "url"]).select(*pages.columns))


def corpus_pages(documents: DataFrame) -> DataFrame:
    """Plain documents as pages: the source is the site, and there is no markup."""
    return documents.select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), F.col("text").alias("content")).filter("content <> ''")


def route(url: Column, sites: Sequence[Site]) -> Column:
    """The first configured site that the url contains, or null; the configured list becomes one expression, not a join."""
    found = [F.when(F.contains(url, F.lit(s.url)), F.lit(s.url)) for s in sites]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def site_of_pages() -> Column:
    return urls.site_of(F.col("url"))


def write_table(rows: DataFrame, path: str, partition_by: str | None = "site") -> None:
    """Replace the partitions that rows has; others stay."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def without_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """What stays of a table when the given sites (column url) are indexed anew."""
    return rows.join(sites.select(F.col("url").alias("site")).distinct(), "site", "left_anti")


def mark_sites(sites: DataFrame, status: str, at: Column, error: Column | None = None) -> DataFrame:
    """Site rows (url, name) with a status of INDEXING, INDEXED or FAILED."""
    if status not in ("INDEXING", "INDEXED", "FAILED"):
        raise ValueError(f"unknown status {status}")
    return sites.select("url", "name", F.lit(status).alias("status"), at.alias("status_time"), (F.lit(None) if error is None else error).cast("string").alias("last_error"))
