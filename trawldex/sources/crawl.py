"""A crawl that is kept: rounds of fetched pages in a folder, so that a stopped crawl goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.operators import graph
from trawldex.functions import urls
from trawldex.sources import files

ROWS = "site string, key string, url string, page_id long, depth int, code int, html string, links array<string>"


def page_id(site: Column, url: Column) -> Column:
    """The id of a page: it follows from its site and address (leniently equal ones have one), so it is the same in every crawl."""
    return F.xxhash64(site, urls.key(url)).bitwiseAND(F.lit((1 << 63) - 1))


class Crawl:
    """Rounds of a crawl in a folder that driver and executors share.

    Round n holds what was fetched n links from the roots, with the links found there; it counts once its marker stands, so a round that was lost is
    fetched again and no other. What is known is read from the rounds themselves.
    """

    def __init__(self, spark: SparkSession, path: str, get: Callable[[DataFrame], DataFrame], on_round: Callable[[int], None] | None = None):
        self.spark, self.path, self.get, self.on_round = spark, path.rstrip("/"), get, on_round

    @classmethod
    def latest(cls, spark: SparkSession, path: str, get: Callable[[DataFrame], DataFrame], on_round: Callable[[int], None] | None = None) -> Crawl:
        """The crawl in the folder that is not finished, or a new one."""
        names = files.names(spark, path)
        last = cls(spark, f"{path}/{max(names)}", get, on_round) if names else None
        return last if last is not None and not last.finished() else cls(spark, f"{path}/{len(names):010d}", get, on_round)

    def finished(self) -> bool:
        return files.exists(self.spark, f"{self.path}/finished")

    def rounds(self) -> int:
        return len(files.names(self.spark, f"{self.path}/done"))

    def _read(self, rounds: range) -> DataFrame:
        found = [f"{self.path}/rounds/{n}" for n in rounds]
        return self.spark.read.schema(ROWS).parquet(*found) if found else self.spark.createDataFrame([], ROWS)

    def pages(self) -> DataFrame:
        """page_id, url, html, code, depth of what was fetched so far; redirects are not followed and are no pages."""
        return self._read(range(self.rounds())).filter("code IS NULL OR code <> 302").select("page_id", "url", "html", "code", "depth")

    def _frontier(self, roots: DataFrame, n: int) -> DataFrame:
        """site, key, url of what comes next: of leniently equal addresses one."""
        if n == 0:
            found = roots.select("site", "url")
        else:
            found = self._read(range(n - 1, n)).select("site", F.explode("links").alias("url"))
        found = found.select("site", urls.key(F.col("url")).alias("key"), "url").groupBy("key").agg(F.min_by("site", "url").alias("site"), F.min("url").alias("url"))
        return found.join(self._read(range(n)).select("key"), "key", "left_anti")

    def run(self, roots: DataFrame, rounds: int | None = None) -> bool:
        """Fetch round by round from roots (site, url) on; False if it stops after so many rounds with more to fetch."""
        n = self.rounds()
        last = None if rounds is None else n + rounds
        while not self.finished():
            frontier = self._frontier(roots, n)
            if frontier.isEmpty():
                files.touch(self.spark, f"{self.path}/finished")
                break
            if n == last:
                return False
            got = frontier.join(self.get(frontier.select("url")).select("url", "code", "html"), "url").withColumn("page_id", page_id(F.col("site"), F.col("url")))
            links = F.coalesce(graph.resolved(F.col("html"), F.col("url"), F.col("site")), F.array().cast("array<string>"))
            rows = got.select("site", "key", "url", "page_id", F.lit(n).alias("depth"), "code", "html", F.when(F.coalesce(F.col("code") == 302, F.lit(False)), F.array().cast("array<string>")).otherwise(links).alias("links"))
            rows.write.mode("overwrite").parquet(f"{self.path}/rounds/{n}")
            files.touch(self.spark, f"{self.path}/done/round-{n}")
            n += 1
            if self.on_round is not None:
                self.on_round(n)
        return True
