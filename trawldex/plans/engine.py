"""What a user calls: start and stop indexing, index one page, search, statistics."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from hashlib import sha256
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.operators import analyzer, routing, search, stats
from trawldex.plans import results
from trawldex.plans.store import Store
from trawldex.functions import urls
from trawldex.sources import fetch, files, tables
from trawldex.sources.config import Settings, Site
from trawldex.sources.crawl import Crawl, page_id
from trawldex.sources.scratch import materialize

log = logging.getLogger("trawldex")
GATHERERS = 4  # sites that are gathered at once
SITES = "url string, name string, status string, status_time timestamp, last_error string"


class EngineError(RuntimeError):
    """A call that cannot be answered now."""


class Engine:
    """An index of the configured sites' pages in a shared folder.

    source: a function that gives the crawled pages of all sites (page_id, url, html, optionally code). Without one, each site is gathered by itself:
    by site_source (a function of the site that gives its pages), by default a crawl over HTTP that goes on where a stopped one was.
    Sites are gathered side by side under job tags of their own, so one can fail or be stopped and the others are indexed; each has a status, touched
    as its pages come in. Indexing runs in a thread of its own under a Spark job group, so that stopping cancels its jobs; a build that is
    stopped or fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, settings: Settings, path: str, source: Callable[[], DataFrame] | None = None, lex: DataFrame | None = None, profile: str = "latin", model: DataFrame | None = None, site_source: Callable[[Site], DataFrame] | None = None):
        self.spark, self.settings, self.path, self.source = spark, settings, path.rstrip("/"), source
        self.lex = analyzer.lexicon_for_join(analyzer.lexicon(spark) if lex is None else lex)
        self.profile, self.site_source = profile, site_source or self._crawled
        self.store = Store(spark, f"{self.path}/index", self.lex, profile, model)
        self._lock, self._worker, self._stopped = Lock(), None, False
        self._saving, self._cancelled = Lock(), set()
        if settings.debug:
            log.setLevel(logging.DEBUG)

    # sites

    def sites(self) -> DataFrame:
        """Stored sites; the latest written table counts."""
        done = [n for n in files.names(self.spark, f"{self.path}/sites") if files.exists(self.spark, f"{self.path}/sites/{n}/_SUCCESS")]
        return self.spark.read.schema(SITES).parquet(f"{self.path}/sites/{max(done)}") if done else self.spark.createDataFrame([], SITES)

    def _save_sites(self, rows: DataFrame) -> None:
        found = files.names(self.spark, f"{self.path}/sites")
        rows.select("url", "name", "status", "status_time", "last_error").coalesce(1).write.parquet(f"{self.path}/sites/{int(max(found, default='0')) + 1:010d}")

    def _mark(self, status: str, error: str | None = None) -> None:
        """All configured sites get the status; sites that are no longer configured go."""
        self._save_sites(tables.mark_sites(self.settings.site_table(self.spark), status, F.current_timestamp(), None if error is None else F.lit(error)))

    def _mark_site(self, site: Site, status: str, error: str | None = None) -> None:
        """One configured site gets the status, now; the others keep theirs."""
        with self._saving:
            mine = self.spark.createDataFrame([(site.url, site.name)], "url string, name string")
            other = self.sites().filter(F.col("url") != site.url)
            self._save_sites(other.unionByName(tables.mark_sites(mine, status, F.current_timestamp(), None if error is None else F.lit(error))))

    # gathering

    def _tag(self, site: Site) -> str:
        return "trawldex-" + sha256(site.url.encode()).hexdigest()[:16]

    def _crawled(self, site: Site) -> DataFrame:
        """Pages of a site over HTTP."""
        at = f"{self.path}/crawls/{self._tag(site)}"
        found = Crawl.latest(self.spark, at, lambda urls: fetch.fetch(urls, self.settings.web_request), lambda _: self._mark_site(site, "INDEXING"))
        roots = self.spark.createDataFrame([(site.url, site.url)], "site string, url string")
        found.run(roots)
        return found.pages()

    def _gather(self, site: Site) -> DataFrame | str:
        """The site's pages, written; or what went wrong."""
        context = self.spark.sparkContext
        context.setJobGroup("trawldex-indexing", "indexing", interruptOnCancel=True)
        context.addJobTag(self._tag(site))
        try:
            pages = self.site_source(site)
            columns = ["page_id", "url", "html", "code"] if "code" in pages.columns else ["page_id", "url", "html", F.lit(200).alias("code")]
            written = materialize(pages.select(*columns), "gathered")
            if written.isEmpty():
                return "the site has no pages"
            if site.url in self._cancelled:
                return "stopped by the user"
            self._mark_site(site, "INDEXING")
            return written
        except Exception as failure:
            return "stopped by the user" if self._stopped or site.url in self._cancelled else f"{type(failure).__name__}: {failure}"[:255]
        finally:
            context.removeJobTag(self._tag(site))

    def stop_site(self, url: str) -> None:
        """Stop the gathering of one configured site; the others go on."""
        site = next((s for s in self.settings.sites if s.url == url), None)
        if site is None or not self.is_indexing():
            raise EngineError("the site is not being indexed")
        self._cancelled.add(url)
        self.spark.sparkContext.cancelJobsWithTag(self._tag(site))

    def _build_sites(self) -> None:
        """Gather every site, then index what came in, in one build."""
        with ThreadPoolExecutor(GATHERERS) as pool:
            found = dict(zip(self.settings.sites, pool.map(self._gather, self.settings.sites), strict=True))
        good = {s: rows for s, rows in found.items() if not isinstance(rows, str)}
        for site, error in found.items():
            if site not in good:
                self._mark_site(site, "FAILED", error)
        if good and not self._stopped:
            pages = reduce(DataFrame.unionByName, good.values())
            self.store.build(self._routed(pages), F.col("code"))
        for site in good:
            self._mark_site(site, "FAILED" if self._stopped else "INDEXED", "stopped by the user" if self._stopped else None)

    # indexing

    def is_indexing(self) -> bool:
        """Whether a worker runs here, or a stored site is still marked as being indexed by another session."""
        if self._worker is not None and self._worker.is_alive():
            return True
        own = self.settings.site_table(self.spark).select("url")
        return not self.sites().filter("status = 'INDEXING'").join(own, "url", "left_semi").isEmpty()

    def start_indexing(self) -> None:
        with self._lock:
            if self.is_indexing():
                raise EngineError("indexing is already in progress")
            self._stopped = False
            self._cancelled.clear()
            self._mark("INDEXING")
            self._worker = InheritableThread(target=self._build, name="trawldex-indexing", session=self.spark)
            self._worker.start()

    def _routed(self, pages: DataFrame) -> DataFrame:
        """Pages of configured sites, whatever their number."""
        sites = routing.listed(self.spark, [s.url for s in self.settings.sites])
        return routing.route(pages, sites).filter("routed_to IS NOT NULL").drop("routed_to")

    def _build(self) -> None:
        self.spark.sparkContext.setJobGroup("trawldex-indexing", "indexing", interruptOnCancel=True)
        try:
            log.debug("indexing of %s begins", [s.url for s in self.settings.sites])
            if self.source is None:
                self._build_sites()
                return
            pages = self.source()
            self.store.build(self._routed(pages), F.col("code") if "code" in pages.columns else None)
            status, error = "INDEXED", None
        except Exception as failure:  # whatever went wrong is kept with the sites
            status, error = "FAILED", "stopped by the user" if self._stopped else f"{type(failure).__name__}: {failure}"[:255]
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if self._stopped:
            status, error = "FAILED", "stopped by the user"
        log.debug("indexing ends: %s %s", status, error or "")
        self._mark(status, error)

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the worker; False if it still runs after so many seconds."""
        if self._worker is not None:
            self._worker.join(seconds)
            return not self._worker.is_alive()
        return True

    def stop_indexing(self) -> None:
        with self._lock:
            if not self.is_indexing():
                raise EngineError("indexing is not in progress")
            self._stopped = True
            if self._worker is not None and self._worker.is_alive():
                self.spark.sparkContext.cancelJobGroup("trawldex-indexing")
                self._worker.join()
            else:  # marked by a session that is gone
                self._mark("FAILED", "stopped by the user")

    def index_page(self, page_id: int, url: str, content: str, code: int = 200) -> None:
        """Index or replace one page (html) of a configured site; a site that is not stored yet is created."""
        with self._lock:
            if self.is_indexing():
                raise EngineError("indexing is in progress")
            site = next((s for s in self.settings.sites if s.url in url), None)
            if site is None:
                raise EngineError("the page lies outside the configured sites")
            page = self.spark.createDataFrame([(page_id, url, content, code)], "page_id long, url string, html string, code int")
            self.store.upsert(page, code=F.col("code"))
            stored = self.sites()
            other = stored.filter(F.col("url") != site.url)
            mine = self.spark.createDataFrame([(site.url, site.name)], "url string, name string")
            self._save_sites(other.unionByName(tables.mark_sites(mine, "INDEXED", F.current_timestamp())))

    def index_url(self, url: str) -> int:
        """Fetch one page of a configured site and index or replace it; the id of the page. A known path keeps its id."""
        site = next((s for s in self.settings.sites if s.url in url), None)
        if site is None:
            raise EngineError("the page lies outside the configured sites")
        one = self.spark.createDataFrame([(url,)], "url string")
        answer = fetch.fetch(one, self.settings.web_request, 0.0).withColumn("page_id", page_id(F.lit(site.url), F.col("url"))).withColumn("path", urls.path_of(F.col("url"), F.lit(site.url))).first()
        if answer.html is None:
            raise EngineError(f"the page cannot be fetched: {answer.error or answer.code}")
        known = self.store.by_path(site.url, answer.path).first() if self.store.exists() else None
        number = answer.page_id if known is None else known.page_id
        self.index_page(number, url, answer.html, answer.code)
        return number

    # answers

    def search(self, query: str, site: str | None = None, offset: int = 0, limit: int = 20) -> dict:
        """{result, count, data}: data has site, siteName, uri, title, snippet, relevance of one page of results, best first."""
        search.validate(query, site, offset, limit)
        known = {s.url: s.name for s in self.settings.sites}
        if site is not None:
            if site not in known or self.sites().filter((F.col("url") == site) & (F.col("status") == "INDEXED")).isEmpty():
                raise search.SearchError("the site is not indexed")
        found = results.matches(self.store, query, self.settings.max_relative_frequency, site).persist()
        try:
            count = found.count()
            page = results.with_snippets(self.store, found, query, self.settings.snippet_radius, offset, limit)
            rows = page.collect()  # at most `limit` rows
        finally:
            found.unpersist()
        data = [{"site": r.site, "siteName": known.get(r.site, ""), "uri": r.uri, "title": r.title, "snippet": r.snippet, "relevance": r.relevance} for r in rows]
        return {"result": True, "count": count, "data": data}

    def statistics(self) -> dict:
        """{result, statistics: {total, detailed}}: one item for each configured site."""
        configured, counts = self.settings.site_table(self.spark), self.store.counts()
        total = stats.total_stats(configured, counts, self.is_indexing()).first().asDict()
        detailed = [r.asDict() for r in stats.site_stats(configured, self.sites(), counts).orderBy("url").collect()]  # one row a configured site
        return {"result": True, "statistics": {"total": total, "detailed": detailed}}
