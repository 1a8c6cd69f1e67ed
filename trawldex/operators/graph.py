"""Link graph: links of pages, reachability by breadth-first search."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawldex.functions import html, urls
from trawldex.sources.scratch import discard, materialize


def page_links(pages: DataFrame) -> DataFrame:
    """site, page_id, url, href: every anchor of every page (pages: site, page_id, url, html)."""
    return pages.select("site", "page_id", "url", F.explode(html.links(F.col("html"))).alias("href"))


def resolved_links(links: DataFrame) -> DataFrame:
    """Distinct links in their site's scope, without links of a page to itself."""
    rows = links.select("site", "page_id", F.col("url").alias("src"), urls.normalize(F.col("href"), F.col("site")).alias("dst"))
    return rows.filter(urls.in_scope(F.col("dst"), F.col("site")) & (urls.key(F.col("src")) != urls.key(F.col("dst")))).distinct()


def resolved(page: Column, url: Column, site: Column) -> Column:
    """Array of a page's distinct links in its site's scope, without those to itself."""
    found = F.array_distinct(F.transform(html.links(page), lambda href: urls.normalize(href, site)))
    return F.filter(found, lambda link: urls.in_scope(link, site) & (urls.key(link) != urls.key(url)))


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """keys, node, depth of every node that seeds (keys, node) reach over edges (keys, src, dst).

    Each round expands only the last frontier, until there is none; if there still is one after max_depth rounds, this raises.
    What is visited is a table in the scratch folder, written anew every 32 rounds, so lineage stays short; the tables that it replaces go.
    """
    spark, made = seeds.sparkSession, []
    visited = materialize(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)), "reach", made)
    frontier = visited
    for depth in count(1):
        step = frontier.select(*keys, F.col("node").alias("src")).join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(visited, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach", made)
        if frontier.isEmpty():
            discard(spark, [made.pop()])
            return visited
        if max_depth is not None and depth > max_depth:
            discard(spark, made)
            raise RuntimeError(f"nodes lie more than {max_depth} links from the seeds")
        visited = visited.unionByName(frontier)
        if depth % 32 == 0:
            visited = materialize(visited, "reach", made)
            discard(spark, made, 2)  # the frontier and what is visited


def flatten(tree: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root, depth of a forest (keys, node, parent; no parent: a root): how far above every node its root is.

    Every node knows an ancestor and how far up it is; in each round it takes over what that ancestor knows, so the known distance doubles and the
    number of rounds grows with the logarithm of the depth. Nodes that have reached their root move no more. A node whose parent is not in the
    table is a root; a cycle raises.
    """
    spark, made = tree.sparkSession, []
    names = tree.select(*keys, F.col("node").alias("parent"))
    held = tree.join(names.withColumn("held", F.lit(True)), [*keys, "parent"], "left")
    start = held.select(*keys, "node", F.when(F.col("held"), F.col("parent")).otherwise(F.col("node")).alias("root"), F.when(F.col("held"), 1).otherwise(0).cast("long").alias("depth"))
    state = materialize(start, "flatten", made)
    most = max(1, state.count()).bit_length() + 1
    for _ in range(most):
        above = state.select(*keys, F.col("node").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"))
        going = state.filter("depth > 0").join(above, [*keys, "root"]).filter("more > 0")
        moved = materialize(going.select(*keys, "node", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "flatten", made)
        if moved.isEmpty():
            discard(spark, [made.pop()])
            return state
        # what did not move stays as it is
        rest = state.join(moved.select(*keys, "node"), [*keys, "node"], "left_anti")
        state = materialize(rest.unionByName(moved), "flatten", made)
        discard(spark, made, 1)
    discard(spark, made)
    raise ValueError("the links of the tree run in a circle")


def crawl(roots: DataFrame, get: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """Rows (site, url, depth, code, html) of every page that roots (site, url) reach over links in their site's scope.

    get: gives (url, code, html) of addresses (url). Each round fetches what the last one found and nothing has visited under a leniently
    equal address; answers of 302 are dropped and not followed. If there is more after max_depth rounds, this raises.
    """
    spark, made = roots.sparkSession, []
    frontier = materialize(roots.select("site", "url").groupBy(urls.key(F.col("url")).alias("key")).agg(F.min_by("site", "url").alias("site"), F.min("url").alias("url")), "crawl", made)
    seen, pages = frontier.select("key"), None
    for depth in count(0):
        if max_depth is not None and depth > max_depth:
            discard(spark, made)
            raise RuntimeError(f"pages lie more than {max_depth} links from the roots")
        got = frontier.select("site", "url").join(get(frontier.select("url")).select("url", "code", "html"), "url")
        got = materialize(got.filter("code IS NULL OR code <> 302").withColumn("depth", F.lit(depth)), "crawl", made)
        pages = got if pages is None else pages.unionByName(got)
        links = resolved_links(page_links(got.withColumn("page_id", F.lit(0))))
        step = links.select(urls.key(F.col("dst")).alias("key"), "site", F.col("dst").alias("url")).groupBy("key").agg(F.min_by("site", "url").alias("site"), F.min("url").alias("url"))
        frontier = materialize(step.join(seen, "key", "left_anti"), "crawl", made)
        if frontier.isEmpty():
            discard(spark, [made.pop()])
            return pages.select("site", "url", "depth", "code", "html")
        seen = seen.unionByName(frontier.select("key"))
        if depth % 32 == 31:
            seen, pages = materialize(seen, "crawl", made), materialize(pages, "crawl", made)
            discard(spark, made, 3)  # the frontier, what is seen and the pages
