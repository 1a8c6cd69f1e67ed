"""Search on the persisted index: only what the query's lemmas and the rows of one result page need is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.operators import analyzer, search, snippets
from trawldex.plans.store import MOST_KEYS, Store


def query_lemmas(store: Store, query: str) -> list[str]:
    """The query's lemmas: no more than its words have analyses."""
    return sorted(r.lemma for r in analyzer.query_lemmas(store.spark, query, store.lex, store.profile, store.model).collect())


def _fixed_if_few(store: Store, rows: DataFrame) -> DataFrame:
    """The same rows; as rows of their own, to be broadcast, if there are no more than MOST_KEYS."""
    few = store._few(rows)
    return rows if few is None else F.broadcast(store.spark.createDataFrame(few, rows.schema))


def kept_lemmas(store: Store, lemmas: list[str], most: float, site: str | None = None) -> DataFrame:
    """site, lemma, frequency of the lemmas that are not too frequent in their site; how many pages a site has is stored."""
    df, counts = store.lemmas(lemmas), store.counts().select("site", F.col("pages").alias("n_pages"))
    if site is not None:
        df, counts = df.filter(F.col("site") == site), counts.filter(F.col("site") == site)
    return _fixed_if_few(store, search.keep_rare(df, counts, most))


def candidate_blocks(store: Store, kept: DataFrame, lemmas: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all, wanted): blocks of the kept lemmas, and those of them that can hold a result: where the site's rarest lemma has pages.

    Blocks are told apart by site, lemma and number alone; few numbers become a filter of the scan, so a frequent lemma beside a rare one is
    read in these places only.
    """
    blocks = store.blocks(lemmas)
    names = blocks.join(kept.select("site", "lemma"), ["site", "lemma"], "left_semi")
    rarest = kept.groupBy("site").agg(F.min_by("lemma", F.struct("frequency", "lemma")).alias("lemma"))
    places = blocks.select("site", "lemma", "block").join(rarest, ["site", "lemma"], "left_semi").select("site", "block").distinct()
    few, wanted = store._few(places), names
    if few is not None:
        places = F.broadcast(store.spark.createDataFrame(few, places.schema))
        wanted = names.filter(F.col("block").isin(*sorted({b for _, b in few})))
    return names, wanted.join(places, ["site", "block"], "left_semi")


def scores(store: Store, query: str, most: float, site: str | None = None) -> DataFrame:
    """site, page_id, total, top of the pages that hold all kept lemmas, from the blocks of the rarest lemma on."""
    lemmas = query_lemmas(store, query)
    kept = kept_lemmas(store, lemmas, most, site)
    _, wanted = candidate_blocks(store, kept, lemmas)
    return search.pages_with_all(store.opened(wanted), kept)


def matches(store: Store, query: str, most: float, site: str | None = None) -> DataFrame:
    return search.relevance(scores(store, query, most, site))


def _fixed(store: Store, found: DataFrame, offset: int, limit: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows of one result page, as rows of their own, and their keys."""
    top = [(r.site, r.page_id, r.relevance) for r in search.ranked(found, offset, limit).collect()]  # at most `limit` rows
    return store.spark.createDataFrame(top, "site string, page_id long, relevance double"), [(s, p) for s, p, _ in top]


def page(store: Store, found: DataFrame, offset: int = 0, limit: int | None = 20) -> DataFrame:
    """site, page_id, uri, title, relevance, best first. The keys of a page of at most MOST_KEYS rows are found first; then only their titles are read."""
    if limit is not None and limit <= MOST_KEYS:
        top, keys = _fixed(store, found, offset, limit)
        info = store.pages_of(keys)
    else:
        top, info = search.ranked(found, offset, limit), store.pages()
    info = info.select("site", "page_id", F.col("path").alias("uri"), "title")
    return search.in_order(top.join(info, ["site", "page_id"]).select("site", "page_id", "uri", "title", "relevance"))


def with_snippets(store: Store, found: DataFrame, query: str, radius: int, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of results with snippets. The words of the query and their places come from the forward index of these pages; windows are cut from their markup."""
    top, keys = _fixed(store, found, offset, min(limit, MOST_KEYS))
    lemmas = query_lemmas(store, query)
    hits = F.filter("terms", lambda t: t["lemma"].isin(*lemmas)) if lemmas else F.slice("terms", 1, 0)
    # by place, each word once: a word may have several of the lemmas
    words = F.array_distinct(F.transform(F.array_sort(F.transform(hits, lambda t: F.struct(t["pos"].alias("pos"), t["word"].alias("word")))), lambda x: x["word"]))
    listed = store.terms_of(keys).select("site", "page_id", words.alias("words"))
    info = store.pages_of(keys).select("site", "page_id", F.col("path").alias("uri"), "title", "body")
    rows = top.join(info, ["site", "page_id"]).join(listed, ["site", "page_id"], "left")
    return search.in_order(rows.select("site", "page_id", "uri", "title", "relevance", snippets.snippet(F.col("body"), F.col("words"), radius).alias("snippet")))
