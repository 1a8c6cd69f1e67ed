"""Registry of the engine's own queries. Their DuckDB SQL is in `oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.functions import html, markup, numbers, urls
from trawldex.operators import analyzer, graph, index, morphology, routing, search, snippets, stats
from trawldex.plans import oracle, results, views
from trawldex.plans.store import opened
from trawldex.sources import tables
from trawldex.sources.scratch import materialize, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]



def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load(spark, sf, "pages").withColumn("site", urls.site_of(F.col("url")))


def _first_site(spark: SparkSession, sf: str) -> DataFrame:
    """The site of the page with the least id, as one row."""
    return _raw(spark, sf).agg(F.min_by("site", "page_id").alias("site"))


def _of_first_site(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return rows.join(F.broadcast(_first_site(spark, sf)), "site", "left_semi")


def build_index(spark, sf):
    """A full build, which later queries of the session read; its size by table."""
    at = opened(spark, sf, views.lex(spark), scratch_dir(spark), anew=True)
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in (("pages", at.pages()), ("lemmas", at.lemmas()), ("postings", at.postings()))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def scan_pages(spark, sf):
    return tables.load(spark, sf, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


def pages_of_site(spark, sf):
    return _of_first_site(_raw(spark, sf).select("site", "page_id", "url"), spark, sf)


def site_by_url(spark, sf):
    return _of_first_site(_raw(spark, sf).select("site").distinct(), spark, sf)


def page_path(spark, sf):
    return _raw(spark, sf).select("page_id", urls.path_of(F.col("url"), F.col("site")).alias("path"))


def page_by_path(spark, sf):
    """The page with the path that the first page has, by the stored paths: one key, one part."""
    rows = _raw(spark, sf).select("site", "page_id", urls.path_of(F.col("url"), F.col("site")).alias("path"))
    one = rows.agg(F.min_by(F.struct("site", "path"), "page_id").alias("k")).select("k.site", "k.path").first()
    return views.store(spark, sf).by_path(one.site, one.path).select("site", "path", "page_id")


def page_title(spark, sf):
    return tables.load(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def markup_text(spark, sf):
    """Text and title of every page that has text, by the reader that knows where tags end."""
    rows = markup.read_pages(_raw(spark, sf).select("page_id", "site", "html"))
    return rows.filter("site <> '' AND text <> ''").select("page_id", "text", "title")


def page_markup(spark, sf):
    """Every page's markup in one spelling."""
    return markup.read_pages(_raw(spark, sf).select("page_id", "html")).select("page_id", "markup")


def page_text(spark, sf):
    return views.pages(spark, sf).select("page_id", "content")


def strip_inline_tags(spark, sf):
    return tables.load(spark, sf, "pages").select("page_id", html.strip_inline_tags(F.col("html")).alias("stripped"))


def extract_links(spark, sf):
    return graph.page_links(_raw(spark, sf)).select("page_id", "href")


def normalize_url(spark, sf):
    return graph.page_links(_raw(spark, sf)).select("page_id", "href", urls.normalize(F.col("href"), F.col("site")).alias("link"))


def is_file_link(spark, sf):
    every = graph.page_links(_raw(spark, sf)).select("href").union(_raw(spark, sf).select(F.col("url").alias("href")))
    return every.distinct().select("href", urls.is_file(F.col("href")).alias("is_file"))


def valid_site_url(spark, sf):
    return _raw(spark, sf).select("page_id", urls.is_http(F.col("site")).alias("valid"), urls.is_http(F.col("url")).alias("url_valid"))


def dedupe_urls(spark, sf):
    rows = _raw(spark, sf).select("page_id", urls.key(F.col("url")).alias("url_key"))
    return rows.groupBy("url_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def resolve_links(spark, sf):
    return graph.resolved_links(graph.page_links(_raw(spark, sf)))


def site_routing(spark, sf):
    """Each page with the first site that its url contains, or null; all sites of the table are configured, in the order of their addresses."""
    sites = _raw(spark, sf).select(F.col("site").alias("url")).distinct().orderBy("url").withColumn("place", F.monotonically_increasing_id())
    return routing.route(_raw(spark, sf).select("page_id", "url"), sites).select("page_id", "routed_to")


def crawl_links(spark, sf):
    """Reachability over the links that the pages really have: from each site's first page on, over links in scope."""
    links = resolve_links(spark, sf).select("site", urls.key(F.col("src")).alias("src"), urls.key(F.col("dst")).alias("dst"))
    seeds = _raw(spark, sf).groupBy("site").agg(urls.key(F.min_by("url", "page_id")).alias("node"))
    return graph.reach(links, seeds, ["site"]).select("site", "node", F.col("depth").cast("long").alias("depth"))


def crawl_reach(spark, sf):
    """A derived tree of pages, flattened: the k-th page of a site is where the pages 2k and 2k + 1 were found."""
    from pyspark.sql.window import Window as W

    nodes = _raw(spark, sf).select("site", F.row_number().over(W.partitionBy("site").orderBy("page_id")).cast("long").alias("k"))
    parent = F.when(F.col("k") > 1, F.shiftright("k", 1))
    return graph.flatten(nodes.select("site", F.col("k").alias("node"), parent.alias("parent")), ["site"]).select("site", "node", "depth")


def tokenize_docs(spark, sf):
    rows = views.doc_words(spark, sf)
    return rows.groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("word").alias("n_distinct"))


def lemmatize(spark, sf):
    return analyzer.analyses(views.words(spark, sf), views.lex(spark)).select("site", "page_id", "pos", "word", "lemma", F.coalesce("pos_tag", F.lit("")).alias("pos_tag"))


def stop_filter(spark, sf):
    return analyzer.lemmas(views.words(spark, sf), views.lex(spark)).select("page_id", "pos", "lemma")


def morph_rules(spark, sf):
    """The trie of endings that the documents teach: one row for each rule of a suffix."""
    return views.model(spark, sf)[0].select("suffix", F.explode("rules").alias("r")).select("suffix", F.col("r.strip").cast("long").alias("strip"), "r.ending", "r.pos_tag")


def morph_pages(spark, sf):
    """Analyses of every word of the pages: listed, guessed by its ending, or itself."""
    words = views.words(spark, sf).select("word").distinct()
    return analyzer.analyses(words, views.lex(spark), *views.model(spark, sf)).select("word", "lemma", F.coalesce("pos_tag", F.lit("")).alias("pos_tag"))


def morph_terms(spark, sf):
    """Occurrences and documents of each kept lemma by source, with guessed lemmas: words are counted before they are analysed."""
    words = analyzer.page_words(tables.corpus_pages(tables.load(spark, sf, "documents")), ["site", "page_id"])
    kept = analyzer.lemmas(words, views.lex(spark), *views.model(spark, sf)).groupBy("site", "page_id", "lemma").agg(F.sum("n").alias("n"))
    return kept.groupBy("site", "lemma").agg(F.sum("n").alias("occurrences"), F.count("*").alias("frequency"))


def morph_accuracy(spark, sf):
    """Held-out words of the documents' own lexicon, and how many of them the rest teaches."""
    lex = materialize(views.derived_lex(spark, sf), "derived")
    return morphology.accuracy(lex.filter(~views.held_out()), lex.filter(views.held_out()))


def query_lemmas(spark, sf):
    """Distinct lemmas of many queries at once: every page's title is one."""
    queries = views.pages(spark, sf).select("page_id", F.col("title").alias("content"))
    return analyzer.lemmas(analyzer.page_words(queries, ["page_id"]), views.lex(spark)).select("page_id", "lemma").distinct()


def matched_words(spark, sf):
    return analyzer.matched_words(views.words(spark, sf), views.lex(spark), F.broadcast(views.wanted(spark)), ["page_id"])


def term_freq(spark, sf):
    return views.term_rows(spark, sf)


def doc_freq(spark, sf):
    return index.doc_freq(views.term_rows(spark, sf))


def postings(spark, sf):
    tf = materialize(views.term_rows(spark, sf), "terms")  # read twice
    return index.postings(tf, index.doc_freq(tf))


def doc_postings(spark, sf):
    return views.doc_terms(spark, sf).groupBy("site", "lemma").agg(F.sum("rank").alias("occurrences"), F.count("*").alias("frequency"))


def lemmas_of_site(spark, sf):
    return _of_first_site(views.store(spark, sf).lemmas(), spark, sf).select("site", "lemma", "frequency")


def lemma_in_list(spark, sf):
    at = views.store(spark, sf)
    return at.lemmas(results.query_lemmas(at, views.QUERY))


def postings_of_page(spark, sf):
    return _of_first_page(spark, sf).select("page_id", "lemma", "rank")


def postings_semi(spark, sf):
    at = views.store(spark, sf)
    return _of_first_site(at.postings(results.query_lemmas(at, views.QUERY)), spark, sf).select("site", "page_id", "lemma", "rank")


def lemmas_of_page(spark, sf):
    """Stored lemma rows of the lemmas that the first page holds."""
    at, page = views.store(spark, sf), _of_first_page(spark, sf)
    return at.lemmas_of(page).join(page.select("site", "lemma"), ["site", "lemma"], "left_semi")


def _of_first_page(spark, sf):
    """Postings of the page with the least id, by its key in the forward index."""
    one = _raw(spark, sf).agg(F.min_by(F.struct("site", "page_id"), "page_id").alias("k")).select("k.*").first()
    return views.store(spark, sf).postings_of([(one.site, one.page_id)])


def pages_per_site(spark, sf):
    return views.store(spark, sf).counts().select("site", F.col("pages").alias("n_pages"))


def lemmas_per_site(spark, sf):
    return views.store(spark, sf).counts().filter("lemmas > 0").select("site", F.col("lemmas").alias("n_lemmas"))


def _configured(spark, sf):
    """Configured sites: those of the pages, and one that was never crawled."""
    own = _raw(spark, sf).select(F.col("site").alias("url")).distinct()
    return own.union(spark.range(1).select(F.lit("http://never.example.com").alias("url"))).withColumn("name", F.regexp_replace("url", "^https?://", ""))


def total_stats(spark, sf):
    return stats.total_stats(_configured(spark, sf), views.store(spark, sf).counts())


def site_stats(spark, sf):
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    stored = tables.mark_sites(_configured(spark, sf).filter("url NOT LIKE '%never%'"), "INDEXED", at)
    return stats.site_stats(_configured(spark, sf), stored, views.store(spark, sf).counts(), at)


def fmt_status_time(spark, sf):
    return tables.load(spark, sf, "events").select("event_id", numbers.status_time(F.col("ts")).alias("status_time"), numbers.epoch_millis(F.col("ts")).alias("millis"))


def high_freq_filter(spark, sf):
    return search.keep_rare(views.store(spark, sf).lemmas(), pages_per_site(spark, sf), views.MOST)


def rare_first(spark, sf):
    return search.rare_first(lemma_in_list(spark, sf))


def pages_all_lemmas(spark, sf):
    return views.scores(spark, sf).select("site", "page_id")


def relevance(spark, sf):
    return search.relevance(views.scores(spark, sf))


def round_relevance(spark, sf):
    return search.relevance(views.scores(spark, sf)).select("page_id", numbers.round_half_up(F.col("relevance")).alias("relevance"))


def search_all(spark, sf):
    return views.results(spark, sf, limit=None)


def search_top(spark, sf):
    return views.results(spark, sf)


def search_site(spark, sf):
    at, site = views.store(spark, sf), _first_site(spark, sf).first().site
    return results.page(at, results.matches(at, views.QUERY, views.MOST, site), limit=None)


def search_blocks(spark, sf):
    """Blocks of postings of each kept lemma, and how many of them a search opens: those where the site's rarest lemma has pages."""
    at = views.store(spark, sf)
    lemmas = results.query_lemmas(at, views.QUERY)
    every, wanted = results.candidate_blocks(at, results.kept_lemmas(at, lemmas, views.MOST), lemmas)
    count = lambda rows, n: rows.groupBy("site", "lemma").agg(F.count("*").alias(n))
    rows = count(every, "n_blocks").join(count(wanted, "n_read"), ["site", "lemma"], "left").withColumn("n_read", F.coalesce("n_read", F.lit(0).cast("long")))
    return rows.select("site", "lemma", "n_blocks", "n_read", (F.col("n_blocks") - F.col("n_read")).alias("n_skipped"))


def search_page2(spark, sf):
    return views.results(spark, sf, offset=20, limit=20)


def search_count(spark, sf):
    return views.scores(spark, sf).agg(F.count("*").alias("n"))


def word_positions(spark, sf):
    """First place of each matched word in the lower-cased text, from 0."""
    rows = matched_words(spark, sf).join(views.pages(spark, sf).select("page_id", "content"), "page_id")
    return rows.select("page_id", "word", (F.position("word", F.lower("content")) - 1).cast("long").alias("at")).filter("at >= 0")


def _windows(spark, sf):
    """Token places (from 1) of matched words and the windows around them."""
    at = F.col("first_pos") + 1
    return matched_words(spark, sf).select("page_id", "word", at.cast("long").alias("at"), F.greatest(at - views.RADIUS, F.lit(1)).cast("long").alias("start"), (at + views.RADIUS).cast("long").alias("end"))


def snippet_window(spark, sf):
    words = views.pages(spark, sf).select("page_id", analyzer.tokens(F.col("content")).alias("words"))
    rows = matched_words(spark, sf).join(words, "page_id")
    return rows.select("page_id", "word", F.array_join(snippets.word_window(F.col("words"), F.col("first_pos") + 1, views.RADIUS), " ").alias("win"))


def merge_intervals(spark, sf):
    return snippets.merge_intervals(_windows(spark, sf).select("page_id", "start", "end"), ["page_id"])


def highlight(spark, sf):
    rows = matched_words(spark, sf).join(views.pages(spark, sf).select("page_id", "content"), "page_id")
    return rows.select("page_id", "word", snippets.highlight_first(F.col("content"), F.col("word")).alias("marked"))


def snippets_top(spark, sf):
    """The first result page with snippets: they are cut from its rows only."""
    at = views.store(spark, sf)
    return results.with_snippets(at, results.matches(at, views.QUERY, views.MOST), views.QUERY, views.RADIUS)


def reindex_cleanup(spark, sf):
    """Postings that stay when the sites of the ten first pages are indexed anew."""
    again = _raw(spark, sf).select("page_id", F.col("site").alias("url")).orderBy("page_id").limit(10)
    return tables.without_sites(views.store(spark, sf).postings(), again).select("site", "page_id", "lemma", "rank")


def _revised(spark, sf):
    """New content for the first page of each site: its title, twice."""
    rows = views.store(spark, sf).pages()
    first = rows.groupBy("site").agg(F.min("page_id").alias("page_id"))
    return rows.join(first, ["site", "page_id"], "left_semi").select("site", "page_id", F.concat_ws(" ", "title", "title").alias("content"))


def _revised_terms(spark, sf):
    return index.term_freq(analyzer.lemmas(analyzer.token_rows(_revised(spark, sf), ["site", "page_id"]), views.lex(spark)))


def upsert_page(spark, sf):
    return index.replace_pages(views.store(spark, sf).postings().select("site", "page_id", "lemma", "rank"), _revised_terms(spark, sf), ["site", "page_id"], _revised(spark, sf))


def upsert_lemma_df(spark, sf):
    at = views.store(spark, sf)
    gone = at.postings().join(_revised(spark, sf).select("site", "page_id"), ["site", "page_id"], "left_semi")
    return index.update_doc_freq(at.lemmas(), gone, _revised_terms(spark, sf))


_NAMES = {"search_top": "search", "snippets_top": "snippets"}
_ALL: list[Query] = [
    build_index, crawl_links, scan_pages, pages_of_site, site_by_url, page_path, page_by_path, page_title, page_text, markup_text, page_markup, strip_inline_tags, extract_links, normalize_url,
    is_file_link, valid_site_url, dedupe_urls, resolve_links, site_routing, crawl_reach, tokenize_docs, lemmatize, stop_filter, morph_rules, morph_pages, morph_terms, morph_accuracy, query_lemmas,
    matched_words, term_freq, doc_freq, postings, doc_postings, lemmas_of_site, lemma_in_list, postings_of_page, postings_semi, lemmas_of_page,
    pages_per_site, lemmas_per_site, total_stats, site_stats, fmt_status_time, high_freq_filter, rare_first, pages_all_lemmas, relevance,
    round_relevance, search_all, search_top, search_blocks, search_site, search_page2, search_count, word_positions, snippet_window, merge_intervals, highlight,
    snippets_top, reindex_cleanup, upsert_page, upsert_lemma_df,
]


def queries() -> dict[str, Query]:
    return {_NAMES.get(f.__name__, f.__name__): f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
