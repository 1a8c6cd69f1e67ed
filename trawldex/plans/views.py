"""Shared inputs of the registered queries: pages, tokens, term rows, and what a search needs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.operators import analyzer, index, morphology, search
from trawldex.plans import results as search_results
from trawldex.plans.store import Store, opened
from trawldex.sources import tables
from trawldex.sources.scratch import materialize, scratch_dir

QUERY = "the is that zzzz"
MOST = 0.95
RADIUS = 3
#: Endings of the derived lexicon, and the part of speech that each stands for.
ENDINGS = [("s", "NOUN"), ("e", "ADJ"), ("n", "VERB"), ("en", "VERB"), ("er", "NOUN"), ("er", "ADJ"), ("ment", "ADV")]


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.site_pages(tables.load(spark, sf, "pages"))


def lex(spark: SparkSession) -> DataFrame:
    """The lexicon in the code: small, so it is sent, and tokens stay where they are."""
    return F.broadcast(analyzer.lexicon_for_join(analyzer.lexicon(spark)))


def words(spark: SparkSession, sf: str) -> DataFrame:
    return analyzer.token_rows(pages(spark, sf).select("site", "page_id", "content"), ["site", "page_id"])


def term_rows(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_freq(analyzer.lemmas(analyzer.page_tokens(pages(spark, sf), ["site", "page_id"]), lex(spark)))


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    return analyzer.token_rows(tables.corpus_pages(tables.load(spark, sf, "documents")), ["site", "page_id"])


def doc_terms(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_freq(analyzer.lemmas(analyzer.page_tokens(tables.corpus_pages(tables.load(spark, sf, "documents")), ["site", "page_id"]), lex(spark)))


def doc_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of the documents; written, as several steps read them."""
    return materialize(doc_words(spark, sf).select("word").distinct(), "vocabulary")


def derived_lex(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon that the documents give: a word with an ending whose stem of four letters or more is a word as well is a form of it."""
    known = doc_vocabulary(spark, sf)
    fits = reduce(or_, [F.endswith("word", F.lit(e)) & (F.char_length("word") >= 4 + len(e)) for e, _ in ENDINGS])  # before there is a row for each ending
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(pos).alias("pos_tag")) for e, pos in ENDINGS]))
    forms = known.filter(fits).select("word", ends.alias("x")).filter(F.endswith("word", F.col("x.e")))
    forms = forms.select("word", F.substr("word", F.lit(1), F.char_length("word") - F.char_length("x.e")).alias("base_form"), "x.pos_tag").filter(F.char_length("base_form") >= 4)
    return forms.join(known.withColumnRenamed("word", "base_form"), "base_form", "left_semi").select("word", "base_form", "pos_tag")


def held_out() -> Column:
    """A fifth of the words, by their first letter: endings know nothing of it."""
    return F.ascii("word") % 5 == 0


def model(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Endings that the documents' own lexicon teaches, and whether they are few; written, as they are read for every word."""
    endings = materialize(morphology.learn(derived_lex(spark, sf)), "endings")
    return endings, endings.count() <= morphology.FEW


def wanted(spark: SparkSession, query: str = QUERY) -> DataFrame:
    return analyzer.query_lemmas(spark, query, lex(spark))


def store(spark: SparkSession, sf: str) -> Store:
    """The persisted index of the folder's pages."""
    return opened(spark, sf, lex(spark), scratch_dir(spark))


def scores(spark: SparkSession, sf: str, query: str = QUERY, most: float = MOST) -> DataFrame:
    """site, page_id, total, top of the pages that hold all kept lemmas."""
    return search_results.scores(store(spark, sf), query, most)


def results(spark: SparkSession, sf: str, site: str | None = None, offset: int = 0, limit: int | None = 20, query: str = QUERY) -> DataFrame:
    """site, page_id, uri, title, relevance, best first."""
    search.validate(query, site, offset, 0 if limit is None else limit)
    at = store(spark, sf)
    return search_results.page(at, search_results.matches(at, query, MOST, site), offset, limit)
