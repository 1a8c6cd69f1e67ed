import pytest

from trawldex.plans import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, same):
    same(core.queries()[name], SQL[name])


def test_every_query_is_checked_by_sql_or_here():
    assert set(core.queries()) == set(SQL)


def test_snippets(spark, sf):
    rows = core.queries()["snippets"](spark, sf).collect()
    assert rows and all(r.snippet == "" or (r.snippet.startswith("... ") and r.snippet.endswith(" ...") and "<b>" in r.snippet) for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_invariants(spark, sf):
    from pyspark.sql import functions as F

    from trawldex.operators import index, stats
    from trawldex.plans import views

    tf = views.term_rows(spark, sf)
    assert tf.count() == tf.select("page_id", "lemma").distinct().count()
    df = index.doc_freq(tf).join(stats.pages_per_site(views.pages(spark, sf)), "site")
    assert df.filter("frequency > n_pages").isEmpty()
    kept = views.words(spark, sf)
    from trawldex.operators import analyzer

    assert tf.agg(F.sum("rank")).first()[0] == analyzer.lemmas(kept, views.lex(spark)).count()
    whole = [r.page_id for r in views.results(spark, sf, limit=40).collect()]
    parts = [r.page_id for o in (0, 20) for r in views.results(spark, sf, offset=o).collect()]
    assert parts == whole


def test_upsert_equals_rebuild(spark, sf):
    from pyspark.sql import functions as F

    from trawldex.operators import analyzer, index
    from trawldex.plans import views

    pages = views.pages(spark, sf).select("site", "page_id", "content")
    revised = core._revised(spark, sf)
    rebuilt = index.replace_pages(pages, revised, ["site", "page_id"], revised)
    tf = index.term_freq(analyzer.lemmas(analyzer.token_rows(rebuilt, ["site", "page_id"]), views.lex(spark)))
    for ours, theirs in ((core.upsert_page(spark, sf), tf), (core.upsert_lemma_df(spark, sf), index.doc_freq(tf))):
        assert ours.select(*theirs.columns).exceptAll(theirs).isEmpty() and theirs.exceptAll(ours.select(*theirs.columns)).isEmpty()


@pytest.mark.parametrize("name", ["pages_per_site", "build_index", "relevance", "search_blocks", "dedupe_urls"])
def test_pages_of_equal_addresses_all_count(spark, tmp_path, name):
    """As the SQL has it, each row of the table is a page."""
    import duckdb

    rows = [(i, f"http://a.com/p{i % 7}{'/' * (i % 2)}", f"<title>t</title><p>the fox is {'that' if i % 3 else 'red'} w{i}</p>") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        cur = con.execute(SQL[name])
        names, wanted = [c[0] for c in cur.description], sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in core.queries()[name](spark, str(tmp_path)).collect()) == wanted


@pytest.mark.parametrize("name, most", [("doc_postings", 2), ("doc_freq", 2), ("term_freq", 1), ("morph_terms", 2)])
def test_words_move_once(spark, sf, name, most):
    """Texts are dealt by page before they are cut: then only sums by lemma move."""
    rows = core.queries()[name](spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan
