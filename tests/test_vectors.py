"""Hand-derived vectors."""

import pytest
from pyspark.sql import functions as F

from trawldex.functions import html, numbers, urls
from trawldex.operators import analyzer, search, snippets
from trawldex.sources.config import Settings, Site


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, words",
    [("Раз, два - три кто-то -ёж foo", ["раз", "дватри", "кто-то", "-ёж"]), ("раз,два", ["раздва"]), ("", [])],
)
def test_tokens_ru(spark, text, words):
    assert _one(spark, analyzer.tokens(F.lit(text), "ru")) == words


@pytest.mark.parametrize(
    "href, is_file, link, scope",
    [
        ("/", False, "http://s.ru", True),
        ("/a?x=1#y", False, "http://s.ru/a", True),
        ("/a#y", False, "http://s.ru/a", True),
        ("/a#y?z", False, "http://s.ru/a#y", True),
        ("#top", False, "#top", False),
        ("b.html", False, "b.html", False),
        ("/f.pdf", True, "http://s.ru", True),
        ("http://other.com", True, "http://s.ru", True),
        ("http://other.com/x", False, "http://other.com/x", False),
        ("/v1.2.html", True, "http://s.ru", True),
        ("/a.html", False, "http://s.ru/a.html", True),
        ("/a.htm", False, "http://s.ru/a.htm", True),
        ("/p?x=1.5", True, "http://s.ru", True),
        ("/a.b/c", False, "http://s.ru/a.b/c", True),
        ("//cdn.ru/x", False, "http://s.ru//cdn.ru/x", True),
        ("http://e.com/http://s.ru/a", False, "http://e.com/http://s.ru/a", True),
        ("mailto:a@b.ru", True, "http://s.ru", True),
        ("tel:123", False, "tel:123", False),
    ],
)
def test_links(spark, href, is_file, link, scope):
    site, h = F.lit("http://s.ru"), F.lit(href)
    got = _one(spark, F.struct(urls.is_file(h), urls.normalize(h, site), urls.in_scope(urls.normalize(h, site), site)))
    assert tuple(got) == (is_file, link, scope)


@pytest.mark.parametrize("a, b, equal", [("http://s.ru/a", "http://s.ru/a/", True), ("http://s.ru/a", "http://s.ru/A", False), ("/", "/", True), ("/", "", False)])
def test_lenient_equality(spark, a, b, equal):
    assert _one(spark, urls.key(F.lit(a)) == urls.key(F.lit(b))) is equal


@pytest.mark.parametrize("x, y", [(1.0, 1.0), (1.125, 1.13), (8 / 3, 2.67), (2.675, 2.68), (1.005, 1.0)])
def test_rounding(spark, x, y):
    assert _one(spark, numbers.round_half_up(F.lit(x))) == y


@pytest.mark.parametrize("given, kept", [([10, 3, 2], [2, 3]), ([3, 10], [3]), ([9, 3], [3, 9])])
def test_frequency_filter(spark, given, kept):
    df = spark.createDataFrame([("s", f"l{i}", n) for i, n in enumerate(given)], "site string, lemma string, frequency long")
    counts = spark.createDataFrame([("s", 10)], "site string, n_pages long")
    assert sorted(r.frequency for r in search.keep_rare(df, counts, 0.95).collect()) == kept


@pytest.mark.parametrize("ranks, value", [([3], 1.0), ([3, 1], 1.33), ([2, 2, 2], 3.0)])
def test_relevance(spark, ranks, value):
    tf = spark.createDataFrame([("s", 1, f"l{i}", float(r)) for i, r in enumerate(ranks)] + [("s", 2, "other", 1.0)], "site string, page_id long, lemma string, rank double")
    kept = spark.createDataFrame([("s", f"l{i}") for i in range(len(ranks))], "site string, lemma string")
    rows = search.ranked(search.relevance(search.pages_with_all(tf, kept))).collect()
    assert [(r.page_id, r.relevance) for r in rows] == [(1, value)]


@pytest.mark.parametrize(
    "content, radius, cut",
    [
        ("<p>один два слово три четыре пять</p>", 1, " два слово три"),
        ("<p>один два слово три четыре пять</p>", 3, "один два слово три четыре пять"),
        ("<p>один два слово</p>", 3, "один два слово"),
        ("<p>слово</p>", 3, "слово"),
        ("<p>раз, слово; два 12 три </p>", 2, "раз, слово; два 12 три"),
        ("слово раз", 3, "слово раз"),
    ],
)
def test_snippet_borders(spark, content, radius, cut):
    at = content.index("слово")
    left, right = spark.range(1).select(snippets.border(F.lit(content), F.lit(max(0, at - 1)), radius, False), snippets.border(F.lit(content), F.lit(at + 5), radius, True)).first()
    assert content[left:right] == cut


@pytest.mark.parametrize(
    "given, merged",
    [([(0, 5), (3, 9), (20, 25)], [(0, 9), (20, 25)]), ([(0, 5), (5, 8)], [(0, 8)]), ([(0, 10), (2, 3)], [(0, 10)]), ([(0, 5), (6, 8)], [(0, 5), (6, 8)])],
)
def test_merge(spark, given, merged):
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in given])
    assert [tuple(s) for s in spark.range(1).select(snippets.merge(spans).alias("m")).first().m] == merged
    rows = spark.createDataFrame([(1, a, b) for a, b in given], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in snippets.merge_intervals(rows, ["k"]).collect()) == merged


def test_snippet_text(spark):
    cut = lambda text, words, n: spark.range(1).select(snippets.snippet(F.lit(text), F.array(*map(F.lit, words)), n).alias("s")).first().s
    assert cut("<p>One two word three</p>", ["word"], 1) == "...  two <b>word</b> three ..."
    assert cut("nothing here", ["word"], 3) == ""


def test_settings():
    ok = Settings.from_mapping({"application": {"search": {"snippet-radius": 5, "max-relative-frequency": 0.5}, "sites": [{"url": "http://a.b", "name": "A"}]}})
    assert ok.snippet_radius == 5 and ok.sites == (Site("http://a.b", "A"),)
    for bad in ({"snippet_radius": 0}, {"max_relative_frequency": 1.5}, {"sites": (Site("http://a.b/", "A"),)}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_validation_order():
    for args, message in ((("q", "nope", -1, -1), "url"), (("q", None, -1, -1), "limit"), (("q", None, -1, 1), "offset"), (("", None, 0, 1), "empty")):
        with pytest.raises(search.SearchError, match=message):
            search.validate(*args)


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><style>p{}</style></head><script>var t="</p>";</script><!-- x --><p><b>Hi\n there'
    assert _one(spark, html.title(F.lit(page))) == "A & B"
    assert _one(spark, html.text(F.lit(page))) == "A & B Hi there"
    assert _one(spark, html.links(F.lit('<a class="x" href="/a">a</a><a href="/b">'))) == ["/a", "/b"]


def test_statistics_defaults(spark):
    from trawldex.operators import stats

    cfg = spark.createDataFrame([("http://a.b", "A"), ("http://c.d", "C")], "url string, name string")
    stored = spark.createDataFrame([("http://a.b", "INDEXED", None)], "url string, status string, last_error string").withColumn("status_time", F.timestamp_millis(F.lit(5000)))
    counts = spark.createDataFrame([("http://a.b", 1, 1)], "site string, pages long, lemmas long")
    rows = {r.url: r for r in stats.site_stats(cfg, stored, counts, F.timestamp_millis(F.lit(7000))).collect()}
    a, c = rows["http://a.b"], rows["http://c.d"]
    assert (a.status, a.status_time, a.error, a.pages, a.lemmas) == ("INDEXED", 5000, "", 1, 1)
    assert (c.status, c.status_time, c.error, c.pages, c.lemmas) == ("NOT INDEXED", 7000, "", 0, 0)


def test_reach_on_a_chain(spark):
    from trawldex.operators import graph

    edges = spark.createDataFrame([("s", i, i + 1) for i in range(5)] + [("s", 3, 0), ("t", 1, 2)], "site string, src int, dst int")
    rows = graph.reach(edges, spark.createDataFrame([("s", 0)], "site string, node int"), ["site"]).collect()
    assert sorted((r.node, r.depth) for r in rows) == [(i, i) for i in range(6)]


def test_reach_has_no_silent_bound(spark):
    import pytest

    from trawldex.operators import graph

    edges = spark.createDataFrame([("s", i, i + 1) for i in range(40)], "site string, src int, dst int")
    seeds = spark.createDataFrame([("s", 0)], "site string, node int")
    with pytest.raises(RuntimeError):
        graph.reach(edges, seeds, ["site"], max_depth=2)
    assert sorted((r.node, r.depth) for r in graph.reach(edges, seeds, ["site"]).collect()) == [(i, i) for i in range(41)]


def test_reach_removes_what_nothing_reads(spark):
    import pytest

    from trawldex.operators import graph
    from trawldex.sources import files
    from trawldex.sources.scratch import scratch_dir

    def tables():
        return {n for n in files.names(spark, f"{scratch_dir(spark)}/trawldex") if n.startswith("reach-")}

    edges = spark.createDataFrame([("s", i, i + 1) for i in range(36)], "site string, src int, dst int")
    seeds = spark.createDataFrame([("s", 0)], "site string, node int")
    before = tables()
    with pytest.raises(RuntimeError):
        graph.reach(edges, seeds, ["site"], max_depth=2)
    assert tables() == before
    rows = graph.reach(edges, seeds, ["site"])
    assert len(tables() - before) == 6  # what was visited after 32 rounds, the frontier of then, and four since
    assert sorted((r.node, r.depth) for r in rows.collect()) == [(i, i) for i in range(37)]


def test_route(spark):
    from trawldex.sources import tables

    sites = [Site("http://a.b", "A"), Site("http://c.d", "C")]
    for url, want in (("http://a.b/x", "http://a.b"), ("http://e.f/http://c.d/x", "http://c.d"), ("http://x.y", None)):
        assert _one(spark, tables.route(F.lit(url), sites)) == want
    assert _one(spark, tables.route(F.lit("http://a.b"), [])) is None


def test_decoding_keeps_odd_characters(spark):
    text = "\uffff &amp;amp; \ufffe1 \ufffe0 &lt;\uffff&#38;#38; &#xFFFF;"
    assert _one(spark, html.decode(F.lit(text))) == "\uffff &amp; \ufffe1 \ufffe0 <\uffff&#38; &#xFFFF;"
