"""The persisted index and the calls on it."""

import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from trawldex.functions import html, urls
from trawldex.operators import analyzer, graph, search, snippets
from trawldex.plans import queries as core
from trawldex.plans import results, views
from trawldex.plans.engine import Engine, EngineError
from trawldex.plans.store import Store
from trawldex.sources import fetch
from trawldex.sources.config import Settings, Site, WebRequest, parse_yaml

A, B = "http://a.com", "http://b.org"
PAGES = [
    (1, f"{A}/", "<title>One</title><p>alpha beta beta</p>"),
    (2, f"{A}/two", "<title>Two</title><p>alpha <b>gamma</b> in Text</p>"),
    (3, f"{B}/x?y=1", "<title>Three</title><p>beta alpha</p>"),
    (4, "http://other.net/", "<title>Out</title><p>alpha</p>"),
    (5, f"{A}/empty", "<p> </p>"),
]
SCHEMA = "page_id long, url string, html string"


def _lex(spark):
    return analyzer.lexicon_for_join(analyzer.lexicon(spark))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_layers_equal_a_rebuild(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), _lex(spark)).build(spark.createDataFrame(PAGES, SCHEMA), parts=4)
    changes = [(2, f"{A}/two", "<p>delta delta alpha</p>"), (1, f"{A}/", "<p></p>"), (9, f"{A}/new", "<p>beta</p>")]
    store.upsert(spark.createDataFrame(changes[:2], SCHEMA))
    store.upsert(spark.createDataFrame(changes[2:], SCHEMA))
    left = [PAGES[2], PAGES[3], changes[0], changes[2]]
    whole = Store(spark, str(tmp_path / "again"), _lex(spark)).build(spark.createDataFrame(left, SCHEMA), parts=4)
    for name in ("pages", "postings", "lemmas"):
        assert _rows(getattr(store, name)().select(*getattr(whole, name)().columns)) == _rows(getattr(whole, name)()), name
    assert _rows(store.lemmas(["alpha", "nothing"])) == _rows(whole.lemmas().filter("lemma = 'alpha'"))
    store.compact()
    assert len(store.layers()) == 1 and _rows(store.postings().select("site", "page_id", "lemma", "rank")) == _rows(whole.postings().select("site", "page_id", "lemma", "rank"))
    store.remove_sites(spark.createDataFrame([(A,)], "url string"))
    assert {r.site for r in store.pages().collect()} == {B, "http://other.net"} and _rows(store.lemmas().filter(F.col("site") == A)) == []


def test_unfinished_layer_does_not_count(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "index"), _lex(spark)).build(spark.createDataFrame(PAGES, SCHEMA))
    before = _rows(store.postings())
    monkeypatch.setattr(store, "_done", lambda *a, **k: None)
    store.upsert(spark.createDataFrame([(1, f"{A}/", "<p>lost</p>")], SCHEMA))
    assert _rows(store.postings()) == before


def test_postings_are_pruned(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), _lex(spark)).build(spark.createDataFrame(PAGES, SCHEMA), parts=8)
    plan = store.postings(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(lemma), EqualTo(lemma,alpha)]" in plan


@pytest.mark.parametrize("name", ["search", "search_page2", "search_all", "search_site"])
def test_results_come_in_order(spark, sf, name):
    rows = [(-r.relevance, r.site, r.page_id) for r in core.queries()[name](spark, sf).collect()]
    assert rows == sorted(rows)


def _engine(spark, tmp_path, pages=PAGES, source=None, **settings):
    known = Settings(sites=(Site(A, "A"), Site(B, "B"), Site("http://never.com", "N")), **settings)
    return Engine(spark, known, str(tmp_path / "engine"), source or (lambda: spark.createDataFrame(pages, SCHEMA)))


def test_engine_flow(spark, tmp_path):
    engine = _engine(spark, tmp_path, max_relative_frequency=1.0)
    with pytest.raises(search.SearchError, match="not indexed"):
        engine.search("alpha", A)
    with pytest.raises(EngineError, match="not in progress"):
        engine.stop_indexing()
    assert {d["status"] for d in engine.statistics()["statistics"]["detailed"]} == {"NOT INDEXED"}
    engine.start_indexing()
    assert engine.wait(120) and not engine.is_indexing()
    found = engine.search("Alpha, BETA")
    assert found["count"] == 2 and [(d["site"], d["siteName"], d["uri"], d["relevance"]) for d in found["data"]] == [(B, "B", "/x?y=1", 2.0), (A, "A", "/", 1.5)]
    assert found["data"][1]["snippet"] == "... <b>alpha</b> <b>beta</b> beta ..."
    assert engine.search("alpha", A, limit=1)["count"] == 2 and len(engine.search("alpha", A, limit=1)["data"]) == 1
    with pytest.raises(search.SearchError, match="not indexed"):
        engine.search("alpha", "http://other.net")
    with pytest.raises(search.SearchError, match="url"):
        engine.search("alpha", A + "\n")
    total = engine.statistics()["statistics"]["total"]
    assert (total["sites"], total["pages"], total["indexing"]) == (3, 3, False)
    engine.index_page(77, "http://never.com/p", "<title>P</title><p>alpha omega</p>")
    assert {d["url"]: (d["status"], d["pages"], d["lemmas"]) for d in engine.statistics()["statistics"]["detailed"]}["http://never.com"] == ("INDEXED", 1, 3)  # the title is text too
    assert [d["uri"] for d in engine.search("omega")["data"]] == ["/p"]
    with pytest.raises(EngineError, match="outside"):
        engine.index_page(78, "http://other.net/q", "<p>x</p>")


def test_start_twice_stop_and_failure(spark, tmp_path):
    gate = threading.Event()

    def slow():
        gate.wait(60)
        return spark.createDataFrame(PAGES, SCHEMA)

    engine = _engine(spark, tmp_path, source=slow)
    engine.start_indexing()
    assert engine.is_indexing() and engine.statistics()["statistics"]["total"]["indexing"]
    with pytest.raises(EngineError, match="already"):
        engine.start_indexing()
    threading.Timer(0.5, gate.set).start()
    engine.stop_indexing()
    assert {(r.status, r.last_error) for r in engine.sites().collect()} == {("FAILED", "stopped by the user")}

    def broken():
        raise OSError("no source")

    other = _engine(spark, tmp_path / "b", source=broken)
    other.start_indexing()
    other.wait(60)
    assert {(r.status, r.last_error) for r in other.sites().collect()} == {("FAILED", "OSError: no source")}
    assert not other.store.exists()


def _walk(content, start, radius, right):
    """The window's border, character by character."""
    step, bracket, pos = (1, "<", start) if right else (-1, ">", start)
    part = lambda c: c == "-" or c.isalpha()
    inside = lambda: 0 <= pos < len(content)
    for _ in range(radius):
        while inside() and not part(content[pos]) and content[pos] != bracket:
            pos += step
        while inside() and part(content[pos]):
            pos += step
        if not inside() or content[pos] == bracket:
            break
    if right:
        return min(pos, len(content))
    return max(0, pos + 1) if not inside() or content[pos] == bracket else pos


def test_borders_against_a_walk(spark):
    text = "<p>один, два-три 45 слово; <i>x</i> y z</p> end- of  the text"
    rows = spark.range(len(text)).select(F.col("id").cast("int").alias("start"), F.lit(text).alias("text"))
    kinds = [(radius, right) for radius in (1, 2, 3, 9) for right in (True, False)]
    for r in rows.select("start", *[snippets.border(F.col("text"), F.col("start"), n, right).alias(f"{n}{right}") for n, right in kinds]).collect():
        assert [r[f"{n}{right}"] for n, right in kinds] == [_walk(text, r.start, n, right) for n, right in kinds], r.start


def _merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_snippets_query_against_brute_force(spark, sf):
    bodies = {(r.site, r.page_id): (r.body, r.content) for r in views.store(spark, sf).pages().collect()}
    wanted = set(results.query_lemmas(views.store(spark, sf), views.QUERY))
    base = {}
    for word, form, pos in analyzer.lexicon_rows():
        base.setdefault(word, []).append((form, pos))
    rows = core.queries()["snippets"](spark, sf).collect()
    assert rows
    for r in rows:
        body, content = bodies[r.site, r.page_id]
        plain = re.sub(r"(?:[^\w -]|[\d_])", "", content)
        tokens = [w for w in re.sub(" {2,}", " ", re.sub(r"[^\w]-[^\w]", "", plain)).lower().split(" ") if w not in ("", "-", "--")]
        words = []
        for w in tokens:
            kept = [f for f, pos in base.get(w, [(w, "")]) if pos not in analyzer.STOP_POS]
            if wanted & set(kept) and w not in words:
                words.append(w)
        spans = []
        for w in words:
            at = body.lower().find(w)
            if at >= 0:
                spans.append((_walk(body, max(0, at - 1), views.RADIUS, False), _walk(body, at + len(w), views.RADIUS, True)))
        text = "... " + " ... <...> ... ".join(body[a:b] for a, b in _merge(spans)) + " ..." if spans else ""
        for w in words:
            at = text.lower().find(w)
            if at >= 0:
                text = f"{text[:at]}<b>{text[at : at + len(w)]}</b>{text[at + len(w) :]}"
        assert r.snippet == text, (r.site, r.page_id)


def test_links_of_any_spelling(spark):
    page = """<A HREF='/one'>1</A> <a class="x" href=/two>2</a> <a\ntitle='t'\nHref = "/three">3</a> <abbr href="/no">n</abbr> <a data-href="/no">n</a> <a href="">e</a>"""
    assert spark.range(1).select(html.links(F.lit(page)).alias("x")).first().x == ["/one", "/two", "/three", ""]


def test_entities(spark):
    for raw, text in (("&#65;&#x42;&eacute;&amp;lt;", "ABé&lt;"), ("&#38;amp; &lt;b&gt;", "&amp; <b>"), ("&#128512;&nope; &", "\U0001f600&nope; &"), ("&#0;&#xD800;&#9999999;", "&#0;&#xD800;&#9999999;"), ("plain", "plain")):
        assert spark.range(1).select(html.decode(F.lit(raw)).alias("x")).first().x == text


def test_large_lexicon(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("concat('Word', id) AS word", "concat('base', id % 1000) AS base_form", "if(id % 7 = 0, 'prep', 'noun') AS pos")
    rows.write.parquet(str(tmp_path / "lex"))
    lex = analyzer.lexicon_for_join(analyzer.load_lexicon(spark, str(tmp_path / "lex")))
    words = spark.createDataFrame([("word8",), ("word14",), ("word1008",), ("unlisted",)], "word string")
    assert sorted(r.lemma for r in analyzer.lemmas(words, lex).collect()) == ["base8", "unlisted"]
    (tmp_path / "lex.tsv").write_text("Cats\tcat\tnoun\nin\tin\tprep\n")
    small = analyzer.lexicon_for_join(analyzer.load_lexicon(spark, str(tmp_path / "lex.tsv"), "csv"))
    assert [r.lemma for r in analyzer.lemmas(spark.createDataFrame([("cats",), ("in",)], "word string"), small).collect()] == ["cat"]


def test_settings_file(spark, tmp_path):
    (tmp_path / "app.yaml").write_text(
        "# settings\nserver:\n  port: 8080\napplication:\n  debug: true\n  search:\n    snippet-radius: 5\n    max-relative-frequency: 0.8\n"
        "  web-request:\n    user-agent: 'Me # 1'\n    referrer: http://r.com\n  sites:\n    - url: http://a.com\n      name: A site\n    -\n      url: \"http://b.org\"\n      name: B\n"
    )
    s = Settings.from_file(spark, str(tmp_path / "app.yaml"))
    assert s == Settings(sites=(Site("http://a.com", "A site"), Site("http://b.org", "B")), snippet_radius=5, max_relative_frequency=0.8, debug=True, web_request=WebRequest("Me # 1", "http://r.com"))
    assert parse_yaml("") == {} and parse_yaml("a:\n- 1\n- x: y\n  z: 2.5\nb: null") == {"a": [1, {"x": "y", "z": 2.5}], "b": None}


def test_lenient_membership(spark):
    held = F.array(F.lit("http://s.ru/a"), F.lit("/"))
    got = [spark.range(1).select(urls.contains_leniently(held, F.lit(u)).alias("x")).first().x for u in ("http://s.ru/a/", "http://s.ru/A", "/", "")]
    assert got == [True, False, True, False]


def test_crawl_over_http(spark):
    site = {
        "/": "<title>Root</title><a href='/a'>a</a> <a href=\"/b/\">b</a> <a href='/moved'>m</a> <a href='http://elsewhere.net/x'>out</a>",
        "/a": "<a href='/b'>again, without its slash</a> <a href='/c?q=1#f'>c</a>",
        "/b/": "<p>leaf</p>",
        "/c": "<a href='/'>home</a> <a href='/missing'>gone</a>",
    }
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/a")
                self.end_headers()
                return
            body = site.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        roots = spark.createDataFrame([(root, root + "/")], "site string, url string")
        pages = graph.crawl(roots, lambda u: fetch.fetch(u, WebRequest("tester"), 0.0)).collect()
    finally:
        server.shutdown()
    got = {r.url.removeprefix(root): (r.depth, r.code) for r in pages}
    assert got == {"/": (0, 200), "/a": (1, 200), "/b/": (1, 200), "/c": (2, 200), "/missing": (3, 404)}
    assert {agent for _, agent in seen} == {"tester"} and len(seen) == 6
    bad = fetch.fetch(spark.createDataFrame([("http://127.0.0.1:9/",)], "url string"), delay=0.0).first()
    assert bad.code is None and bad.html is None and bad.error
