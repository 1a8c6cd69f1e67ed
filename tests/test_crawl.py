"""Crawls that are kept, sites gathered side by side, single pages fetched."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from trawldex.plans.engine import Engine, EngineError
from trawldex.sources import fetch
from trawldex.sources.config import Settings, Site, WebRequest
from trawldex.sources.crawl import Crawl

PAGES = {
    "/": "<title>Root</title><p>alpha</p><a href='/a'>a</a> <a href='/b/'>b</a> <a href='/moved'>m</a>",
    "/a": "<p>alpha beta</p><a href='/b'>again</a> <a href='/c?q=1#f'>c</a>",
    "/b/": "<p>gamma</p>",
    "/c": "<p>beta beta</p><a href='/'>home</a> <a href='/big'>big</a>",
}


@pytest.fixture
def web():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["Accept-Language"], self.headers["User-Agent"], time.monotonic()))
            moved = self.path == "/moved"
            body = ("x" * 5000 if self.path == "/big" else PAGES.get(self.path, "")).encode()
            self.send_response(302 if moved else 200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            if moved:
                self.send_header("Location", "/a")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.seen = seen
    yield server
    server.shutdown()


def _root(web, host="127.0.0.1"):
    return f"http://{host}:{web.server_port}"


def test_a_stopped_crawl_goes_on(spark, web, tmp_path):
    root = _root(web)
    roots = spark.createDataFrame([(root, root + "/")], "site string, url string")
    get = lambda u: fetch.fetch(u, WebRequest("tester", accept_language="en"), 0.0)
    assert not Crawl.latest(spark, str(tmp_path / "c"), get).run(roots, rounds=2)
    assert [p for p, *_ in web.seen if p != "/moved"][0] == "/" and len(web.seen) == 4
    (tmp_path / "c" / "0000000000" / "rounds" / "2").mkdir()  # a round that was lost
    again = Crawl.latest(spark, str(tmp_path / "c"), get)
    assert again.rounds() == 2 and again.run(roots) and again.finished()
    got = {r.url.removeprefix(root): (r.depth, r.code, r.page_id) for r in again.pages().collect()}
    assert {u: x[:2] for u, x in got.items()} == {"/": (0, 200), "/a": (1, 200), "/b/": (1, 200), "/c": (2, 200), "/big": (3, 200)}
    assert len(web.seen) == 6 and {x[1:3] for x in web.seen} == {("en", "tester")}
    fresh = Crawl.latest(spark, str(tmp_path / "c"), get)  # the next one is new, with the same ids
    assert fresh.rounds() == 0 and fresh.run(roots) and {r.page_id for r in fresh.pages().collect()} == {x[2] for x in got.values()}


def test_bodies_are_bounded_and_hosts_take_turns(spark, web, monkeypatch):
    monkeypatch.setattr(fetch, "MOST_BYTES", 1000)
    assert fetch.get(_root(web) + "/big", WebRequest())[1:] == (None, "the body has more than 1000 bytes")
    web.seen.clear()
    hosts = [_root(web), _root(web, "localhost")]
    rows = spark.createDataFrame([(h + f"/x{i}",) for h in hosts for i in range(3)], "url string").coalesce(1)
    began = time.monotonic()
    found = rows.select("url").mapInPandas(lambda b: b, "url string")
    assert fetch.fetch(found, delay=0.5).count() == 6
    assert len(web.seen) == 6 and time.monotonic() - began < 60
    for host in ("127.0.0.1", "localhost"):
        del host
    times = sorted(t for *_, t in web.seen)
    assert times[-1] - times[0] < 6 * 0.5  # pauses of two hosts overlap


def test_indexing_crawls_the_sites_and_fetches_pages(spark, web, tmp_path):
    root = _root(web)
    engine = Engine(spark, Settings(sites=(Site(root, "Here"), Site("http://127.0.0.1:9", "Nowhere")), max_relative_frequency=1.0), str(tmp_path / "e"))
    engine.start_indexing()
    assert engine.wait(300)
    status = {r.name: (r.status, r.last_error) for r in engine.sites().collect()}
    assert status["Here"] == ("INDEXED", None)
    found = engine.search("beta")
    assert [d["uri"] for d in found["data"]] and {d["uri"] for d in found["data"]} == {"/a", "/c"} and found["data"][0]["siteName"] == "Here"
    PAGES["/a"], old = "<p>omega</p>", PAGES["/a"]
    try:
        number = engine.index_url(root + "/a")
    finally:
        PAGES["/a"] = old
    assert engine.search("omega")["count"] == 1 and engine.search("beta")["count"] == 1
    assert engine.store.by_path(root, "/a").first().page_id == number
    with pytest.raises(EngineError, match="outside"):
        engine.index_url("http://elsewhere.net/")
    with pytest.raises(EngineError, match="fetched"):
        engine.index_url(root + "/missing")


def test_one_site_fails_or_is_stopped_the_others_are_indexed(spark, tmp_path):
    sites = tuple(Site(f"http://{n}.com", n) for n in ("good", "bad", "slow", "empty"))
    running = threading.Event()

    def source(site):
        if site.name == "bad":
            raise OSError("no route")
        rows = [] if site.name == "empty" else [(1, f"{site.url}/", f"<p>{site.name} words</p>")]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        if site.name == "slow":
            running.set()
            return df.crossJoin(spark.range(0, 1 << 40, 1, 2).filter("xxhash64(id) = 1 AND xxhash64(id, 1) = 2")).drop("id").unionByName(df)
        return df

    engine = Engine(spark, Settings(sites=sites), str(tmp_path / "e"), site_source=source)
    with pytest.raises(EngineError):
        engine.stop_site("http://slow.com")
    engine.start_indexing()
    assert running.wait(120)
    time.sleep(3)
    engine.stop_site("http://slow.com")
    assert engine.wait(240)
    got = {r.name: (r.status, r.last_error) for r in engine.sites().collect()}
    assert got == {"good": ("INDEXED", None), "bad": ("FAILED", "OSError: no route"), "slow": ("FAILED", "stopped by the user"), "empty": ("FAILED", "the site has no pages")}
    assert {r.site for r in engine.store.pages().collect()} == {"http://good.com"}
    times = engine.sites().agg(F.count_distinct("status_time")).first()[0]
    assert times > 1
