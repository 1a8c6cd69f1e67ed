"""What the index reads and writes: pruned plans, counts, blocks, repeated pages, folding."""

import random

import pytest
from pyspark.sql import functions as F

from trawldex.operators import analyzer, index, stats
from trawldex.plans import results, store as stores
from trawldex.plans.store import Store
from trawldex.sources import files

A, B = "http://a.com", "http://b.org"
SCHEMA = "page_id long, url string, html string"


def _store(spark, path, pages, parts=4):
    lex = analyzer.lexicon_for_join(analyzer.lexicon(spark))
    return Store(spark, str(path), lex).build(spark.createDataFrame(pages, SCHEMA), parts=parts)


def _many(n, seed=0):
    rng = random.Random(seed)
    return [(i, f"{rng.choice([A, B])}/p{i}", f"<title>t{i}</title><p>{' '.join(rng.choice(['alpha', 'beta', 'gamma', 'delta', f'own{i % 50}']) for _ in range(12))}</p>") for i in range(n)]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _scans(df):
    """Nodes that read Parquet, of the plan that ran or would run."""
    return [x for x in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n") if "Scan parquet" in x and "Location" in x]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return _store(spark, tmp_path_factory.mktemp("index"), _many(300), 8)


def test_keyed_reads_are_pruned(built):
    for df in (built.pages_of([(A, 3)]), built.terms_of([(A, 3), (B, 9)]), built.by_path(A, "/p3"), built.blocks(["alpha"]), built.lemmas(["alpha", "beta"])):
        assert _scans(df)
        for scan in _scans(df):
            assert "PartitionFilters: [" in scan and "part#" in scan.split("PartitionFilters")[1] and "PushedFilters" in scan, scan


def test_upsert_reads_and_writes_what_it_needs(spark, built, monkeypatch):
    read = []
    whole = built._read
    monkeypatch.setattr(built, "_read", lambda name: read.append(name) or whole(name))
    few = built._of
    monkeypatch.setattr(built, "_of", lambda rows, name, keys: read.append(f"{name} by key") or few(rows, name, keys))
    assert built.upsert(spark.createDataFrame([(3, f"{A}/p3", "<p>alpha epsilon</p>")], SCHEMA), tag="once")
    assert read == ["forward", "forward by key", "lemmas", "lemmas by key"]
    assert not built.upsert(spark.createDataFrame([(3, f"{A}/p3", "<p>other</p>")], SCHEMA), tag="once")
    layer = max(n for n, _ in built.layers())
    for name in stores.TABLES:
        at = f"{built.path}/{name}/layer={layer}"
        written = [f for d in files.names(spark, at) for f in (files.names(spark, f"{at}/{d}") if d.startswith("part=") else [d]) if f.endswith(".parquet")]
        assert len(written) <= 1, (name, written)


def test_counts_equal_a_recount(spark, tmp_path):
    at = _store(spark, tmp_path, _many(60))
    at.upsert(spark.createDataFrame([(3, f"{A}/p3", "<p>only here</p>"), (70, "http://new.net/", "<p>alpha</p>"), (5, f"{A}/p5", "<p></p>"), (5, f"{B}/p5", "")], SCHEMA))
    at.remove_sites(spark.createDataFrame([(B,)], "url string"))
    for _ in range(3):
        want = stats.pages_per_site(at.pages()).join(stats.lemmas_per_site(index.doc_freq(at.postings())), "site").selectExpr("site", "n_pages", "n_lemmas")
        assert _rows(at.counts().filter("pages > 0")) == _rows(want)
        assert _rows(at.lemmas()) == _rows(index.doc_freq(at.postings()).select("site", "lemma", "frequency"))
        at.fold() if len(at.layers()) > 2 else at.compact()
    assert len(at.layers()) == 1


def test_folding_keeps_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_LAYERS", 4)
    at = _store(spark, tmp_path / "a", _many(40))
    now = {p: (p, u, h) for p, u, h in _many(40)}
    for i in range(6):
        page = (i * 3, now[i * 3][1], f"<p>alpha round{i}</p>")
        now[page[0]] = page
        at.upsert(spark.createDataFrame([page], SCHEMA))
    assert len(at.layers()) <= 4
    whole = _store(spark, tmp_path / "b", list(now.values()))
    for name in ("pages", "postings", "lemmas", "counts"):
        assert _rows(getattr(at, name)().select(*getattr(whole, name)().columns)) == _rows(getattr(whole, name)()), name


def test_blocks(spark, built):
    blocks = built.blocks().collect()
    assert all(b.n == len(b.offsets) == len(b.ranks) <= stores.BLOCK and b.lo // stores.BLOCK == b.hi // stores.BLOCK == b.block for b in blocks)
    plain = spark.createDataFrame([("s", p, "x", float(p % 5 + 1)) for p in (-300, -1, 0, 255, 256, 2**40, 2**62)], "site string, page_id long, lemma string, rank double")
    assert _rows(stores.unblocked(stores._blocks(plain)).select(*plain.columns)) == _rows(plain)


def test_frequent_lemma_beside_a_rare_one(spark, tmp_path):
    pages = [(i * 100, f"{A}/p{i}", "<p>alpha" + (" rareword" if i in (7, 90) else "") + "</p>") for i in range(200)]
    at = _store(spark, tmp_path, pages)
    lemmas = results.query_lemmas(at, "alpha rareword")
    every, wanted = results.candidate_blocks(at, results.kept_lemmas(at, lemmas, 1.0), lemmas)
    counts = {r.lemma: r["count"] for r in wanted.groupBy("lemma").count().collect()}
    assert counts == {"alpha": 2, "rareword": 2} and every.filter("lemma = 'alpha'").count() > 70
    assert any("In(block" in s or "EqualTo(block" in s for s in _scans(wanted))
    assert {r.page_id for r in results.scores(at, "alpha rareword", 1.0).collect()} == {700, 9000}


def test_search_reads_titles_and_bodies_of_one_page_only(built):
    found = results.matches(built, "alpha gamma", 1.0)
    for df in (results.page(built, found), results.with_snippets(built, found, "alpha gamma", 3)):
        for scan in _scans(df):
            assert "/gone/" in scan or "part#" in scan.split("PartitionFilters")[1].split("\n")[0], scan
    for df in (found, results.matches(built, "alpha", 1.0, A)):
        assert not any("/pages/" in s or "body" in s for s in _scans(df))


def test_repeated_pages_count_once(spark, tmp_path):
    page = (1, f"{A}/x", "<p>alpha</p>")
    at = _store(spark, tmp_path, [page, page, (2, f"{A}/x/", "<p>alpha alpha</p>"), (3, f"{A}/y", "<p>beta</p>"), (3, f"{A}/z", "<p>gamma</p>"), (3, f"{B}/z", "<p>gamma</p>")])
    assert _rows(at.postings()) == [(A, 1, "alpha", 1.0), (A, 3, "beta", 1.0), (B, 3, "gamma", 1.0)]
    assert _rows(at.counts()) == [(A, 2, 2), (B, 1, 1)]


def test_layers_are_claimed(spark, tmp_path):
    at = _store(spark, tmp_path, _many(3))
    one, two = at._next(), at._next()
    assert one != two and not files.claim(spark, f"{at.path}/claims/layer-{one}")


def test_empty_index(spark, tmp_path):
    at = _store(spark, tmp_path, [])
    assert at.counts().collect() == at.postings(["x"]).collect() == at.pages_of([(A, 1)]).collect() == []
    assert results.page(at, results.matches(at, "alpha", 1.0)).collect() == []
    bare = Store(spark, str(tmp_path / "none"), at.lex)
    bare.upsert(spark.createDataFrame([(1, f"{A}/", "<p>alpha</p>")], SCHEMA))
    assert _rows(bare.counts()) == [(A, 1, 1)] and results.matches(bare, "alpha", 1.0).count() == 1
