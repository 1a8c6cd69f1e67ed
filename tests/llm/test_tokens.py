import collections

import pytest

from trawldex.llm import q_tokens, tokens

COLUMNS = "op string, source string, lang string, version string, tokens long, old_tokens long"


def _rows(df):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    enc = tokens.encoder(q_tokens.VOCABULARY, q_tokens.PATTERN)
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = (r.quality, r.toxic)
    want = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        quality, toxic = labels.get(r.doc_id, (1, 0))
        if toxic > 0:
            continue
        g = want[r.source, r.lang, q_tokens.VERSION]
        g[0] += 1
        g[1] += len(enc.encode_ordinary(r.text or "")) + (quality <= 0)
    assert _rows(q_tokens.op7_token_rollup(spark, sf)) == {k: tuple(v) for k, v in want.items()}


def test_ledger(spark, tmp_path):
    book = tokens.Ledger(spark, str(tmp_path / "ledger"))
    make = lambda rows: spark.createDataFrame(rows, COLUMNS)
    assert book.rollup().count() == 0
    first = make([("insert", "a", "en", "v", 10, None), ("insert", None, None, "v", 4, None), ("insert", "b", "en", "v", 7, None)])
    assert book.commit("1", first) and not book.commit("1", first)
    assert book.commit("2", make([("delete", "b", "en", "v", 7, None), ("revise", "a", "en", "v", 12, 10), ("insert", "a", "en", "w", None, None)]))
    want = {("a", "en", "v"): (1, 12), (None, None, "v"): (1, 4), ("a", "en", "w"): (1, 0)}
    assert _rows(book.rollup()) == want
    book.compact()
    assert _rows(book.rollup()) == want and not book.commit("2", first)
    assert book.commit("3", make([]).limit(0)) and _rows(book.rollup()) == want
    assert book.commit("4", make([("insert", "a", "en", "v", 1, None)]))
    book.compact()
    assert _rows(book.rollup()) == want | {("a", "en", "v"): (2, 13)} and book.committed() == {"1", "2", "3", "4"}


def test_half_written_batch(spark, tmp_path):
    book = tokens.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("insert", "a", "en", "v", 10, None)], COLUMNS)
    book.commit("1", rows)
    next((tmp_path / "ledger" / "batches" / "batch=1").glob("_SUCCESS")).unlink()
    assert book.rollup().count() == 0 and book.commit("1", rows)
    assert _rows(book.rollup()) == {("a", "en", "v"): (1, 10)}


def test_unknown_op(spark):
    with pytest.raises(Exception, match="unknown op"):
        tokens.signed(spark.createDataFrame([("drop", "a", "en", "v", 1, None)], COLUMNS)).collect()


def test_counts_keep_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a few words", "x")], "doc_id long, text string, n string")
    rows = tokens.count_tokens(docs, q_tokens.VOCABULARY, q_tokens.PATTERN).collect()
    assert [(r.doc_id, r.n, r.tokens) for r in sorted(rows)] == [(1, "x", 0), (2, "x", 0), (3, "x", 3)]


def test_batch_names(spark, tmp_path):
    book = tokens.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("insert", "a", "en", "v", 10, None)], COLUMNS)
    names = ["2026/11/26", "a batch=b", "%2F", "..", "", "née", "x:y*?"]
    for n, name in enumerate(names, 1):
        assert book.commit(name, rows) and not book.commit(name, rows)
        assert _rows(book.rollup()) == {("a", "en", "v"): (n, 10 * n)}
    assert book.committed() == set(names)
    book.compact()
    assert not any(book.commit(name, rows) for name in names) and book.committed() == set(names)


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    book, late = (tokens.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    monkeypatch.setattr(late, "_counts", lambda batch: False)  # it looked before the other had ended
    make = lambda n: spark.createDataFrame([("insert", "a", "en", "v", n, None)], COLUMNS)
    assert book.commit("1", make(10)) and not late.commit("1", make(99))
    assert _rows(book.rollup()) == {("a", "en", "v"): (1, 10)}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "some words " * 60_000)], "doc_id long, text string")
    enc = tokens.encoder(q_tokens.VOCABULARY, q_tokens.PATTERN)
    assert tokens.count_tokens(docs, q_tokens.VOCABULARY, q_tokens.PATTERN).first().tokens == len(enc.encode_ordinary("some words " * 60_000))


def test_a_column_of_the_same_name_is_replaced(spark):
    docs = spark.createDataFrame([(1, "two words", 99, "x")], "doc_id long, text string, tokens int, source string")
    found = tokens.count_tokens(docs, q_tokens.VOCABULARY, q_tokens.PATTERN)
    assert found.columns == ["doc_id", "source", "tokens"] and found.first().tokens == 2
    assert tokens.count_tokens(docs.select("text", "tokens"), q_tokens.VOCABULARY, q_tokens.PATTERN).first().tokens == 2
