from trawldex.operators import analyzer
from trawldex.plans.store import Store
from trawldex.streaming.upserts import layered, maintain, maintain_index


def test_stream_of_versions(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "index")
    lex = analyzer.lexicon_for_join(analyzer.lexicon(spark))
    schema = "site string, page_id long, content string, version long"
    batches = [[("s", 1, "alpha beta", 1), ("t", 2, "gamma", 1), ("u/ä=", 4, "kept", 1)], [("s", 1, "old", 2), ("s", 1, "delta delta", 3), ("s", 3, "beta", 1)], [("t", 2, "", 2)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = maintain(spark.readStream.schema(schema).parquet(str(source)), table, str(tmp_path / "ck"), lex).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None
    got = sorted((r.site, r.page_id, r.lemma, r["rank"]) for r in spark.read.parquet(table).collect())
    assert got == [("s", 1, "delta", 2.0), ("s", 3, "beta", 1.0), ("u/ä=", 4, "kept", 1.0)]


def test_stream_into_the_index(spark, tmp_path):
    lex = analyzer.lexicon_for_join(analyzer.lexicon(spark))
    schema = "page_id long, url string, html string, version long"
    batches = [[(1, "http://s.com/a", "<p>alpha beta</p>", 1), (2, "http://t.com/", "<p>gamma</p>", 1)], [(1, "http://s.com/a", "<p>old</p>", 2), (1, "http://s.com/a", "<p>delta delta</p>", 3)], [(2, "http://t.com/", "", 2)]]
    store = Store(spark, str(tmp_path / "index"), lex)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = maintain_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None
    assert [tuple(r) for r in store.postings().collect()] == [("http://s.com", 1, "delta", 2.0)]
    assert [tuple(r) for r in store.counts().collect()] == [("http://s.com", 1, 1)] and len(store.layers()) == 3
    layered(store)(spark.createDataFrame(batches[1], schema), 1)  # a batch that runs again
    assert len(store.layers()) == 3
