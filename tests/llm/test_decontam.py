import random

from trawldex.llm import decontam, q_decontam


def brute(text, items, window):
    w, hit, found = decontam.words((text or "").encode()), set(), set()
    for i, t in items:
        v = decontam.words((t or "").encode())
        n = min(window, len(v))
        wanted = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in wanted:
                hit |= set(range(p, p + n))
                found.add(i)
    return len(w), len(hit), sorted(found)


def test_sql(same):
    same(q_decontam.op2_decontaminate, q_decontam.OP2_SQL)


def test_brute_force():
    random.seed(1)
    for k in range(150):
        v = "ab" if k % 2 else "abcdefg"
        make = lambda n, v=v: " ".join(random.choice(v) * random.choice([1, 1, 2]) for _ in range(n))
        window = random.choice([1, 2, 3, 5, 13])
        items = [(i, random.choice([None, "", make(random.randrange(1, 25)), make(random.randrange(1, 25))])) for i in range(random.randrange(6))]
        texts = [random.choice([None, "", make(random.randrange(80)), make(random.randrange(80))]) for _ in range(8)]
        if items:
            texts.append(f"{make(9)} {items[0][1] or ''}, {make(9)}")
        q = decontam.Queries(items, window)
        for limit in (1 << 20, 20):
            for t, r in zip(texts, decontam.judge([None if t is None else t.encode() for t in texts], q, limit), strict=True):
                assert (r["n_words"], r["n_hit"], r["items"]) == brute(t, items, window)


def test_longest_match():
    q = decontam.Queries([(7, "a b c d e f g h")], 3)
    r = decontam.judge([b"x b c d e y a b c z"], q)[0]
    assert r["longest"] == 4
    assert r["spans"] == [{"start": 1, "end": 5, "item_id": 7, "item_word": 1}, {"start": 6, "end": 9, "item_id": 7, "item_word": 0}]


def test_blocks_agree(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)]
    docs = [(d, f"pre {items[d % 12][1]} mid {items[(d * 5) % 12][1]} post") for d in range(30)] + [(99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    one = decontam.scan(rows, bench).select("__doc.doc_id", "__r.n_hit", "__r.items").orderBy("doc_id").collect()
    many = decontam.scan(rows, bench, block_bytes=400).select("__doc.doc_id", "__r.n_hit", "__r.items").orderBy("doc_id").collect()
    assert one == many and all(r.n_hit >= 20 for r in one if r.doc_id != 99)


def test_remove(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(1, item, "z"), (2, "clean text", "z"), (3, None, None), (4, "", "z")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "clean text")], "item_id long, text string")
    kept = decontam.remove(docs, bench)
    # the rule does not ask for an item's id: document 2 is an item without one
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    assert decontam.remove(docs.limit(0), bench).count() == 0 and decontam.remove(docs, bench.limit(0)).count() == 4


def test_items_without_id(spark, tmp_path, monkeypatch):
    import duckdb

    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    docs = [(1, f"x {a} y"), (2, f"{a} {b}"), (3, f"{b} {c} tail"), (4, "clean"), (5, None)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame([(None, a), (7, b), (None, c), (8, None), (None, None)], "item_id long, text string")}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(q_decontam.OP2_SQL).fetchdf().sort_values("doc_id")
    scan = decontam.scan
    for block_bytes in (decontam.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontam, "scan", lambda d, e, w, n=block_bytes: scan(d, e, w, block_bytes=n))
        found = q_decontam.op2_decontaminate(spark, str(tmp_path)).orderBy("doc_id").collect()
        assert [tuple(r) for r in found] == [tuple(r) for r in want[list(found[0].asDict())].itertuples(index=False)]
    assert [(r.n_hit, r.n_items) for r in found] == [(20, 1), (40, 2), (40, 2), (0, 0), (0, 0)]


def test_large_benchmark_writes_documents_once(spark, monkeypatch):
    """Repeated documents and items, in many blocks: texts are written once, and the blocks find what one block finds."""
    made = []
    whole = decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df, label: made.append((label, df.columns)) or whole(df, label))
    items = [(i % 9, " ".join(f"q{i % 9}x{k}" for k in range(20))) for i in range(18)] + [(None, "lone words of an item")]
    docs = [(i % 12, "some words " + items[i % 19][1] + " and more " + items[(3 * i) % 19][1]) for i in range(40)] + [(50, None), (51, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: sorted(decontam.scan(d, b, block_bytes=size).select("__doc.doc_id", "__doc.text", "__r.n_words", "__r.n_hit", "__r.longest", "__r.items", "__r.spans").collect(), key=repr)
    one = rows(1 << 20)
    assert made == []
    assert rows(300) == one and len(one) == len(docs)
    assert len(made) > 5 and [c for _, c in made if "__doc" in c] == [["__doc", "__id"]]
