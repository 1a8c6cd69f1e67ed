import collections
import random

from trawldex.llm import components, ngram_join, q_ngram


def brute(rows, per=85, width=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        for g in s:
            where[g].append(i)
    both = collections.Counter((a, b) for m in where.values() for k, a in enumerate(m) for b in m[k + 1 :])
    for (a, b), c in both.items():
        if 100 * c >= per * (len(sets[a]) + len(sets[b]) - c) and top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_sql(same):
    same(q_ngram.op9_ngram_jaccard, q_ngram.OP9_SQL)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 16)
    random.seed(5)
    v = [f"w{i}" for i in range(60)]
    base = [random.choice(v) for _ in range(120)]
    rows = [(-1, None), (-2, ""), (-3, "a b"), (-4, "A  B"), (-5, "a b c d"), (-6, "a b c d\n")]
    for i in range(110):
        x = list(base)
        for _ in range(random.randrange(7)):
            p, k = random.randrange(len(x)), random.random()
            if k < 0.5:
                x[p] = random.choice(v)
            elif k < 0.75:
                del x[p]
            else:
                x.insert(p, random.choice(v))
        rows.append((i * 7 - 3000, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85, hot=10).collect()}
    assert found == want


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect())
    assert rows == [((False, 0), None), ((True, 1), 1), ((True, 2), 1), ((True, 2), 1), ((True, 3), 3)]
    extra = docs.selectExpr("*", "'x' AS n", "1 AS component_id")
    kept = ngram_join.keep_one(extra, 4, 85)
    assert kept.columns == extra.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert ngram_join.near_duplicates(docs.limit(0), 4, 85).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(links, []).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def _groups(spark, rows, width=4, per=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs, width, per).collect()}


def test_two_near_documents_alone(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(4, " ".join(words)), (9, " ".join(words + ["more"]))]
    assert _groups(spark, rows) == {(4, 4), (9, 4)}
    docs = spark.createDataFrame([*rows, (11, "something else altogether " * 9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs, 4, 85).collect()) == [4, 11]


def test_chain_of_three(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(30 - k, " ".join(words[6 * k : 6 * k + 88])) for k in range(3)]
    assert _groups(spark, rows) == {(28, 28), (29, 28), (30, 28)}
    assert brute(rows) == {i: (85, 28) for i in (28, 29, 30)}


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    assert _groups(spark, [(3, a), (5, a), (5, b), (9, b), (12, c)]) == {(3, 3), (5, 3), (9, 3), (12, 12)}
    assert _groups(spark, [(5, a), (5, b), (7, b + " end"), (5, None), (8, None)]) == {(5, 5), (7, 5), (8, 8)}
    assert _groups(spark, [(5, a), (5, ""), (7, a + " end"), (7, None), (8, "")]) == {(5, 5), (7, 5), (8, 8)}


def test_complementary_words_differ(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    assert _groups(spark, rows) == {(1, 1), (2, 2)}


def test_very_long_text_and_word(spark, monkeypatch):
    from trawldex.llm import arrays

    monkeypatch.setattr(arrays, "CHUNK", 1000)
    assert arrays.word_hashes.__globals__["CHUNK"] == 1000
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "y" * 5000 + " z"), (4, "y" * 4999 + "x z"), (5, long[: len(long) // 2])]
    assert _groups(spark, rows) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_hub_whose_copies_do_not_link_each_other(spark, monkeypatch):
    """A star: every copy links with the base only, so the base must be met by all of them, in blocks of any size."""
    monkeypatch.setattr(ngram_join, "CELL_BYTES", 4000)
    random.seed(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(77, " ".join(base))]
    for i in range(60):
        x = list(base)
        for p in random.sample(range(0, 150, 4), 3):
            x[p] = f"new{i}-{p}"
        rows.append((i * 5 + 1, " ".join(x)))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (7, 4096):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85, hot=hot).collect()} == want


def test_forest_tests_each_pair_once():
    import numpy as np

    group = np.repeat([0, 1, 2], [5, 1, 6])
    seen = set()

    def joined(a, b):
        pairs = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert len(pairs) == len(a) and not pairs & seen
        seen.update(pairs)
        return (a + b) % 3 == 0

    a, b = ngram_join.forest(group, joined)
    up = list(range(12))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert up[y] != up[x]
        up = [up[x] if u == up[y] else u for u in up]
    for x in range(12):
        for y in range(x):
            assert group[x] != group[y] or (x + y) % 3 or up[x] == up[y]


def test_sketches_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 40, 500, 511, 512, 530, 1000, 1100, 4000, 4500, 9000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sets += [base, np.unique(np.r_[base[: n - n // 20], rng.integers(0, 2**64, n // 15, dtype=np.uint64)])]
    n = np.array([len(s) for s in sets])
    k = ngram_join.Sketches(n, np.frombuffer(b"".join(map(ngram_join.sketch, sets)), np.uint8))
    i, j = np.triu_indices(len(sets), 1)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    bound = k.apart(i, j)
    assert (bound <= real).all()
    far = (real > 0.9 * (n[i] + n[j])) & (n[i] > 600) & (100 * np.minimum(n[i], n[j]) >= 85 * np.maximum(n[i], n[j]))
    assert far.any() and (bound[far] > (n[i] + n[j] - 2 * ngram_join.need(n[i], n[j], 85))[far]).all()
