import random
import zlib

import numpy as np
import pytest

from trawldex.llm import q_spelling, spelling
from trawldex.llm.sqltext import crc32_sql


def edits(u, letters):
    for i in range(len(u) + 1):
        for c in letters:
            yield u[:i] + c + u[i:]
            if i < len(u):
                yield u[:i] + c + u[i + 1 :]
        if i < len(u):
            yield u[:i] + u[i + 1 :]


def brute(words):
    letters, every = set("".join(words)), set(words)
    return {tuple(sorted((u, v))) for u in every for v in edits(u, letters) if v in every and v != u}


def pools():
    rng = random.Random(3)
    few = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 11))) for _ in range(300)}
    wide = {"".join(rng.choice("abcé\U0001F600") for _ in range(rng.randrange(7, 10))) for _ in range(400)}
    runs = {"a" * n for n in range(7, 30)} | {"a" * n + "b" for n in range(7, 20)} | {"b" + "a" * n for n in range(7, 20)}
    stem = {"prefixprefix" + x for x in few} | {x + "suffixsuffix" for x in few}
    return [few, wide, runs, stem, {"solitary"}, set()]


@pytest.mark.parametrize("most", [1, 3, 40, 20_000])
def test_pairs_against_brute_force(spark, most):
    for words in pools()[:: 1 if most == 3 else 2]:
        df = spark.createDataFrame([(w, i + 1, 0) for i, w in enumerate(sorted(words))], "word string, n long, key int")
        found = spelling.near_pairs(df, most).collect()
        assert sorted(tuple(sorted((r.a, r.b))) for r in found) == sorted(brute(words))  # each pair once


def test_groups_are_bounded(spark):
    words = sorted({"commonstem" + "".join(random.Random(i).choice("abcdefgh") for _ in range(6)) + "commonend" for i in range(3000)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    rows = spelling.groups(df, 100).groupBy("key").count()
    # a window of one place holds as many words as there are letters, and one that lacks the place
    assert rows.agg({"count": "max"}).first()[0] <= 100


def test_light_words_are_few():
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(9)) for i in range(4000)})
    n = len(words)
    t = spelling.Tries(words, np.ones(n, int), np.full(n, 9), np.zeros(n, int), np.full(n, 10))
    shared = t.shared()
    assert sum(t.light(shared, e)[0].size for e in range(9)) <= n * np.log2(n)


def test_families(spark):
    rows = [("windows", 1000), ("window s", 1), ("windowss", 100), ("windowsss", 10), ("windowssss", 1), ("windowz", 100), ("wandows", 1000), ("far away", 5), ("", 3), (None, 3), ("windowz", 1)]
    got = {r.word: r for r in spelling.families(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["windowssss"].form, got["windowssss"].root) == ("windowsss", "windows")
    assert (got["windowz"].form, got["windowz"].n, got["windows"].form, got["windows"].n_near) == (None, 101, None, 4)
    assert (got["window s"].form, got["window s"].root, got["window s"].form_n) == ("windows", "windows", 1000)
    assert (got["far away"].root, got["far away"].n_near, got["far away"].form_n) == ("far away", 0, None) and len(got) == 8
    tie = [("aaaaaab", 50), ("aaaaaac", 50), ("aaaaaaa", 5)]
    got = {r.word: r.form for r in spelling.families(spark.createDataFrame(tie, "word string, n long")).collect()}
    assert got["aaaaaaa"] == "aaaaaab"


def test_query_matches_sql(same):
    rows = same(q_spelling.op11_spelling_variants, q_spelling.OP11_SQL)
    assert any(r.form for r in rows) and any(r.root not in (r.word, r.form) for r in rows) or len(rows) > 100


def test_words_of_documents(spark, duck):
    text = "AbcdefghÉ× abcdefg-hijklmn " * 2 + "short " + "é" * 9 + " " + "x" * 200_000 + " " + "x" * 200_000
    docs = spark.createDataFrame([(5, text, "n"), (5, text, "n"), (None, text, "n"), (6, None, "n"), (7, "", "n")], "doc_id long, text string, n string")
    got = {r.word: r.n for r in q_spelling.word_counts(docs).collect()}
    want = {}
    for d in ("5", "5", ""):
        for run in ["abcdefghÉ×", "abcdefg", "hijklmn"] * 2 + ["é" * 9, "x" * 200_000, "x" * 200_000]:
            h = zlib.crc32(f"{d}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] = want.get(word, 0) + 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert q_spelling.word_counts(docs.limit(0)).isEmpty()
    for s in ("", "a", "5:é×\U0001F600" * 9):
        assert duck.execute(f"SELECT {crc32_sql('?')}", [s]).fetchone()[0] == zlib.crc32(s.encode())
