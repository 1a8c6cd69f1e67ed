import collections
import random
import re


from trawldex.llm import q_quality, quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_sql(same):
    same(q_quality.op10_quality_rules, q_quality.OP10_SQL)


def test_brute_force(spark):
    random.seed(1)
    texts = [None, "", " \t\n", "a b c", "a a a a", " x\n\n x\n x \v\f y ", "a b c a b c", "é" * 50, "w " * 20000, "a b\na b\n a b\n"]
    texts += ["".join(random.choice("ab \n#*") for _ in range(random.randrange(200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.ledger(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in (brute(texts[r.doc_id]), brute("a b c") if r.doc_id == 1 else None), r


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "short"), (3, good + " ###" * 200), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    book = quality.ledger(docs)
    assert {r.doc_id for r in quality.apply_policy(book, quality.STRICT).filter("kept").collect()} == {1}
    out = {r.rule: r for r in quality.ablation(book, quality.STRICT).collect()}
    assert out["few_words"].n_failed == 2 and out["few_words"].n_kept_without == 3
    assert out["symbols"].n_failed == 1


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(60)), "a", 3)], "doc_id long, text string, n_words string, fail_mask int")
    assert quality.filter_documents(docs).collect() == docs.collect()
    assert quality.filter_documents(docs.limit(0)).collect() == []


def test_empty_table(spark):
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_policy_versions_match_sql(same):
    rows = same(q_quality.op10_policy_ablation, q_quality.OP10_ABLATION_SQL)
    assert len(rows) == 2 + 4 + 5


def test_the_ledger_is_stored_once(spark, sf, monkeypatch):
    made = []
    whole = q_quality.materialize
    monkeypatch.setattr(q_quality, "materialize", lambda df, label: made.append(label) or whole(df, label))
    plan = q_quality.op10_policy_ablation(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert made == ["ledger"] and "documents.parquet" not in plan and "text" not in plan
