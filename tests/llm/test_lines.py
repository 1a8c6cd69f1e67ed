import collections
import hashlib
import random
import uuid

from trawldex.llm import lines, q_lines

WS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, at_least):
    key = lambda x: x.strip(WS).translate(FOLD)
    docs = collections.defaultdict(set)
    for i, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            docs[key(x)].add(("row", i) if d is None else d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not key(x) or len(docs[key(x)]) < at_least]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def test_query_matches_sql(same):
    rows = same(q_lines.op12_line_dedup, q_lines.OP12_SQL)
    assert any(r.n_dropped for r in rows)


def made(spark, tmp_path, **more):
    return lines.LineRuns(spark, f"{tmp_path}/runs-{uuid.uuid4().hex}", **({"at_least": 3, "fanout": 2, "buckets": 3} | more))


def test_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    pool = [f"Line {i}" for i in range(12)] + ["", " \t", "É x ", "é x", "LINE 3 \r", "\x0bline 4"]
    rows = [(i if i % 9 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) + (f"\nown {i}" if i % 2 else "")) for i in range(60)]
    rows += [(1, rows[1][1])] * 3 + [(70, None), (71, ""), (72, "\n\n")]
    dealt = spark.createDataFrame([(d, t, (d or 0) % 5, 0, "") for d, t in rows], "doc_id long, text string, batch int, n int, h1 string")
    for at_least in (1, 4):
        runs = made(spark, tmp_path, at_least=at_least)
        for b in range(5):
            counts = lines.document_counts(dealt.filter(f"batch = {b}"))
            assert runs.add(f"b/{b}", counts) and not runs.add(f"b/{b}", counts)
        assert [r.level for r in runs.runs()] == [2, 0] and max(runs.batches().values()) == 4
        found = sorted(map(repr, map(tuple, runs.strip(dealt).collect())))
        assert found == sorted(map(repr, brute(rows, at_least)))
        again = lines.LineRuns(spark, runs.path, at_least, 2)  # another session finds runs and layout
        assert again.buckets == 3 and again.repeated().count() == runs.repeated().count()
        runs.close()


def test_settled_lines_enter_no_later_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common\nown {i}") for i in range(8)], "doc_id long, text string")
    runs = made(spark, tmp_path, fanout=9)
    runs.add("a", lines.document_counts(docs.filter("doc_id < 4")))
    runs.add("b", lines.document_counts(docs.filter("doc_id >= 4")))
    assert [runs._read(r).count() for r in runs.runs()] == [5, 4]
    assert {r.kept for r in runs.strip(docs).collect()} == {f"own {i}" for i in range(8)}


def test_runs_join_without_moving(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x\ny") for i in range(4)], "doc_id long, text string")
    runs = made(spark, tmp_path)
    runs.add("a", lines.document_counts(docs))
    batch = runs._dealt(lines.document_counts(docs))
    plan = batch.join(runs._read(runs.runs()[0]).hint("merge"), lines.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    run_side = plan[plan.index("SortMergeJoin") :].split("\n")
    at = next(i for i, x in enumerate(run_side) if "Scan parquet" in x and "trawldex_lines" in x)
    assert "Bucketed: true" in plan and not any("Exchange" in x for x in run_side[at - 3 : at])


def test_a_lost_attempt_does_not_count(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x") for i in range(4)], "doc_id long, text string")
    runs = made(spark, tmp_path)
    spark.range(3).selectExpr("id AS h1", "id AS h2", "id AS n").write.parquet(runs._at(lines.Run(0, 0, 0)))
    assert runs.runs() == [] and runs.repeated().isEmpty()
    assert runs.add("a", lines.document_counts(docs)) and runs.repeated().count() == 1


def test_edges(spark, tmp_path):
    runs = made(spark, tmp_path)
    none = spark.createDataFrame([], "doc_id long, text string")
    runs.add("none", lines.document_counts(none))
    assert runs.strip(none).collect() == []
    long = "\n".join(f"l{i % 5000}" for i in range(100_000))
    docs = spark.createDataFrame([(i, long) for i in range(3)] + [(7, "l1\nl1\n ok")], "doc_id long, text string")
    runs.add("long", lines.document_counts(docs))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in runs.strip(docs).collect()}
    assert got == {0: (100_000, 100_000, ""), 1: (100_000, 100_000, ""), 2: (100_000, 100_000, ""), 7: (3, 2, " ok")}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
