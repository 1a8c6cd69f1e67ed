import numpy as np

import corpus_pipeline
from trawldex.llm import decontam, mixing, q_mixing

from test_mixing import _missing, least
from test_ngram import brute as near_brute
from test_quality import brute as quality_brute
from test_sharding import jump


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    from trawldex.llm.common import materialize

    one = materialize(stage["quality_rules"](spark, docs, sf), "t")
    kept = {r.doc_id for r in one.collect()}
    for i, t in texts.items():
        n, chars, symbols, _, repeat = quality_brute(t)
        if n < 50 or 100 * repeat > 50 * n or 2 * symbols > n:
            assert i not in kept
        elif symbols == 0 and repeat < 0.2 * n and 2 * n <= chars <= 40 * n and len(set((t or "").split("\n"))) == len((t or "").split("\n")):
            assert i in kept
    two = materialize(stage["near_duplicates"](spark, one, sf), "t")
    groups = near_brute([(i, texts[i]) for i in kept], 80, 5)
    assert {r.doc_id for r in two.collect()} == {c for _, c in groups.values()}
    three = materialize(stage["decontaminate"](spark, two, sf), "t")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    q = decontam.Queries(bench, 13)
    clean = {r.doc_id for r in two.collect() if not (lambda x: x["n_hit"] > 0 and 20 * x["n_hit"] >= x["n_words"])(decontam.judge([(r.text or "").encode()], q)[0])}
    assert {r.doc_id for r in three.collect()} == clean
    four = materialize(stage["mix_sources"](spark, three, sf), "t")
    assert four.columns == docs.columns
    kept, labels = {r.doc_id for r in four.collect()}, spark.read.parquet(f"{sf}/labels.parquet")
    ids = sorted(clean)
    model = mixing.train(three, labels)
    p, words = model.of([(texts[i] or "").encode() for i in ids])
    rated = {r[0].doc_id: r.rate for r in mixing.plan(three, labels, q_mixing.WEIGHTS, max_rate=1.0, carry=["doc_id"], allow_gap=True).rows.collect()}
    rate, share = np.array([rated[i] for i in ids]), np.array(list(q_mixing.WEIGHTS.values()))
    asked = share * (words @ p)[0] / share[0]
    assert (rate >= 0).all() and (rate <= 1).all() and _missing(p, words, rate, asked) <= least(p, words, asked, 1.0) + 1e-6
    rate = rated
    luck = {r.doc_id: r.x for r in three.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'mix'), 4294967296) / 4294967296D AS x").collect()}
    assert all((i in kept) == (luck[i] < rate[i]) for i in ids if abs(luck[i] - rate[i]) > 2e-3 or rate[i] in (0, 1))
    five = stage["shard"](spark, four, sf).collect()
    assert {(r.doc_id, r.shard, r.grown_shard) for r in five} == {(i, jump(i, 24), jump(i, 25)) for i in kept}
    for n in range(24):
        assert sorted(r.slot for r in five if r.shard == n) == list(range(sum(r.shard == n for r in five)))


def test_every_stage_on_odd_inputs(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with names of the operators' own, empty tables."""
    good = " ".join(f"word{i % 97}{'abcde'[i % 5]} of" for i in range(200))
    long = " ".join(f"w{i % 4999}x{i % 5003}" for i in range(60_000))
    rows = [(None, good + " a", None, None), (1, None, "en", "s"), (2, "", None, "s"), (3, good, "en", None), (3, good, "en", None), (4, good + " end", None, "s"), (5, long, "en", "s"), (None, None, None, None), (6, "few words", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["__doc", "__r", "__text", "tokens", "posterior", "rate", "copies", "component_id", "class_id", "n", "part", "slot_", "fail_mask", "kept"]
    docs = docs.selectExpr("*", *[f"'x' AS {c}" for c in names])
    want = {"quality_rules": [None, 3, 3, 4, 5], "near_duplicates": [None, None, 1, 2, 3, 3, 5, 6], "decontaminate": [None, None, 1, 2, 3, 3, 4, 5, 6]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name in want:
            assert sorted(ids, key=lambda i: (i is not None, i or 0)) == want[name], (name, ids)
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    last = dict(corpus_pipeline.STAGES)["shard"]
    assert last(spark, docs, sf).count() == len(rows) and last(spark, docs.limit(0), sf).count() == 0


def test_run_leaves_what_its_result_reads(spark, sf):
    from pathlib import Path

    from trawldex.llm.common import scratch_dir

    top = Path(scratch_dir(spark).removeprefix("file:")) / "trawldex"
    before = set(top.iterdir()) if top.exists() else set()
    rows = corpus_pipeline.run(spark, sf)
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert left == {"mix_sources", "sizes"} and rows.count() > 0
