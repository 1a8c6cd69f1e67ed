import numpy as np
import pytest

from trawldex.llm import mixing, q_mixing


def _labelled(n=240):
    words = {0: "solid", 1: "junk", 2: "nasty"}
    docs = [(i, f"the {words[i % 3]} text of number {i} and more " * 5) for i in range(n)]
    labels = [(i, int(i % 3 == 0), int(i % 3 == 2)) for i in range(0, n, 2)]
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = mixing.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [(i, t) for i, t in docs if i % 2]
    p, words = model.of([t.encode() for _, t in odd])
    assert (p.argmax(axis=1) == np.array([i % 3 for i, _ in odd])).mean() > 0.95
    assert np.allclose(p.sum(axis=1), 1) and set(words) == {8 * 5}


def test_rates_meet_targets(spark):
    docs, labels = _labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = mixing.mix(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"good": 0.6, "poor": 0.3, "toxic": 0.1}).collect()
    total = sum(np.array(r.posterior) * r.tokens * r.rate for r in rows)
    assert np.allclose(total / total.sum(), [0.6, 0.3, 0.1], atol=0.02)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)


def _missing(p, tokens, rates, target):
    return ((((tokens * rates) @ p - target) / tokens.sum()) ** 2 / (target / tokens.sum())).sum() / 2


def least(p, tokens, target, most):
    """The least sum of squares, by coordinates: each rate in turn is set to what is best for it."""
    w, t = tokens / tokens.sum(), target / tokens.sum()
    r = np.full(len(p), min(most, t.sum()))
    now = (w * r) @ p
    for _ in range(400):
        for i in range(len(p)):
            g, h = ((now - t) / t) @ p[i], (p[i] ** 2 / t).sum() * w[i]
            new = min(max(r[i] - g / h, 0), most)
            now = now + w[i] * (new - r[i]) * p[i]
            r[i] = new
    return _missing(p, tokens, r, target)


@pytest.mark.parametrize("target, most", [([30, 20, 10], np.inf), ([30, 20, 10], 4.0), ([10, 60, 3], 1.0)])
def test_solver_against_exact(spark, monkeypatch, target, most):
    monkeypatch.setattr(mixing, "REPLAY", 9)
    rng = np.random.default_rng(0)
    p, tokens = rng.dirichlet([1, 1, 1], 120), rng.integers(1, 5, 120)
    target = np.array(target) * tokens.sum() / 100
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
    s = mixing.solve(rows, target, None if most == np.inf else most)
    r = s.rates(p)
    assert (r >= 0).all() and (r <= most).all()
    assert _missing(p, tokens, r, target) <= least(p, tokens, target, most) + 1e-6
    found = rows.withColumn("rate", s.rate()).collect()  # the expression gives the same
    assert max(abs(x.rate - s.rates(np.array([x.posterior]))[0]) for x in found) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "some words", None), (None, "some words", None)], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(1, None, None), (77, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, q_mixing.WEIGHTS, allow_gap=True).collect()
    assert len(rows) == 4 and sorted(r.tokens for r in rows) == [0, 0, 2, 2]
    assert mixing.apply_mix(docs, labels, q_mixing.WEIGHTS, allow_gap=True).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels.limit(0), q_mixing.WEIGHTS).count() == 0


def test_rates_settle_for_a_rare_domain(spark):
    rng = np.random.default_rng(5)
    for shares in ([0.95, 0.047, 0.003], [0.5, 0.499, 0.001]):
        kind = rng.choice(3, 3000, p=shares)
        p = 0.9 * np.eye(3)[kind] + 0.1 * rng.dirichlet([2, 2, 0.02], 3000)
        tokens = rng.integers(20, 400, 3000)
        rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
        target = np.array(list(q_mixing.WEIGHTS.values())) * (tokens @ p)[0] / q_mixing.WEIGHTS["good"]
        for most in (4.0, np.inf) if shares[0] > 0.9 else (np.inf,):  # with rates up to 4 the rare domain cannot have its share
            r = mixing.solve(rows, target, None if most == np.inf else most).rates(p)
            left = r - np.clip(r - p @ (((tokens * r) @ p - target) / target), 0, most)
            assert ((tokens * np.abs(left)) @ p / target).max() < 2e-3
        assert np.allclose((tokens * r) @ p, target, rtol=1e-2)


def test_unsettled_rates_raise(spark):
    rows = spark.createDataFrame([(5, [0.7, 0.2, 0.1]), (9, [0.1, 0.8, 0.1]), (2, [0.1, 0.1, 0.8])], "tokens long, posterior array<double>")
    with pytest.raises(RuntimeError):
        mixing.solve(rows, np.array([2.0, 1.0, 1.0]), 4.0, steps=1)


def test_sample_is_of_labels_with_a_document(spark):
    docs, labels = _labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    absent = [(i, 1, 1) for i in range(1000, 6000)]
    model = mixing.train(d, spark.createDataFrame(labels + absent, "doc_id long, quality int, toxic int"), sample=len(labels))
    alone = mixing.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert np.array_equal(model.weights, alone.weights) and alone.weights.any()


def test_query_against_exact_solver(spark, sf):
    """Posteriors, totals and rates of the query on whole texts: no rates of any kind come nearer to the asked totals."""
    from trawldex.llm.common import table

    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = q_mixing.op6_mix_weights(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    model = mixing.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    p, words = model.of([(docs[r.doc_id] or "").encode() for r in rows])
    assert [r.tokens for r in rows] == words.tolist()
    assert np.allclose(p, [[r.p_good, r.p_poor, r.p_toxic] for r in rows], atol=1e-6)
    share, rates = np.array(list(q_mixing.WEIGHTS.values())), np.array([r.rate for r in rows])
    asked = share * (words @ p)[0] / share[0]
    assert np.allclose(asked, [rows[0].asked_good, rows[0].asked_poor, rows[0].asked_toxic])
    assert np.allclose((words * rates) @ p, [rows[0].achieved_good, rows[0].achieved_poor, rows[0].achieved_toxic], rtol=1e-4)
    assert _missing(p, words, rates, asked) <= least(p, np.maximum(words, 1e-9), asked, np.inf) + 1e-6
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_held_out_recall_on_labels(spark):
    """On the labelled documents: better than the share of the greatest class, and each class is recognised better than by chance."""
    from trawldex.llm.common import table

    sf = "/root/testdata/sf0.1"
    model = mixing.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    n = {d: c for d, (c, _) in model.report.items()}
    right = sum(c * r for c, r in model.report.values()) / sum(n.values())
    assert right > n["good"] / sum(n.values()) + 0.05, model.report
    assert model.report["poor"][1] > 0.5 and model.report["toxic"][1] > 0.3, model.report


def test_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BATCH_BYTES", 500)
    docs, labels = _labelled(60)
    docs += [(7, docs[7][1])] * 3 + [(500, "solid " * 5000), (None, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = mixing.mix(d, spark.createDataFrame(labels + [(0, 0, 1)], "doc_id long, quality int, toxic int"), q_mixing.WEIGHTS, allow_gap=True).collect()
    assert len(rows) == len(docs) and len({(r.rate, r.copies) for r in rows if r[0].doc_id == 7}) == 1
    assert [r.tokens for r in rows if r[0].doc_id == 500] == [5000]


def test_targets_out_of_reach_are_told(spark):
    docs, labels = _labelled()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = {"good": 0.2, "poor": 0.7, "toxic": 0.1}
    with pytest.raises(mixing.MixGap):
        mixing.plan(d, lab, weights, max_rate=1.0)
    m = mixing.plan(d, lab, weights, max_rate=1.0, allow_gap=True)
    assert np.isclose(m.asked["poor"], 0.7 * m.asked["good"] / 0.2) and m.achieved["poor"] < m.asked["poor"] and m.gap() > 0.1
    rows = m.rows.collect()
    assert all(0 <= r.rate <= 1 for r in rows)
    assert all(r.rate > 0.99 for r in rows if r.posterior[1] > 0.9)  # all that the domain has
