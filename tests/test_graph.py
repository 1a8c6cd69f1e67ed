import pytest
from pyspark.sql import functions as F

from trawldex.operators import graph, routing
from trawldex.plans import queries as core


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    whole = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, made: rounds.append(label) or whole(df, label, made))
    n = 100_000
    chain = spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = graph.flatten(chain, ["site"]).agg(F.sum("depth"), F.max("depth"), F.max("root"), F.count("*")).first()
    assert tuple(got) == (n * (n - 1) // 2, n - 1, 0, n)
    assert (len(rounds) - 1) / 2 <= 20


def test_forest(spark):
    rows = [("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("b", 2, None), ("b", 3, 2), ("a", 9, 77), ("a", 10, 9)]
    tree = spark.createDataFrame(rows, "site string, node long, parent long")
    got = sorted(map(tuple, graph.flatten(tree, ["site"]).select("site", "node", "root", "depth").collect()))
    assert got == [("a", 1, 1, 0), ("a", 2, 1, 1), ("a", 3, 1, 2), ("a", 9, 9, 0), ("a", 10, 9, 1), ("b", 2, 2, 0), ("b", 3, 2, 1)]
    assert graph.flatten(tree.limit(0), ["site"]).isEmpty()
    with pytest.raises(ValueError, match="circle"):
        graph.flatten(spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "site string, node long, parent long"), ["site"])


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_routing_over_many_sites(spark, most_bytes):
    sites = ["http://b.org", "http://a.com", "http://a.co", "", "http://b.org"] + [f"http://s{i}.net" for i in range(200 if most_bytes > 60 else 5)]
    urls = ["http://a.com/x", "http://x.com/?u=http://a.co", "http://s3.net/", "http://none.net", None, "", "http://a.com/http://b.org", "http://s1.net.evil.org"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.routed_to for r in routing.route(rows, routing.listed(spark, sites), most_bytes=most_bytes).collect()}
    assert got == {i: next((s for s in sites if s and u and s in u), None) for i, u in enumerate(urls)}


def test_routing_plan_has_no_branch_for_a_site(spark, sf):
    plan = core.queries()["site_routing"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "http" not in plan.replace("https?", "") and plan.count("CASE WHEN") <= 3


def test_no_sites(spark):
    rows = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    assert routing.route(rows, routing.listed(spark, [])).first().routed_to is None
