import random

import pytest
from pyspark.sql import functions as F

from trawldex.llm import q_warc, warc

COLUMNS = "record_id long, url string, ts long, kind string, status int, headers map<string,string>"


def test_sql(same):
    same(q_warc.op3_warc_revisits, q_warc.OP3_SQL)


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTP://Ex.com:80/a/#x", "http://ex.com/a"),
        ("https://ex.com:443", "https://ex.com/"),
        ("https://ex.com:80/?Q=A", "https://ex.com:80/?Q=A"),
        ("http://ex.com/A//?x#y", "http://ex.com/A?x"),
        ("http://ex.com?x", "http://ex.com/?x"),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.range(1).select(warc.canonical_url(F.lit(url)).alias("u")).first().u == key


def test_brute_force(spark):
    random.seed(6)
    rows = []
    for i in range(400):
        full = random.random() < 0.5
        tag = random.choice(["a", "b"])
        rows.append((i, f"http://u{random.choice([0, 0, 0, 1, 2])}.x/", random.randrange(3000), "response" if full else "revisit", random.choice([200, 200, 404]) if full else 304, {"ETag": tag, "X": str(i), "Date": str(i)}))
    out = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, COLUMNS), 7).collect()}
    for i, url, ts, kind, _, h in rows:
        if kind != "revisit":
            assert i not in out
            continue
        before = [r for r in rows if r[1] == url and r[3] == "response" and r[4] == 200 and (r[2], r[0]) < (ts, i)]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        r = out[i]
        if best is None:
            assert r.verdict == "no_earlier_response" and r.response_id is None
        elif best[5]["ETag"] != h["ETag"]:
            assert (r.verdict, r.response_id, r.headers) == ("validator_mismatch", best[0], None)
        else:
            assert (r.verdict, r.response_id) == ("resolved", best[0])
            assert r.headers == {"etag": h["ETag"], "x": best[5]["X"], "date": h["Date"]}


def test_edges(spark):
    rows = [
        (1, None, 1, "revisit", 304, {"ETag": "a"}),
        (2, "http://a.b", None, "revisit", 304, {"ETag": "a"}),
        (3, "http://a.b", 1, "response", 200, {"Last-Modified": "m", "Etag": "t"}),
        (4, "http://a.b", 2, "revisit", 304, None),
        (5, "http://a.b/", 3, "revisit", 304, {"LAST-MODIFIED": "m", "Content-Length": "0"}),
        (5, "http://a.b/", 3, "revisit", 304, {"LAST-MODIFIED": "m", "Content-Length": "0"}),
        (6, "http://a.b/", 3, "revisit", 304, {"ETag": 'W/t'}),
        (7, "", 3, "revisit", 304, {"ETag": "t"}),
        (8, "no/scheme", 3, "response", 200, {"ETag": "t"}),
        (9, "no/scheme", 4, "revisit", 304, {"ETag": "t"}),
    ]
    records = spark.createDataFrame(rows, COLUMNS).withColumn("hit", F.lit(1))
    got = sorted((r.record_id, r.verdict) for r in warc.resolve(records).collect())
    assert got == [(1, "no_earlier_response"), (2, "no_earlier_response"), (4, "no_validator"), (5, "resolved"), (5, "resolved"), (6, "resolved"), (7, "no_earlier_response"), (9, "no_earlier_response")]
    assert warc.resolve(records.limit(0)).count() == 0


def test_whole_urls_and_verdicts(spark, sf):
    rows = q_warc.op3_warc_revisits(spark, sf).collect()
    assert {r.verdict for r in rows} == {"resolved", "validator_mismatch", "no_validator", "no_earlier_response"}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sum("?" in r.url for r in rows) >= sum("?" in u.split("#")[0] for u in pages.values()) > 0


def test_hot_url_is_spread_over_blocks(spark):
    rows = [(i, "http://hot.x/", i // 3, "response" if i % 50 == 0 else "revisit", 200 if i % 50 == 0 else 304, {"ETag": "t"}) for i in range(2000)]
    out = warc.resolve(spark.createDataFrame(rows, COLUMNS), 16).collect()
    assert {(r.record_id, r.response_id) for r in out} == {(i, i // 50 * 50) for i in range(2000) if i % 50}


def test_very_long_url_and_headers(spark):
    url, value = "http://a.b/" + "x" * 200_000, "v" * 500_000
    rows = [(1, url, 1, "response", 200, {"ETag": "t", "X-Long": value}), (2, url + "#f", 2, "revisit", 304, {"ETag": "t"})]
    r = warc.resolve(spark.createDataFrame(rows, COLUMNS)).first()
    assert r.verdict == "resolved" and r.headers["x-long"] == value
