"""op3: revisits over all pages, by whole URLs with their queries.

Page p is captured at minute p as a full response and again, half an hour later, in a new version if p is divisible by three. An hour
later there is a revisit with the first version's tag, under another spelling of the URL (upper-case scheme and host, default port, fragment);
half a minute before the first capture one with the date of the version only, and, for odd p, a day later one that names no validator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import warc
from trawldex.llm.common import table


def records(pages: DataFrame) -> DataFrame:
    at = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    rows = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), size.alias("size"))
    site = F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1)
    port = F.when(F.startswith(site, F.lit("http://")), ":80").when(F.startswith(site, F.lit("https://")), ":443").otherwise("")
    plain = F.regexp_replace(F.substr(F.col("url"), F.char_length(site) + 1), "#.*$", "")
    spelled = F.concat(F.upper(site), F.when(site.rlike(r":[0-9]+$"), "").otherwise(port), plain, F.lit("#again"))
    full = lambda k, ts, etag: F.struct((5 * F.col("page_id") + k).alias("record_id"), F.col("url").alias("url"), ts.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Length"), "size", F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), ts.cast("string"), F.lit("Last-Modified"), ts.cast("string"), F.lit("ETag"), etag).alias("headers"))
    again = lambda k, url, ts, *named: F.struct((5 * F.col("page_id") + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), ts.cast("string"), *named).alias("headers"))
    at, tag = F.col("at"), F.col("tag")
    every = F.array(full(0, at, tag), again(1, spelled, at + 3600, F.lit("ETag"), F.concat(F.lit("W/"), tag)), again(2, F.col("url"), at - 30, F.lit("Last-Modified"), (at - 60).cast("string")))
    some = lambda cond, x: F.filter(F.array(x), lambda _: cond)
    newer = some(F.pmod("page_id", F.lit(3)) == 0, full(3, at + 1800, F.concat(F.lit('"new-'), F.substr(tag, F.lit(2)))))
    silent = some(F.pmod("page_id", F.lit(2)) == 1, again(4, F.col("url"), at + 86400))
    return rows.select(F.explode(F.concat(every, newer, silent)).alias("r")).select("r.*")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve(records(table(spark, sf_dir, "pages")))
    header = lambda k: F.element_at("headers", k).alias(k.replace("-", "_"))
    return rows.select("record_id", "url", "ts", "response_id", "response_ts", "verdict", *[header(k) for k in ("content-length", "content-type", "date", "last-modified", "etag")])


OP3_SQL = r"""
WITH p AS (SELECT page_id, page_id * 60 AS t0, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size,
             regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
c AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head FROM p),
d AS (SELECT *, regexp_replace(regexp_replace(lower(head), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS site,
             regexp_extract(substr(u, length(head) + 1), '^([^?]*)', 1) AS path FROM c),
k AS (SELECT page_id, t0, tag, size, regexp_matches(head, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]') AS usable,
             site || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || substr(u, length(head) + length(path) + 1) AS url FROM d),
f AS (SELECT 5 * page_id AS id, url, t0 AS ts, tag, size, usable FROM k
      UNION ALL SELECT 5 * page_id + 3, url, t0 + 1800, '"new-' || substr(tag, 2), size, usable FROM k WHERE page_id % 3 = 0),
v AS (SELECT 5 * page_id + 1 AS id, url, t0 + 3600 AS ts, tag, CAST(NULL AS VARCHAR) AS date, usable FROM k
      UNION ALL SELECT 5 * page_id + 2, url, t0 - 30, NULL, CAST(t0 - 60 AS VARCHAR), usable FROM k
      UNION ALL SELECT 5 * page_id + 4, url, t0 + 86400, NULL, NULL, usable FROM k WHERE page_id % 2 = 1),
j AS (SELECT v.*, f.id AS rid, f.ts AS rts, f.tag AS rtag, f.size,
             row_number() OVER (PARTITION BY v.id ORDER BY f.ts DESC NULLS LAST, f.id DESC) AS n
      FROM v LEFT JOIN f ON f.url = v.url AND v.usable AND f.usable AND (f.ts < v.ts OR (f.ts = v.ts AND f.id < v.id))),
w AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_earlier_response' WHEN tag IS NULL AND date IS NULL THEN 'no_validator'
                     WHEN coalesce(tag = rtag, date = CAST(rts AS VARCHAR)) THEN 'resolved' ELSE 'validator_mismatch' END AS verdict FROM j WHERE n = 1)
SELECT id AS record_id, url, ts, rid AS response_id, rts AS response_ts, verdict,
       CASE WHEN verdict = 'resolved' THEN size END AS content_length, CASE WHEN verdict = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN verdict = 'resolved' THEN CAST(ts AS VARCHAR) END AS date, CASE WHEN verdict = 'resolved' THEN coalesce(date, CAST(rts AS VARCHAR)) END AS last_modified,
       CASE WHEN verdict = 'resolved' THEN coalesce('W/' || tag, rtag) END AS etag
FROM w
"""
