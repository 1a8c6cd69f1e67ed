"""Not-modified revisits in web archives, resolved against the latest earlier full response.

Records (record_id, url, ts, kind, status, headers: map<string,string>): `response` rows carry a full answer,
`revisit` rows a not-modified one. A revisit is joined as of its time to the latest earlier response (status 200) of the
same canonical URL; its validator must agree with that response's; the headers that a not-modified answer may
update are then merged over the response's.

The as-of join works in blocks: records are dealt by ranges of (url, time, id), so that a URL with very many captures is spread over
blocks of about equal size, and written with the number of their block. Within (url, block) a window looks back, and for revisits
with no response in their block the last response of an earlier block is found among one row per (url, block). Only narrow
columns are shuffled, never bodies; records without a usable URL or time are split off before.

Verdicts: `resolved`, `no_earlier_response`, `validator_mismatch` (the latest earlier response is another version; an older
one is not taken instead), `no_validator` (the revisit names none). Equal times are ordered by record id, so a response counts as earlier
than a revisit of the same time if its id is smaller. Defined results: a null or empty url, one without scheme and host, or a null time has no earlier response; null or empty headers
have no validators; repeated rows are resolved alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trawldex.llm.common import materialize

#: Headers that a 304 answer may update (lower case).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, at least `/` as path, no slash at the end of a longer path."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    site = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substr(plain, F.char_length(site) + 1)
    site = F.regexp_replace(F.regexp_replace(site, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.substr(rest, F.char_length(path) + 1)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(site, F.when(path == "", "/").otherwise(path), query)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the first stays."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    value = lambda k: F.element_at(F.map_values(F.map_filter(headers, lambda n, v: F.lower(n) == k)), 1)
    return F.map_from_arrays(names, F.transform(names, value))


def _tag(h: Column) -> Column:
    """Entity tags compare weakly: a leading W/ does not count."""
    return F.regexp_replace(F.trim(F.element_at(h, "etag")), "^W/", "")


def resolve(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per revisit: record_id, url, ts, response_id, response_ts, verdict, headers (merged if resolved).

    blocks: number of ranges, by default that of shuffle partitions.
    """
    blocks = blocks or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind", "status", lower_keys(F.coalesce("headers", F.expr("CAST(map() AS map<string,string>)"))).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    usable = F.coalesce(F.col("url").rlike("^[a-z][a-z0-9+.-]*://[^/?]") & F.col("ts").isNotNull(), F.lit(False))
    alone = rows.filter(~usable & (F.col("kind") == "revisit"))
    dealt = rows.filter(usable & (full | (F.col("kind") == "revisit"))).repartitionByRange(blocks, "url", "ts", "record_id")
    # written, so that every reader sees the same blocks
    rows = materialize(dealt.withColumn("block", F.spark_partition_id()), "captures")
    answer = F.struct("ts", "record_id", "headers")
    look = W.partitionBy("url", "block").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(F.when(full, answer), ignorenulls=True).over(look)).filter(F.col("kind") == "revisit")
    latest = F.max_by(F.when(full, answer), F.when(full, F.struct("ts", "record_id")))
    # one row per (url, block); a block is a range, so few urls have more than one
    tops = rows.groupBy("url", "block").agg(latest.alias("top"))
    earlier = tops.select("url", "block", F.last("top", ignorenulls=True).over(W.partitionBy("url").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    found = near.join(earlier.filter("far IS NOT NULL"), ["url", "block"], "left").withColumn("hit", F.coalesce("near", "far"))
    found = found.select("record_id", "url", "ts", "headers", "hit").unionByName(alone.select("record_id", "url", "ts", "headers", F.lit(None).cast(found.schema["hit"].dataType).alias("hit")))
    mine, theirs = F.col("headers"), F.col("hit.headers")
    agrees = (
        F.when(_tag(mine).isNotNull(), F.coalesce(_tag(mine) == _tag(theirs), F.lit(False)))
        .when(F.element_at(mine, "last-modified").isNotNull(), F.coalesce(F.element_at(mine, "last-modified") == F.element_at(theirs, "last-modified"), F.lit(False)))
    )
    verdict = F.when(F.col("hit").isNull(), "no_earlier_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    keep = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return found.select("record_id", "url", "ts", F.col("hit.record_id").alias("response_id"), F.col("hit.ts").alias("response_ts"), verdict.alias("verdict"), F.when(verdict == "resolved", F.map_concat(keep, update)).alias("headers"))
