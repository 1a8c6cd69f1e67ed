"""op8: repeated strings of 50 bytes removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import suffix
from trawldex.llm.common import table

LENGTH = 50


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.dedup(table(spark, sf_dir, "documents"), LENGTH)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50),
w AS (SELECT p.doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM p JOIN d USING (doc_id)),
m AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (g) WHERE first_id < doc_id),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS t FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN e IS NULL THEN h ELSE t || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
