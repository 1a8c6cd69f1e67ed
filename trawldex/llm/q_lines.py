"""op12: lines that ten documents or more hold, removed from all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import lines
from trawldex.llm.common import materialize, scratch_dir, table
from trawldex.llm.sqltext import LOWER, UPPER

AT_LEAST = 10
BATCHES = 4
FANOUT = 3


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches by a hash of their id; each joins the runs and adds its own, and in the end all are stripped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int"))
    counts = materialize(lines.document_counts(dealt, ["batch"]), "line-counts")
    runs = lines.LineRuns(spark, f"{scratch_dir(spark)}/trawldex/lines-{uuid.uuid4().hex}", AT_LEAST, FANOUT)
    for b in range(BATCHES):
        runs.add(f"batch {b}", counts.filter(F.col("batch") == b))
    return runs.strip(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(len(ls))) AS p, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN rid END) >= {AT_LEAST}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
