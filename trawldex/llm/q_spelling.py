"""op11: spelling variants of the words of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import spelling
from trawldex.llm.common import table
from trawldex.llm.sqltext import LOWER, UPPER, crc32_sql

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
SLIP = 31
LETTERS = r"[A-Za-zÀ-ÿ]"


def slipped(doc_id: Column, run: Column) -> Column:
    """A run with one code point deleted, where the checksum of document and run says so; without an id, the checksum is of the run alone after the colon."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough; counts are combined before the shuffle."""
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = rows.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.families(word_counts(table(spark, sf_dir, "documents")), TIMES)


_H = crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")
OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
h AS MATERIALIZED (SELECT *, {_H} AS h FROM g),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
p AS MATERIALIZED (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
o AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS x, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM p),
c AS (SELECT a.word, b.word AS near FROM o a JOIN o b ON a.x = b.x AND a.word <> b.word UNION SELECT o.word, w.word FROM o JOIN w ON o.d = w.word UNION SELECT w.word, o.word FROM o JOIN w ON o.d = w.word),
n AS (SELECT c.word, near, w.n AS m, row_number() OVER (PARTITION BY c.word ORDER BY w.n DESC, near) AS i, count(*) OVER (PARTITION BY c.word) AS n_near FROM c JOIN w ON w.word = near),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN near END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM w LEFT JOIN n ON n.word = w.word AND i = 1),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word) JOIN f AS g ON g.word = t.root WHERE g.form IS NULL
"""
