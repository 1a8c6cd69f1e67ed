"""op10: quality ledger of all documents, with the strict policy's verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import quality
from trawldex.llm.common import materialize, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), quality.STRICT)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.failed(quality.BASE).alias("base_failed"), "kept", "n_lines", "fail_mask",
    )


#: Versions of one policy: the second also asks for few symbols and no repeated lines, the third for all rules.
VERSIONS = [quality.Policy("rules", 1, quality.BASE.mask), quality.Policy("rules", 2, 15), quality.Policy("rules", 3, quality.STRICT.mask)]


def op10_policy_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a policy and what each of their rules does, from one ledger: texts are measured once, and the ledger is what is stored."""
    book = materialize(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "ledger")
    rows = [quality.ablation(book, p).withColumn("policy", F.lit(f"{p.name}-v{p.version}")) for p in VERSIONS]
    kept = [book.agg(F.count_if(~quality.failed(p)).alias("n_kept")).withColumn("policy", F.lit(f"{p.name}-v{p.version}")) for p in VERSIONS]
    both = reduce(DataFrame.unionByName, rows).join(F.broadcast(reduce(DataFrame.unionByName, kept)), "policy")  # one row a version
    return both.select("policy", "rule", "n_failed", "n_failed_only_here", "n_kept_without", "n_kept")


_MASKS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
h AS (SELECT DISTINCT doc_id, i + o AS p FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1),
r AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words) THEN 16 ELSE 0 END) AS BIGINT) AS fail_mask
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, n_lines, fail_mask FROM f
"""
OP10_SQL = _MASKS
OP10_ABLATION_SQL = _MASKS[: _MASKS.rindex("SELECT doc_id")].rstrip() + """,
p AS (SELECT * FROM (VALUES ('rules-v1', 3), ('rules-v2', 15), ('rules-v3', 31)) AS t(policy, mask)),
u AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16)) AS t(rule, bit))
SELECT policy, rule, count(*) FILTER (fail_mask & mask & bit <> 0) AS n_failed, count(*) FILTER (fail_mask & mask = bit) AS n_failed_only_here,
       count(*) FILTER (fail_mask & mask & ~bit = 0) AS n_kept_without, count(*) FILTER (fail_mask & mask = 0) AS n_kept
FROM f, p JOIN u ON mask & bit <> 0 GROUP BY policy, rule
"""
