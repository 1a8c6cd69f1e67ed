"""op13: damaged conversations and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import repair
from trawldex.llm.common import table
from trawldex.llm.sqltext import crc32_sql


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with a fifth of a quarter dropped, emptied, robbed of their stops, repeated or given to the user, by a checksum; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), h.alias("h")).filter("h <> 0")
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_all(rows: DataFrame, **sizes: int) -> DataFrame:
    """Every conversation of rows, repaired after damage; those that lost all rows are empty."""
    found = repair.repaired(damaged(rows), **sizes).withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_all(table(spark, sf_dir, "conversations"))


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _edit(cost: str, letter: str, line: str | None, rest: str) -> str:
    lines = f"list_prepend({line}, {rest}.t)" if line else f"{rest}.t"
    return f"{{'c': CAST({cost} + {rest}.c AS BIGINT), 'a': '{letter}' || {rest}.a, 't': {lines}}}"


def _row(place: str, kept: dict[str, str], needed: str) -> str:
    keep = " ".join(f"WHEN kind = '{k}' THEN {_edit('late', 'K', line, q)}" for k, q in kept.items() for line in ["role || ':' || text"])
    other = "'user:'" if needed == "u" else "'assistant:'"
    delete, rerole = _edit("3", "D", None, place), _edit("2 + late", "R", f"{other} || text", needed)
    return _least(delete, f"CASE WHEN NOT gone THEN CASE {keep} END END", f"CASE WHEN NOT gone THEN {rerole} END")


_INS_U, _INS_A = (lambda q: _edit("2", "I", "'user:'", q)), (lambda q: _edit("2", "I", "'assistant:'", q))
_HASH = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_HASH} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, trim(text, {_WS}) AS bare, substr(role, 1, 1) AS kind, row_number() OVER w AS i, lead(substr(role, 1, 1)) OVER w AS follow,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS MATERIALIZED (SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, count(*) OVER (PARTITION BY conv_id) - i + 1 AS k FROM o),
m AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (follow IS NOT NULL AND kind || follow NOT IN ('su', 'ua', 'au')) AS illegal,
      coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS k FROM f GROUP BY conv_id),
z AS (SELECT DISTINCT conv_id FROM conversations),
v(conv_id, k, n, s, u, a) AS (
 SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}, {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}},
        {{'c': CAST(2 AS BIGINT), 'a': 'I', 't': ['assistant:']}}, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} FROM z
 UNION ALL
 SELECT conv_id, k, {_least('n', _INS_U('u'))}, {_least('s', _INS_U('u'))}, u, a FROM (
 SELECT conv_id, k, n, s, {_least('u', _INS_A('a'))} AS u, {_least('a', _INS_U('u'))} AS a FROM (
 SELECT conv_id, k, {_row('n', {'s': 's', 'u': 'u'}, 'u')} AS n, {_row('s', {'u': 'u'}, 'u')} AS s, {_row('u', {'a': 'a'}, 'a')} AS u, {_row('a', {'u': 'u'}, 'u')} AS a FROM (
 SELECT v.conv_id, f.k, n, s, u, a, f.kind, role, text, blank OR dup AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.k = v.k + 1))))
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       v.n.c AS cost, v.n.a AS audit, sha256(array_to_string(v.n.t, chr(10))) AS repaired_sha256
FROM z LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM z.conv_id JOIN v ON v.conv_id IS NOT DISTINCT FROM z.conv_id AND v.k = coalesce(m.k, 0)
"""
