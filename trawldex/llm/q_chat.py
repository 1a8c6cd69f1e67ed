"""op1: all conversations, and one that speaks the template's own control strings, as session logs with drafts, streams,
regenerations and deletions that are folded, formatted and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.llm import chat
from trawldex.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    done = chat.render(chat.fold(chat.turns_to_history(turns.unionByName(hard))))
    back = chat.parse(done)
    digest = lambda parts: F.sha2(F.array_join(parts, ""), 256)
    loss = F.array_join("masked", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<)(/?s>)|(\[)(/?(?:INST|SYS|ROLE)\])', '\1\3' || '\\' || '\2\4', 'g') AS x,
             regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '(<)(/?s>)|(\[)(/?(?:INST|SYS|ROLE)\])', '\1\3' || '\\' || '\2\4', 'g') AS y FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(7 + length(x) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 0 ELSE 13 + length(y) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
