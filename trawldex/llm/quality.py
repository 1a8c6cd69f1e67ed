"""Quality rules as a bitmask ledger (DataFrame expressions only).

Every rule is evaluated once per document. The ledger stores the measurements and one `fail_mask`
whose bit b is set when rule b failed; policies are versioned bit sets that are applied to the
ledger afterwards, so a new policy or an ablation never reads the texts again.

Defined results: a null text measures as an empty one (no words, so `few_words` fails); repeated rows
are measured one by one; an empty table gives an empty ledger; other columns of the input are
ignored by `ledger` and kept by `filter_documents`, whatever their names. A text is measured whole in one row,
so a single text is bounded by Spark's 2 GB limit on a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawldex.llm.common import WS_CHARS, WS_CLASS

SYMBOLS = r"[#*$%&|<>]"

#: Rule name -> bit, and the SQL condition on the measurements that makes it fail.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "2 * n_symbols > n_words"),
    "repeated_lines": (3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    "word_length": (4, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
}


def bits(*names: str) -> int:
    return sum(1 << RULES[n][0] for n in names)


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document is kept when none of them failed."""

    name: str
    version: int
    mask: int


BASE = Policy("base", 1, bits("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, bits(*RULES))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry (default doc_id) plus the measurements of RULES, in one pass without a shuffle.

    Windows of three words are named by a 64-bit hash whose low bits are replaced by the window's
    position, sorted as plain longs; neighbours with the same name are compared word by word, and a
    document in which two different windows share a name is measured again by the words themselves.
    """
    df = docs.select(*[F.col(c) for c in (carry or ["doc_id"])], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    trimmed = F.btrim("__t", F.lit(WS_CHARS))
    df = df.withColumn("__w", F.when(trimmed == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(trimmed, WS_CLASS + "+")))
    df = df.withColumns({"__l": F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""), "__n": F.size("__w")})
    df = df.withColumn("__m", F.expr("shiftleft(1L, CAST(ceil(log2(__n + 1)) AS INT)) - 1")).withColumn("__k", F.expr("~__m"))
    named = "transform(slice(__w, 2, greatest(__n - 2, 0)), (x, i) -> (xxhash64(__w[i], x, __w[i + 2]) & __k) | i)"
    df = df.withColumn("__s", F.expr(f"sort_array({named})"))
    # Neighbours of the same name: the later and, at the same place, the earlier one of each pair.
    df = df.withColumns({"__b": F.expr("filter(slice(__s, 2, __n), (x, i) -> ((x ^ __s[i]) & __k) = 0)"), "__a": F.expr("filter(slice(__s, 1, greatest(size(__s) - 1, 0)), (x, i) -> ((x ^ __s[i + 1]) & __k) = 0)")})
    differ = " OR ".join(f"__w[(x & __m) + {k}] <> __w[(__a[i] & __m) + {k}]" for k in range(3))
    spelled = """flatten(transform(array(sort_array(transform(sequence(0, __n - 3),
                     i -> named_struct('g', concat_ws(' ', __w[i], __w[i + 1], __w[i + 2]), 'i', CAST(i AS BIGINT))))),
                   s -> transform(filter(s, (x, i) -> (i > 0 AND x.g = s[i - 1].g) OR (i < size(s) - 1 AND x.g = s[i + 1].g)), x -> x.i)))"""
    kept = "array_union(transform(__a, x -> x & __m), transform(__b, x -> x & __m))"
    df = df.withColumn("__p", F.expr(f"sort_array(CASE WHEN exists(transform(__b, (x, i) -> {differ}), x -> x) THEN {spelled} ELSE {kept} END)"))
    repeat = F.expr(
        """aggregate(__p, named_struct('n', 0L, 'last', -3L),
             (s, p) -> named_struct('n', s.n + least(3L, p - s.last), 'last', p), s -> s.n)"""
    )
    measures = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )
    # The generator keeps later filters from being pushed into the measurements, which would spell them out many times over.
    names = carry or ["doc_id"]
    return df.select(*names, F.explode(F.array(measures)).alias("__q")).select(*names, "__q.*")


def fail_mask() -> Column:
    total = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Measurements and fail_mask of every document."""
    return measure(docs, text, carry).withColumn("fail_mask", fail_mask())


def failed(policy: Policy, mask: str = "fail_mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's verdict; texts are not read again."""
    return rows.withColumns({"policy": F.lit(f"{policy.name}-v{policy.version}"), "kept": ~failed(policy)})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that pass without it.

    Rows are first counted by fail_mask (at most 2^rules groups, combined before the shuffle), then
    the groups are unfolded by bit.
    """
    groups = rows.groupBy("fail_mask").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for n, (b, _) in RULES.items() if policy.mask >> b & 1])).alias("r")
    own = F.col("fail_mask").bitwiseAND(F.lit(policy.mask).cast("long"))
    unfolded = groups.select("n", own.alias("m"), rule).select("n", "m", "r.rule", "r.bit")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return unfolded.groupBy("rule").agg(
        count(F.col("m").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("m") == F.col("bit"))("n_failed_only_here"),
        count(F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col(text).alias("__text"))
    rows = ledger(packed, "__text", ["__doc"])
    return rows.filter(~failed(policy)).select(*[F.col(f"__doc.`{c}`").alias(c) for c in names])
