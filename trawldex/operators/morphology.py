"""Lemmas of words that no lexicon lists, by endings that a lexicon teaches.

Every entry (word, base form, part of speech) is a rule: so many letters go, others come. A trie of reversed words, kept as a table with one row
for each suffix, holds the rules of the entries below it. An unknown word takes the rules of its longest suffix that has any: one analysis for each
rule that is not rare beside the most frequent one. A suffix whose rules are those of its own suffix, one letter shorter, says nothing new and is left out.

Learning groups entries by suffix; guessing joins distinct words with the trie. Lexicon and vocabulary may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawldex.functions.html import once

LONGEST = 8  # letters of a suffix
LEAST_STEM = 2  # letters that stay
FEW = 100_000  # suffixes of a trie that every task can hold
RULES = "array<struct<strip:int,ending:string,pos_tag:string>>"


def _shared(a: Column, b: Column) -> Column:
    """Letters that two words begin with alike."""
    prefix = F.when(F.startswith(a, b), F.char_length(b)).when(F.startswith(b, a), F.char_length(a))  # as most forms are
    places = F.sequence(F.lit(1), F.greatest(F.least(F.char_length(a), F.char_length(b)), F.lit(1)))
    return prefix.otherwise(F.size(F.filter(places, lambda i: (F.char_length(a) >= i) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))))


def rules(lex: DataFrame) -> DataFrame:
    """word, strip, ending, pos_tag of lexicon entries (word, base_form, pos_tag) that keep a stem; irregular ones teach nothing."""
    rows = lex.filter("word <> '' AND base_form <> ''").select("word", "base_form", "pos_tag").distinct()
    rows = rows.withColumn("stem", _shared(F.col("word"), F.col("base_form")))
    rows = rows.withColumn("strip", (F.char_length("word") - F.col("stem")).cast("int")).filter((F.col("stem") >= LEAST_STEM) & (F.col("strip") <= LONGEST))
    return rows.select("word", "strip", F.substr("base_form", F.col("stem") + 1).alias("ending"), "pos_tag")


def _suffixes(words: DataFrame, least: Column) -> DataFrame:
    """words with each suffix, from the least length on."""
    most = F.least(F.char_length("word"), F.lit(LONGEST))
    return words.filter(least <= most).withColumn("suffix", F.explode(F.transform(F.sequence(least, most), lambda k: F.right(F.col("word"), k))))


def learn(lex: DataFrame, least: int = 2, share: float = 0.25) -> DataFrame:
    """suffix, rules: the trie. A rule of a suffix needs `least` words and so much of what the suffix's most frequent rule has."""
    rows = _suffixes(rules(lex), F.greatest(F.col("strip"), F.lit(1)))
    counted = rows.groupBy("suffix", "strip", "ending", "pos_tag").agg(F.count("*").alias("n"))
    most = counted.groupBy("suffix").agg(F.max("n").alias("most"))
    kept = counted.join(most, "suffix").filter((F.col("n") >= least) & (F.col("n") >= F.col("most") * share))
    # no more than 1 / share rules each
    nodes = kept.groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("strip", "ending", "pos_tag"))).cast(RULES).alias("rules"))
    above = nodes.select(F.col("suffix").alias("inner"), F.col("rules").alias("same"))
    inner = F.right(F.col("suffix"), F.char_length("suffix") - 1)
    return nodes.join(above, inner == F.col("inner"), "left").filter("same IS NULL OR same <> rules").select("suffix", "rules")


def guess(words: DataFrame, model: DataFrame) -> DataFrame:
    """word, lemma, pos_tag of distinct words (column word): by the longest suffix that the trie has; a word of no known suffix stands for itself."""
    # lengths of suffixes first, and each word with 0: the rules themselves move for the longest one only
    found = _suffixes(words.select("word"), F.lit(1)).join(model.select("suffix"), "suffix", "left_semi").select("word", F.char_length("suffix").alias("k"))
    best = found.unionByName(words.select("word", F.lit(0).alias("k"))).groupBy("word").agg(F.max("k").alias("k"))
    rows = best.withColumn("suffix", F.right("word", F.col("k"))).join(model, "suffix", "left").select("word", "rules")
    return rows.select("word", F.explode(_applied(F.col("rules"))).alias("r")).select("word", *_analysis())


def _applied(rules: Column) -> Column:
    """Rules (or null) that leave the word a stem; where none does, the one by which it stands for itself."""
    itself = F.array(F.struct(F.lit(0).alias("strip"), F.lit("").alias("ending"), F.lit(None).cast("string").alias("pos_tag"))).cast(RULES)
    usable = once(F.filter(rules, lambda r: F.char_length("word") - r["strip"] >= LEAST_STEM), lambda x: F.when(F.size(x) > 0, x))
    # a word this long keeps a stem by any rule
    return F.coalesce(F.when(F.char_length("word") >= LONGEST + LEAST_STEM, rules).when(rules.isNotNull(), usable), itself)


def _analysis() -> list[Column]:
    """lemma, pos_tag of a word by its rule `r`."""
    return [F.concat(F.substr("word", F.lit(1), F.char_length("word") - F.col("r.strip")), F.col("r.ending")).alias("lemma"), F.col("r.pos_tag").alias("pos_tag")]


def guess_in_place(rows: DataFrame, lex: DataFrame, model: DataFrame) -> DataFrame:
    """rows (column word, any others) plus lemma, pos_tag of each analysis, listed or guessed; for a trie of at most FEW suffixes, which every task
    holds by length, so no row moves."""
    known = rows.join(lex, "word", "left").withColumnRenamed("pos_tag", "listed")
    for k in range(1, LONGEST + 1):
        nodes = model.filter(F.char_length("suffix") == k).select(F.col("suffix").alias("_suffix"), F.col("rules").alias(f"_rules{k}"))
        known = known.join(F.broadcast(nodes), F.right("word", F.lit(k)) == F.col("_suffix"), "left").drop("_suffix")
    known = known.select(*rows.columns, "base_form", "listed", F.coalesce(*[F.col(f"_rules{k}") for k in range(LONGEST, 0, -1)]).alias("rules"))
    # a listed word stands for its base form: all of it goes, the base form comes
    listed = F.array(F.struct(F.char_length("word").alias("strip"), F.col("base_form").alias("ending"), F.col("listed").alias("pos_tag"))).cast(RULES)
    return known.select(*rows.columns, F.explode(F.when(F.col("base_form").isNotNull(), listed).otherwise(_applied(F.col("rules")))).alias("r")).select(*rows.columns, *_analysis())


def accuracy(lex: DataFrame, held_out: DataFrame, **options: float) -> DataFrame:
    """words, hits, exact: how many held-out words get one of their base forms, and how many get exactly their analyses (base form and part of speech)."""
    wanted = held_out.select("word", F.struct(F.col("base_form").alias("lemma"), "pos_tag").alias("a")).groupBy("word").agg(F.array_sort(F.collect_set("a")).alias("wanted"))
    got = guess(wanted.select("word"), learn(lex, **options)).groupBy("word").agg(F.array_sort(F.collect_set(F.struct("lemma", "pos_tag"))).alias("got"))
    both = wanted.join(got, "word")
    hit = F.arrays_overlap("wanted.lemma", "got.lemma")
    return both.agg(F.count("*").alias("words"), F.count_if(hit).alias("hits"), F.count_if(F.col("wanted") == F.col("got")).alias("exact"))
