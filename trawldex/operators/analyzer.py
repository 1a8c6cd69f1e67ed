"""Text analysis: tokens, lemmas, part-of-speech filter. A profile names the alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawldex.functions.html import once
from trawldex.operators import morphology

#: Letters of each profile, as the inside of a character class.
ALPHABETS = {"ru": "А-Яа-яёЁ", "latin": r"\p{L}"}

#: A small lexicon (word, base form, part of speech). A word may have several analyses; a word that is not
#: listed stands for itself. PREP, CONJ and INTJ are left out of an index.
STOP_POS = ["PREP", "CONJ", "INTJ"]
_LISTED = {
    "PREP": "of in to for on by with at from into over under after before между в на с к по из у о от до для "
    "en par dans avec sans sur auf für mit von zu aus bei nach por con desde hasta",
    "CONJ": "and or but for nor und oder aber denn et ou mais donc y pero и или но а",
    "INTJ": "oh ah ach hélas ay ох ах эй",
}
_FORMS = "is>be was>be are>be were>be be>be has>have had>have the>the that>that this>this these>this is>is ist>sein sind>sein est>être sont>être les>le la>le le>le los>el las>el el>el страны>страна кошки>кошка кошек>кошка"


def lexicon_rows() -> list[tuple[str, str, str]]:
    rows = [(w, w, pos) for pos, words in _LISTED.items() for w in words.split()]
    return rows + [(*f.split(">"), "WORD") for f in _FORMS.split()] + [("that", "that", "CONJ")]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), "word string, base_form string, pos string")


def load_lexicon(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A lexicon of any size from a table (word, base_form, pos): parquet, or csv with tabs. Words are folded as tokens are; repeated rows count once.

    Spark broadcasts it if it is small and joins by sorting otherwise."""
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("sep", "\t").schema("word string, base_form string, pos string").csv(path)
    return rows.select(F.lower("word").alias("word"), F.lower("base_form").alias("base_form"), F.upper("pos").alias("pos")).filter("word IS NOT NULL AND base_form IS NOT NULL").distinct()


def tokens(text: Column, profile: str = "latin") -> Column:
    """Array of words. Other characters than letters, spaces and hyphens are deleted, as are hyphens with a neighbour that is
    no letter on both sides (with those neighbours); hyphens inside and at the edge of words stay."""
    a = ALPHABETS[profile]
    kept = F.regexp_replace(text, f"[^{a} -]+", "")
    # one or two hyphens alone are no word
    hyphens = lambda t: F.regexp_replace(F.regexp_replace(t, f"[^{a}]-[^{a}]", ""), "(?<![^ ])--?(?![^ ])", "")
    kept = once(kept, lambda t: F.when(F.contains(t, F.lit("-")), hyphens(t)).otherwise(t))
    return F.array_remove(F.split(F.lower(kept), " "), "")


def token_rows(rows: DataFrame, keys: list[str], text: str = "content", profile: str = "latin") -> DataFrame:
    """keys, pos (from 0), word."""
    return rows.select(*keys, F.posexplode(tokens(F.col(text), profile)).alias("pos", "word"))


def page_tokens(rows: DataFrame, keys: list[str], profile: str = "latin", text: str = "content") -> DataFrame:
    """token_rows of texts that are dealt by their keys before they are cut: what groups by these keys, and by more, moves no row for each word."""
    return token_rows(rows.select(*keys, text).repartition(*keys), keys, text, profile)


def page_words(rows: DataFrame, keys: list[str], profile: str = "latin", text: str = "content") -> DataFrame:
    """keys, word, n, pos (first place): distinct words, so that a lexicon meets each word of a page once."""
    return page_tokens(rows, keys, profile, text).groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


def analyses(words: DataFrame, lex: DataFrame, model: DataFrame | None = None, few: bool = False) -> DataFrame:
    """words plus lemma and part of speech of each analysis, prepositions, conjunctions and interjections included.

    A word that the lexicon does not list stands for itself or, with a model (see morphology.learn), for what its ending says. Then distinct words
    are looked up and guessed, each once, and what they stand for is joined to the rows; few: the model has no more than morphology.FEW suffixes, and
    rows are looked up where they are.
    """
    if model is None:
        found = words.join(lex, "word", "left")
        return found.withColumn("lemma", F.coalesce("base_form", "word")).drop("base_form")
    if few:
        return morphology.guess_in_place(words, lex, model)
    listed = words.select("word").distinct().join(lex, "word", "left")
    known = listed.filter("base_form IS NOT NULL").select("word", F.col("base_form").alias("lemma"), "pos_tag")
    return words.join(known.unionByName(morphology.guess(listed.filter("base_form IS NULL").select("word"), model)), "word")


def lemmas(words: DataFrame, lex: DataFrame, model: DataFrame | None = None, few: bool = False) -> DataFrame:
    """words plus lemma: one row for each analysis that is kept."""
    return analyses(words, lex, model, few).filter(F.coalesce(~F.col("pos_tag").isin(*STOP_POS), F.lit(True))).drop("pos_tag")


def lexicon_for_join(lex: DataFrame) -> DataFrame:
    """The lexicon with its part of speech under a name of its own (token rows have a position called pos)."""
    return lex.select("word", "base_form", F.col("pos").alias("pos_tag"))


def query_lemmas(spark: SparkSession, query: str, lex: DataFrame, profile: str = "latin", model: DataFrame | None = None) -> DataFrame:
    """Distinct lemmas of a query: as many rows as the query has words, at most a few more."""
    row = spark.range(1).select(F.lit(query).alias("content"))
    return lemmas(token_rows(row, [], profile=profile), lex, model).select("lemma").distinct()


def matched_words(words: DataFrame, lex: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct words of each group whose kept lemmas are wanted, with their first position."""
    hit = lemmas(words, lex).join(wanted, "lemma", "left_semi")
    return hit.groupBy(*keys, "word").agg(F.min("pos").alias("first_pos"))
