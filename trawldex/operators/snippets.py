"""Snippets: windows of words around the hits, merged and highlighted, as expressions. Used on the rows of one result page only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Letters and hyphens make words; digits and others do not.
WORD, OTHER = r"[\p{L}-]+", r"[^\p{L}-]"
BETWEEN = " ... <...> ... "


def _words(radius: int) -> str:
    """So many words, with something between every two, so that no word is taken for two."""
    return f"{WORD}(?:{OTHER}+{WORD}){{{radius - 1}}}"


def border(content: Column, start: Column, radius: int, right: bool) -> Column:
    """Where a window of `radius` words beyond place start (from 0) ends: at a tag's bracket or the text's end at the latest.

    To the right the end is exclusive, to the left it is the first character of the window: the one before the last word, if there is one.
    """
    if radius < 1:
        raise ValueError("a window has one word or more on each side")
    if right:
        rest = F.substring_index(F.substr(content, start + 1), "<", 1)
        words = F.char_length(F.regexp_extract(rest, f"^{OTHER}*{_words(radius)}", 0))
        return start + F.when(words > 0, words).otherwise(F.char_length(rest))
    rest = F.substring_index(F.substr(content, F.lit(1), start + 1), ">", -1)
    words = F.char_length(F.regexp_extract(rest, f"(?:^|{OTHER}){_words(radius)}{OTHER}*\\z", 0))
    end = F.least(start + 1, F.char_length(content))
    return end - F.when(words > 0, words).otherwise(F.char_length(rest))


def merge(spans: Column) -> Column:
    """Overlapping or touching spans (array of a, b) become one, in order: a fold over the few spans of one text."""
    kind = "array<struct<a:int,b:int>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] <= last["b"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def _place(word: Column, text: Column) -> Column:
    """Place of a word (lower case) in a text of any case, from 1; 0 if there is none."""
    return F.position(word, F.lower(text))


def highlight_first(text: Column, word: Column, place: Column | None = None) -> Column:
    """The first occurrence of word in bold, if there is one."""
    at = F.position(word, text) if place is None else place
    n = F.char_length(word)
    done = F.concat(F.substr(text, F.lit(1), at - 1), F.lit("<b>"), F.substr(text, at, n), F.lit("</b>"), F.substr(text, at + n))
    return F.when(at > 0, done).otherwise(text)


def snippet(content: Column, words: Column, radius: int) -> Column:
    """Windows around the first occurrence of each word (array), joined, with each word's first occurrence in them in bold; empty if none occurs."""
    found = F.filter(words, lambda w: _place(w, content) > 0)
    left = lambda w: border(content, F.greatest(_place(w, content) - 2, F.lit(0)), radius, False)
    right = lambda w: border(content, _place(w, content) - 1 + F.char_length(w), radius, True)
    spans = merge(F.transform(found, lambda w: F.struct(left(w).alias("a"), right(w).alias("b"))))
    pieces = F.transform(spans, lambda s: F.substr(content, s["a"] + 1, s["b"] - s["a"]))
    text = F.concat(F.lit("... "), F.array_join(pieces, BETWEEN), F.lit(" ..."))
    marked = F.aggregate(words, text, lambda t, w: highlight_first(t, w, _place(w, t)))
    return F.coalesce(F.when(F.size(pieces) > 0, marked), F.lit(""))


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of merged intervals (inclusive bounds; touching ones merge)."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def word_window(words: Column, at: Column, radius: int) -> Column:
    """Words of the array from radius before to radius after place `at` (from 1)."""
    first = F.greatest(at - radius, F.lit(1))
    return F.slice(words, first, at + radius - first + 1)
