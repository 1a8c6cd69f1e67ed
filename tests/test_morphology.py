import random

from pyspark.sql import functions as F

from trawldex.operators import analyzer, morphology

ENTRY = "word string, base_form string, pos_tag string"
#: Endings of regular paradigms: what the base form ends in, its part of speech, endings of its forms.
PARADIGMS = [
    ("а", "NOUN", ["а", "ы", "е", "у", "ой", "ам", "ами", "ах"]),
    ("ь", "NOUN", ["ь", "и", "ью", "ей", "ям"]),
    ("ый", "ADJ", ["ый", "ого", "ому", "ым", "ая", "ую", "ые", "ыми"]),
    ("ать", "VERB", ["ать", "аю", "аешь", "ает", "аем", "ают", "ал", "ала"]),
    ("ть", "VERB", ["ть", "лю", "ишь", "ит", "ят", "л", "ли"]),
    ("y", "NOUN", ["y", "ies"]),
    ("e", "VERB", ["e", "es", "ed", "ing"]),
    ("", "NOUN", ["", "s"]),
]


def _lexicon(n):
    rng = random.Random(11)
    rows = set()
    for i in range(n):
        end, pos, forms = PARADIGMS[i % len(PARADIGMS)]
        letters = ("бвгдклмнпрст", "аеиоу") if "а" <= (end or "z")[0] else ("bcdfgklmnprt", "aeiou")
        stem = "".join(rng.choice(letters[k % 2]) for k in range(rng.choice([5, 7])))
        rows |= {(stem + f, stem + end, pos) for f in forms}
    return sorted(rows)


def test_held_out_accuracy(spark):
    rows = _lexicon(2400)
    bases = sorted({r[1] for r in rows})
    random.Random(1).shuffle(bases)
    held = set(bases[: len(bases) // 5])  # whole paradigms are held out
    train, test = ([r for r in rows if (r[1] in held) == h] for h in (False, True))
    got = morphology.accuracy(spark.createDataFrame(train, ENTRY), spark.createDataFrame(test, ENTRY)).first()
    assert got.words > 1000 and got.hits >= 0.95 * got.words and got.exact >= 0.6 * got.words, got


def test_several_analyses(spark):
    lex = [(f"st{c}ks", f"st{c}k", "NOUN") for c in "aeiou"] + [(f"st{c}ks", f"st{c}k", "VERB") for c in "aei"] + [("oddks", "oddly", "ADV"), ("went", "go", "VERB")]
    model = morphology.learn(spark.createDataFrame(lex, ENTRY))
    words = spark.createDataFrame([(w,) for w in ("blanks", "ks", "zzz", "")], "word string")
    got = sorted((r.word, r.lemma, r.pos_tag or "") for r in morphology.guess(words, model).collect())
    assert got == [("", "", ""), ("blanks", "blank", "NOUN"), ("blanks", "blank", "VERB"), ("ks", "ks", ""), ("zzz", "zzz", "")]
    assert {r.suffix for r in model.collect()} == {"s"}  # longer suffixes say the same
    assert morphology.learn(spark.createDataFrame([], ENTRY)).isEmpty()


def test_listed_words_are_not_guessed_and_stop_words_go(spark):
    lex = analyzer.lexicon_for_join(analyzer.lexicon(spark))
    taught = spark.createDataFrame([(f"wor{c}s", f"wor{c}", "NOUN") for c in "abcd"] + [(f"pl{c}cks", f"pl{c}ck", "INTJ") for c in "abc"], ENTRY)
    words = spark.createDataFrame([("has",), ("in",), ("birds",), ("birds",), ("trucks",)], "word string")
    got = sorted((r.word, r.lemma) for r in analyzer.lemmas(words, lex, morphology.learn(taught)).collect())
    assert got == [("birds", "bird"), ("birds", "bird"), ("has", "have")]


def test_learning_joins_no_words_twice(spark):
    """Unknown words are looked up once each, however often they occur."""
    model = morphology.learn(spark.createDataFrame([("cats", "cat", "NOUN"), ("rats", "rat", "NOUN")], ENTRY))
    words = spark.range(1000).select(F.lit("bats").alias("word"))
    lex = analyzer.lexicon_for_join(analyzer.lexicon(spark))
    assert analyzer.lemmas(words, lex, model).groupBy("lemma").count().collect() == [("bat", 1000)]


def test_few_suffixes_are_looked_up_in_place(spark):
    """The same analyses, listed and guessed, and nothing but the lexicon and the trie is sent."""
    taught = _lexicon(300) + [("wers", "wer", "NOUN"), ("ters", "ter", "NOUN"), ("abcdefgh", "ab", "VERB"), ("zbcdefgh", "zb", "VERB")]
    learned = morphology.learn(spark.createDataFrame(taught, ENTRY))
    model = spark.createDataFrame(learned.collect(), learned.schema)
    lex = F.broadcast(analyzer.lexicon_for_join(analyzer.lexicon(spark)))
    words = sorted({w for w, *_ in _lexicon(600)} | {"", "s", "es", "that", "in", "has", "x", "bcdefgh", "qbcdefgh", "qqbcdefgh", "кошки"})
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, word string")
    found = [analyzer.analyses(rows, lex, model, few) for few in (False, True)]
    plain, place = [sorted((r.id, r.word, r.lemma, r.pos_tag or "") for r in x.collect()) for x in found]
    assert plain == place and {i for i, *_ in place} == set(range(len(words)))
    plan = found[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(word" not in plan


def test_derived_lexicon_reads_the_words_once(spark, sf):
    """The vocabulary is a table of its own: neither the lexicon nor the pages' analyses cut the documents again."""
    from trawldex.plans import queries, views

    for rows in (views.derived_lex(spark, sf), queries.morph_pages(spark, sf)):
        assert "documents.parquet" not in "".join(rows.inputFiles())
