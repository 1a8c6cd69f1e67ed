import hashlib
import random

from pyspark.sql import functions as F

from trawldex.llm import chat, q_chat


def test_sql(same):
    same(q_chat.op1_chat_format, q_chat.OP1_SQL)


def test_round_trip(spark):
    random.seed(4)
    bits = ["</s>", "<s>", "[INST]", " [/INST]", "\\", "\\\\", "[", "<", "é", "\n", "[SYS] ", "[ROLE]", "[/ROLE]", "<\\s>", "x"]
    rows, want = [], {}
    for c in range(40):
        turns = []
        for t in range(random.randrange(1, 150 if c < 3 else 6)):
            role = random.choice(["user", "assistant", "system", "tool", "[ROLE]x\\", "", None])
            text = random.choice([None, "".join(random.choice(bits) for _ in range(random.randrange(12)))])
            rows.append((c, t, role, text))
            turns.append((role or "", text or ""))
        want[c] = turns
    random.shuffle(rows)
    log = chat.turns_to_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(log))).collect()}
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert list(back[c].masked) == [x for r, x in turns if r == "assistant"]
        assert back[c].formatted.count("<s>") == len(turns)


def test_events(spark):
    log = [
        (1, 0, 0, 0, "start", "user", "hi"),
        (1, 1, 0, 0, "start", "assistant", ""),
        (1, 1, 0, 1, "delta", None, "he"),
        (1, 1, 0, 2, "delta", None, "llo"),
        (1, 1, 0, 700, "regenerate", "assistant", "go"),
        (1, 1, 0, 701, "delta", None, "od"),
        (1, 2, 0, 0, "start", "user", "typo"),
        (1, 2, 0, 5, "edit", None, "fixed"),
        (1, 3, 0, 0, "start", "assistant", "gone"),
        (1, 3, 0, 9, "delete", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, part int, seq long, op string, role string, text string")
    out = [(r.turn, r.role, r.text) for r in chat.fold(events).orderBy("turn").collect()]
    assert out == [(0, "user", "hi"), (1, "assistant", "good"), (2, "user", "fixed")]


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, None, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.fold(chat.turns_to_events(turns)))).collect()}
    assert back == {None: [("", ""), ("", "")], 2: [("system", "s"), ("user", "a"), ("user", "a")]}
    assert chat.render(chat.fold(chat.turns_to_events(turns.limit(0)))).count() == 0


def test_hard_conversation(spark, sf):
    r = q_chat.op1_chat_format(spark, sf).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_turns == 2 and r.loss_chars == len(said)


def test_history_of_a_session(spark):
    rows = [(1, t, ["user", "assistant", "tool", None][t % 4], [None, "", "é", "of some length"][t % 3]) for t in range(24)] + [(1, 5, "assistant", "again"), (1, None, "assistant", "ab")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.turns_to_history(turns)
    ops = {r.op: r["count"] for r in log.groupBy("op").count().collect()}
    assert set(ops) == {"start", "delta", "edit", "regenerate", "delete"} and log.selectExpr("max(seq) > 256").first()[0]
    key = lambda r: (r.turn is not None, r.turn or 0, r.role, r.text)
    folded = sorted(map(key, chat.fold(log.orderBy(F.rand(3))).collect()))
    assert folded == sorted(map(key, chat.fold(chat.turns_to_events(turns)).collect()))


def test_very_long_text(spark):
    long = "</s>[INST] \\ ok " * 40_000
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.parse(chat.render(chat.fold(chat.turns_to_history(turns)))).first()
    assert [t.text for t in r.turns] == ["q", long] and list(r.masked) == [long]
