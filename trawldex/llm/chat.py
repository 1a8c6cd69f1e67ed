"""Chat formatting by event-sourced reconstruction (DataFrame expressions only).

A log holds events (conv_id, turn, seq, op, role, text). `fold` rebuilds each message from its events in
sequence order: `start`, `edit` and `regenerate` replace what the message said so far, `delta` appends
to it, `delete` removes it. The fold is associative, so events are folded in blocks of the sequence and
the blocks' states are folded again; no task needs all events of a conversation. `render` writes each
conversation as one string, again by blocks of turns, with a mask over the assistant's texts.

The template: `<s>` opens and `</s>` closes a turn; inside, `[INST] text [/INST]` for a user,
`[SYS] text [/SYS]` for a system, the bare text for an assistant and `[ROLE]role[/ROLE]text` for any other
role. In texts and roles a backslash is doubled and a control string gets a single backslash after its first
character, so control strings never occur inside them and `parse` gets back the very input.

Defined results: null text and null role count as empty; a null conv_id is a conversation of its own; null turns
and sequences sort first; events with the same sequence are ordered by op, role and text; an empty log gives no
rows; a message without `start` begins empty; other columns are ignored, whatever their names. A text may be of any length, but a
formatted conversation is one value, so it is bounded by Spark's 2 GB limit on a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed values of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
REPLACING = ["start", "edit", "regenerate"]
EVENTS_PER_BLOCK = 256
TURNS_PER_BLOCK = 64


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _merged(items: str, zero_text: str = "''") -> Column:
    """Fold an array of states {reset, gone, role, text} in their order: a reset forgets what came before."""
    return F.expr(
        f"""aggregate({items}, named_struct('reset', false, 'gone', false, 'role', CAST(NULL AS STRING), 'parts', CAST(array() AS array<string>)),
          (a, x) -> CASE WHEN x.reset THEN named_struct('reset', true, 'gone', x.gone, 'role', coalesce(x.role, a.role), 'parts', array(x.text))
                         ELSE named_struct('reset', a.reset, 'gone', a.gone, 'role', coalesce(x.role, a.role), 'parts', concat(a.parts, array(x.text))) END,
          a -> named_struct('reset', a.reset, 'gone', a.gone, 'role', a.role, 'text', array_join(a.parts, '')))"""
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text); `part` tells messages of the same turn apart."""
    state = F.struct(
        "seq", "op", F.col("op").isin(*REPLACING, "delete").alias("reset"), (F.col("op") == "delete").alias("gone"), "role",
        F.when(F.col("op") == "delete", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )
    keys = ["conv_id", "turn", "part"]
    blocks = events.groupBy(*keys, F.floor(F.col("seq") / EVENTS_PER_BLOCK).alias("__b")).agg(F.sort_array(F.collect_list(state)).alias("__e"))
    blocks = blocks.select(*keys, "__b", _merged("__e").alias("s"))
    whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__b"), F.col("s.reset").alias("reset"), F.col("s.gone").alias("gone"), F.col("s.role").alias("role"), F.col("s.text").alias("text")))).alias("__e"))
    done = whole.select(*keys, _merged("__e").alias("s")).filter(~F.col("s.gone"))
    return done.select(*keys, F.coalesce("s.role", F.lit("")).alias("role"), F.col("s.text").alias("text"))


def render_turn(role: Column, text: Column) -> Column:
    t = escape(text)
    inner = (
        F.when(role == "user", F.concat(F.lit("[INST] "), t, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("[SYS] "), t, F.lit(" [/SYS]")))
        .when(role == "assistant", t)
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), t))
    )
    return F.concat(F.lit("<s>"), inner, F.lit("</s>"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, and loss_mask as (turn, start, end) for each assistant turn.

    `turn` counts the conversation's turns from 0; start and end are code points within that rendered turn.
    """
    line = render_turn(F.col("role"), F.col("text"))
    spoken = F.when(F.col("role") == "assistant", F.char_length(escape(F.col("text"))))
    rows = messages.select("conv_id", F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("__b"), F.struct("turn", "part", "role", line.alias("line"), spoken.alias("spoken")).alias("m"))
    blocks = rows.groupBy("conv_id", "__b").agg(F.sort_array(F.collect_list("m")).alias("m"))
    blocks = blocks.select("conv_id", F.struct("__b", F.expr("array_join(transform(m, x -> x.line), '')").alias("text"), F.expr("transform(m, x -> x.spoken)").alias("spoken")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    spans = "filter(transform(flatten(transform(b, x -> x.spoken)), (n, i) -> named_struct('turn', i, 'start', 3, 'end', 3 + n)), x -> x.end IS NOT NULL)"
    return whole.select("conv_id", F.expr("array_join(transform(b, x -> x.text), '')").alias("formatted"), F.expr(spans).alias("loss_mask"))


def rendered_turns(formatted: Column) -> Column:
    """The rendered turns of a formatted conversation, each from `<s>` to `</s>`."""
    return F.transform(F.filter(F.split(formatted, "<s>"), lambda x: x != ""), lambda x: F.concat(F.lit("<s>"), x))


def parse_turn(line: Column) -> Column:
    """(role, text) of a rendered turn."""
    inner = F.substr(line, F.lit(4), F.char_length(line) - 7)
    cut = lambda head, tail: F.substr(inner, F.lit(head + 1), F.char_length(inner) - head - tail)
    role = F.substring_index(F.substr(inner, F.lit(7)), "[/ROLE]", 1)
    return (
        F.when(F.startswith(inner, F.lit("[INST] ")), F.struct(F.lit("user").alias("role"), unescape(cut(7, 8)).alias("text")))
        .when(F.startswith(inner, F.lit("[SYS] ")), F.struct(F.lit("system").alias("role"), unescape(cut(6, 7)).alias("text")))
        .when(F.startswith(inner, F.lit("[ROLE]")), F.struct(unescape(role).alias("role"), unescape(F.substr(inner, F.char_length(role) + 14)).alias("text")))
        .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(inner).alias("text")))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id with `turns` (role, text in order) and `masked` (the texts under the loss mask), read from the output."""
    lines = formatted.withColumn("__lines", rendered_turns(F.col("formatted")))
    masked = F.transform("loss_mask", lambda s: unescape(F.substr(F.get(F.col("__lines"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return lines.select("conv_id", "formatted", F.transform("__lines", parse_turn).alias("turns"), masked.alias("masked"))


def numbered(turns: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) with `part`: rows that share a turn are separate messages, in the order of role and text."""
    same = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    return turns.select("conv_id", "turn", (F.row_number().over(same) - 1).alias("part"), "role", "text")


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one `start` event per row."""
    return numbered(turns).select("conv_id", "turn", "part", F.lit(0).cast("long").alias("seq"), F.lit("start").alias("op"), "role", "text")


def turns_to_history(turns: DataFrame) -> DataFrame:
    """A table of finished turns as the log of a session that ends with them.

    An assistant's message is streamed in the wrong order, regenerated and streamed again; any other message starts as a draft and is
    edited, its second half following as a delta. Every third turn also has a message that is deleted in the end.
    Sequence numbers are far apart, so that a message's events lie in several blocks.
    """
    half = F.expr("CAST(char_length(text) DIV 2 AS INT)")
    a, b = F.substr(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1)
    step = EVENTS_PER_BLOCK // 2
    event = lambda k, op, text, role=None, part=0: F.struct(F.lit(part).alias("more"), F.lit(k * step).cast("long").alias("seq"), F.lit(op).alias("op"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.cast("string").alias("text"))
    role, none = F.col("role"), F.lit(None)
    streamed = F.array(event(0, "start", none, role), event(1, "delta", b), event(2, "delta", a), event(3, "regenerate", none, role), event(4, "delta", a), event(5, "delta", b))
    edited = F.array(event(0, "start", F.concat(F.lit("draft "), F.coalesce(b, F.lit(""))), role), event(3, "edit", a), event(4, "delta", b))
    dropped = F.array(event(0, "start", F.lit("never mind"), F.lit("user"), 1), event(2, "delete", none, None, 1))
    events = F.concat(F.when(role == "assistant", streamed).otherwise(edited), F.when(F.pmod("turn", F.lit(3)) == 0, dropped).otherwise(F.filter(dropped, lambda x: F.lit(False))))
    rows = numbered(turns).select("conv_id", "turn", "part", F.explode(events).alias("e"))
    return rows.select("conv_id", "turn", (F.col("part") * 2 + F.col("e.more")).alias("part"), "e.seq", "e.op", "e.role", "e.text")
