"""Repair of conversations whose turns are damaged: the cheapest edits that make the roles a dialogue.

Roles must read `(s?(ua)+)?` by their initials. Kept rows cost nothing, rows given another role 2, deleted rows 3 (blank rows and repeated ones
must go), inserted ones 2, and a truncated row that stays costs 1 more. What the rest of a conversation costs from each of the four places of
that grammar is a vector of four numbers. Less their least one, only a few dozen vectors exist: they are the states of an automaton that reads
rows from the last to the first. Its transitions are worked out when they are first needed and kept in a table, so reading a row is one
look-up. From the first row on, arcs whose cost is exactly the difference of two vectors (tight arcs) give the edits; of several the least
letter is taken, so the audit is the least of all cheapest ones.

Rows are dealt to blocks of bounded size by ranges of (conversation, turn), so a conversation of any length lies in many blocks. Where one does,
each block says what it makes of every state, and these maps are folded from the last block to the first; then each block traces its
rows from every place that it can be entered at, and the pieces are chained.

Defined results: rows of equal turn are ordered by role and text; null role or text is one space, which makes a text blank and a role one that
must change; rows without a turn come first; rows without a conversation id are one conversation, whose id is null; repeated rows are repeated
turns; an empty table gives none; only the four named columns are read; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.llm.common import WS_CHARS, materialize

BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 100_000

# the grammar: nothing yet, after system, after user, after assistant
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEEDED = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
KINDS = "sua"
GONE = 8  # symbols: place of the initial among s, u, a, others; 4 more if truncated; or this
DELETE, INSERT, REROLE, LATE = 3, 2, 2, 1
END = (0, 4, 2, 0)  # what finishing costs when no rows are left


def _arcs(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next place) of the edits of a row, in the order of their letters; inserting is not among them."""
    arcs = [("D", DELETE, place)]
    if symbol != GONE:
        late = LATE * (symbol // 4)
        kept = NEXT[KINDS[symbol % 4]].get(place) if symbol % 4 < 3 else None
        if kept is not None:
            arcs.append(("K", late, kept))
        arcs.append(("R", REROLE + late, NEXT[NEEDED[place][0]][place]))
    return arcs


def _inserted(place: int) -> int:
    return NEXT[NEEDED[place][0]][place]


class Automaton:
    """The determinised automaton; states are normalised cost vectors, transitions are worked out once."""

    def __init__(self):
        self.states: list[tuple[int, ...]] = [END]
        self._number = {END: 0}
        self._table: dict[tuple[int, int], tuple[int, int]] = {}
        self._steps: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def number(self, vector: tuple[int, ...]) -> int:
        if vector not in self._number:
            self._number[vector] = len(self.states)
            self.states.append(vector)
        return self._number[vector]

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """(state before a row, what it adds to the costs) from the state after it."""
        found = self._table.get((state, symbol))
        if found is None:
            after = self.states[state]
            costs = [min(c + after[q] for _, c, q in _arcs(symbol, place)) for place in range(4)]
            for _ in range(3):  # two insertions in a row at most lead anywhere new
                costs = [min(c, INSERT + costs[_inserted(place)]) for place, c in enumerate(costs)]
            least = min(costs)
            found = self._table[state, symbol] = (self.number(tuple(c - least for c in costs)), least)
        return found

    def step(self, state: int, symbol: int, place: int) -> tuple[str, int, int]:
        """(letters, next place, cost) of the cheapest edits up to and with a row, least letters first; state is the one after the row."""
        key = (state, symbol, place)
        if key not in self._steps:
            number, gain = self.before(state, symbol)
            now, after = self.states[number], self.states[state]
            letters, cost = "", 0
            while key not in self._steps:
                tight = {x: (q, c) for x, c, q in _arcs(symbol, place) if now[place] + gain == c + after[q]}
                if "D" not in tight and now[place] == INSERT + now[_inserted(place)]:
                    letters, cost, place = letters + "I", cost + INSERT, _inserted(place)
                    continue
                letter = min(tight)
                self._steps[key] = (letters + letter, tight[letter][0], cost + tight[letter][1])
        return self._steps[key]

    def finish(self, place: int) -> tuple[str, int]:
        letters = "I" * (END[place] // INSERT)
        return letters, END[place]

    def closed(self) -> list[tuple[int, ...]]:
        """All vectors that any rows can lead to, in order: some dozens."""
        done = 0
        while done < len(self.states):
            for symbol in range(GONE + 1):
                self.before(done, symbol)
            done += 1
        return sorted(self.states)


# tables


def _blocks(rows: DataFrame, block_bytes: int, block_rows: int) -> DataFrame:
    """conv, turn, role, text, init, blank, cut, rid, block in order, written: rid rises with (conv, turn, role, text)."""
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-size[0] // block_rows), -(-size[1] // block_bytes))
    inner = F.btrim("text", F.lit(WS_CHARS))
    # the last key parts equal rows, which may be many
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "spread"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select("conv", "turn", "role", "text", F.substr("role", F.lit(1), F.lit(1)).alias("init"), (inner == "").alias("blank"), (~F.right(inner, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("block"))
    return materialize(rows, "repair-turns")


def _later_copies(turns: DataFrame) -> DataFrame:
    """block, rid of rows whose role and text an earlier row of the conversation has: only hashes move."""
    name = [F.xxhash64("conv", "role", "text").alias("k1"), F.xxhash64(F.lit("turn"), "text", "role", "conv").alias("k2")]
    rows = turns.filter("NOT blank").select(*name, "rid", "block")
    first = rows.groupBy("k1", "k2").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, ["k1", "k2"]).filter("rid > first").select("block", "rid")


def _symbols(rows: pa.Table, copies: set[int]) -> list[int]:
    out = []
    for init, blank, cut, rid in zip(*(rows.column(c).to_pylist() for c in ("init", "blank", "cut", "rid")), strict=True):
        kind = KINDS.find(init) if init else 3
        out.append(GONE if blank or rid in copies else (3 if kind < 0 else kind) + 4 * cut)
    return out


def _segments(rows: pa.Table) -> Iterator[tuple[object, int, int]]:
    """(conv, begin, end) of the conversations in a sorted block."""
    conv = rows.column("conv").to_pylist()
    begin = 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[begin]:
            yield conv[begin], begin, i
            begin = i


def _later_ends(turns: DataFrame, copies: DataFrame) -> DataFrame:
    """block, last: the state (its place among all) after the last row of blocks whose last conversation goes on in the next block."""
    spans = turns.groupBy("conv", "block").agg(F.count("*").alias("n")).groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("c"))
    kind = turns.schema["conv"].dataType.simpleString()
    if spans.isEmpty():
        return turns.sparkSession.createDataFrame([], "block int, last int")

    def maps(left: pa.Table, right: pa.Table) -> pa.Table:
        """What the block makes of each state that may follow it (each conversation; only long ones are here)."""
        left = left.sort_by("rid")
        symbols, table = _symbols(left, set(right.column("rid").to_pylist())), Automaton()
        every = table.closed()
        number = {table.number(v): i for i, v in enumerate(every)}
        back = [[number[table.before(table.number(v), s)[0]] for v in every] for s in range(GONE + 1)]
        back = np.array(back)
        out = []
        for conv, begin, end in _segments(left):
            state = np.arange(len(every))
            for s in reversed(symbols[begin:end]):
                state = back[s][state]
            out.append((conv, left.column("block")[0].as_py(), state.tolist()))
        conv, block, to = zip(*out, strict=True) if out else ((), (), ())  # a block may have copies and no long conversation
        return pa.table({"conv": pa.array(conv, left.schema.field("conv").type), "block": pa.array(block, pa.int32()), "to": pa.array(to, pa.list_(pa.int32()))})

    narrow = turns.select("conv", "init", "blank", "cut", "rid", "block").join(spans, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    parts = narrow.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(maps, f"conv {kind}, block int, to array<int>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's last block to its first: the state after each block but the last."""
        conv, state, following = None, -1, None
        start = Automaton().closed().index(END)
        for batch in batches:
            out = []
            for c, block, to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if following is None or c != conv:
                    state = start
                else:
                    out.append((block, state))
                conv, following, state = c, block, to[state]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*out, strict=True)], names=["block", "last"])

    return parts.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(fold, "block int, last int")


def _pieces(turns: DataFrame, copies: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for each conversation, block and place that the block is entered at."""
    kind = turns.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, block int, entry int, leave int, cost long, audit string, repaired string, blank long, copies long, cut long, illegal long, init string, fin string, turns long, low long, high long, first_turn long, last_turn long"

    def trace(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("rid")
        later = set(right.column("rid").to_pylist()) - {None}
        last = next((x for x in right.column("last").to_pylist() if x is not None), None)
        table = Automaton()
        start = 0 if last is None else table.number(Automaton().closed()[last])
        symbols = _symbols(left, later)
        role, text, turn, init, blank, cut, rid = (left.column(c).to_pylist() for c in ("role", "text", "turn", "init", "blank", "cut", "rid"))
        block, out = left.column("block")[0].as_py(), []
        for conv, begin, end in _segments(left):
            goes_on = end == len(symbols) and last is not None
            state, after = (start if goes_on else 0), []
            for s in reversed(symbols[begin:end]):
                after.append(state)
                state, _ = table.before(state, s)
            after.reverse()
            copied = [rid[i] in later for i in range(begin, end)]
            known = [t for t in turn[begin:end] if t is not None]
            counts = (
                sum(blank[begin:end]), sum(copied), sum(cut[i] and not blank[i] and not c for i, c in zip(range(begin, end), copied, strict=True)),
                sum(init[i] + init[i + 1] not in ("su", "ua", "au") for i in range(begin, end - 1)), init[begin], init[end - 1], len(set(known)),
                min(known, default=None), max(known, default=None), turn[begin], turn[end - 1],
            )
            # only the first conversation of a block can have begun before
            for entry in range(4) if begin == 0 else (NOTHING,):
                place, cost, letters, lines = entry, 0, [], []
                for i, s in zip(range(begin, end), after, strict=True):
                    edits, follow, more = table.step(s, symbols[i], place)
                    cost += more
                    letters.append(edits)
                    for _ in edits[:-1]:
                        lines.append(NEEDED[place] + ":")
                        place = _inserted(place)
                    if edits[-1] != "D":
                        lines.append((role[i] if edits[-1] == "K" else NEEDED[place]) + ":" + text[i])
                    place = follow
                if not goes_on:
                    edits, more = table.finish(place)
                    cost += more
                    letters.append(edits)
                    for _ in edits:
                        lines.append(NEEDED[place] + ":")
                        place = _inserted(place)
                out.append((conv, block, entry, place, cost, "".join(letters), "\n".join(lines) if lines else None, *counts))
        names = [f.split()[0] for f in schema.split(", ")]
        types = [left.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]
        return pa.table({n: pa.array(x, t) for n, t, x in zip(names, types, zip(*out, strict=True), strict=True)})

    known = copies.select("block", "rid", F.lit(None).cast("int").alias("last")).unionByName(ends.select("block", F.lit(None).cast("long").alias("rid"), "last"))
    rows = turns.withColumn("turn", F.col("turn").cast("long"))
    # blocks without rows are in neither side
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(trace, schema)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _chained(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: pieces in order, entered where the one before was left. Rows stream by; only the audit is kept."""
    kind = pieces.schema["conv"].dataType.simpleString()
    columns = pieces.columns

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fields = None, {}

        def result() -> tuple:
            gaps = 0 if fields["low"] is None else fields["high"] - fields["low"] + 1 - fields["turns"]
            return (now[0], gaps, fields["blank"], fields["copies"], fields["cut"], fields["illegal"], fields["cost"], "".join(fields["audit"]), fields["sha"].hexdigest())

        type_of = None
        for batch in batches:
            type_of, out = batch.schema.field("conv").type, []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                r = dict(zip(columns, row, strict=True))
                if now is None or now[0] != r["conv"]:
                    if now is not None:
                        out.append(result())
                    now = (r["conv"],)
                    fields = dict.fromkeys(("blank", "copies", "cut", "illegal", "cost", "turns"), 0) | {"low": None, "high": None, "audit": [], "sha": hashlib.sha256(), "any": False, "place": NOTHING, "fin": None, "last_turn": None, "block": None}
                if r["block"] == fields["block"] or r["entry"] != fields["place"]:
                    continue  # the piece of another place
                fields["block"], fields["place"] = r["block"], r["leave"]
                for c in ("blank", "copies", "cut", "illegal", "cost", "turns"):
                    fields[c] += r[c]
                if fields["fin"] is not None:
                    fields["illegal"] += fields["fin"] + r["init"] not in ("su", "ua", "au")
                    # a turn that goes on in this block was counted in the one before
                    fields["turns"] -= r["first_turn"] is not None and r["first_turn"] == fields["last_turn"]
                fields["fin"], fields["last_turn"] = r["fin"], r["last_turn"]
                if r["low"] is not None:
                    fields["low"] = r["low"] if fields["low"] is None else min(fields["low"], r["low"])
                    fields["high"] = r["high"] if fields["high"] is None else max(fields["high"], r["high"])
                fields["audit"].append(r["audit"])
                if r["repaired"] is not None:
                    if fields["any"]:
                        fields["sha"].update(b"\n")
                    fields["sha"].update(r["repaired"].encode())
                    fields["any"] = True
            if out:
                yield _records(out, type_of)
        if now is not None:
            yield _records([result()], type_of)

    return pieces.repartition("conv").sortWithinPartitions("conv", "block", "entry").mapInArrow(chain, f"conv {kind}, {RESULT}")


def _records(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", *(f.split()[0] for f in RESULT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def repaired(rows: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows (conv_id, turn, role, text)."""
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turns = _blocks(rows, block_bytes, block_rows)
    copies = materialize(_later_copies(turns), "repair-copies")
    ends = _later_ends(turns, copies)
    return _chained(_pieces(turns, copies, ends)).withColumnRenamed("conv", "conv_id")
