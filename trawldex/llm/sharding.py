"""Stable shards by jump consistent hashing (DataFrame expressions only).

A key's shard is a pure function of the key and the number of shards; there is no ring table, and
when shards are appended a row either stays or moves into a new shard. Rows are numbered gaplessly
within each shard without gathering a shard in one task: rows are dealt to (shard, block) cells, the
cells are counted with map-side combining, and a row's slot is its cell's offset plus its place in it.

Defined results: a null key counts as 0; a null text counts as empty; repeated rows are separate rows
with separate slots (which of two equal rows gets which slot cannot be told from the result); an empty
table gives an empty result; other columns are carried, and one that is called like a column of the result gets underscores behind its name;
texts are read once for size and checksum, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed values of the method: the multiplier 2862933555777941757 = (A1 << 32) + A0 of the generator.
A1, A0 = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
LOW = 0xFFFFFFFF


def jump_hash(key: str, shards: int) -> Column:
    """Shard of a long column, 0 to shards - 1.

    The 64-bit generator state is kept as two 32-bit halves (hi, lo), as a long product would overflow
    under ANSI arithmetic. A key needs about ln(shards) jumps: 32 steps are folded first, and only a key that
    has not landed by then is folded on, up to `shards` steps, which is the most there can be.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    # lo * A0 in 16-bit parts of A0, then what reaches the upper half.
    step = f"""CASE WHEN s.j >= {shards} THEN s ELSE
      aggregate(array(s.lo * {A0 & 0xFFFF}), named_struct('hi', s.hi, 'lo', s.lo, 'b', s.j, 'j', s.j), (r, t) ->
        named_struct(
          'hi', ( ((t + (((s.lo * {A0 >> 16}) & 65535) * 65536) + 1) DIV 4294967296) + ((s.lo * {A0 >> 16}) DIV 65536)
                + ((s.lo * {A1}) & {LOW}) + (s.hi * {A0 & 0xFFFF}) + (((s.hi * {A0 >> 16}) & 65535) * 65536) ) & {LOW},
          'lo', (t + (((s.lo * {A0 >> 16}) & 65535) * 65536) + 1) & {LOW},
          'b', s.j, 'j', s.j),
        r -> named_struct('hi', r.hi, 'lo', r.lo, 'b', r.b,
          'j', CAST(floor((r.b + 1) * (2147483648D / ((r.hi DIV 2) + 1))) AS BIGINT))) END"""
    k = f"coalesce(CAST(`{key}` AS BIGINT), 0L)"
    start = f"named_struct('hi', shiftrightunsigned({k}, 32), 'lo', {k} & {LOW}, 'b', -1L, 'j', 0L)"
    first = f"aggregate(sequence(1, {min(shards, 32)}), {start}, (s, i) -> {step})"
    if shards <= 32:
        return F.expr(f"CAST({first}.b AS INT)")
    rest = f"aggregate(sequence(1, {shards}), f, (s, i) -> {step})"
    return F.expr(f"aggregate(array({first}), {start}, (z, f) -> CASE WHEN f.j >= {shards} THEN f ELSE {rest} END, z -> CAST(z.b AS INT))")


CELL_ROWS = 50_000


def assign(rows: DataFrame, key: str, shards: int, grown: int | None = None, order: list[str] | None = None, blocks: int = 32, salt: str | None = None) -> DataFrame:
    """rows plus shard, slot and, if asked for, grown_shard (the shard among `grown`).

    Slots follow no meaning beyond being gapless; they are fixed by `order` (default: the key). `blocks` is the
    number of cells a shard is numbered in (`blocks_for` has one that fits the rows). Rows that agree in all of `order` share a cell
    unless `salt`, a column that stays the same when the rows are read again, parts them.
    """
    order = [*(order or [key]), *([salt] if salt else [])]
    result = {"shard", "slot", *(["grown_shard"] if grown is not None else [])}
    carried = {c: c for c in rows.columns if c != salt}
    for c in result & set(carried):
        while carried[c] in result or list(carried.values()).count(carried[c]) > 1 or carried[c] in set(rows.columns):
            carried[c] += "_"
    sort = [F.col(f"__row.`{c}`") for c in order]
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), jump_hash(key, shards).alias("shard"), *([] if grown is None else [jump_hash(key, grown).alias("grown_shard")]))
    out = out.withColumn("__cell", F.pmod(F.xxhash64(*sort), F.lit(blocks)).cast("int"))
    counts = out.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = W.partitionBy("shard").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("shard", "__cell").orderBy(*sort)) - 1
    out = out.withColumn("__place", place).join(offsets, ["shard", "__cell"]).withColumn("slot", (F.col("__before") + F.col("__place")).cast("long"))
    return out.select(*[F.col(f"__row.`{c}`").alias(n) for c, n in carried.items()], "shard", *([] if grown is None else ["grown_shard"]), "slot")


def blocks_for(rows: int, shards: int) -> int:
    """Cells a shard, so that a cell has about CELL_ROWS rows."""
    return max(32, -(-rows // (shards * CELL_ROWS)))
