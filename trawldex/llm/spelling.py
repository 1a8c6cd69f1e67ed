"""Spelling variants: words one edit apart, by merging light subtrees of tries along heavy paths.

In a trie of words, two words part at exactly one node. There, the child with most words is heavy and all others are light. If the two are one
edit apart, what follows the node in one, with its first character skipped or replaced, is what follows in the other. So it is enough to take
the words of light children, skip or replace their next character and look them up: against the heavy child with its character, against shorter
words with none, and against each other with the character left open. A word lies in a light child at most log2(n) times, and every
pair is found once, at the node where it parts.

Tries are built over groups that Spark deals out. If the longer word has m characters and the words part at place e, they share the first e
and the last m - 1 - e. So each word goes to groups by a window [a, b) of places: words that share the first a and the last m - b
characters, once for each half of the word. A group of more than `most` words is dealt again by both halves of its window; a window of one
place holds words that differ in one character only, as many as there are letters, so splitting ends. A pair belongs to one group.

Each task holds the tries of some whole groups as sorted arrays: a node is a run of words with a common prefix. Words are looked up by a
polynomial sum and then compared themselves.

Defined results: null and empty words and words below the least length are left out; words that are equal count as one, with the sum of their
n; a word without near words is in no pair; empty tables give none; only the named columns are read; words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawldex.llm.common import materialize

MOST = 20_000
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
PAIRS = "a string, n_a long, b string, n_b long"


# groups


def _key(word: Column, size: Column, a: Column, b: Column) -> Column:
    # equal keys of other groups do no harm: a task compares all that decides
    return F.xxhash64(size, a, b, F.substr(word, F.lit(1), a), F.substr(word, F.char_length(word) - (size - b) + 1, size - b))


def _dealt(rows: DataFrame) -> DataFrame:
    """word, n, size, a, b in both halves of their window, with the keys of their groups."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    rows = rows.select("word", "n", "size", F.explode(halves).alias("h")).select("word", "n", "size", "h.a", "h.b")
    return rows.withColumn("key", _key(F.col("word"), F.col("size"), F.col("a"), F.col("b")))


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, size, a, b, key: every word once for each group that it belongs to; size is the length of a pair's longer word."""
    length = F.char_length("word").cast("int")
    sizes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    rows, done = _dealt(sizes.select("*", F.lit(0).alias("a"), F.col("size").alias("b"))), None
    while True:
        # keys of large groups: no more than one in `most` rows
        large = materialize(rows.groupBy("key").agg(F.count("*").alias("m"), F.max(F.col("b") - F.col("a")).alias("w")).filter((F.col("m") > most) & (F.col("w") > 1)).select("key"), "spelling-large")
        some = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if some else rows
        done = small if done is None else done.unionByName(small)
        if not some:
            return done
        again = rows.join(large, "key", "left_semi")
        # a key that collides may bring rows of a window that cannot be split
        done = done.unionByName(again.filter("b - a <= 1").select(*done.columns))
        rows = materialize(_dealt(again.filter("b - a > 1")), "spelling-dealt")


# tries of one task


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tries:
    """Tries of groups: words sorted within each group, with the group's number, size and window."""

    def __init__(self, words: list[str], group: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.words, self.group, self.size, self.a, self.b = words, group, size, a, b
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        longest = int(self.n.max(initial=0))
        self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest + 1, _BASE, np.uint64))])
        at = np.arange(self.flat.size) - np.repeat(self.start[:-1], self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.flat.astype(np.uint64) * self.power[at], dtype=np.uint64)])
        self.whole = self.sums[self.start[1:]] - self.sums[self.start[:-1]] + _mixed(group.astype(np.uint64) + np.uint64(1))

    def shared(self) -> np.ndarray:
        """Length of the prefix that each word shares with the one before; -1 for the first of a group."""
        out = np.full(len(self.words), -1, np.int64)
        live = np.flatnonzero(self.group[1:] == self.group[:-1]) + 1
        depth = 0
        while live.size:
            out[live] = depth
            live = live[(self.n[live] > depth) & (self.n[live - 1] > depth)]
            live = live[self.flat[self.start[live] + depth] == self.flat[self.start[live - 1] + depth]]
            depth += 1
        return out

    def light(self, shared: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in light children of nodes at depth e whose window holds e, and the character of their heavy child."""
        first = np.flatnonzero(shared <= e)  # where children begin
        width = np.diff(np.append(first, shared.size))
        ends = self.n[first] == e  # a word that ends at the node is a light child
        node = np.cumsum(shared[first] < e) - 1
        order = np.lexsort((np.where(ends, 0, width), node))
        last = np.append(np.flatnonzero(np.diff(node[order])), order.size - 1)
        heavy = order[last]  # by node
        lone = np.bincount(node) == 1
        is_light = ~lone[node]
        is_light[heavy] = False
        lights = np.flatnonzero(is_light)
        at = np.repeat(first[lights] - np.concatenate([[0], np.cumsum(width[lights])[:-1]]), width[lights]) + np.arange(width[lights].sum()) if lights.size else np.zeros(0, np.int64)
        letter = np.repeat(self.flat[self.start[first[heavy[node[lights]]]] + e], width[lights]) if lights.size else np.zeros(0, np.uint32)
        inside = (self.a[at] <= e) & (e < self.b[at])
        return at[inside], letter[inside]

    def pairs(self) -> list[tuple[int, int]]:
        """Places of words that are one edit apart, each pair once."""
        shared = self.shared()
        asked, names, out = [], [], []
        one = np.uint64(_BASE)
        for e in np.unique(shared[shared >= 0]).tolist():
            at, letter = self.light(shared, e)
            if not at.size:
                continue
            more, top = self.n[at] > e, self.n[at] == self.size[at]
            begin = self.start[at]
            before = self.sums[begin + e] - self.sums[begin]
            salt = self.whole[at] - (self.sums[self.start[at + 1]] - self.sums[begin])
            letters = letter.astype(np.uint64) * self.power[e]
            # the heavy child's character put before what follows
            some = ~top
            after = self.sums[self.start[at + 1]] - self.sums[begin + e]
            asked.append(at[some])
            names.append((before + letters + after * one + salt)[some])
            # the own character replaced by the heavy one, left open, or skipped
            some = top & more
            at, begin, before, salt, letters = at[some], begin[some], before[some], salt[some], letters[some]
            own = self.flat[begin + e]
            rest = self.sums[self.start[at + 1]] - self.sums[begin + e + 1]
            asked.append(at)
            names.append(before + letters + rest + salt)
            out += self._open(at, before + rest + salt, e)
            follows = np.zeros(at.size, np.uint32)
            inner = self.n[at] > e + 1
            follows[inner] = self.flat[begin[inner] + e + 1]
            parts = follows != own  # otherwise the words part later
            asked.append(at[parts])
            names.append((before + rest * np.uint64(_UNBASE) + salt)[parts])
        if asked:
            out += self._found(np.concatenate(asked), np.concatenate(names))
        return out

    def _found(self, asked: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(self.whole, kind="stable")
        table = self.whole[order]
        lo, hi = np.searchsorted(table, names, "left"), np.searchsorted(table, names, "right")
        hit = np.flatnonzero(hi > lo)
        out = []
        for i, x, y in zip(asked[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
            out += [(i, int(j)) for j in order[x:y] if self._near(i, int(j))]
        return out

    def _open(self, at: np.ndarray, names: np.ndarray, e: int) -> list[tuple[int, int]]:
        """Pairs of light words that coincide when the character at e is left open: as many as there are letters at most."""
        order = np.argsort(names, kind="stable")
        cuts = np.flatnonzero(np.diff(names[order])) + 1
        out = []
        begin = np.concatenate([[0], cuts])
        end = np.append(cuts, order.size)
        for x, y in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
            same = at[order[x:y]].tolist()
            out += [(i, j) for k, i in enumerate(same) for j in same[k + 1 :] if self._near(i, j)]
        return out

    def _near(self, i: int, j: int) -> bool:
        """Whether the words of one group are one edit apart and part inside its window, the longer one being of the group's size."""
        if self.group[i] != self.group[j]:
            return False
        short, long = sorted((self.words[i], self.words[j]), key=len)
        if len(long) != self.size[i] or len(long) - len(short) > 1:
            return False
        e = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))  # noqa: B905
        if e == len(long) or not self.a[i] <= e < self.b[i]:
            return False
        return short[e + (len(short) == len(long)) :] == long[e + 1 :]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups: at least `most` rows, or what is left."""
    kept: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.concat_tables(kept)
        change = np.flatnonzero(_new_group(whole))
        if change.size > 1:
            yield whole.slice(0, int(change[-1]))
            whole = whole.slice(int(change[-1]))
        kept, rows = [whole], whole.num_rows
    if rows:
        yield pa.concat_tables(kept)


def _new_group(rows: pa.Table) -> np.ndarray:
    fresh = np.zeros(rows.num_rows, bool)
    for c in ("key", "size", "a", "b"):
        x = rows.column(c).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    fresh[:1] = True
    return fresh


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, n_a, b, n_b: every two words (word, n) that differ by one inserted, deleted or replaced code point, once, in no order."""
    words = words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, most):
            text = rows.column("word").to_pylist()
            n = rows.column("n").to_numpy()
            column = lambda c: rows.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            found = Tries(text, np.cumsum(_new_group(rows)), column("size"), column("a"), column("b")).pairs()
            for k in range(0, len(found), 50_000):
                i, j = np.array(found[k : k + 50_000]).T
                yield pa.RecordBatch.from_arrays([pa.array([text[x] for x in i], pa.string()), pa.array(n[i]), pa.array([text[x] for x in j], pa.string()), pa.array(n[j])], names=["a", "n_a", "b", "n_b"])

    rows = groups(materialize(words, "spelling-words"), most).select("key", "size", "a", "b", "word", "n")
    return rows.repartition("key").sortWithinPartitions("key", "size", "a", "b", "word").mapInArrow(run, PAIRS)


def families(words: DataFrame, times: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    form: the near word of largest n (ties: smallest in code-point order) if its n is at least `times` the word's; root: the last of the forms from
    the word on. n grows by `times` with each step, so the longest chain, and with it the number of doublings, is known from the largest n.
    """
    words = materialize(words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-counts")
    pairs = near_pairs(words, most)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.m") >= F.col("n") * times
    rows = materialize(rows.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n")), "spelling-forms")
    links = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    largest, steps = words.agg(F.max("n")).first()[0] or 1, 1
    while times**steps < largest:  # no chain of so many steps
        links = materialize(links.alias("x").join(links.alias("y"), F.col("x.root") == F.col("y.word"), "left").select("x.word", F.coalesce("y.root", "x.root").alias("root")), "spelling-roots")
        steps *= 2
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
