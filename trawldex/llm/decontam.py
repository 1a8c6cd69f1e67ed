"""Benchmark decontamination with training suffix arrays.

Documents are read in shards of bounded size. In each shard a suffix array over the words is built, every
suffix of every benchmark item is searched in it by binary search, and the search goes on to the longest
verbatim match. A document word is hit when it lies in an occurrence of one of an item's windows.

Words: A-Z are lower-cased; a word is a run of 0-9, a-z and characters from U+0080 on. Words that no item uses
are one symbol that matches nothing, so suffixes that begin with one are left out of the array; this loses no match.

The benchmark is the stated query set. Its size is measured first; it is sent to the tasks in blocks of at most
`block_bytes`, and documents pass once for each block.

Defined results: a null or empty text has no words and is never contaminated; an item without words has no
window; an item of fewer than `window` words is one window; repeated document rows are judged one by one and repeated
items count once; items with a null id are searched like others and count as one item, null (last in `items`); empty tables give no hits; other columns are carried, whatever their names. A text longer than a
shard is cut into overlapping pieces, so memory is bounded by the shard and not by the text (beyond the row itself).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawldex.llm.arrays import give_back, ranges
from trawldex.llm.common import materialize

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "item_id", "item_word")]))),
    ]
)

#: Bytes of words, lower-cased; all others become a space. Bytes from 0x80 on belong to words.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Queries:
    """The suffixes of a block of items that begin a window, as word numbers (1 and up) of the block's vocabulary."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window = window
        tokens = [(i, words((t or "").encode())) for i, t in items]
        tokens = [(i, w) for i, w in tokens if w]
        self.vocab: dict[bytes, int] = {}
        for _, ws in tokens:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.bits = max(1, (len(self.vocab) + 1).bit_length())
        self.k = max(1, 63 // self.bits)
        none = np.zeros(0, np.int64)
        self.ids = np.concatenate([none, *(np.fromiter(map(self.vocab.__getitem__, ws), np.int64, len(ws)) for _, ws in tokens)])
        size = np.array([len(ws) for _, ws in tokens], np.int64)
        own = np.minimum(size, window)
        n, begin = size - own + 1, np.cumsum(size) - size
        self.of, self.items = np.repeat(np.arange(len(tokens)), n), [i for i, _ in tokens]
        self.word = ranges(np.zeros(len(n), np.int64), n) if len(n) else none
        self.start, self.end, self.need = begin[self.of] + self.word, (begin + size)[self.of], own[self.of]
        self.longest = int(size.max(initial=1))
        # Bounds of each query's first words as packed numbers.
        n = np.minimum(self.k, self.need)
        key = np.zeros(len(self.start), np.int64)
        for j in range(self.k):
            has = j < n
            key = (key << self.bits) | np.where(has, self.ids[np.minimum(self.start + j, max(0, len(self.ids) - 1))] if len(self.ids) else 0, 0)
        self.low, self.depth = key, n
        self.high = key | ((np.int64(1) << (self.bits * (self.k - n))) - 1)

    def owner(self, i: int) -> tuple[int | None, int]:
        """Item and first word of a query."""
        return self.items[self.of[i]], int(self.word[i])


def suffix_array(ids: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Positions of suffixes that begin with a known word, in order of their first q.longest words, and the packed first words.

    ids ends with at least q.k zeros. Sorting is by doubling: only groups that still tie are sorted again.
    """
    n = len(ids) - q.k
    packed = np.zeros(n, np.int64)
    for j in range(q.k):
        packed = (packed << q.bits) | ids[j : n + j]
    sa = np.flatnonzero(ids[:n])
    sa = sa[np.argsort(packed[sa], kind="stable")]
    keys = packed[sa]
    rank = np.zeros(len(ids) + 1, np.int64)
    if not len(sa):
        return sa, keys
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1  # rank: place of the group's first member, from 1
    rank[sa] = group
    mask = (np.int64(1) << q.bits) - 1
    whole = (keys & mask) != 0  # the last packed word is known: the suffix may match further
    depth = q.k
    tied = np.flatnonzero((np.r_[~fresh[1:], False] | ~fresh) & whole)
    while len(tied) and depth < q.longest:
        pos = sa[tied]
        nxt = rank[np.minimum(pos + depth, len(ids))]
        order = np.lexsort((nxt, group[tied]))
        pos, nxt, own = pos[order], nxt[order], group[tied][order]
        sa[tied] = pos
        new = np.r_[True, (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])]
        group[tied] = np.where(new, tied + 1, 0)
        group[tied] = np.maximum.accumulate(group[tied])
        rank[pos] = group[tied]
        again = (np.r_[~new[1:], False] | ~new) & (nxt != 0)
        tied = tied[again]
        depth *= 2
    return sa, keys


def _bound(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """By binary search for all at once: the first place in [lo, hi) whose word at `depth` is >= word (> if right)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = ids[sa[np.where(open_, mid, 0)] + np.where(open_, depth, 0)]
        less = (at <= word) if right else (at < word)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def search(ids: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Longest matches (position, length, query) of at least a window, and each window's occurrences (query, positions)."""
    none = np.zeros(0, np.int64)
    sa, keys = suffix_array(ids, q)
    if not len(sa) or not len(q.start):
        return none, none, none, []
    lo, hi, depth = np.searchsorted(keys, q.low), np.searchsorted(keys, q.high, "right"), q.depth.copy()
    best = np.zeros(len(sa), np.int64)
    who = np.zeros(len(sa), np.int64)
    live = np.flatnonzero(lo < hi)
    found: dict[tuple[int, int, int], int] = {}
    windows = []
    while len(live):
        for i in live[depth[live] >= q.need[live]]:
            a, b, d = lo[i], hi[i], depth[i]
            if d == q.need[i]:
                windows.append((int(i), sa[a:b]))
            if found.get((a, b, d)) is None:  # the same words in several items are one search
                found[a, b, d] = int(i)
                longer = best[a:b] < d
                best[a:b][longer] = d
                who[a:b][longer] = i
        live = live[q.start[live] + depth[live] < q.end[live]]
        if not len(live):
            break
        word = q.ids[q.start[live] + depth[live]]
        a = _bound(ids, sa, lo[live], hi[live], depth[live], word, False)
        b = _bound(ids, sa, a, hi[live], depth[live], word, True)
        lo[live], hi[live] = a, b
        depth[live] += 1
        live = live[a < b]
    hit = np.flatnonzero(best)
    return sa[hit], best[hit], who[hit], windows


def _shards(texts, q: Queries, limit: int):
    """Lists of pieces (document, word offset, ids), each list of bounded size."""
    get, pieces, size = q.vocab.get, [], 0
    for d, t in enumerate(texts):
        data = (t or b"").translate(_FOLD)
        at, offset, carry = 0, 0, []
        while at < len(data) or (at == 0 and not data):
            end = min(len(data), at + limit)
            if end < len(data):
                cut = data.find(b" ", end)
                end = len(data) if cut < 0 else cut
            own = data[at:end].split()
            ids = carry + [get(w, 0) for w in own]
            pieces.append((d, offset - len(carry), np.array(ids, np.int64), offset + len(own)))
            offset += len(own)
            carry = ids[len(ids) - min(len(ids), q.longest - 1) :] if end < len(data) and q.longest > 1 else []
            size += end - at
            if not data:
                break
            at = end
            if size >= limit:
                yield pieces
                pieces, size = [], 0
    if pieces:
        yield pieces


def _null_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def judge(texts: list[bytes | None], q: Queries, limit: int = SHARD_BYTES) -> list[dict]:
    """RESULT of each text."""
    out = [{"n_words": 0, "n_hit": 0, "longest": 0, "items": set(), "ranges": []} for _ in texts]
    gap = np.zeros(q.k + 1, np.int64)
    for pieces in _shards(texts, q, limit):
        starts = np.cumsum([0] + [len(p[2]) + len(gap) for p in pieces])
        ids = np.concatenate([x for p in pieces for x in (p[2], gap)])
        for d, _, _, n in pieces:
            out[d]["n_words"] = max(out[d]["n_words"], n)
        pos, length, who, windows = search(ids, q)
        piece = np.searchsorted(starts, pos, "right") - 1
        order = np.argsort(pos, kind="stable")
        for j in order:
            d, offset = pieces[piece[j]][:2]
            at = int(pos[j] - starts[piece[j]]) + offset
            out[d]["ranges"].append((at, at + int(length[j]), int(who[j])))
        for i, where in windows:
            item = q.owner(i)[0]
            for p in np.unique(np.searchsorted(starts, where, "right") - 1):
                out[pieces[p][0]]["items"].add(item)
    for r in out:
        ranges = r.pop("ranges")
        r["longest"] = max((b - a for a, b, _ in ranges), default=0)
        r["items"] = sorted(r["items"], key=_null_last)
        _joined(r, [(a, b, *q.owner(i)) for a, b, i in ranges])
    return out


def _joined(r: dict, ranges: list[tuple[int, int, int, int]]) -> None:
    """Set spans (disjoint, in order, each with the item that it begins with) and n_hit of a result."""
    spans: list[dict] = []
    for a, b, item, word in sorted(ranges, key=lambda r: (r[0], r[1], _null_last(r[2]), r[3])):
        if spans and a < spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b, "item_id": item, "item_word": word})
    r |= {"spans": spans, "n_hit": sum(s["end"] - s["start"] for s in spans)}


def merged(a: dict, b: dict) -> dict:
    """The result of one text against two blocks of items."""
    out = {"n_words": a["n_words"], "longest": max(a["longest"], b["longest"]), "items": sorted({*a["items"], *b["items"]}, key=_null_last)}
    _joined(out, [tuple(s[k] for k in ("start", "end", "item_id", "item_word")) for s in a["spans"] + b["spans"]])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of bounded size, one at a time; more than one block only if the benchmark's measured size asks for it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = items.withColumn("__b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield [(r.item_id, r.text) for r in dealt.filter(F.col("__b") == b).distinct().collect()]


def _pass(packed: DataFrame, items: list[tuple[int | None, str | None]], window: int, text: str) -> DataFrame:
    """__doc and __r of every row; of rows with a number (__id) only that and __r."""
    sent = packed.sparkSession.sparkContext.broadcast(items)
    own = "__id" if "__id" in packed.columns else "__doc"
    schema = T.StructType([packed.schema[own], T.StructField("__r", RESULT)])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "item_id", "item_word")])))])

    def run(batches):
        q = Queries(sent.value, window)
        for batch in batches:
            docs = batch.column("__doc")
            texts = docs.field(text).cast(pa.binary())
            for at in range(0, len(texts), 1024):
                rows = judge(texts.slice(at, 1024).to_pylist(), q)
                yield pa.RecordBatch.from_arrays([batch.column(own).slice(at, 1024), pa.array(rows, kind)], names=[own, "__r"])
        del q
        give_back()

    return packed.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (__doc: struct of all columns, __r: RESULT): every document with its matches.

    A benchmark of one block is one pass without a shuffle. Of a larger one, documents are numbered and written once; a pass for each block writes
    the numbers of the rows that it hits and what it found there, no texts, and what all found comes back to the documents in one join.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(packed, first, window, text)
    held = materialize(packed.withColumn("__id", F.monotonically_increasing_id()), "decontam")
    found = None
    for k, block in enumerate(chain([first, second], blocks)):
        rows = _pass(held, block, window, text).withColumn("__k", F.lit(k))
        rows = materialize(rows.filter("__r.n_hit > 0") if k else rows, "decontam-hits")
        found = rows if found is None else found.unionByName(rows)
    each = found.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__k", "__r"))).alias("__rs"))  # no more than there are blocks

    def fold(batches):
        for batch in batches:
            rows = [reduce(merged, [x["__r"] for x in xs]) for xs in batch.column("__rs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(rows, batch.schema.field("__rs").type.value_type.field("__r").type)], names=["__id", "__r"])

    whole = each.mapInArrow(fold, T.StructType([T.StructField("__id", T.LongType()), T.StructField("__r", RESULT)]))
    return held.join(whole, "__id").select("__doc", "__r")


def contaminated(r: str = "__r") -> Column:
    """The rule: something is hit, and at least a twentieth of the document's words are."""
    return (F.col(f"{r}.n_hit") > 0) & (20 * F.col(f"{r}.n_hit") >= F.col(f"{r}.n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    kept = scan(docs, benchmark, window, text).filter(~contaminated())
    return kept.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
