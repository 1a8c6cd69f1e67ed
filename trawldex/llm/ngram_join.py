"""Near-duplicate join on word n-grams: Jaccard similarity of shingle sets, and the classes that its links form.

Texts are lower-cased (A-Z) and cut at white space; a document's set is its distinct `width`-word shingles, by 64-bit hash.

1. One pass over the texts names every set (size and 128-bit sum) and counts shingles in a table of fixed size.
   Rows with equal sets form a class; its least id stands for it from here on.
2. A second pass orders each set rare-first (by the table, then by hash) and keeps its prefix: two sets that reach the
   threshold share a shingle of both prefixes. A sketch of the set bounds the symmetric difference from below: parities of
   256 parts of a small set, sizes of n / 16 parts or more of a large one (parities say nothing where each part has many shingles).
3. Prefix shingles that two representatives or more have are found and counted by hash bucket; all others can link nothing.
4. The documents of a shared shingle meet in a cell; those of a hot shingle are dealt to blocks, and every two blocks meet in one
   cell, so that each pair meets once. A cell searches the graph of its candidates (pairs that pass the length, positional
   and sketch filters) breadth first and gives back a spanning forest: no more rows than came in. Documents that the search has
   reached are not compared again, so a group of near copies costs one comparison each.
5. The components of the forests are families: every link lies inside one. A family's texts meet in cells of bounded size
   (again every two blocks of a large one in one cell). There the links are found by the same search: pairs that pass the length
   filter and the suffix filter (the sorted sets, parted at fixed places, differ at least by the differences of the parts' sizes) are
   verified on the whole sets, each pair at most once, and a spanning forest of verified links is what comes out.
Links inside a component that is already connected change no class and are not enumerated.

Defined results: null and empty texts have an empty set and link with nothing; rows with the same id are one document (they share
a component, whatever their texts, and so do the documents that they link with); a null id is returned with a null component; an
empty table gives an empty result; other columns are ignored, whatever their names. A text is worked on whole, in batches of about
a MB: memory is bounded by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.llm.arrays import give_back, mix, ranges, shingle_sets, split_by
from trawldex.llm.common import discard, materialize
from trawldex.llm.components import components

BATCH_BYTES = 1 << 20
SLICE_ROWS = 2048
SLICE_BYTES = 8 << 20  # of texts whose prefixes are worked on together
HOT = 4096  # documents of one shingle in a block
CELL_BYTES = 2 << 20  # of shingle sets in a block of a family
FAN = 64
PARTS = 64
SMALL = 512  # shingles from which on a sketch holds sizes, not parities
SPLITS = 256  # parts of a sorted set in the suffix filter


def _batches(docs: pa.Array, ids: pa.Array):
    """(ids, texts) in batches of bounded size."""
    start, size = 0, 0
    lengths = pc.binary_length(docs).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= BATCH_BYTES or i == len(lengths) - 1:
            yield ids.slice(start, i + 1 - start), [t or b"" for t in docs.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def need(a, b, per: int):
    """Least overlap with which sets of sizes a and b reach per / 100."""
    return -(-per * (a + b) // (100 + per))


def sketch_bytes(n: np.ndarray) -> np.ndarray:
    """Length of the sketch of sets of n shingles: 32 for parities, else the power of two from n / 16 on."""
    return np.where(n < SMALL, 32, 1 << np.ceil(np.log2(np.maximum(n, SMALL) / 16)).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """The sketch of a set; sizes are kept modulo 256."""
    if len(s) < SMALL:
        odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()
    m = int(sketch_bytes(np.array([len(s)]))[0])
    return (np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 255).astype(np.uint8).tobytes()


class Sketches:
    """Sketches of sets of n shingles, laid end to end in data."""

    def __init__(self, n: np.ndarray, data: np.ndarray):
        self.size, self.small = sketch_bytes(n), n < SMALL
        at = np.cumsum(self.size) - self.size
        self.place = np.zeros(len(n), np.int64)  # row in the matrix of its own size
        self.half = np.full(len(n), -1, np.int64)  # and of half its size, into which it is folded
        self.odd = data[ranges(at[self.small], self.size[self.small])].view(np.uint64).reshape(-1, 4)
        self.place[self.small] = np.arange(len(self.odd))
        self.sizes: dict[int, np.ndarray] = {}
        large = [int(m) for m in np.unique(self.size[~self.small])]
        for m in sorted({k for m in large for k in (m, m // 2)}):
            own, twice = (np.flatnonzero(~self.small & (self.size == k)) for k in (m, 2 * m))
            whole = data[ranges(at[own], self.size[own])].reshape(-1, m)
            both = data[ranges(at[twice], self.size[twice])].reshape(-1, 2 * m)
            self.place[own] = np.arange(len(own))
            self.half[twice] = len(own) + np.arange(len(twice))
            self.sizes[m] = np.concatenate([whole, both[:, :m] + both[:, m:]])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one of the sets only."""
        out = np.zeros(len(a), np.int64)
        odd = np.flatnonzero(self.small[a] & self.small[b])
        out[odd] = np.bitwise_count(self.odd[self.place[a[odd]]] ^ self.odd[self.place[b[odd]]]).sum(axis=1)
        large = np.flatnonzero(~self.small[a] & ~self.small[b])
        least = np.minimum(self.size[a[large]], self.size[b[large]])
        for m in np.unique(least):
            mine = large[least == m]
            row = lambda x: np.where(self.size[x] == m, self.place[x], np.where(self.size[x] == 2 * m, self.half[x], -1))  # noqa: B023, E731
            for k in range(0, len(mine), max(1, (1 << 21) // int(m))):
                i = mine[k : k + max(1, (1 << 21) // int(m))]
                x, y = row(a[i]), row(b[i])
                d = (self.sizes[int(m)][x] - self.sizes[int(m)][y]).view(np.int8).astype(np.int16)
                out[i] = np.where((x < 0) | (y < 0), 0, np.abs(d).sum(axis=1))  # sizes further apart than twice tell nothing
        return out


def _pass_one(docs: DataFrame, width: int, bits: int) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("node", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        node = TaskContext.get().partitionId()
        for batch in batches:
            for ids, texts in _batches(batch.column("text"), batch.column("doc_id")):
                sets = shingle_sets(texts, width)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                cell, times = np.unique((flat >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + times, 2**31 - 1)
                at = np.r_[0, np.cumsum(n)]
                sums = [np.r_[np.uint64(0), np.cumsum(mix(flat, k), dtype=np.uint64)] for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
                s1, s2 = ((c[at[1:]] - c[at[:-1]]).view(np.int64) for c in sums)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s1), pa.array(s2), *(pa.nulls(len(n), kind.field(i).type) for i in (4, 5, 6))], schema=kind)
        own = counts.reshape(PARTS, -1)
        some = [p for p in range(PARTS) if own[p].any()]
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([node] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([own[p].tobytes() for p in some], pa.binary())], schema=kind)
        del counts, own
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, node long, part int, counts binary")


def _added(table: pa.Table) -> pa.Table:
    """The sum of at most FAN count tables of one part."""
    total: np.ndarray | int = 0
    for b in table.column("counts"):
        total = total + np.frombuffer(b.as_buffer(), np.int32).astype(np.int64)
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "part": table.column("part").slice(0, 1).combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})


def _rarity(first: DataFrame, bits: int) -> np.ndarray:
    """The tasks' count tables added up in a tree, so that no group holds more than FAN of them.

    At most PARTS rows and 2^22 counters come to the driver: a bound that does not depend on the documents.
    """
    rows = first.filter("part IS NOT NULL").select("node", "part", "counts")
    last = rows.agg(F.max("node")).first()[0] or 0
    while True:
        rows = rows.groupBy(F.expr(f"node div {FAN}").alias("up"), "part").applyInArrow(lambda t: _added(t), "node long, part int, counts binary")
        last //= FAN
        if last == 0:
            break
    freq = np.zeros((PARTS, (1 << bits) // PARTS), np.int32)
    for r in rows.collect():
        freq[r.part] = np.frombuffer(r.counts, np.int32)
    return freq.reshape(-1)


def _pass_two(docs: DataFrame, width: int, per: int, bits: int, table) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("fame", pa.float32()), ("prefix", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        freq = table.value
        for batch in batches:
            for ids, texts in _batches(batch.column("text"), batch.column("doc_id")):
                prefix, sketches, n, fame = [], [], [], []
                for s in shingle_sets(texts, width):
                    n.append(len(s))
                    keep = len(s) - (per * len(s) + 99) // 100 + 1 if len(s) else 0
                    f = freq[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    fame.append(float(f.mean()) if len(s) else 0.0)
                    if keep < len(s):
                        edge = np.partition(f, keep - 1)[keep - 1]
                        s_, f_ = s[f <= edge], f[f <= edge]
                    else:
                        s_, f_ = s, f
                    prefix.append(s_[np.lexsort((s_, f_))[:keep]].tobytes())
                    sketches.append(sketch(s))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(fame, pa.float32()), pa.array(prefix, pa.binary()), pa.array(sketches, pa.binary())], schema=kind)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n int, fame float, prefix binary, sketch binary")


class Postings:
    """The postings (shingle key, row, position) of a slice of representatives, sorted by key."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_numpy()
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.fame = table.column("fame").to_numpy()
        rows = [np.frombuffer(b, np.uint64) for b in table.column("prefix").to_pylist()]
        long = np.array([len(r) for r in rows], np.int64)
        key = np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.pos = ranges(np.zeros(len(long), np.int64), long)[order]
        self.row = np.repeat(np.arange(len(long)), long)[order]
        self.sketch = table.column("sketch").to_pylist()


_KEYS = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])
_SHARED = pa.schema([("slice", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])


def _slice_keys(table: pa.Table, buckets: int) -> pa.Table:
    """Distinct shingles of a slice and how many rows have them."""
    p = Postings(table)
    cut = np.flatnonzero(np.r_[True, p.key[1:] != p.key[:-1]])
    key, n = p.key[cut], np.diff(np.r_[cut, len(p.key)]).astype(np.int32)
    number = table.column("slice")[0].as_py()
    return pa.Table.from_pylist([{"bucket": b, "slice": number, "key": key[o].tobytes(), "n": n[o].tobytes()} for b, o in split_by((key % np.uint64(buckets)).astype(np.int64))], _KEYS)


def _shared_keys(table: pa.Table) -> pa.Table:
    """Of the shingles of a bucket those that two rows or more have, given back to each slice that has them, with their number."""
    slices = table.column("slice").to_pylist()
    keys = [np.frombuffer(b, np.uint64) for b in table.column("key").to_pylist()]
    key = np.concatenate(keys)
    n = np.concatenate([np.frombuffer(b, np.int32) for b in table.column("n").to_pylist()]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], cut), np.diff(np.r_[cut, len(key)]))
    out, at = [], 0
    for s, k in zip(slices, keys, strict=True):
        own = total[at : at + len(k)]
        at += len(k)
        mine = own > 1
        if mine.any():
            out.append({"slice": s, "key": k[mine].tobytes(), "n": own[mine].tobytes()})
    return pa.Table.from_pylist(out, _SHARED)


#: A bucket gets each row of a slice once, and the postings refer to it by number (who).
_POSTING = {"key": np.uint64, "cell": np.int64, "side": np.int8, "pos": np.int32, "who": np.int32}
_ROW = {"doc": np.int64, "n": np.int32, "fame": np.float32}
_FIELDS = {**_POSTING, **_ROW, "sketch": np.uint8}
_PACKED = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), *[(f, pa.binary()) for f in _FIELDS]])
_PACKED_DDL = "bucket int, slice int, " + ", ".join(f"{f} binary" for f in _FIELDS)


def blocks_of(block: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For members in `block` of `blocks` blocks: (member, cell, side), one for each cell that its block belongs to.

    Cell (i, j), i <= j, is numbered i * blocks + j; side tells whether the member is of block i (0) or of a later block j (1).
    """
    take = np.repeat(np.arange(len(block)), blocks)
    other = ranges(np.zeros(len(blocks), np.int64), blocks)
    own = block[take]
    return take, np.minimum(own, other) * blocks[take] + np.maximum(own, other), (own > other).astype(np.int8)


def _cells(docs: pa.Table, extra: pa.Table, buckets: int, hot: int) -> pa.Table:
    """The postings of a slice under shared shingles, by bucket."""
    if not docs.num_rows or not extra.num_rows:
        return pa.Table.from_pylist([], _PACKED)
    p = Postings(docs)
    wanted = np.concatenate([np.frombuffer(b, np.uint64) for b in extra.column("key").to_pylist()])
    number = np.concatenate([np.frombuffer(b, np.int64) for b in extra.column("n").to_pylist()])
    order = np.argsort(wanted, kind="stable")
    wanted, number = wanted[order], number[order]
    at = np.minimum(np.searchsorted(wanted, p.key), len(wanted) - 1)
    mine = np.flatnonzero(wanted[at] == p.key)
    blocks = -(-number[at[mine]] // hot)
    block = (mix(p.ids[p.row[mine]].view(np.uint64), 0xD6E8FEB86659FD93) % blocks.astype(np.uint64)).astype(np.int64)
    take, cell, side = blocks_of(block, blocks)
    key, pos, row = p.key[mine][take], p.pos[mine][take], p.row[mine][take]
    bucket = (mix(key + mix(cell.astype(np.uint64), 0x9E3779B97F4A7C15), 0xA0761D6478BD642F) % np.uint64(buckets)).astype(np.int64)
    slice_, out = docs.column("slice")[0].as_py(), []
    for number, o in split_by(bucket):
        own, who = np.unique(row[o], return_inverse=True)
        cols = {"key": key[o], "cell": cell[o], "side": side[o], "pos": pos[o], "who": who, "doc": p.ids[own], "n": p.n[own], "fame": p.fame[own]}
        packed = {f: np.ascontiguousarray(cols[f].astype(k)).tobytes() for f, k in {**_POSTING, **_ROW}.items()}
        out.append({"bucket": number, "slice": slice_, **packed, "sketch": b"".join(p.sketch[r] for r in own)})
    return pa.Table.from_pylist(out, _PACKED)


def forest(group: np.ndarray, joined) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that joined(a, b) -> bool defines on the pairs of members of the same group.

    group: sorted group number of every member. All groups are searched breadth first at the same time; what a search has reached
    is compared with nothing that was reached before it, so every pair is tested at most once.
    """
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    slot = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if len(group) else np.zeros(0, np.int64)
    queue = np.empty(len(group), np.int64)  # of each group, in its own places
    head, tail = first.copy(), first.copy()
    rest = np.arange(len(group))
    out_a, out_b = [], []
    while len(rest):
        own = slot[rest]
        lead = np.r_[True, own[1:] != own[:-1]]
        live = own[lead]
        idle = head[live] == tail[live]
        start = rest[lead][idle]  # the first member that is left begins a new tree
        queue[tail[live[idle]]] = start
        tail[live[idle]] += 1
        stay = np.ones(len(rest), bool)
        stay[np.flatnonzero(lead)[idle]] = False
        rest = rest[stay]
        if not len(rest):
            break
        source = np.empty(len(first), np.int64)
        source[live] = queue[head[live]]
        head[live] += 1
        own = slot[rest]
        ok = joined(source[own], rest)
        new, by = rest[ok], own[ok]
        if len(new):
            out_a.append(source[by])
            out_b.append(new)
            edge = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            n = np.diff(np.r_[edge, len(by)])
            queue[ranges(tail[by[edge]], n)] = new
            tail[by[edge]] += n
            rest = rest[~ok]
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    differ = a != b
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[differ], axis=0) if differ.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _candidates(table: pa.Table, per: int) -> pa.Table:
    """A spanning forest of the candidates under each shingle of a bucket."""
    c = {f: [np.frombuffer(b, k) for b in table.column(f).to_pylist()] for f, k in _FIELDS.items()}
    rows = np.array([len(x) for x in c["doc"]])
    who = np.concatenate([x + at for x, at in zip(c["who"], np.cumsum(rows) - rows, strict=True)])
    c = {f: np.concatenate(x) for f, x in c.items()}
    ids, size = c["doc"], c["n"].astype(np.int64)
    sketches = Sketches(size, c["sketch"])
    order = np.lexsort((ids[who], -c["fame"][who], c["cell"], c["key"]))  # the most typical first: its search reaches most
    key, cell, side, pos, who = (x[order] for x in (c["key"], c["cell"], c["side"], c["pos"].astype(np.int64), who))
    new = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]
    group = np.cumsum(new) - 1
    mixed = np.maximum.reduceat(side, np.flatnonzero(new))[group] > 0  # two blocks meet here: pairs of one block meet elsewhere
    doc, n = ids[who], size[who]

    def joined(a, b):
        """The pair shares the shingle at the places pos: length, positional and sketch filter."""
        least = need(n[a], n[b], per)
        ok = 100 * np.minimum(n[a], n[b]) >= per * np.maximum(n[a], n[b])
        ok &= np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
        ok &= ~mixed[a] | (side[a] != side[b])
        some = np.flatnonzero(ok)
        ok[some] = sketches.apart(who[a[some]], who[b[some]]) <= (n[a] + n[b] - 2 * least)[some]
        return ok | (doc[a] == doc[b])

    a, b = forest(group, joined)
    out = _edges(doc[a], doc[b])
    give_back()
    return out


def _verified(table: pa.Table, width: int, per: int) -> pa.Table:
    """A spanning forest of the links inside each family cell. Rows: family, cell, side, doc_id, text."""
    family, cell = (table.column(f).to_numpy() for f in ("family", "cell"))
    side, doc = table.column("side").to_numpy(), table.column("doc_id").to_numpy()
    place = pa.array(np.arange(len(doc)))
    sets: list[np.ndarray] = []
    for _, batch in _batches(table.column("text").combine_chunks(), place):
        sets += shingle_sets(batch, width)
    n = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((cell, family))
    new = np.r_[True, (family[order][1:] != family[order][:-1]) | (cell[order][1:] != cell[order][:-1])]
    group = np.empty(len(doc), np.int64)
    group[order] = np.cumsum(new) - 1
    # shingles of a group by number, and how many of its rows have each
    by = np.lexsort((flat, group[row]))
    fresh = np.r_[True, (flat[by][1:] != flat[by][:-1]) | (group[row[by]][1:] != group[row[by]][:-1])] if len(flat) else np.zeros(0, bool)
    number = np.empty(len(flat), np.int64)
    number[by] = np.cumsum(fresh) - 1
    have = np.bincount(number, minlength=1)
    begin = np.cumsum(n) - n
    fame = np.add.reduceat(np.r_[have[number], 0], np.minimum(begin, len(number))) * (n > 0) / np.maximum(1, n)
    part = np.bincount(row * SPLITS + (flat >> np.uint64(64 - SPLITS.bit_length() + 1)).astype(np.int64), minlength=len(doc) * SPLITS).reshape(-1, SPLITS).astype(np.int32)
    order = np.lexsort((doc, -fame, group))  # members by group, the most typical first
    mixed = np.zeros(len(doc), bool)
    mixed[group[side > 0]] = True
    marked = np.zeros(len(have), bool)

    def joined(a, b):
        a, b = order[a], order[b]
        ok = (n[a] > 0) & (~mixed[group[a]] | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= per * np.maximum(n[a], n[b]))
        some = np.flatnonzero(ok & (doc[a] != doc[b]))
        apart = n[a] + n[b] - 2 * need(n[a], n[b], per)
        for k in range(0, len(some), 4096):  # suffix filter
            i = some[k : k + 4096]
            ok[i] = np.abs(part[a[i]] - part[b[i]]).sum(axis=1) <= apart[i]
        some = some[ok[some]]
        source = np.unique(a[some])
        on = number[ranges(begin[source], n[source])]
        marked[on] = True
        for k in range(0, len(some), 1024):
            i = some[k : k + 1024]
            m = n[b[i]]
            both = np.add.reduceat(marked[number[ranges(begin[b[i]], m)]], np.cumsum(m) - m, dtype=np.int64) if len(i) else m
            ok[i] = 100 * both >= per * (n[a[i]] + m - both)
        marked[on] = False
        return ok | (doc[a] == doc[b])

    a, b = forest(group[order], joined)
    out = _edges(doc[order[a]], doc[order[b]])
    del sets, flat, number, part
    give_back()
    return out


class Join:
    """The steps of the join over one table of documents (columns doc_id, text as bytes)."""

    def __init__(self, docs: DataFrame, width: int, per: int, hot: int = HOT):
        self.docs, self.width, self.per, self.hot = docs, width, per, hot
        self.scratch: list[str] = []

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label, self.scratch)

    def _done(self, since: int = 0) -> None:
        """Remove the scratch tables written since that number; nothing reads them any more."""
        gone, self.scratch[since:] = self.scratch[since:], []
        discard(self.docs.sparkSession, gone)

    def links(self, reps: DataFrame, candidates: DataFrame) -> DataFrame:
        """A spanning forest of the links in the families that candidates (a, b) form."""
        width, per = self.width, self.per
        mark = len(self.scratch)
        families = components(candidates, self.scratch).withColumnRenamed("component", "family")
        sized = reps.groupBy("doc_id").agg(F.sum(F.lit(8) * F.col("n")).alias("size"))  # one row for each id, but for ids with several texts
        members = self._keep(sized.join(families.withColumnRenamed("id", "doc_id"), "doc_id"), "members")
        sizes = members.groupBy("family").agg(F.sum("size").alias("bytes"))
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        parts = int(total // CELL_BYTES) + 1
        blocks = sizes.select("family", F.ceil(F.col("bytes") / (2 * CELL_BYTES)).alias("blocks"))  # a family that fits into a cell has one block
        placed = members.join(blocks, "family")
        block = F.pmod(F.xxhash64("doc_id"), "blocks")
        placed = placed.select("doc_id", "family", block.alias("block"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        cell = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
        placed = placed.select("doc_id", "family", cell.alias("cell"), (F.col("block") > F.col("other")).cast("byte").alias("side"))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("family", "cell"), F.lit(parts)).cast("int"))
        texts = self.docs.join(placed, "doc_id")
        found = self._keep(texts.groupBy("part").applyInArrow(lambda t: _verified(t, width, per), "a long, b long"), "links")
        kept = self.scratch.pop()
        self._done(mark)
        self.scratch.append(kept)
        return found

    def run(self) -> DataFrame:
        """Rows (doc_id, n_shingles, class_id, component_id)."""
        width, per, hot = self.width, self.per, self.hot
        spark = self.docs.sparkSession
        total = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(22, max(12, int(total // 1536).bit_length()))
        first = self._keep(_pass_one(self.docs, width, bits), "sets")
        table = spark.sparkContext.broadcast(_rarity(first, bits))
        sets = first.filter("part IS NULL").select("doc_id", "n", "s1", "s2")
        classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"))
        classes = self._keep(classes, "classes")
        mark = len(self.scratch)
        count = classes.count()
        slices, buckets = max(count // SLICE_ROWS, int(total // SLICE_BYTES)) + 1, max(count // (2 * SLICE_ROWS), int(total // SLICE_BYTES)) + 8
        prefixes = _pass_two(self.docs, width, per, bits, table).filter("n > 0")
        reps = prefixes.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        reps = self._keep(reps.select(F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "n", "fame", "prefix", "sketch"), "reps")
        keys = reps.groupBy("slice").applyInArrow(lambda t: _slice_keys(t, buckets), "bucket int, slice int, key binary, n binary")
        shared = keys.groupBy("bucket").applyInArrow(_shared_keys, "slice int, key binary, n binary")
        cells = reps.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(lambda a, b: _cells(a, b, buckets, hot), _PACKED_DDL)
        candidates = self._keep(cells.groupBy("bucket").applyInArrow(lambda t: _candidates(t, per), "a long, b long").distinct(), "candidates")
        links = self.links(reps, candidates)
        # Rows with their class; an empty set is a class of its own id. Ids with several classes join them.
        rows = sets.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
        rows = self._keep(rows.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id"))), "rows")
        several = rows.groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).filter("least <> most")
        same = rows.join(several, "doc_id").select(F.col("class_id").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        comps = self._keep(components(links.unionByName(same), self.scratch), "components")
        kept = self.scratch[-1]
        out = rows.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
        mine = next(p for p in self.scratch if "/rows-" in p)
        self.scratch[mark:] = [p for p in self.scratch[mark:] if p not in (kept, mine)]
        self._done()
        self.scratch += [kept, mine]
        table.unpersist()
        return out


def near_duplicates(docs: DataFrame, width: int = 5, per: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one per row of docs; `per` is the similarity in hundredths."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return Join(rows, width, per, hot).run()


def keep_one(docs: DataFrame, width: int = 5, per: int = 80) -> DataFrame:
    """The document with the least id of each component, with all columns; documents without an id stay."""
    groups = near_duplicates(docs, width, per)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
