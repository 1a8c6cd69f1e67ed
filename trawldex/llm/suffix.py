"""Suffix-array removal of repeated byte strings across documents.

A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller id.

Steps, each over bounded groups:
1. Documents are dealt to slices of about `slice_bytes`. Every string of `length` bytes is named by its anchor, the
   16-byte piece in it with the least hash; equal strings have equal anchors. A slice reports its distinct anchors.
2. By anchor: which occur in two documents or more. Strings under any other anchor occur in one document only.
3. Each slice cuts its text into segments of neighbouring strings with the same shared anchor and sends every distinct
   segment once, with the least and the greatest id that has it.
4. By anchor: a suffix array over the distinct segments in two stages (suffixes smaller than their successor are
   sorted directly, all others are induced by scanning the buckets), common prefixes of neighbours, and from them the
   least id of every string.
5. Each slice removes the strings whose least id is smaller than the document's own.
A passage that very many documents share reaches step 4 once per slice, however many documents have it.

Defined results: null text counts as empty; a null id counts as the smallest; rows with the same id do not remove each
other's bytes; an empty table gives an empty result; other columns are ignored, whatever their names; bytes that are no UTF-8 count as they are. A text is processed in
chunks, so memory beyond the text itself is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.llm.arrays import give_back, mix, ranges, split_by

SLICE_BYTES = 4 << 20
CHUNK = 1 << 22
PIECE = 16  # bytes of an anchor
PART_BYTES = 3 << 20  # bytes of segments in one suffix array
LEAST_ID = -(2**63)


def _words(x: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes at every place as a number; x is padded with zeros at its end."""
    n = len(x)
    pad = np.zeros(n + 16, np.uint8)
    pad[:n] = x
    out = np.empty(n, np.uint64)
    kind = ">u8" if big else "<u8"
    for o in range(min(8, n)):
        m = len(range(o, n, 8))
        out[o::8] = pad[o : o + 8 * m].view(kind)
    return out


def segments(x: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the documents in x (document d is x[starts[d]:starts[d + 1]]): first string, number of strings, anchor key."""
    wide = length - PIECE + 1
    firsts, counts, keys = [], [], []
    ends = np.repeat(starts[1:], np.diff(starts))
    for c in range(0, max(0, len(x) - length + 1), CHUNK):
        part = x[c : c + CHUNK + length - 1]
        w = _words(part)
        n = len(part) - PIECE + 1
        h = mix(w[:n] ^ mix(w[8 : n + 8], 0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93)
        packed = (h & ~np.uint64(0x7FFFFF)) | np.arange(n, dtype=np.uint64)
        low, have = packed, 1
        while have * 2 <= wide:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < wide:
            low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
        anchor = (low & np.uint64(0x7FFFFF)).astype(np.int64)
        at = np.arange(c, c + len(low))
        valid = at + length <= ends[c : c + len(low)]
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        # a run ends where the next one begins or where strings would cross a document's end
        stop = np.flatnonzero(np.r_[valid[:-1] & (new[1:] | ~valid[1:]), valid[-1:]]) + 1
        firsts.append(first + c)
        counts.append(stop - first)
        keys.append(mix(h[anchor[first]], 0xA0761D6478BD642F) >> np.uint64(1))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(keys)


def names(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of x[first:first + size] for each first, the same wherever the bytes stand.

    The bytes are folded eight at a time, each block mixed with its number, so that no simple rule makes names equal."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # a bounded number of bytes at a time
        until = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), CHUNK // 2, "right")) + at)
        f, n = first[at:until], size[at:until]
        blocks = (n + 7) // 8
        base = int(f.min())
        word = _words(x[base : int((f + n).max())])
        number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        value = word[np.repeat(f - base, blocks) + 8 * number]
        left = np.minimum(8, np.repeat(n, blocks) - 8 * number).astype(np.uint64)
        value &= ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - left))  # little endian: later bytes are the high ones
        value = mix(mix(value, 0xE7037ED1A0B428DB) + number.astype(np.uint64), 0x9FB21C651E98DF25)
        out[at:until] = mix(np.add.reduceat(value, np.cumsum(blocks) - blocks) + n.astype(np.uint64), 0x8EBC6AF09C88C6E3)
        at = until
    return out


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t that do not begin with 0, in the order of their first `depth` bytes. t ends with 0; 0 parts strings.

    Suffixes smaller than their successor are sorted by their bytes, eight at a time and only where they tie; the
    others are induced: scanning the buckets of first bytes upwards, a suffix puts its predecessor, if
    that begins with a greater byte, at the end of what the predecessor's bucket has so far.
    """
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    last = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(last[::-1])[::-1]
    smaller = np.r_[step, -1][np.minimum(nxt, n - 1)] > 0
    direct = np.flatnonzero(smaller & (t[:-1] != 0))
    word = _words(t, big=True)
    order = np.argsort(word[direct], kind="stable")
    sa = direct[order]
    key = word[sa]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(sa) else np.zeros(0, np.int64)
    same = np.r_[group[1:] == group[:-1], False] if len(sa) else np.zeros(0, bool)
    tied = np.flatnonzero(same | np.r_[False, same[:-1]]) if len(sa) else np.zeros(0, np.int64)
    at = 8
    while len(tied) and at < depth:
        pos, own = sa[tied], group[tied]
        key = word[np.minimum(pos + at, n - 1)]
        order = np.lexsort((key, own))
        pos, key = pos[order], key[order]
        sa[tied] = pos
        fresh = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
        group[tied] = np.cumsum(fresh)
        same = np.r_[~fresh[1:], False]
        tied = tied[same | np.r_[False, same[:-1]]]
        at += 8
    bounds = np.searchsorted(t[sa], np.arange(257, dtype=np.int64))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    done = []
    for c in range(256):
        if c == 0:
            entries = np.flatnonzero(t == 0)
        else:
            induced = list(waiting[c])
            while induced and len(induced[-1]):
                cur = np.concatenate(induced) if len(induced) == len(waiting[c]) else induced[-1]
                before = cur[cur > 0] - 1
                induced.append(before[t[before] == c])
            entries = np.concatenate([*induced, sa[bounds[c] : bounds[c + 1]]]) if induced else sa[bounds[c] : bounds[c + 1]]
            done.append(entries)
        before = entries[entries > 0] - 1
        first = t[before]
        up = first > c
        before, first = before[up], first[up]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                waiting[first[a]].append(before[a:b])
        waiting[c] = []
    return np.concatenate(done)


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to depth, in which the suffixes at a and b agree; word has eight bytes, the first one highest."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        differ = word[a[live] + at] ^ word[b[live] + at]
        lead = np.full(len(live), 8)
        for k in range(8):
            lead[differ >> np.uint64(8 * k) != 0] = 7 - k
        out[live] += lead
        live = live[differ == 0]
    return np.minimum(out, depth)


def least_ids(strings: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For segments laid end to end in `strings`: of every string of `length` bytes in them, the least id (per segment, in order)."""
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    present = np.bincount(strings, minlength=256) > 0
    if present.all():  # no number is left to part the segments: every byte becomes two of 32, and only whole bytes are looked at
        halves = np.empty(2 * len(strings), np.uint8)
        halves[0::2], halves[1::2] = strings >> 4, (strings & 15) + 16
        wide, found = least_ids(halves, 2 * sizes, ids, 2 * length)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        return begin, found[wide[owner] + 2 * (np.arange(int(ends[-1])) - begin[owner])]
    # bytes are numbered from one, so that 0 can part the segments
    number = np.cumsum(present).astype(np.uint8)
    t = np.zeros(int(ends[-1]) + 64, np.uint8)
    keep = np.ones(int(ends[-1]), bool)
    keep[ends - 1] = False
    t[: len(keep)][keep] = number[strings]
    t = t[: len(keep)] if len(keep) else t[:1]
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    is_start = np.arange(len(t)) + length <= (ends - 1)[owner]
    order = suffix_order(t, length)
    order = order[is_start[order]]
    padded = np.zeros(len(t) + 64, np.uint8)
    padded[: len(t)] = t
    lcp = common_prefix(_words(padded, big=True), order[:-1], order[1:], length)
    new = np.flatnonzero(np.r_[True, lcp < length])
    least = np.minimum.reduceat(ids[owner[order]], new)
    out = np.empty(len(t), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[new, len(order)]))
    return begin, out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LEAST_ID).to_numpy()


def _text(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    texts = [b if b is not None else b"" for b in table.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(b) for b in texts])


def _shut(values: np.ndarray) -> bytes:
    """The bytes of values, compressed, behind their number."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def _rows(parts: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(parts, schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("data", pa.binary())])
_SHARED = pa.schema([("slice", pa.int32()), ("data", pa.binary())])
_SEGMENTS = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("name", pa.binary()), ("key", pa.binary()), ("size", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("text", pa.binary())])
_REMOVE = pa.schema([("slice", pa.int32()), ("name", pa.binary()), ("start", pa.binary()), ("end", pa.binary()), ("least", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def slice_anchors(table: pa.Table, length: int, buckets: int) -> pa.Table:
    """Distinct anchors of a slice; the lowest bit tells whether two of its documents have the anchor."""
    x, starts = _text(table)
    first, _, key = segments(x, starts, length)
    doc = _ids(table.column("doc_id"))[np.searchsorted(starts, first, "right") - 1]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    if not len(key):
        return _rows([], _ANCHORS)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    both = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
    data = (key[cut] << np.uint64(1)) | both.astype(np.uint64)
    number = table.column("slice")[0].as_py()
    return _rows([{"bucket": b, "slice": number, "data": data[o].tobytes()} for b, o in split_by((key[cut] % np.uint64(buckets)).astype(np.int64))], _ANCHORS)


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of the anchors of a bucket, those in two documents or more, given back to each slice that has them."""
    slices = table.column("slice").to_pylist()
    data = [np.frombuffer(b, np.uint64) for b in table.column("data").to_pylist()]
    key = np.concatenate(data)
    order = np.argsort(key >> np.uint64(1), kind="stable")
    plain = key[order] >> np.uint64(1)
    cut = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
    count = np.diff(np.r_[cut, len(plain)])
    good = (count > 1) | (np.bitwise_or.reduceat(key[order], cut) & np.uint64(1)).astype(bool)
    shared = np.empty(len(key), bool)
    shared[order] = np.repeat(good, count)
    out, at = [], 0
    for s, d in zip(slices, data, strict=True):
        mine = d[shared[at : at + len(d)]] >> np.uint64(1)
        at += len(d)
        if len(mine):
            out.append({"slice": s, "data": mine.tobytes()})
    return _rows(out, _SHARED)


def slice_segments(docs: pa.Table, shared: pa.Table, length: int, buckets: int) -> pa.Table:
    """Distinct segments of a slice under shared anchors."""
    if not docs.num_rows or not shared.num_rows:
        return _rows([], _SEGMENTS)
    x, starts = _text(docs)
    first, count, key = segments(x, starts, length)
    wanted = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in shared.column("data").to_pylist()]))
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    mine = np.flatnonzero(wanted[at] == key)
    first, key, size = first[mine], key[mine], count[mine] + length - 1
    name = names(x, first, size)
    doc = _ids(docs.column("doc_id"))[np.searchsorted(starts, first, "right") - 1]
    order = np.argsort(name, kind="stable")
    cut = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    least, most = np.minimum.reduceat(doc[order], cut), np.maximum.reduceat(doc[order], cut)
    one = order[cut]
    number = docs.column("slice")[0].as_py()
    out = []
    for b, o in split_by((key[one] % np.uint64(buckets)).astype(np.int64)):
        at, n = first[one[o]], size[one[o]]
        take = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        out.append({"bucket": b, "slice": number, "name": name[one[o]].tobytes(), "key": _shut((key[one[o]] >> np.uint64(40)).astype(np.uint16)), "size": _shut(n.astype(np.int32)), "least": _shut(least[o]), "most": _shut(most[o] - least[o]), "text": _shut(x[take])})
    return _rows(out, _SEGMENTS)


def _take(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    begin = np.r_[0, np.cumsum(size)[:-1]][which]
    n = size[which]
    return flat[np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


def bucket_removals(table: pa.Table, length: int) -> pa.Table:
    """Suffix arrays over a bucket's distinct segments; for each slice, the runs of strings that a smaller id has."""
    col = lambda c, kind: [_opened(b, kind) for b in table.column(c).to_pylist()]
    name = [np.frombuffer(b, np.uint64) for b in table.column("name").to_pylist()]
    key, size, least, most = col("key", np.uint16), col("size", np.int32), col("least", np.int64), col("most", np.int64)
    of = np.repeat(table.column("slice").to_numpy(), [len(x) for x in name])
    text = np.concatenate(col("text", np.uint8))
    name, key, size, least, most = (np.concatenate(c) for c in (name, key, size.copy(), least, most))
    size, most = size.astype(np.int64), most + least
    order = np.argsort(name, kind="stable")
    cut = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    one = order[cut]
    group = np.empty(len(name), np.int64)
    group[order] = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(name)]))
    low = np.minimum.reduceat(least[order], cut)
    # whole anchors, by a part of their key, go to suffix arrays of bounded size
    by = np.argsort(key[one], kind="stable")
    heavy = np.cumsum(size[one][by]) // PART_BYTES
    edge = np.r_[True, key[one][by][1:] != key[one][by][:-1]]
    part = np.maximum.accumulate(np.where(edge, heavy, 0))
    starts, ends, ids, which = [], [], [], []
    for p in np.split(by, np.flatnonzero(np.diff(part)) + 1):
        begin, found = least_ids(_take(text, size, one[p]), size[one[p]], low[p], length)
        n = size[one[p]] - length + 1
        seg = np.repeat(np.arange(len(p)), n)
        off = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        val = found[begin[seg] + off]
        run = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (val[1:] != val[:-1])])
        stop = np.r_[run[1:], len(val)] - 1
        starts.append(off[run])
        ends.append(off[stop] + 1)
        ids.append(val[run])
        which.append(p[seg[run]])
    starts, ends, ids, which = (np.concatenate(x) for x in (starts, ends, ids, which))
    order = np.argsort(which, kind="stable")
    starts, ends, ids, which = starts[order], ends[order], ids[order], which[order]
    at = np.searchsorted(which, np.arange(len(one) + 1))
    give_back()
    out = []
    for s, o in split_by(of.astype(np.int64)):
        n = at[group[o] + 1] - at[group[o]]
        take = np.repeat(at[group[o]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        use = ids[take] < np.repeat(most[o], n)
        take, own = take[use], np.repeat(name[o], n)[use]
        if len(take):
            out.append({"slice": s, "name": _shut(own), "start": _shut(starts[take].astype(np.int32)), "end": _shut(ends[take].astype(np.int32)), "least": _shut(ids[take])})
    return _rows(out, _REMOVE)


def slice_kept(docs: pa.Table, removals: pa.Table, length: int) -> pa.Table:
    """What stays of each document of a slice."""
    if not docs.num_rows:
        return _rows([], _KEPT)
    x, starts = _text(docs)
    ids = _ids(docs.column("doc_id"))
    gone = np.zeros(len(x), bool)
    if removals.num_rows:
        col = lambda c, kind: np.concatenate([_opened(b, kind) for b in removals.column(c).to_pylist()])
        name, a, b, least = col("name", np.uint64), col("start", np.int32), col("end", np.int32), col("least", np.int64)
        order = np.argsort(name, kind="stable")
        name, a, b, least = name[order], a[order], b[order], least[order]
        first, count, _ = segments(x, starts, length)
        own = names(x, first, count + length - 1)
        lo, hi = np.searchsorted(name, own), np.searchsorted(name, own, "right")
        n = hi - lo
        take = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = np.repeat(first, n)
        use = least[take] < ids[np.searchsorted(starts, at, "right") - 1]
        at, take = at[use], take[use]
        mark = np.zeros(len(x) + 1, np.int32)
        np.add.at(mark, at + a[take], 1)
        np.add.at(mark, at + b[take] - 1 + length, -1)
        gone = np.cumsum(mark[:-1]) > 0
    inner = np.r_[False, gone[:-1]] if len(gone) else gone
    head = np.zeros(len(x) + 1, bool)
    head[starts[:-1]] = True
    opens = np.flatnonzero(gone & (~inner | head[:-1]))
    following = np.r_[gone[1:], False] if len(gone) else gone
    closes = np.flatnonzero(gone & (~following | head[1:] | (np.arange(len(x)) == len(x) - 1))) + 1
    out = []
    raw = docs.column("doc_id").to_pylist()
    at = np.searchsorted(opens, starts)
    for d in range(len(raw)):
        s, e = starts[d], starts[d + 1]
        spans = [{"start": int(p - s), "end": int(q - s)} for p, q in zip(opens[at[d] : at[d + 1]], closes[at[d] : at[d + 1]], strict=True)]
        kept = x[s:e] if not spans else x[s:e][~gone[s:e]]
        out.append({"doc_id": raw[d], "n_bytes": int(e - s), "spans": spans, "kept": kept.tobytes()})
    return _rows(out, _KEPT)


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (doc_id, n_bytes, spans of removed bytes, kept bytes), one per row of docs."""
    if length < PIECE:
        raise ValueError(f"length must be at least {PIECE}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(total // slice_bytes) + 1
    buckets = slices // 4 + 8
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))  # by id and text, so that rows of one id spread
    by_slice = lambda df: df.groupBy("slice")
    ddl = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    of = lambda s: ", ".join(f"{f.name} {ddl.get(f.type, 'array<struct<start:bigint,end:bigint>>')}" for f in s)
    anchors = by_slice(rows).applyInArrow(lambda t: slice_anchors(t, length, buckets), of(_ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, of(_SHARED))
    parts = by_slice(rows).cogroup(by_slice(shared)).applyInArrow(lambda a, b: slice_segments(a, b, length, buckets), of(_SEGMENTS))
    removals = parts.groupBy("bucket").applyInArrow(lambda t: bucket_removals(t, length), of(_REMOVE))
    return by_slice(rows).cogroup(by_slice(removals)).applyInArrow(lambda a, b: slice_kept(a, b, length), of(_KEPT))
