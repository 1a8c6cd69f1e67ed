import random

import numpy as np

from trawldex.llm import arrays, q_suffix, suffix


def brute(docs, length):
    first = {}
    for i, t in docs:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], 1 << 62), i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = (bytes(np.frombuffer(t, np.uint8)[~gone]), int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum()))
    return out


def test_sql(same):
    same(q_suffix.op8_suffix_dedup, q_suffix.OP8_SQL)


def test_suffix_order():
    random.seed(3)
    for k in range(60):
        t = bytearray(random.choice(b"\x01\x02\x03" if k % 2 else b"\x01\x02\x03\x04\x05\x06\x07") for _ in range(random.randrange(1, 300)))
        for _ in range(5):
            t[random.randrange(len(t))] = 0
        a = np.frombuffer(bytes(t) + b"\0", np.uint8)
        found = [bytes(a[p:]).split(b"\0")[0] for p in suffix.suffix_order(a, 400)]
        assert found == sorted(found) and len(found) == int((a != 0).sum())


def test_brute_force(spark, monkeypatch):
    random.seed(8)
    docs = []
    base = "".join(random.choice("abcdefgh é") for _ in range(600))
    for i in range(60):
        t = ""
        for _ in range(random.randrange(5)):
            if random.random() < 0.6:
                a = random.randrange(600)
                t += base[a : a + random.randrange(5, 160)]
            else:
                t += "".join(random.choice("ab") for _ in range(random.randrange(60)))
        docs.append((i * 3 - 5, t))
    docs += [(1000 + i, base[:90]) for i in range(20)] + [(-100, base[20:80])]
    for length, slice_bytes in ((50, 700), (20, 1 << 20)):
        want = brute([(i, t.encode()) for i, t in docs], length)
        rows = suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"), length, slice_bytes=slice_bytes).collect()
        assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in rows} == want


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 100)
    monkeypatch.setattr(arrays, "CHUNK", 100)
    x = np.frombuffer(b"abcdefghij" * 100, np.uint8)
    first, count, key = suffix.segments(x, np.array([0, 400, 1000]), 50)
    assert count.sum() == 351 + 551 and (first[1:] >= first[:-1] + count[:-1]).all() and len(key) == len(first)


def test_edges(spark):
    long = "x y " * 100
    docs = spark.createDataFrame([(None, long), (None, long), (1, long), (1, long), (2, None), (3, ""), (4, "short"), (5, long)], "doc_id long, text string")
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, len(bytes(r.kept))) for r in suffix.dedup(docs).collect())
    assert rows == [(False, 0, 400, 400)] * 2 + [(True, 1, 400, 0)] * 2 + [(True, 2, 0, 0), (True, 3, 0, 0), (True, 4, 5, 5), (True, 5, 400, 0)]
    assert suffix.dedup(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark):
    random.seed(12)
    every = bytes(range(256))
    docs = [(1, every * 2), (2, b"\xff" * 60 + b"\x00" * 60), (3, b"x" + b"\xff" * 55 + every[10:80] + b"\x00" * 52), (4, every[::-1])]
    rows = suffix.dedup(spark.createDataFrame([(i, bytearray(t)) for i, t in docs], "doc_id long, text binary")).collect()
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in rows} == brute(docs, 50)


def test_rows_of_one_id_and_long_text(spark):
    texts = [f"{k} " + " ".join(f"word{i % 997}-{i % 1009}" for i in range(k, k + 9000)) for k in range(4)]
    docs = [(7, texts[0]), (7, texts[1]), (8, texts[2]), (None, texts[3])]
    rows = suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"), slice_bytes=1 << 16).collect()
    got = {(r.doc_id, r.n_bytes): len(bytes(r.kept)) for r in rows}
    assert all(got[i, len(t)] == len(t) for i, t in docs if i is None) and got[8, len(texts[2])] < 100 and got[7, len(texts[0])] < 100


def test_least_ids_when_every_byte_occurs():
    """The same with all 256 bytes as with few, against a dictionary of strings."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 40).astype(np.uint8)
    parts = [np.arange(256, dtype=np.uint8), *[np.r_[rng.integers(0, 256, rng.integers(0, 9)).astype(np.uint8), base[rng.integers(0, 20) :]] for _ in range(30)], base[:3]]
    ids, n = np.arange(len(parts))[::-1].copy(), 8
    sizes = np.array([len(p) for p in parts])
    begin, out = suffix.least_ids(np.concatenate(parts), sizes, ids, n)
    least = {}
    for p, d in zip(parts, ids, strict=True):
        for o in range(len(p) - n + 1):
            least[p[o : o + n].tobytes()] = min(d, least.get(p[o : o + n].tobytes(), d))
    for p, b in zip(parts, begin, strict=True):
        assert [out[b + o] for o in range(len(p) - n + 1)] == [least[p[o : o + n].tobytes()] for o in range(len(p) - n + 1)]
