import collections
import random
import zlib

from trawldex.llm import q_sharding, sharding


def jump(key, n):
    key, b, j = (key or 0) & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    random.seed(0)
    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63)] + [random.randrange(-(2**63), 2**63) for _ in range(500)] + list(range(300))
    for n in (1, 2, 24, 25, 33, 1000):
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash("k", n).alias("s")).collect()
        assert [r.s for r in rows] == [jump(r.k, n) for r in rows]


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q_sharding.op4_jump_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = collections.defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25)) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (None, None, 1), (5, "", 2), (5, "x", 2)], "doc_id long, text string, shard int")
    rows = q_sharding.shard_documents(docs).collect()
    assert sorted(r.size for r in rows) == [8, 8, 8, 9] and {r.shard for r in rows if r.doc_id is None} == {jump(0, 24)}
    assert q_sharding.shard_documents(docs.limit(0)).count() == 0


def test_clashing_columns_and_repeats(spark):
    rows = spark.range(50).selectExpr("7L AS doc_id", "'a' AS shard", "2 AS slot", "3 AS shard_", "id AS __cell", "id AS n")
    out = sharding.assign(rows, "doc_id", 4, 5, ["doc_id"], 3, "n")
    assert out.columns == ["doc_id", "shard__", "slot_", "shard_", "__cell", "shard", "grown_shard", "slot"]
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(50)) and {(r.shard__, r.slot_, r.shard_) for r in got} == {("a", 2, 3)}


def test_ties_and_long_texts(spark):
    docs = spark.createDataFrame([(3, "same")] * 40 + [(4, "é" * 300_000)], "doc_id long, text string")
    rows = q_sharding.shard_documents(docs).collect()
    assert sorted(r.slot for r in rows if r.doc_id == 3) == list(range(40)) or jump(3, 24) == jump(4, 24)
    assert [r.size for r in rows if r.doc_id == 4] == [600_008]
