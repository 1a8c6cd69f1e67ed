import collections
import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from trawldex.llm import q_repair, repair

WS = " \t\n\x0b\x0c\r"


def damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            row = (c, t, "user" if h == 4 else role, "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text)
            yield from [row] * (2 if h == 3 else 1)


def cheapest(rows):
    """Uniform-cost search over (rows read, roles so far) without automata; rows: (role, text, fault)."""
    heap = [((0, ""), 0, 0, ())]
    step = {0: "su", 1: "u", 2: "a", 3: "u"}
    done = set()
    while heap:
        (cost, audit), i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        to = lambda k: {"s": 1, "u": 2, "a": 3}[k]
        full = {"u": "user", "a": "assistant"}
        for k in step[q]:
            if k in full:
                heapq.heappush(heap, ((cost + 2, audit + "I"), i, to(k), (*out, full[k] + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, ((cost + 3, audit + "D"), i + 1, q, out))
            if fault not in ("blank", "dup"):
                late = fault == "cut"
                for k in step[q]:
                    if role[:1] == k:
                        heapq.heappush(heap, ((cost + late, audit + "K"), i + 1, to(k), (*out, f"{role}:{text}")))
                    if k in full:
                        heapq.heappush(heap, ((cost + 2 + late, audit + "R"), i + 1, to(k), (*out, f"{full[k]}:{text}")))


def brute(rows):
    convs = collections.defaultdict(list)
    for r in damage(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(convs[c], key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
        seen, marked, faults = set(), [], collections.Counter()
        for _, role, text in mine:
            bare = text.strip(WS)
            fault = "blank" if not bare else "dup" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest(marked)
        out[c] = (gaps, faults["blank"], faults["dup"], faults["cut"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, block int")


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = rng.choice(["a.", "b", "c!", " ", None, "d? ", "e\n.", f"own {t}.", f"own {t}"])
            rows.append((c if c % 11 else None, None if rng.random() < 0.1 else t // rng.choice([1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7}])
def test_against_brute_force(spark, sizes):
    rows = made(1, 40, 14) + made(2, 1, 120)
    found = {r[0]: tuple(r)[1:] for r in q_repair.repair_all(table(spark, rows), **sizes).collect()}
    want = brute(rows)
    assert {c: (found.get(c), want[c]) for c in want if found.get(c) != want[c]} == {} and len(found) == len(want)


def test_query_matches_sql(same):
    rows = same(q_repair.op13_conversation_repair, q_repair.OP13_SQL)
    assert any("R" in r.audit for r in rows) and any("I" in r.audit for r in rows) and any("D" in r.audit for r in rows)


def test_automaton_is_small_and_lazy():
    table = repair.Automaton()
    table.before(0, 1)
    assert len(table.states) == 2
    every = table.closed()
    assert len(every) == len(set(every)) <= 100 and all(min(v) == 0 for v in every)


def test_long_conversation_of_equal_rows(spark):
    """One conversation, most of it one row again and again, in many blocks."""
    rows = [(1, 0, "user", "hi.")] + [(1, 1, "assistant", "same.")] * 600 + [(1, 5, "user", "bye.")]
    found = repair.repaired(table(spark, rows), block_rows=50).first()
    assert (found.gaps, found.duplicate, found.illegal, found.cost) == (3, 599, 599, 599 * 3 + 2)
    assert found.audit == "KK" + "D" * 599 + "KI" and found.repaired_sha256 == hashlib.sha256(b"user:hi.\nassistant:same.\nuser:bye.\nassistant:").hexdigest()


def test_edges(spark):
    assert q_repair.repair_all(table(spark, [])).collect() == []
    lost = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    row = q_repair.repair_all(table(spark, [(3, lost, "user", "x")])).first()
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = "x" * 3_000_000 + "."
    found = repair.repaired(table(spark, [(9, 0, "user", long), (9, 1, "assistant", long)])).first()
    assert found.audit == "KK" and found.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
