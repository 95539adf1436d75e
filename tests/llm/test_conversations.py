"""Conversation repair against a plain search for the cheapest, then least audit."""

import hashlib
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest

from graphreports.llm import conversations as c

STATES = {"": 0, "s": 1, "u": 2, "a": 3}
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """(cost, audit) of rows (initial, fault)."""

    @lru_cache(None)
    def go(i, state, put):
        found = []
        wanted = "a" if state == "u" else "u"
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            initial, fault = rows[i]
            ways = [(3, "D", state)]
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                if initial == wanted or initial == "s" and state == "":
                    ways.append((extra, "K", initial))
                ways.append((2 + extra, "R", wanted))
            for cost, letter, after in ways:
                rest = go(i + 1, after, 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1]))
        if put < 3:
            rest = go(i, wanted, put + 1)
            if rest:
                found.append((2 + rest[0], "I" + rest[1]))
        return min(found) if found else None

    return go(0, "", 0)


def plain(rows):
    """The contract for the rows (turn, role, text) of one conversation, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = [x for x in text if x not in " \t\n\x0b\x0c\r"][-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = cheapest(tuple(zip(initials, faults))) if rows else (0, "")
    said, state, at = [], "", 0
    for edit in audit:
        wanted = "a" if state == "u" else "u"
        if edit == "I":
            said.append({"u": "user:", "a": "assistant:"}[wanted])
            state = wanted
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        state = role[:1] if edit == "K" else wanted
        said.append((role if edit == "K" else {"u": "user", "a": "assistant"}[wanted]) + ":" + text)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = [t for t, _, _ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def damage(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return in_order(out)


def any_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u", "Assistant", None]
    texts = ["Yes.", "No!", "so", "é?", " \n", "", None, "ok. \x0b", "long " * 50, "a\nb."]
    return [(rng.choice([k, k, k, k // 2, None]), rng.choice(roles[: rng.choice([2, 5, 10])]), rng.choice(texts) if rng.random() < 0.5 else f"text {k}.") for k in range(n)]


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(2)
    kinds = [4 * r + f for r in range(4) for f in range(4)]
    names = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}
    for _ in range(150):
        n = rng.randint(0, 9)
        rows = [[rng.choice(kinds if rng.random() < 0.7 else [0, 4, 8]) for _ in range(n)] for _ in range(3)]
        ended = np.array([r + [c.END] for r in rows]).reshape(3, n + 1)
        want = [cheapest(tuple(("sua "[k // 4], names[k % 4]) for k in r)) for r in rows]
        assert [x[0] for x in c.audits(ended, np.zeros((3, 4), np.int64), np.array([c.START]))[0]] == [w[1] for w in want]
        assert [int(m[:, c.START].min()) for m in c.matrices(ended)] == [w[0] for w in want]


def test_ranks_order_nodes_by_their_audits():
    rng = random.Random(5)
    n = 320
    letter = np.array([0 if k % 40 == 39 else rng.randint(1, 2) for k in range(n)])
    to = np.array([k if letter[k] == 0 else rng.randint(k + 1, (k // 40) * 40 + 39) for k in range(n)])
    rank, pointers = c.ranked(letter, to)

    def audit(k):
        out = []
        while letter[k]:
            out.append(int(letter[k]))
            k = to[k]
        return out

    every = [audit(k) for k in range(n)]
    order = sorted(range(n), key=lambda k: every[k])
    assert all((rank[a] < rank[b]) == (every[a] < every[b]) for a, b in zip(order, order[1:]))
    assert len(pointers) <= 7


def frame(spark, table, kind="long"):
    rows = [(k, *r, "x", 1, 2) for k, found in table.items() for r in found]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string, pos string, part int, lead int").repartition(5)


def got(df):
    return {r["conv_id"]: tuple(r[x] for x in COLUMNS) for r in df.collect()}


def test_report_is_the_contract(spark):
    rng = random.Random(7)
    table = {k: any_rows(rng, rng.randint(1, 8)) for k in range(120)} | {None: any_rows(rng, 6), 500: [(None, None, None)] * 3}
    dropped = next(k for k in range(10_000, 11_000) if crc32(f"{k}:0".encode()) % 20 == 0)
    table[dropped] = [(0, "user", "Gone.")]
    found = got(c.report(frame(spark, table)))
    assert found == {k: plain(damage(k, rows)) for k, rows in table.items()}
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.fixture
def narrow_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_conversation_over_many_partitions(spark, narrow_ranges):
    rng = random.Random(9)
    table = {"hot": any_rows(rng, 400), "b": any_rows(rng, 5), "same": [(1, "user", "Same.")] * 150, "z": any_rows(rng, 3), "turnless": [(None, "system", f"t{k}.") for k in range(90)]}
    df = frame(spark, table, "string")
    assert c.segments(c.keyed(c.damaged(df))).groupBy("conv_id").count().filter("conv_id = 'hot' and count > 2").count() == 1
    assert got(c.report(df)) == {k: plain(damage(k, rows)) for k, rows in table.items()}


def test_repaired_rows(spark):
    rows = {1: [(0, "system", "S."), (1, "user", "Q?"), (2, "user", "Q?"), (4, "assistant", "A")], 2: [(0, "assistant", "A.")], 3: [(0, "user", " ")]}
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in c.repaired(df).collect()) == [
        (1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A"), (2, 0, "user", ""), (2, 1, "assistant", "A."),
    ]
    found = got(c.summarised(df, df))
    assert found[1][:7] == (1, 0, 1, 1, 1, 4, "KKDK") and found[2][:7] == (0, 0, 0, 0, 0, 2, "IK") and found[3][:7] == (0, 1, 0, 0, 0, 3, "D")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.report(df).collect() == [] and c.repaired(df).collect() == []


def test_supplied_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    table = {}
    for r in df.collect():
        table.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got(c.report(df)) == {k: plain(damage(k, rows)) for k, rows in table.items()}
