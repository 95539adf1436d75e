"""Periodic runs: against a plain search, transforms against plain sums, and the query against its contract."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from graphreports.llm import runs
from tests.llm import brute


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def mixed(rng):
    n = rng.randint(0, 200)
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        p, a = rng.randint(1, max(1, n // 2)), rng.randrange(n)
        unit = [b"u%d" % rng.randrange(rng.choice([1, 2, 500])) for _ in range(p)]
        for i in range(rng.randint(1, n - a)):
            words[a + i] = unit[i % p]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = b"x"
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(15):
        texts = [mixed(rng) for _ in range(rng.randint(1, 8))]
        texts += texts[:2]  # copies beside each other have no common run
        assert runs.runs_of(texts) == [plain_runs(t) for t in texts]


def test_every_period_is_found():
    for q in range(1, 140):
        for extra in (0, 1, 7):
            unit = [b"%d" % i for i in range(q)]
            n = max(12, 2 * q) + extra
            for lead in range(0, 9, 4):
                text = [b"a%d" % i for i in range(lead)] + [unit[i % q] for i in range(n)] + [b"z"]
                assert runs.runs_of([text]) == [[(lead, n, q)]], (q, extra, lead)
    assert runs.runs_of([[b"a"] * 11]) == [[]]


def test_block_sums_are_exact():
    rng = np.random.default_rng(3)
    for b, span, top in ((2, 2, 3), (4, 17, 2), (8, 23, 50), (64, 191, 1 << 20), (256, 700, 3_000_000)):
        blocks, windows = rng.integers(0, top, (5, b)), rng.integers(0, top, (5, span))
        windows[:, span - b :] = blocks
        near = windows.copy()
        near[0, -1] += 1  # a sum of one square
        for w in (windows, near):
            sums = [[int(((blocks[r] - w[r, s : s + b]) ** 2).sum()) for s in range(span - b + 1)] for r in range(5)]
            assert runs.zero_mismatch(blocks, w).tolist() == np.argwhere(np.array(sums) == 0).tolist()


def test_long_and_plain_texts_are_linear():
    for period in (1, 3, 5000):
        assert runs.runs_of([[b"%d" % (i % period) for i in range(300_000)]]) == [[(0, 300_000, period)]]


def contract(doc_id, text):
    words = brute.words(text)
    n = len(words)
    h = crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(kept)))


def test_report(spark):
    rng = random.Random(8)
    vocabulary = ["ab", "cd", "é", "漢", " x", "😀"]
    texts = [None, "", " \t\n", "one"] + ["\n".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    texts += ["a b " * 40, "a b " * 40, "w " * 11, "w " * 12]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, runs string, words string")
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in runs.report(docs).collect()}
    assert got == {k: contract(k, t) for k, t in enumerate(texts)}
    assert sum(1 for k in got if crc32(str(k).encode()) % 10 == 0) > 3


def test_odd_tables(spark):
    assert runs.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a " * 20), ("x", "a " * 20), ("x", "a " * 20), (None, None)], "doc_id string, text string")
    assert sorted(((r["doc_id"] or "", r["n_runs"]) for r in runs.report(docs).collect())) == [("", 0), ("", 1), ("x", 1), ("x", 1)]
    ids = spark.createDataFrame([(None, "a " * 20), (7, "")], "doc_id long, text string").coalesce(1)
    assert sorted(((r["doc_id"] or -1, r["n_runs"]) for r in runs.report(ids).collect())) == [(-1, 1), (7, 0)]
    found = runs.detect(docs).first()
    assert found["text"] == "a" and [tuple(r) for r in found["runs"]] == [(0, 20, 1)]
