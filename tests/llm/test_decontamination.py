"""Benchmark decontamination against a plain search for windows."""

import hashlib
import random
import re

import pytest

from graphreports.llm import decontamination
from graphreports.llm.common import free_names

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "...", "A", "É é", "a b", "😀 漢", "a" * 5000, "the\x00of", "x_y 1.5"]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window):
    """{doc_id: (n_words, n_hit, n_items, digest, contaminated)}"""
    windows = {}
    for item_id, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if item_id is None else str(item_id))
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def some(rng, n, kinds):
    return " ".join(rng.choice(["w%d", "W%d", "é%d"]) % rng.randrange(kinds) for _ in range(n))


@pytest.mark.parametrize("seed, kinds, window, most", [(1, 2, 3, 200_000), (2, 3, 4, 60), (3, 30, 10, 200_000), (4, 2, 10, 150)])
def test_report_is_that_of_a_plain_search(spark, seed, kinds, window, most):
    rng = random.Random(seed)
    items = [(k, some(rng, rng.choice([1, 2, 3, 9, 10, 11, 30]), kinds)) for k in range(12)] + list(enumerate(ODD, 100))
    items += [(3, items[5][1]), (200, items[5][1]), (None, items[6][1])]  # one id of two texts, one text of two ids, no id
    texts = ODD + [some(rng, rng.randint(0, 60), kinds) for _ in range(30)]
    for _ in range(20):
        w = (rng.choice(items)[1] or "x").split(" ")
        a = rng.randrange(len(w))
        texts.append(some(rng, 4, 9) + "\n" + ", ".join(w[a : a + rng.randint(1, 20)]).upper() + ". " + some(rng, 3, 9))
    docs = list(enumerate(texts))
    got = decontamination.report(
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, found int, item int"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string"), window, most,
    )
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()}
    assert rows == plain(docs, items, window)


def test_long_items_are_cut_without_losing_a_window(spark):
    text = " ".join("w%d" % k for k in range(130))
    items = spark.createDataFrame([(1, text), (2, " ".join(text.split()[:12]))], "item_id long, text string")
    rows = [(r["text"], r["piece"].split(" ")) for r in decontamination.pieces(items, 5, 20).collect()]
    windows = {tuple(p[k : k + 5]) for _, p in rows for k in range(len(p) - 4)}
    assert windows == {tuple(text.split()[k : k + 5]) for k in range(126)} and max(len(p) for _, p in rows) <= 20
    dealt, shards = decontamination.sharded(decontamination.pieces(items, 5, 20), 40)
    assert shards >= 4 and dealt.select("shard").distinct().count() > 1


def test_automaton_accepts_the_runs_of_its_texts_alone():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[b"%d" % rng.randrange(2) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        a = decontamination.Automaton(3, [(str(k), t) for k, t in enumerate(texts)])
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        probe = [b"%d" % rng.randrange(3) for _ in range(40)]
        starts, ends, owners = a.hits(probe)
        hit, owned = set(), set()
        for k, t in enumerate(texts):
            n = min(3, len(t))
            for w in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}:
                for i in range(len(probe) - n + 1):
                    if tuple(probe[i : i + n]) == w:
                        hit.update(range(i, i + n))
                        owned.add(str(k))
        assert hit == {i for s, e in zip(starts, ends) for i in range(s, e)} and owned == owners
        assert all(e < s for e, s in zip(ends, starts[1:]))
        state = [0]
        for w in next(iter(sorted(runs, key=len, reverse=True))):
            state.append(a.next[state[-1]][a.number[w]])
        assert len(a.length) <= 2 * sum(map(len, texts))


def test_clean(spark):
    secret = " ".join("Item%d" % k for k in range(12))
    items = spark.createDataFrame([(1, secret)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"Before, it was. {secret.upper()}! After: it is. " + "clean words " * 10, 1, "a"), (2, secret, 2, "b"), (3, None, 3, "c"), (4, "", 4, "d"), (5, "other  text\n", 5, "e"), (5, "other  text\n", 5, "e")],
        "doc_id long, text string, found long, found_ string",
    )
    got = sorted(tuple(r) for r in decontamination.clean(docs, items).collect())
    cut = "Before, it was. ! After: it is. " + "clean words " * 10
    assert [g[:1] + g[2:] for g in got] == [(1, 1, "a"), (3, 3, "c"), (4, 4, "d"), (5, 5, "e"), (5, 5, "e")]
    assert got[0][1] == cut and [g[1] for g in got[1:]] == [None, "", "other  text\n", "other  text\n"]
    assert decontamination.clean(docs, items, longest=12, share=1.0).count() == 6  # a stretch of 12 words is not over the limit
    assert decontamination.clean(docs, items.limit(0)).count() == 6


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert decontamination.report(docs, items).collect() == []
    one = spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in decontamination.report(one, items).fillna("-", "doc_id").collect()) == [("-", 0, 0, 0, none, False), ("x", 2, 0, 0, none, False)]


def test_free_names(spark):
    df = spark.createDataFrame([], "a int, A_ int, b int")
    assert free_names(df, "a", "a", "c", "c") == ["a__", "a___", "c", "c_"]
