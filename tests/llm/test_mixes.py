"""Mixing and packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from checks.compare import duck, rows_of
from graphreports.llm import mixing, packing
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, taken string"


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, open_, want = 1.5 * sum(sizes.values()), set(weight), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= share
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets_and_the_same_each_time(spark):
    rows = [(k, "w " * (1 + k % 37), "abc"[min(k % 5, 2)] if k % 11 else None, "x") for k in range(3000)] + [(None, None, "a", None), (3001, "", "e", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    source = {r[0]: r[2] for r in rows}
    for r in got:
        by[source[r["doc_id"]]].append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 37
    assert sorted(map(str, mixing.plan(df.repartition(7)).collect())) == sorted(map(str, got))
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.filter("text is not null").count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.plan(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_against_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    ours = mixing.plan(spark.read.parquet(f"{folder}/documents.parquet"))
    cursor = duck(folder).execute(mixing.SQL)
    assert rows_of(ours.columns, ours.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def check_packing(rows, docs, length=2048, gapless=True):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // length)))
        for k, r in enumerate(own):
            part = ids[k * length : (k + 1) * length]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * length, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for group in by_bin.values() if gapless else ():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_bin)


def test_packing(spark):
    texts = [None, "", "Hello, world's  best TEXT <|endoftext|> ΣΑΣ é 3x!!"] + ["word%d other " % k * (7 * k % 900) for k in range(180)] + ["long text " * 6000]
    df = spark.createDataFrame([(k, t, "s", "x") for k, t in enumerate(texts)], DOCS)
    rows = packing.pack(df, PATH, block=40).collect()
    bins = check_packing(rows, list(enumerate(texts)))
    size = [r["length"] for r in rows]
    whole = packing.best_fit(size, sorted(range(len(size)), key=lambda i: -size[i]), 2048)  # all pieces at once
    assert -(-sum(size) // 2048) <= bins <= len(whole) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert packing.pack(df.limit(1), PATH).count() == 1


def test_words_have_the_ids_of_whole_texts(spark):
    tokenizer, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = [
        "Hello, hello! HELLO's can't  x.%%% é. «é». 3.14 a)... a). 12.,. ... 'tis 'Tis don'T. e\u0301. É! \u00a0x\u2003y \x1cz \x85 K\u212a. ΑΣ. ΑΣ\nΑΣ,b ſ. İ. ß!!",
        "<|endoftext|> x<|ENDOFTEXT|>", "a<|b", "日本語。テスト! 🙂🙂. a🙂. \u200d.", "x" * 300 + "." * 50, "", " \t\n",
    ]
    for _turn in range(2):
        for t in texts:
            assert words.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
        words.old, words.young = words.young, {}


def test_plain_words_need_no_more_than_the_model(monkeypatch):
    tokenizer, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = ["Don't we'll ÿß 's !'s x'st a1b2 3.14 café's. éé1é, naïve ño;", "~!@#$%^&*()_+`-=[]{}|;:\",./? ab</w> __init__ ó. a--b"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(words, "_encode", lambda left: pytest.fail(str(left)) if left else None)
    assert [np.frombuffer(words.ids(t), "<u4").tolist() for t in texts] == expected
    monkeypatch.undo()
    other = "÷×ª µ ÀÉ a\x00b \x7f ſ K 中文1a œuvre <é e\u0301 \u00ad"
    assert np.frombuffer(words.ids(other), "<u4").tolist() == tokenizer.encode(other, add_special_tokens=False).ids


def test_crossover_keeps_every_piece(spark):
    import random

    rng = random.Random(6)
    size = [rng.randrange(1, 2048) for _ in range(300)]
    a = packing.best_fit(size, list(range(300)), 2048)
    b = packing.best_fit(size, list(range(299, -1, -1)), 2048)
    for child in (packing.crossover(a, b, size, 2048, rng), packing.mutate(a, size, 2048, rng)):
        assert sorted(i for x in child for i in x) == list(range(300))
        assert all(sum(size[i] for i in x) <= 2048 for x in child)
    best = packing.evolve(size, [], 1, 2048, 10, 4)[0]
    assert len(best) <= len(packing.best_fit(size, sorted(range(300), key=lambda i: -size[i]), 2048))
    assert packing._bins(packing._coded(best, 300)) == [sorted(x) for x in best]


def test_words_agree_with_brute_force(spark):
    text = "a\x0bb c\x1cd \x85e"
    df = spark.createDataFrame([(1, text, "s", "x")], DOCS)
    assert mixing.plan(df).first()["size"] == len(brute.words(text))
