"""Quality rules, line de-duplication, near-duplicates."""

import random

import numpy as np
import pytest

from graphreports.llm import linededup, quality, simhash
from graphreports.llm.components import components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, extra string"


@pytest.fixture
def docs(spark):
    return lambda *texts: spark.createDataFrame([(k, t, "en", "s", "x") for k, t in enumerate(texts)], DOCS)


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "été", "don't", "#1", "a|b", "WOW!!")):
    return " ".join(rng.choice(words) + rng.choice(["", "\n", "\t", "\x0b"]) for _ in range(n))


ODD = [None, "", " \t\n", "one", "a b c", "a b c a b c", "x\nx\nx\n\n \n \n", " word two", "😀 😀 😀 😀", "a a a a a", "b\r\nb\r\nb"]


def test_measures(spark, docs):
    rng = random.Random(1)
    texts = ODD + [prose(rng, n) for n in (3, 40, 60, 300)] + [" ".join(str(i) for i in range(30_000)) + " 1 2 3", " ".join(["w%d" % (i % 700) for i in range(9000)])]
    got = {r["doc_id"]: r for r in quality.report(docs(*texts), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.measures(t), k
        assert r["kept"] == (not r["base_failed"])


def test_allowed_rejections(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(n, level) for n in (0, 1, 30, 300, 1500) for level in (0.3, 0.05, 0.001)]
    df = spark.createDataFrame(cases, "n long, level double").select("n", "level", quality.allowed_rejections(F.col("n"), 0.02, F.col("level")).alias("k"))
    for n, level, k in df.collect():
        tail, most = 0.0, -1
        for i in range(n + 1):
            tail += comb(n, i) * 0.02**i * 0.98 ** (n - i)
            if tail > level:
                break
            most = i
        assert k == min(most, int(np.ceil(n * 0.02))), (n, level)


def test_cutoffs_keep_good_and_drop_bad(spark, docs):
    rng = random.Random(2)
    plain = [" ".join("w%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(2600)]
    marked = [" ".join("w%d***" % rng.randrange(10**6) for _ in range(60)) for _ in range(400)]
    df = docs(*plain, *marked)
    labels = spark.createDataFrame([(k, int(k < len(plain))) for k in range(3000) if k % 10], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.report(df, labels).filter("kept").collect()}
    assert kept == set(range(len(plain)))
    few = labels.filter("doc_id < 60")
    assert quality.report(df, few).filter("kept").count() == 3000, "too few labels to bound the risk"
    out = quality.keep(df, labels)
    assert out.columns == df.columns and out.count() == len(plain)


def test_quality_is_native(spark, docs):
    text = quality.measure(docs("a"))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_line_dedup(spark, docs):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.randrange(15, 40))) for _ in range(60)]

    def edited(s):
        k = rng.randrange(len(s))
        return rng.choice([s[:k] + s[k + 1 :], s[:k] + "z" + s[k:], s[:k] + "z" + s[k + 1 :], s.upper(), s[:k] + "yz" + s[k:], s])

    texts = ["\n".join(edited(rng.choice(base)) for _ in range(6)) for _ in range(70)] + [None, "", "a" * 40, "a" * 41, "b" * 20 + "a" * 20, "b" * 21 + "a" * 19]
    got = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in linededup.report(docs(*texts)).collect()}
    expected = brute.removed_lines(list(enumerate(texts)), linededup.MIN_CHARS)
    assert sum(map(len, expected.values())) > 100
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        assert got[k] == (expected[k], "\n".join(x for i, x in enumerate(lines) if i not in expected[k])), k


def test_line_dedup_keeps_rows_and_columns(spark, docs):
    df = docs("a line that is long enough", "a line that is long enough\nanother line, also long enough", "", None, "a line that is long enougH")
    out = linededup.without_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "a line that is long enough", 1: "another line, also long enough", 2: "", 3: None}
    twice = df.filter("doc_id = 0").union(df.filter("doc_id = 0"))
    assert linededup.without_repeats(twice).count() == 2
    assert linededup.report(df.limit(0)).count() == 0


def test_fingerprints_and_classes(spark, docs):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(500)) for _ in range(rng.randrange(20, 200))]
        for _ in range(5):
            texts.append(" ".join(w if rng.random() > 0.01 else "other" for w in base))
    got = {r["doc_id"]: r for r in simhash.report(docs(*texts)).collect()}
    fps = [brute.fingerprint(t) for t in texts]
    root = brute.components(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    for k in range(len(texts)):
        assert got[k]["fingerprint"] == f"{fps[k]:016x}"
        assert got[k]["component_id"] == root[k]
    assert len(set(root.values())) < len(texts)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centre for _ in range(40)}
    values |= set(map(int, rng.integers(0, 2**63, 200)))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    n, joint = simhash.bit_counts(fps)
    assert n == len(values)
    root = brute.components(sorted(values), lambda a, b: (a ^ b).bit_count() <= 4)
    plans = [simhash.allocate(n, joint, np.array(sorted(values), np.uint64)), [(list(range(0, 32)), 1), (list(range(32, 64)), 2)][:2]]
    for plan in plans:
        assert sum(t + 1 for _, t in plan) == 5
        got = {r["node"]: r["root"] for r in components(simhash.links(fps, plan, block=block)).collect()}
        assert {v: got.get(v, v) for v in values} == root


def test_representatives(spark, docs):
    text = " ".join(f"word{i}" for i in range(80))
    df = docs(text, text, text + " end", "", None, "quite another text with other words")
    df = df.union(df.filter("doc_id = 0"))
    out = simhash.representatives(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 5] and out.columns == df.columns
    assert simhash.report(df.limit(0)).count() == 0


def test_representatives_of_null_and_shared_ids(spark):
    texts = [" ".join(f"{t}{i}" for i in range(80)) for t in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (0, texts[3]), (None, texts[4]), (9, texts[4]), (2**60 + 1, texts[5])]
    out = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == {(None, texts[0]), (None, texts[1]), (1, texts[2]), (0, texts[3]), (9, texts[4]), (2**60 + 1, texts[5])} and out.count() == 6


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_long_documents_take_linear_time(spark):
    """80,000 different lines in one document, of which a thousand come again."""
    import hashlib
    import time

    lines = [hashlib.md5(b"%d" % k).hexdigest() for k in range(80_000)]
    text = "\n".join(lines + lines[:1000])
    docs = spark.createDataFrame([(1, text, "en", "s", "x")], DOCS)
    began = time.time()
    got = linededup.report(docs).first()
    assert got["n_lines"] == 81_000 and got["removed_lines"] == list(range(80_000, 81_000)) and time.time() - began < 60
