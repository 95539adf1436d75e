"""Toxicity, fingerprints, extraction, language model, archives."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphreports.llm import extraction, fingerprint, neural_lm, toxicity, warc
from tests.llm import brute

DOCS = "doc_id long, text string, features string, score string"


@pytest.fixture
def docs(spark):
    return lambda *texts: spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], DOCS)


def prose(rng, n, words=600):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


# --- toxicity


def test_toxicity_learns_on_held_out_rows(spark):
    rng, rows, labels = random.Random(1), [], []
    for k in range(1500):
        toxic = int(rng.random() < 0.25)
        text = prose(rng, rng.randrange(20, 120))
        if toxic:
            at = rng.randrange(5, len(text.split()))
            insults = ["grobblen", "grobbler", "zarkoid", "IDIOT"]
            text = " ".join([*text.split()[:at], *(rng.choice(insults) for _ in range(3)), *text.split()[at:]])
        rows.append((k, text, "x", "y"))
        labels.append((k, toxic))
    rows += [(2000, None, "x", "y"), (2001, "", "x", "y"), (2002, "w1 w2", "x", "y"), (2002, "w1 w2", "x", "y"), (None, "you idiot", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    got = toxicity.score(df, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by, toxic = {r["doc_id"]: r for r in got}, dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [k for k in toxic if by[k]["held_out"]]
    assert np.mean([by[k]["predicted"] == toxic[k] for k in held]) > 0.95
    assert by[2000]["score"] == by[2001]["score"] < 0.3


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs("you idiot", "fine", None), none).collect()
    assert [r["predicted"] for r in sorted(got, key=lambda r: r["doc_id"])] == [0, 0, 0]
    assert toxicity.score(docs("a").limit(0), none).count() == 0


def test_disguised_words_are_read():
    assert toxicity.tokens("St*pid 1d10t! l0ser") == ["stpid", "idiot", "loser"]


# --- fingerprints


def test_fingerprints_follow_the_next_document(spark, docs):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(60)] + ["", None, "one", "é" * 7, "a b c d e f g", "a b c d e f g"]
    got = {r["doc_id"]: r for r in fingerprint.report(docs(*texts), rows=7).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sign = [fingerprint.sample(fingerprint.shingles(x)) for x in (t, edited, following)]
        assert r["fingerprint"] == fingerprint._coded(sign[0]) and r["edited_fingerprint"] == fingerprint._coded(sign[1])
        assert r["near_edited"] == (sign[0] == sign[1]).mean() and r["near_next"] == (sign[0] == sign[2]).mean()
    assert got[64]["near_next"] == 1.0 and got[64]["fingerprint"] == got[65]["fingerprint"]


def test_fingerprints_of_odd_tables(spark, docs):
    df = docs("b", "c", "d").union(docs("a")).union(spark.createDataFrame([(None, "z", "x", "y"), (None, "y", "x", "y")], DOCS))
    assert fingerprint.report(df, rows=1).count() == 6
    one = fingerprint.report(docs("a b")).first()
    assert one["near_next"] == 1.0
    assert fingerprint.report(docs("a").limit(0)).count() == 0


def test_collisions_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    found, true = [], []
    for _ in range(60):
        a, b = Counter(), Counter()
        for t in range(40):
            w = int(rng.integers(0, 5))
            a[t] += w
            b[t] += w if rng.random() < 0.6 else int(rng.integers(0, 5))
        salt = rng.integers(0, 2**62, dtype=np.uint64)
        expand = lambda c: fingerprint._mixed(np.array([t for t, n in c.items() for _ in range(n)], np.uint64) + salt)  # noqa: B023, E731
        found.append(fingerprint.likeness(fingerprint.sample(expand(a)), fingerprint.sample(expand(b))))
        true.append(sum(min(a[t], b[t]) for t in range(40)) / sum(max(a[t], b[t]) for t in range(40)))
    assert abs(np.mean(found) - np.mean(true)) < 0.03
    assert np.abs(np.array(found) - np.array(true)).max() < 0.25


# --- extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all, please, it is fine.</div>
<!-- <p>no</p> --><article><h1>Title &amp; more</h1><p><b>First   para&eacute;
with <i>mark</i>up.<br><p>Second one.</p><div class="ad">Buy this now. It is a very good thing to buy, really.</div><p>Ti.</p></article>
<aside><p>Related stories, all of them long enough to look like text. Really.</p></aside><form><label>Name</label><input></form>
<section id="comments"><p>Great article, thank you so much for writing it. I liked it.</p></section><footer>&copy; 2024 A. B.</footer></body></html>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "Title & more\n\nFirst paraé with markup.\n\nSecond one.\n\nTi."
    soup = "<div class='menu'><a href=x>One</a> <a href=y>Two</a></div><div><p>" + "A long sentence of the text, with a comma. " * 4 + "</p><p>Short.</p></div><div class=footer>Legal</div>"
    assert extraction.main_text(soup).endswith("comma.\n\nShort.") and "Legal" not in extraction.main_text(soup) and "One" not in extraction.main_text(soup)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<p title=\"open>text", "plain < text & co", "</p></div>", "<b>" * 50, "\x00<p>\x00"])
def test_broken_markup_is_read(page):
    assert isinstance(extraction.main_text(page), str)


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {k}, which has some words.</p>" for k in range(5000)) + "</article>"
    assert extraction.main_text(page).count("\n\n") == 4999
    flat = "".join(f"<div><p>w{k}</p></div>" for k in range(3000))
    assert isinstance(extraction.main_text(flat), str)


@pytest.mark.parametrize(
    ("page", "seen"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><article><p>{0}</p></article>", "{0}"),
        ("<head><title>T</title><article><p>{0}</p></article>", "{0}"),
        ("<article><p hidden>secret<p>{0}</article>", "{0}"),
        ("<article><p hidden>secret<div>{0}</div></article>", "{0}"),
        ("<article><ul><li hidden>secret<ul><li>deep</ul><li>{0}</ul></article>", "{0}"),
        ("<article><ul><li hidden>secret</ul><p>{0}</p></article>", "{0}"),
        ("<article><table><tr><td hidden>secret<td>{0}</table></article>", "{0}"),
        ("<article><ul><li><span hidden>secret<li>{0}</ul></article>", "{0}"),
        ("<article><p><span hidden>secret</p><p>{0}</p></article>", "{0}"),
        ("<article><div hidden><p>secret<div>secret</div>secret</div><p>{0}</p></article>", "{0}"),
        ("<article><svg width='1'/><p>{0}</p><svg><path/><text>no</text></svg></article>", "{0}"),
        ("<article><svg><g><svg/></g><text>no</text></svg><p>{0}</p></article>", "{0}"),
        ("<article><svg><text>no<p>{0}</p></article>", "{0}"),
        ("<article><p class='x hidden y' title='display: none'>{0}</p></article>", "{0}"),
        ("<article><p aria-hidden=true>secret</p><p style='color:red; display : none'>secret</p><p>{0}</p></article>", "{0}"),
        ("<article><p>" + "\u0130" * 40 + "</p><script>x</script><p>{0}</p></article>", "\u0130" * 40 + "{0}"),
    ],
)
def test_only_what_is_hidden_is_dropped(page, seen):
    told = "The sentence that is seen here, which is long enough. It goes on, and ends."
    assert "".join(b.text for b in extraction.blocks(page.format(told))) == seen.format(told)


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 9)
        told = [rng.uniform(-3, 3) for _ in range(n)]
        tied = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda label: sum(-t if x else t for t, x in zip(told, label)) / 2 + sum(w for (a, b), w in tied.items() if label[a] != label[b])  # noqa: B023, E731
        best = min(map(cost, product([False, True], repeat=n)))
        assert cost(extraction.minimum_cut(told, tied)) == pytest.approx(best)


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9)], "page_id long, url string, html string, n_chars int")
    got = extraction.report(df).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 0, len(extraction.main_text(PAGE)), len(extraction.main_text(PAGE))]
    assert extraction.report(df.limit(0)).count() == 0


# --- language model


def test_language_model(spark, docs):
    rng = random.Random(5)
    tongue = lambda k: [f"{'abcdefgh'[k]}{'xyzuvwrs'[j % 8]}{j}" for j in range(400)]
    texts = [" ".join(rng.choice(tongue(k % 4)[: 1 + int(rng.paretovariate(0.8)) % 400]) for _ in range(rng.randrange(30, 150))) for k in range(600)]
    texts += [None, "", "NEVER-SEEN words\x0bhere", "AX0 ax0"]
    df = docs(*texts)
    df = df.union(df.filter("doc_id = 5"))
    got = neural_lm.score(df).collect()
    assert len(got) == len(texts) + 1
    low = [brute.words("".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    counts = Counter(w for k, t in enumerate(low) if not held[k] for w in [*t, ""])
    counts.update([*low[5], ""])  # the repeated row
    n, v = sum(counts.values()), len(counts)
    for r in got:
        found = [*low[r["doc_id"]], ""]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(found), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in found)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found))
        assert r["score"] < 0
    tested = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in tested) > 0.95 * sum(r["base_score"] for r in tested), "context helps"


def test_every_position_is_trained_on(spark, docs):
    texts = ["a b c d e f g h i j", "a b", "", None, " ".join(f"w{k % 50}" for k in range(5000)), "a"]
    counts = Counter(w for t in texts for w in [*(t or "").split(), ""])
    head = sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))
    model = neural_lm.train(docs(*texts), neural_lm.Vocabulary(head), np.ones(neural_lm.SIZE))
    assert model.seen == sum(counts.values())
    for n in (1, 2, 3, neural_lm.PIECE, neural_lm.PIECE + 1, 3 * neural_lm.PIECE - 1):
        symbols = np.arange(1, n + 1, dtype=np.int32) * 17
        found = [neural_lm.unpack(neural_lm.pack(p)) for p in neural_lm.pieces(symbols)]
        stream, wanted = neural_lm.joined(found)
        assert stream[wanted].tolist() == symbols.tolist(), "each position once"
        padded = [0] * neural_lm.CONTEXT + symbols.tolist()
        assert all(p[: neural_lm.CONTEXT].tolist() == padded[k * neural_lm.PIECE :][: neural_lm.CONTEXT] for k, p in enumerate(found))


def test_copies_are_averaged(spark, docs, monkeypatch):
    monkeypatch.setattr(neural_lm, "SHARE", 500)
    monkeypatch.setattr(neural_lm, "FAN", 2)
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(1, 60), 40) for _ in range(200)]
    counts = Counter(w for t in texts for w in [*t.split(), ""])
    head = sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))
    words = neural_lm.Vocabulary(head)
    df = docs(*texts)
    model = neural_lm.train(df.repartition(5), words, np.ones(neural_lm.SIZE))
    assert model.seen == sum(counts.values())
    again = neural_lm.train(df.coalesce(1), words, np.ones(neural_lm.SIZE))
    assert np.allclose(model.flat(), again.flat(), atol=1e-5)
    assert not np.allclose(model.flat(), neural_lm.Model(np.ones(neural_lm.SIZE), words.grouped()).flat(), atol=1e-2)


def test_scores_do_not_depend_on_partitions(spark, docs):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(1, 80), 300) for _ in range(300)] + [None, ""]
    df = docs(*texts)
    of = lambda part: [(r["doc_id"], r["score"]) for r in neural_lm.score(part).orderBy("doc_id").collect()]
    one, eight, many = of(df.coalesce(1)), of(df.repartition(8)), of(df.repartition(64, "text"))
    assert [k for k, _ in one] == [k for k, _ in eight] == [k for k, _ in many] == list(range(302))
    for other in (eight, many):
        assert [x for _, x in other] == pytest.approx([x for _, x in one], abs=1e-3)


def test_scores_are_a_plain_forward_pass():
    rng = np.random.default_rng(14)
    model = neural_lm.Model(np.ones(neural_lm.SIZE), np.sort(rng.integers(1, 50, 30))[::-1].astype(float))
    model.load(rng.normal(0, 0.7, len(model.flat())))
    text = rng.integers(0, neural_lm.SIZE + 30, 50)
    stream, wanted = neural_lm.joined(list(neural_lm.pieces(text)))
    got = model.of_contexts(model.contexts(stream), stream[neural_lm.CONTEXT :])
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    for k, symbol in enumerate(text):
        before = [0, 0, 0, 0, *text[:k]][-1 : -neural_lm.CONTEXT - 1 : -1]
        h = np.sum([model.r[x].astype(float) * model.c[j] for j, x in enumerate(before)], axis=0)
        h[-1] = 1
        word, sub = symbol - neural_lm.SIZE, model.sub
        p = softmax(model.q @ h)[symbol if word < 0 else neural_lm.SIZE + word // sub**2]
        if word >= 0:
            for vectors, x in ((model.u, word // sub), (model.w, word)):
                p *= softmax(vectors[x // sub * sub : x // sub * sub + sub] @ h)[x % sub]
        assert got[k] == pytest.approx(math.log(p), abs=1e-4)


def test_probabilities_are_normalised():
    model = neural_lm.Model(np.ones(neural_lm.SIZE))
    model.load(np.random.default_rng(6).normal(0, 0.5, len(model.flat())))
    before = np.random.default_rng(7).integers(0, neural_lm.SIZE, (3, neural_lm.CONTEXT))
    for row in before:
        every = model.log_probabilities(np.repeat(row[None], neural_lm.SIZE, 0), np.arange(neural_lm.SIZE))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_rare_words_have_their_own_context(spark, docs):
    rng = random.Random(8)
    pairs = [(f"aa{k}", f"bb{k}") for k in range(300)]  # all beyond the first level, with one beginning
    texts = [" ".join(x for _ in range(40) for x in rng.choice(pairs)) for _ in range(400)]
    counts = Counter(w for t in texts for w in [*t.split(), ""])
    head = [(f"cc{k}", 10**6) for k in range(neural_lm.FREQUENT)] + sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))
    words = neural_lm.Vocabulary(head)
    for partitions in (1, 4):
        model = neural_lm.train(docs(*texts).repartition(partitions), words, np.ones(neural_lm.SIZE))
        assert len(model.w) == 600 and len(model.r) == neural_lm.SIZE + 600
        symbol = lambda w: int(words.symbol[words.number[w.encode()]])
        seconds = [b for _, b in pairs]
        own, other = [], []
        for a, b in pairs[:40]:
            before = np.array([[symbol(a), 0, 0, 0]])
            told = lambda w, before=before: float(model.log_probabilities(before, np.array([symbol(w)]))[0])
            own.append(told(b)), other.append(np.mean([told(x) for x in seconds[40:60]]))
        assert np.mean(own) - np.mean(other) > math.log(10), "a word's partner is likelier than others"
    sample = np.random.default_rng(9).integers(0, len(model.r), (2, neural_lm.CONTEXT))
    for row in sample:
        every = model.log_probabilities(np.repeat(row[None], len(model.r), 0), np.arange(len(model.r)))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_without_training_rows(spark, docs):
    k = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = spark.createDataFrame([(k, "some words", "x", "y")], DOCS)
    r = neural_lm.score(only).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and math.isfinite(r["score"])
    assert neural_lm.score(only.limit(0)).count() == 0


def test_batches_are_split_like_texts():
    texts = ["", None, " A b\x0b\x0cC\r\n", "\x1cx\x85 \u00a0y\u2003z", "ÉÀ É", " ", "one", "\t"]
    of, found = neural_lm._split(pa.array(texts))
    got = [[] for _ in texts]
    for k, w in zip(of.tolist(), found.to_pylist(), strict=True):
        got[k].append(w.encode())
    assert got == [neural_lm.tokens(t) for t in texts]


def test_word_class_is_the_same_in_the_jvm(spark):
    words = ["a", "é", "ab", "日本", "x'"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(neural_lm._of_class(F.col("w")).alias("c"))
    assert [r["c"] for r in df.collect()] == [neural_lm.word_class(w.encode()) for w in words]


# --- archives


def test_archives_come_back(spark, tmp_path):
    inner = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Page: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\n</p>"
    long, rows = "é" * 100, []
    for k in range(40):
        rows.append((100 - k, f"http://h/{k}\r\nWARC-Type: x", [None, "", "short", long, inner, f"<p>{k}</p>" * 50][k % 6], "digest"))
    rows.append((500, None, long, None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    got = warc.roundtrip(df, str(tmp_path / "w")).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    first = {}
    for page in sorted(html):
        first.setdefault(html[page], page)
    for r in got:
        body = html[r["page_id"]]
        again = len(body) >= 100 and first[body] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[body]) if again else ("response", None))
    assert warc.candidates(spark, str(tmp_path / "w")).count() > len(rows), "the magic inside payloads was found, and left out"


def test_archives_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 300), (1, "u", "y" * 300), (None, None, None)], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["record_type"]) for r in warc.roundtrip(df, str(tmp_path / "a")).collect()) == [("1", "response"), ("1", "response"), ("None", "response")]
    assert warc.roundtrip(df.limit(0), str(tmp_path / "b")).count() == 0


def test_reachable_is_a_chain(spark):
    links = [("f", 10 * k, 10 * (k + 1) if k < 36 else None) for k in range(37)] + [("f", 5, 20), ("g", 0, None), ("g", 7, None)]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(links, "file string, start long, next long")).collect()}
    assert got == {("f", 10 * k) for k in range(37)} | {("g", 0)}


def test_words_are_counted_and_chosen_in_columns(spark, docs):
    texts = ["B a é", None, "", "a\x0bb NUL\u0001x", *[f"w{k} a" for k in range(300)]]
    counts = neural_lm.count_words(docs(*texts).repartition(3))
    expected = Counter(w.decode() for t in texts for w in [*neural_lm.tokens(t), neural_lm.END])
    assert {r["word"]: r["n"] for r in counts.collect()} == expected
    head = neural_lm.head_words(counts.filter("word <> ''"), 5)
    assert isinstance(head, pa.Table) and head.to_pylist() == [{"word": "a", "n": 302}, {"word": "b", "n": 2}]
    words = neural_lm.Vocabulary(head)
    assert (words.words.to_pylist(), words.count.tolist(), words.symbol.tolist()) == (["a", "b"], [0, 302, 2], [0, 1, 2])
    assert neural_lm.head_words(counts.limit(0)).num_rows == 0


def test_classes_of_many_words():
    words = ["a", "ab", "abc", "\u00e9", "\u00e9a", "\u4e2d\u6587", "\U0001f600", "\x00", "\x00b", "z" * 300]
    column = pa.array(["cut", *words, "off"], pa.large_string()).slice(1, len(words))
    assert neural_lm._classes(column).tolist() == [neural_lm.word_class(w.encode()) for w in words]
    assert neural_lm._classes(column.slice(0, 0)).tolist() == []


def test_rare_words_are_looked_up_without_sorting_them(spark, docs, monkeypatch):
    """Text is hashed, in parts whose number follows from the words; the result is that of one part."""
    rng = random.Random(4)
    df = docs(*[" ".join([prose(rng, 20), *(f"rare{rng.randrange(400)}" for _ in range(30))]) for _ in range(40)], None, "")
    monkeypatch.setattr(neural_lm, "HEAD", 50)
    monkeypatch.setattr(neural_lm.head_words, "__defaults__", (50,))
    rows = lambda: {r["doc_id"]: r for r in neural_lm.score(df).collect()}
    one = rows()
    monkeypatch.setattr(neural_lm, "KEYS", 100)
    several = rows()
    assert all((r["n_known"], r["n_tokens"]) == (several[k]["n_known"], several[k]["n_tokens"]) for k, r in one.items())
    assert all(several[k][x] == pytest.approx(r[x], rel=1e-9) for k, r in one.items() for x in ("base_score", "score"))
    plan = neural_lm.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(word" in plan and "REPARTITION_BY_NUM" in plan
