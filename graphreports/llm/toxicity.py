"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The labelled rows are cut by a hash into three parts. On the first a lexicon is learned (words and word beginnings that mark
toxic documents), on the second the trees, on the third the calibration, so that none is judged on what it has seen. Features
of all documents are then computed once, and scored in the JVM.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from graphreports.llm.common import stored

ROWS = 60_000  # labelled rows that are learned from, at most; chosen by hash
TERMS, STRONG, LEAST = 300, 40, 4  # learned terms; those of the upper tier; toxic texts a term must be in
TREES, DEPTH, STEP = 20, 4, 0.2
CUT = 0.3
SEED = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "garbage", "scum", "pathetic", "worthless", "disgusting", "clown", "jerk", "fool", "ugly", "hate")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti usted ustedes vos".split())
NEAR = 3  # words between an address and a lexicon word
FEATURES = ("seed", "seed_rate", "strong", "strong_rate", "learned", "learned_rate", "weight", "top_weight", "different", "addressed", "addressed_rate", "person_rate", "capitals", "exclamations", "questions", "punctuation", "obfuscated", "length")
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
_WORD = re.compile(r"[^\W_](?:[\w@$*!']*[^\W_])?")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(word: str) -> list[str]:
    """What a word is looked up by: itself, and its first 4 to 6 characters with an asterisk."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def tokens(text: str | None) -> list[str]:
    """Lower-case words; digits and signs inside a word are read as the letters they stand for."""
    found = _WORD.findall((text or "").lower())
    return [w if w.isalpha() else w.translate(_LEET).replace("*", "") for w in found]


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pd.DataFrame:
        both = list(counts[0] | counts[1])
        frame = pd.DataFrame({"term": pd.Series(both, dtype=object), "clean": [counts[0][t] for t in both], "bad": [counts[1][t] for t in both]})
        counts[0].clear(), counts[1].clear()
        return frame

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            counts[int(toxic > 0)].update({t for w in set(tokens(text)) for t in terms_of(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
    yield out()


def learn_terms(docs: DataFrame, n_terms: int = TERMS) -> dict[str, float]:
    """Terms of different texts with ``toxic``, and their log odds: the ones that tell most, at most ``n_terms``."""
    texts = docs.select("text", "toxic").dropDuplicates(["text"])
    size = texts.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, clean = size["bad"] or 0, size["n"] - (size["bad"] or 0)
    sums = texts.mapInPandas(_term_counts, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    told = sums.filter(F.col("bad") >= LEAST).withColumn("weight", odds).filter("weight > 1.5")
    best = told.orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "term").limit(n_terms).select("term", "weight").collect()
    return {r["term"]: r["weight"] for r in best}


def features(text: str | None, lexicon: dict[str, float], strong: set[str], cache: dict[str, float]) -> list[float]:
    text = text or ""
    found = tokens(text)
    n = max(1, len(found))
    seed = hits = hard = addressed = persons = 0
    weight, top, last_person, waiting = 0.0, 0.0, -99, []
    different = set()
    for k, w in enumerate(found):
        told = cache.get(w)
        if told is None:
            of = [lexicon[t] for t in terms_of(w) if t in lexicon]
            told = max(of) if of else 0.0
            if any(t in strong for t in terms_of(w)):
                told += 100.0
            if w in SEED:
                told += 1000.0
            if w in SECOND_PERSON:
                told += 10000.0
            if len(cache) > 400_000:
                cache.clear()
            cache[w] = told
        if not told:
            continue
        if told >= 10000.0:
            persons += 1
            last_person = k
            addressed += sum(k - j <= NEAR for j in waiting)
            waiting = []
            told -= 10000.0
        if told:
            if told >= 1000.0:
                seed += 1
                told -= 1000.0
            if told >= 100.0:
                hard += 1
                told -= 100.0
            hits += told > 0
            weight += told
            top = max(top, told)
            different.add(w)
            if k - last_person <= NEAR:
                addressed += 1
            else:
                waiting = [j for j in waiting if k - j <= NEAR] + [k]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    size = max(1, len(raw))
    signs = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    return [
        seed, seed / n, hard, hard / n, hits, hits / n, weight, top, len(different), addressed, addressed / n, persons / n,
        count[65:91].sum() / size, count[33] / n, count[63] / n, signs / size, len(_MIXED.findall(text)) / n, math.log1p(len(found)),
    ]


def featured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and the dense features of each whole text. The lexicon has a bounded number of terms."""
    strong = set(sorted(lexicon, key=lambda t: -lexicon[t])[:STRONG])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "features": [list(map(float, features(t, lexicon, strong, cache))) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(of, f"doc_id {kind}, features array<double>")


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Score of every document.

    Returns doc_id, held_out, score, predicted. Labels are doc_id and toxic (0 or 1; null ones are left out, of several of a
    document the largest counts) and are learned from only where held_out is false. Null and empty texts have zero features
    and are scored like any other; rows that repeat score alike; without labels of both kinds the score is the share of seed
    words among ten, at most 1; an empty table gives no rows; other columns are not read.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(6))
    # About ``rows`` by their hash first, so that no task sorts more than it keeps.
    place = F.xxhash64("doc_id", F.lit(12))
    share = min(1.0, 1.1 * rows / max(1, one.count()))
    near = one.filter(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = near.orderBy(place, "doc_id").limit(rows).withColumn("part", part)
    chosen = F.broadcast(stored(chosen, "toxicity-labels"))  # at most ``rows`` rows of three numbers
    lexicon = learn_terms(docs.join(chosen.filter("part < 3"), "doc_id"))
    table = stored(featured(docs, lexicon), "toxicity-features")
    learned = table.join(chosen.filter("part >= 3"), "doc_id").withColumn("vector", array_to_vector("features"))
    kinds = {(r["fit"], r["toxic"] > 0) for r in learned.select((F.col("part") < 5).alias("fit"), "toxic").distinct().collect()}
    if len(kinds) < 4:
        raw = table.withColumn("score", F.least(F.lit(1.0), F.get("features", F.lit(0)) / 10))
    else:
        fit = learned.filter("part < 5").select("vector", F.col("toxic").alias("label"))
        trees = GBTClassifier(featuresCol="vector", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=1).fit(fit)
        told = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        steps = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(told(learned.filter("part = 5")).select("raw", "toxic"))
        raw = steps.transform(told(table.withColumn("vector", array_to_vector("features"))).drop("prediction", "rawPrediction", "probability"))
        # Calibration makes steps; a hundredth of the raw score keeps the order of documents on one step.
        raw = raw.withColumn("score", 0.99 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")) + 0.01 * F.col("raw"))
    return raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
