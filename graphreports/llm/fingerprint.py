"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its 5-word shingles. For each of 64 samples every shingle of weight w draws r, c (gamma, shape 2)
and b (uniform) from its hash: t = floor(ln w / r + b), ln a = ln c - r (t - b) - r. The shingle with the least a is drawn,
with its t. Two texts draw the same pair with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

SAMPLES, WIDTH = 64, 5
ROWS = 2000  # documents between two cuts, about
MOST_CUTS = 4000
_DRAWS = 1 << 16
_rng = np.random.default_rng(20240501)
# Draws are looked up by 16 bits of a hash of shingle and sample.
_R, _C, _B = _rng.gamma(2.0, 1.0, _DRAWS), _rng.gamma(2.0, 1.0, _DRAWS), _rng.random(_DRAWS)
_ONCE = (np.log(_C) + _R * _B - _R).astype(np.float32)  # ln a for weight 1, where t is 0
_ODD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of all word shingles; of the whole sequence if it has fewer words."""
    found = text.encode("utf-8", "surrogatepass").split()
    if len(_words) > 300_000:
        _words.clear()
    for w in set(found).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(found))
    total = np.zeros(len(found) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[j : len(hashes) - k + 1 + j]
    return _mixed(total)


def sample(hashes: np.ndarray) -> np.ndarray:
    """The signature: for each sample 16 bits of the shingle drawn and its t. No shingles give zeros."""
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    terms, weight = np.unique(hashes, return_counts=True)
    best, which, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    for repeated in (False, True):
        chosen = (weight > 1) == repeated
        some, log_w = terms[chosen], np.log(weight[chosen])[:, None]
        for at in range(0, len(some), 2048):
            part = some[at : at + 2048]
            draw = ((part[:, None] * _ODD) >> np.uint64(48)).astype(np.intp)
            if repeated:
                r, b = _R[draw], _B[draw]
                t = np.floor(log_w[at : at + 2048] / r + b)
                a = (np.log(_C[draw]) - r * (t - b) - r).astype(np.float32)
            else:
                t, a = None, _ONCE[draw]
            row = a.argmin(axis=0)
            least = a[row, np.arange(SAMPLES)]
            won = (least < best) | ((least == best) & (part[row] < which))
            best[won], which[won] = least[won], part[row[won]]
            level[won] = t[row[won], np.flatnonzero(won)] if t is not None else 0
    return (_mixed(which + _STEP * level.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _coded(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def in_order(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Rows (at, ahead, doc_id, text) such that, sorted, each bucket ``at`` ends with the row that follows it (``ahead``).

    Buckets are ranges of doc_id between quantiles, of which there are at most ``MOST_CUTS``; the last one is followed by the
    first. So neighbours meet without one task seeing all documents, and texts are shuffled once.
    """
    n = docs.count()
    cuts = min(MOST_CUTS, n // rows)
    place = docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("__id"))
    points = sorted(set(place.approxQuantile("__id", [k / (cuts + 1) for k in range(1, cuts + 1)], 0.1 / (cuts + 1)))) if cuts else []
    split = Bucketizer(splits=[-float("inf"), *(points or [0.0]), float("inf")], inputCol="__id", outputCol="__at", handleInvalid="keep")
    # Null ids come last, in the bucket the bucketizer keeps for what it can't place.
    placed = split.transform(place.fillna(float("nan"), "__id") if n else place).withColumn("__at", F.col("__at").cast("int"))
    ends = {r["__at"]: r["first"] for r in placed.groupBy("__at").agg(F.min("doc_id").alias("first")).collect()}
    filled = sorted(ends)
    before = {b: filled[k - 1] for k, b in enumerate(filled)}
    every = range(len(points) + 3)
    kind = docs.schema["doc_id"].dataType
    first = F.get(F.array(*[F.lit(ends.get(b)).cast(kind) for b in every]), F.col("__at"))
    previous = F.get(F.array(*[F.lit(before.get(b, b)) for b in every]), F.col("__at"))
    own, sent = F.struct(F.col("__at").alias("at"), F.lit(False).alias("ahead")), F.struct(previous.alias("at"), F.lit(True).alias("ahead"))
    both = F.when(F.col("doc_id").eqNullSafe(first), F.array(own, sent)).otherwise(F.array(own))
    return placed.select(F.explode(both).alias("p"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).select("p.*", "doc_id", "text")


def report(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Fingerprint of every text and of its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is the
    one with the next larger doc_id, of repeated ids by text, null ids last, after the last the first. A null text is empty;
    texts without words have the zero fingerprint and are alike; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.strip().split()[0] for c in schema.split(",")]

    def row(own: tuple, following: tuple) -> tuple:
        (doc_id, text, signature), (_, other, next_signature) = own, following
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        changed = sample(shingles(edited))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, n, digest, _coded(signature), _coded(changed), likeness(signature, changed), likeness(signature, next_signature)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple | None = None
        for b in batches:
            out = []
            ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None)
            for doc_id, text, ahead in zip(ids, b["text"], b["ahead"], strict=True):
                if ahead and waiting is None:
                    continue  # of several rows with the first id only the first follows
                here = (doc_id, text, sample(shingles(text)))
                if waiting is not None:
                    out.append(row(waiting, here))
                waiting = None if ahead else here
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype(b["doc_id"].dtype if b["doc_id"].dtype == object else "Int64")
            yield frame

    placed = in_order(docs, rows)
    order = [F.col("at"), F.col("ahead"), F.col("doc_id").asc_nulls_last(), F.col("text")]
    return placed.repartition("at").sortWithinPartitions(*order).mapInPandas(walk, schema)
