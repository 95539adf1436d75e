"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q, at least max(12, 2 q) words long, which no neighbouring word extends.
Texts are cut into blocks at dyadic scales. A run of period q holds, for the scale B whose distances contain q, a whole
block that comes again q words later. The sum of squared differences between a block and every place of the window behind it
is an exact integer, computed with number-theoretic transforms modulo primes whose product exceeds it; where it is zero the block
occurs, and its distance seeds an extension in both directions, word by word.

Words are numbered per text, so equal numbers mean equal words. A block is transformed only if every four words in it come
again within its reach, and not if its whole window lies in a run already found whose period is no longer than the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LEAST = 12  # words of the shortest run
GROUP = 200_000  # words that are numbered and searched together; a longer text is a group of its own
CELLS = 1 << 20  # numbers in one batch of transforms
# Primes k * 2^m + 1 with a primitive root each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))

Run = tuple[int, int, int]  # start, length, period
Change = Callable[[object, list[bytes]], list[bytes]]


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, least and greatest distance. A run of period q has max(q, 12 - q) places or more at which a word comes again q
    words later; 2 B - 1 places in a row hold a whole block of B."""
    yield 4, 1, 14
    yield 2, 6, 6
    block = 8
    while 2 * (2 * block - 1) <= longest:
        yield block, 2 * block - 1, 4 * block - 2
        block *= 2


# --- number-theoretic transform


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    return x - (x // np.uint64(p)) * np.uint64(p)


def _transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transforms of the rows of ``x``, whose length is a power of two; ``root`` has that order modulo ``p``."""
    rows, n = x.shape
    x = x.reshape(rows, n, 1)
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        powers = np.ones(half, np.uint64)
        at, w = 1, root
        while at < half:  # powers by doubling
            powers[at : 2 * at] = _reduced(powers[: min(at, half - at)] * np.uint64(w), p)
            at, w = 2 * at, w * w % p
        low, high = x[:, :half], x[:, half:]
        total = low + high
        total -= np.uint64(p) * (total >= np.uint64(p))
        other = _reduced((low + (np.uint64(p) - high)) * powers[:, None], p)
        x = np.stack([total, other], axis=2).reshape(rows, half, -1)
        root = root * root % p
    return x.reshape(rows, n)


def _correlated(blocks: np.ndarray, windows: np.ndarray, p: int, g: int) -> np.ndarray:
    """Modulo ``p``, the product sum of each block with its window at every shift at which it fits."""
    b, w = blocks.shape[1], windows.shape[1]
    n = 1 << (b + w - 2).bit_length()
    root = pow(g, (p - 1) // n, p)
    left, right = np.zeros((len(blocks), n), np.uint64), np.zeros((len(blocks), n), np.uint64)
    left[:, :b], right[:, :w] = _reduced(blocks[:, ::-1].astype(np.uint64), p), _reduced(windows.astype(np.uint64), p)
    product = _reduced(_transform(left, p, root) * _transform(right, p, root), p)
    back = _transform(product, p, pow(root, p - 2, p))[:, b - 1 : w]
    return _reduced(back * np.uint64(pow(n, p - 2, p)), p)


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where the sum of squared differences between a block and its window is zero: (row, shift) pairs."""
    b = blocks.shape[1]
    top = int(max(blocks.max(initial=0), windows.max(initial=0)))
    zero, product = np.ones((len(blocks), windows.shape[1] - b + 1), bool), 1
    for p, g in PRIMES:
        if product > b * top * top:  # the sum is below the product of the primes taken, so it is zero where all remainders are
            break
        before = np.zeros((len(windows), windows.shape[1] + 1), np.uint64)
        np.cumsum(_reduced((windows * windows).astype(np.uint64), p), axis=1, out=before[:, 1:])
        own = _reduced((blocks * blocks).astype(np.uint64), p).sum(axis=1)[:, None]
        twice = _correlated(blocks, windows, p, g) * np.uint64(2)
        zero &= _reduced(own + before[:, b:] - before[:, :-b], p) == _reduced(twice, p)
        product *= p
    return np.argwhere(zero)


# --- runs of a group of texts


def _next_same(keys: np.ndarray) -> np.ndarray:
    """Distance to the next equal key; a large number if there is none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), np.iinfo(np.int64).max)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _same_on(code: np.ndarray, at: int, shift: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``shift`` later, or has none."""
    end, step = len(code) - shift, 32
    while at < end:
        stop = min(at + step, end)
        differs = code[at:stop] != code[at + shift : stop + shift]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = stop, step * 2
    return max(at, end) if end > 0 else at


def _same_before(code: np.ndarray, at: int, shift: int) -> int:
    """The first of the places in a row before ``at`` whose words equal those ``shift`` later."""
    step = 32
    while at > 0:
        start = max(at - step, 0)
        differs = code[start:at] != code[start + shift : at + shift]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = start, step * 2
    return 0


def find(code: np.ndarray, base: np.ndarray, longest: int) -> list[Run]:
    """All runs, by start and period.

    ``code`` numbers the words of one or many texts such that no two texts share a number; ``base`` is, for each word, the
    smallest number of its text; ``longest`` is the number of words of the longest text.
    """
    n = len(code)
    if longest < LEAST:
        return []
    width = int((code - base).max()) + 2
    padded = np.concatenate([code, np.full(n + 16, -1)])
    pair = np.append(code[:-1] * np.int64(n + 1) + code[1:], -1)
    pair = _dense(pair)
    again = {2: _next_same(pair)}
    if n > 3:
        four = np.append(pair[:-2] * np.int64(n + 1) + pair[2:], [-2, -3])
        again[4] = _next_same(four)
    period: dict[tuple[int, int], int] = {}
    covered = np.zeros(n, np.int64)  # where a run over this word ends, if its period is no longer than a block
    pending: list[tuple[int, int, int]] = []  # period, start, end of runs that are not yet in ``covered``
    for block, least, most in _scales(longest):
        if n < block:
            continue
        gram = min(block, 4)
        starts = np.arange(0, n - block + 1, block)
        near = again[gram][: len(starts) * block].reshape(len(starts), block)[:, : block - gram + 1].max(axis=1) <= most
        for q, s, e in [x for x in pending if x[0] <= block]:
            np.maximum(covered[s:e], e, out=covered[s:e])
        pending = [x for x in pending if x[0] > block]
        starts = starts[near & (covered[starts] < starts + most + block)]
        seeds = [np.zeros((0, 2), np.int64)]
        span = most - least + block
        rows = max(1, CELLS // (4 * span))
        for k in range(0, len(starts), rows):
            some = starts[k : k + rows]
            blocks = code[some[:, None] + np.arange(block)] - base[some][:, None]
            windows = padded[some[:, None] + least + np.arange(span)] - base[some][:, None]
            windows = np.where((windows < 0) | (windows >= width - 1), width - 1, windows)  # words of other texts, which differ from all
            hits = zero_mismatch(blocks, windows)
            seeds.append(np.column_stack([hits[:, 1] + least, some[hits[:, 0]]]))
        found = np.concatenate(seeds)
        found = found[covered[found[:, 1]] < found.sum(axis=1) + block]  # others lie in a run known, at a multiple of its period
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        cuts = np.flatnonzero(np.diff(found[:, 0])) + 1
        for part in np.split(found, cuts) if len(found) else []:
            shift, places, k = int(part[0, 0]), part[:, 1], 0
            while k < len(places):
                at = int(places[k])
                first, last = _same_before(code, at, shift), _same_on(code, at + block, shift)
                k = int(np.searchsorted(places, last))  # blocks before ``last`` lie in the same stretch
                length = last + shift - first
                if length >= max(LEAST, 2 * shift):
                    key = (first, last + shift)
                    if shift < period.get(key, shift + 1):
                        period[key] = shift
                        pending.append((shift, *key))
    return sorted((s, e - s, q) for (s, e), q in period.items())


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    code, base, at = [], [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        code.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + at)
        base.append(np.full(len(words), at, np.int64))
        at += len(own)
    return np.concatenate(code), np.concatenate(base)


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start and period."""
    lengths = [len(t) for t in texts]
    out: list[list[Run]] = [[] for _ in texts]
    if not sum(lengths):
        return out
    ends = np.cumsum(lengths)
    for s, length, q in find(*_numbered(texts), max(lengths)):
        k = int(np.searchsorted(ends, s, side="right"))
        out[k].append((s - int(ends[k]) + lengths[k], length, q))
    return out


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """Words that no run contains after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped[:-1]), strict=True) if not d]


def _groups(texts: Iterator[tuple[object, list[bytes]]]) -> Iterator[tuple[list[object], list[list[bytes]]]]:
    ids: list[object] = []
    held: list[list[bytes]] = []
    total = 0
    for doc_id, words in texts:
        if held and total + len(words) > GROUP:
            yield ids, held
            ids, held, total = [], [], 0
        ids.append(doc_id)
        held.append(words)
        total += len(words)
    if held:
        yield ids, held


def detect(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start and period) and text without repeated periods, words joined by one space.

    ``change`` may replace a text's words before the search. A null text has no words and gives an empty text; repeated rows stay
    rows; a null id stays null; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, text string"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None)
            split = ((i, words_of(t)) for i, t in zip(ids, b["text"], strict=True))
            changed = ((i, change(i, w) if change else w) for i, w in split)
            for some, texts in _groups(changed):
                found = runs_of(texts)
                kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                own = pd.Series(some, dtype=object if b["doc_id"].dtype == object else "Int64")
                yield pd.DataFrame({"doc_id": own, "runs": runs, "text": kept})

    return docs.select("doc_id", F.col("text")).mapInPandas(of, schema)


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of the query's contract: of one document in ten, the words from some place on repeat a passage."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def report(docs: DataFrame) -> DataFrame:
    """Runs of every text after ``repeated_tail``: doc_id, n_runs, the longest run and digests. Edge cases as in :func:`detect`;
    a document with a null id is not changed before the search."""
    found = detect(docs, repeated_tail)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ranked = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = found.withColumn("best", ranked)
    length = -F.col("best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
