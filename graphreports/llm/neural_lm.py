"""Log-bilinear language model, trained with noise-contrastive estimation, and its score of whole texts.

Every word of the head of the vocabulary is a symbol with vectors of its own, so that parameters grow with the distinct words;
so are the end of a text and the classes of the words outside the head (by their first letters). The context vector is the
sum of the vectors of the four symbols before, each scaled by its position; a logit is the product with an outcome's vector, plus its bias
(kept as the vector's last number, with a last number of 1 in the context vector).
A symbol is predicted in up to three levels: the first has the end, the most frequent words, the classes, and groups of the other head words by
descending count; the second has the subgroups of the group, the third the words of the subgroup, each about as many as the cube root of the
head's words. All are normalised by batched matrix products. Within a class a
word has its count plus one, over the class's counts, its words, and one place for unknown words: so the probabilities of all
words after any context sum to 1.

Texts are read into symbols once and stored in pieces. A piece goes by its hash to one round and one shard, whose number follows from the tokens learned from;
a shard is trained in order of the hashes. So the model depends on the rows alone, not on how the table is partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from graphreports.llm.common import stored

FREQUENT, CLASSES = 160, 95  # outcomes 1 to FREQUENT are words, the rest classes; outcome 0 is the end
SIZE = 1 + FREQUENT + CLASSES  # symbols from here on are the other head words, and first-level outcomes from here on their groups
CONTEXT, DIM, NOISE = 4, 16, 64
ROUNDS, RATE, BATCH = 2, 0.15, 2048  # the rounds share out the pieces of all texts, so that each position is trained on once
SCALE = np.float32(8 / 1024)  # of the gradients of a position
PIECE = 1 << 13  # positions of a text that are trained on and scored together
SHARE = 1 << 22  # positions that one task trains on in a round, about
FAN = 64  # copies of a parameter that are averaged at once
ROWS = 1 << 12  # rows of a parameter that are sent back together
HEAD = 150_000  # words whose vectors and counts every task holds; the counts of all others are joined
WAIT = 1 << 18  # positions that are scored at once
KEYS, PAIRS = 1 << 18, 1 << 20  # counts that a task holds as a hash table to look up rare words in, and rare words of texts it looks up, about
END = b""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts one after the other, as ``tokens`` reads them, and of which text each is."""
    low = pc.ascii_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(low))
    found, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.not_equal(pc.binary_length(found), 0)  # a text without words is read as one empty word
    return of[some.to_numpy(zero_copy_only=False)], found.filter(some)


def word_class(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[:2]) % CLASSES


# The classes of words of two bytes and more by their first two, and of those of one byte.
_OF_TWO = np.array([word_class(bytes([k >> 8, k & 255])) for k in range(1 << 16)])
_OF_ONE = np.array([word_class(bytes([k])) for k in range(256)])


def _classes(words: pa.LargeStringArray) -> np.ndarray:
    """``word_class`` of many words, none of them empty, null, or valid in parts of their buffers alone."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data, first = np.frombuffer(data, np.uint8), at[:-1]
    two = np.flatnonzero(np.diff(at) > 1)
    out = _OF_ONE.take(data.take(first))
    out[two] = _OF_TWO.take(data.take(first[two]).astype(np.int64) * 256 + data.take(first[two] + 1))
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def merged() -> pa.Table:
            sums = pa.concat_tables(waiting).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": sums["word"], "n": sums["n_sum"]})

        for b in batches:
            words, n = _split(b.column("text"))[1].value_counts().flatten()
            waiting += [pa.table({"word": words.cast(pa.string()), "n": n}), pa.table({"word": [END.decode()], "n": [b.num_rows]})]
            if sum(len(t) for t in waiting) > 800_000:
                waiting = [merged()]
                if len(waiting[0]) > 400_000:
                    yield from waiting.pop().to_batches()
        if waiting:
            yield from merged().to_batches()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> pa.Table:
    """(word, n) of the most frequent words, at most ``most``, by descending counts.

    The least count they must have is found in a histogram of some hundred classes of counts, so that neither
    the driver nor one task ever sees more words than are kept.
    """
    level = F.floor(F.log("n") * 32).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    found = counts.select("word", "n").filter(F.lit(False) if least is None else level >= least).toArrow()
    return found.sort_by([("n", "descending"), ("word", "ascending")])


def _of_class(word: Column) -> Column:
    """``word_class`` in the JVM."""
    return (1 + FREQUENT + F.crc32(F.substring(word.cast("binary"), 1, 2)) % CLASSES).cast("int")


class Model:
    """Parameters, and what they are learned from.

    Vectors of symbols as context (r), of first-level outcomes (q), of subgroups (u) and of grouped words (w), position weights (c).
    ``unigram`` has the counts of the first SIZE symbols, ``grouped`` those of the other head words, in descending order.
    """

    NAMES, LEVELS = "rquwc", "quw"

    def __init__(self, unigram: np.ndarray, grouped: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        self.unigram, self.grouped = unigram, np.zeros(0) if grouped is None else grouped
        words = len(self.grouped)
        self.sub = max(1, math.ceil(round(words ** (1 / 3), 6)))  # words of a subgroup, and subgroups of a group
        per = lambda size: np.add.reduceat(self.grouped, np.arange(0, words, size)) if words else np.zeros(0)
        counts = [np.concatenate([unigram, per(self.sub**2)]), per(self.sub), self.grouped]
        draw = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        self.r = draw(SIZE + words)
        self.c = np.ones((CONTEXT, DIM), np.float32)
        self.noise = [x / max(x.sum(), 1) for x in counts]
        for name, noise in zip(self.LEVELS, self.noise, strict=True):
            vectors = draw(len(noise))
            vectors[:, -1] = np.log(noise)
            setattr(self, name, vectors)

    def copy(self) -> Model:
        own = copy(self)
        for name in self.NAMES:
            setattr(own, name, getattr(self, name).copy())
        return own

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def outcomes(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First-level outcomes; the rows of grouped words, their subgroups and words."""
        grouped = np.flatnonzero(symbol >= SIZE)
        word = symbol[grouped] - SIZE
        first = symbol.copy()
        first[grouped] = SIZE + word // self.sub**2
        return first, grouped, word // self.sub, word

    def contexts(self, stream: np.ndarray) -> np.ndarray:
        """Context vectors of the symbols of ``stream`` after its first CONTEXT."""
        n, block = len(stream) - CONTEXT, 4096  # as many as stay near the processor
        h = np.empty((n, DIM), np.float32)
        for at in range(0, n, block):
            part = h[at : at + block]
            r = _rows(self.r, stream[at : at + len(part) + CONTEXT - 1])
            np.multiply(r[CONTEXT - 1 :], self.c[0], out=part)
            for k in range(1, CONTEXT):
                part += r[CONTEXT - 1 - k : len(r) - k] * self.c[k]
        h[:, -1] = 1
        return h

    def log_probabilities(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all symbols, after given contexts (the nearest symbol first)."""
        h = sum(_rows(self.r, before[:, k]) * self.c[k] for k in range(CONTEXT))
        h[:, -1] = 1
        return self.of_contexts(h, symbol)

    def of_contexts(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        first, grouped, subgroup, word = self.outcomes(symbol)
        out = np.empty(len(h))
        _log_softmax(h, self.q, first, out, _far(h, self.q))
        for vectors, outcome in ((self.u, subgroup), (self.w, word)):
            out[grouped] += self._among(_rows(h, grouped), vectors, outcome)
        return out

    def _among(self, h: np.ndarray, vectors: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of outcomes among the ``sub`` that they share a parent with."""
        parent, far = outcome // self.sub, _far(h, vectors)
        order = np.argsort(parent)
        h, within, parent = _rows(h, order), (outcome - parent * self.sub).take(order), parent.take(order)
        edges = np.flatnonzero(np.diff(parent, prepend=-1, append=-1)).tolist()
        told, ones = np.empty(len(outcome)), np.ones(self.sub, np.float32)
        for start, end in zip(edges, edges[1:]):
            at = int(parent[start]) * self.sub
            _log_softmax(h[start:end], vectors[at : at + self.sub], within[start:end], told[start:end], far, ones)
        out = np.empty(len(outcome))
        out[order] = told
        return out


def _rows(of: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``of[index]``, which copies rows of vectors at a fourth of that speed."""
    return of.take(index, axis=0)


def _far(h: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether an exponential of a logit could leave the range of its type."""
    widest = lambda x: math.sqrt(float(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]).max(initial=0)))
    return widest(h) * widest(vectors) + float(np.abs(vectors[:, -1]).max(initial=0)) > 80


_BLOCK = np.arange(512)


def _log_softmax(h: np.ndarray, vectors: np.ndarray, chosen: np.ndarray, out: np.ndarray, far: bool, ones: np.ndarray | None = None) -> None:
    """Logarithm of the chosen outcome's share of each row, in blocks of rows. ``ones`` may be given where many calls share them."""
    block, ones = len(_BLOCK), np.ones(len(vectors), np.float32) if ones is None else ones[: len(vectors)]
    for i in range(0, len(h), block):
        logits = h[i : i + block] @ vectors.T
        told = logits[_BLOCK[: len(logits)], chosen[i : i + block]]
        if far:
            top = logits.max(axis=1)
            logits -= top[:, None]
            told -= top
        np.exp(logits, out=logits)
        out[i : i + block] = told - np.log(logits @ ones)


def _by_row(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``index`` and the sum of the values of each."""
    order = np.argsort(index)
    index = index.take(order)
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index.take(starts), np.add.reduceat(_rows(values, order), starts, axis=0)


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps on a model's own copy, with one AdaGrad rate for each row that a step touches. A batch shares its noise words.

    A step moves no row by more than 4 * RATE, so that all stay finite.
    """

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.sums = {n: np.full(len(getattr(model, n)), 1e-2, np.float32) for n in model.NAMES}
        self.uses = {n: np.zeros(len(getattr(model, n)), np.float32) for n in model.NAMES}  # steps that touched a row
        self.levels = [(np.cumsum(x), np.log(NOISE * x).astype(np.float32)) for x in model.noise]
        self.seen = 0

    def _apply(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        values, uses = getattr(self.m, name), self.uses[name]
        sums = self.sums[name].take(rows) + np.einsum("ij,ij->i", gradient, gradient) * np.float32(1 / DIM)
        self.sums[name][rows] = sums
        gradient *= (RATE / np.sqrt(sums))[:, None]
        values[rows] = np.subtract(_rows(values, rows), gradient, out=gradient)
        uses[rows] = uses.take(rows) + 1

    def _level(self, level: int, h: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Learn to tell the outcomes of a level from noise; the gradient of the loss by the context vectors."""
        vectors = getattr(self.m, self.m.LEVELS[level])
        cumulative, expected = self.levels[level]
        noise = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE) * cumulative[-1]), len(cumulative) - 1).astype(outcome.dtype)
        of_true, of_noise = _rows(vectors, outcome), _rows(vectors, noise)
        for_true = expected.take(outcome)
        for_true -= np.einsum("ij,ij->i", h, of_true)
        for_true = _sigmoid_of_negative(for_true) - 1
        less = of_noise.copy()
        less[:, -1] -= expected.take(noise)  # as the context vectors end in 1
        for_noise = _sigmoid_of_negative(h @ np.negative(less, out=less).T)
        of_true *= for_true[:, None]
        of_true += for_noise @ of_noise
        by_row = np.empty((len(h) + NOISE, DIM), np.float32)
        np.multiply(h, for_true[:, None], out=by_row[: len(h)])
        by_row[len(h) :] = (h.T @ for_noise).T
        rows, sums = _by_row(np.concatenate([outcome, noise]), by_row)
        sums *= SCALE
        self._apply(self.m.LEVELS[level], rows, sums)
        return of_true

    def step(self, stream: np.ndarray, wanted: np.ndarray) -> None:
        """One step on the symbols of ``stream`` after its first CONTEXT that are ``wanted``."""
        m, at = self.m, np.flatnonzero(wanted)
        if not len(at):
            return
        n = len(wanted)
        h = _rows(m.contexts(stream), at)
        first, grouped, subgroup, word = m.outcomes(stream[CONTEXT:].take(at))
        told = self._level(0, h, first)
        if len(grouped):
            of_words = _rows(h, grouped)
            told[grouped] += self._level(1, of_words, subgroup) + self._level(2, of_words, word)
        told *= SCALE
        told[:, -1] = 0
        dh = np.zeros((n, DIM), np.float32)
        dh[at] = told
        r, by_symbol, dc = _rows(m.r, stream), np.zeros((len(stream), DIM), np.float32), np.empty_like(m.c)
        for k in range(CONTEXT):
            part = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + n)
            by_symbol[part] += dh * m.c[k]
            dc[k] = np.einsum("ij,ij->j", dh, r[part])
        self._apply("r", *_by_row(stream, by_symbol))
        self._apply("c", np.arange(CONTEXT), dc)
        self.seen += len(at)

    def learned(self) -> Iterator[tuple[str, int, bytes, bytes, bytes]]:
        """For each ROWS rows of a parameter: which were touched, their values, and in how many steps."""
        for name in self.m.NAMES:
            values, uses = getattr(self.m, name), self.uses[name]
            for at in range(0, len(uses), ROWS):
                row = np.flatnonzero(uses[at : at + ROWS])
                if len(row):
                    yield name, at, row.astype(np.int32).tobytes(), values[at + row].tobytes(), uses[at + row].tobytes()

    def learn(self, pieces: list[np.ndarray]) -> None:
        stream, wanted = joined(pieces)
        for at in range(CONTEXT, len(stream), BATCH):
            self.step(stream[at - CONTEXT : at + BATCH], wanted[at : at + BATCH])


def joined(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces one after the other, and which symbols are not the context that a piece begins with."""
    stream = np.concatenate(pieces)
    wanted = np.ones(len(stream), bool)
    starts = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    for k in range(CONTEXT):
        wanted[starts + k] = False
    return stream, wanted


def pieces(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """A text's symbols in pieces of at most PIECE, each after the CONTEXT symbols before it; before the first stands the end of another text."""
    padded = np.concatenate([np.zeros(CONTEXT, np.int32), symbols.astype(np.int32)])
    for at in range(0, len(symbols), PIECE):
        yield padded[at : at + CONTEXT + PIECE]


def pack(piece: np.ndarray) -> bytes:
    """Three bytes a symbol: all low halves, then the rest, which compresses well."""
    return (piece & 0xFFFF).astype("<u2").tobytes() + (piece >> 16).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int32) + (np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int32) << 16)


class Vocabulary:
    """Symbols and counts of the head; bounded by HEAD words."""

    def __init__(self, head: pa.Table | list[tuple[str, int]]):
        if not isinstance(head, pa.Table):
            head = pa.table({"word": pa.array([w for w, _ in head], pa.string()), "n": pa.array([n for _, n in head], pa.int64())})
        head = head.filter(pc.not_equal(head["word"], END.decode()))
        self.words = pa.concat_arrays([pa.array([], pa.large_string()), *head["word"].cast(pa.large_string()).chunks])
        self.count = np.concatenate([[0.0], head["n"].to_numpy()])
        place = np.arange(len(head))
        self.symbol = np.concatenate([[0], np.where(place < FREQUENT, place + 1, SIZE + place - FREQUENT)]).astype(np.int64)

    @property
    def number(self) -> dict[bytes, int]:
        """Places of the words in ``symbol`` and ``count``."""
        return {w.encode(): k + 1 for k, w in enumerate(self.words.to_pylist())}

    def grouped(self) -> np.ndarray:
        """Counts of the head words that are predicted in groups."""
        return self.count[1 + FREQUENT :]


PARTS = "doc_id string, rid long, part int, key long, symbols binary, n_tokens long, n_known long, base_score double, words array<string>, times array<int>"


def read_parts(docs: DataFrame, vocabulary: Vocabulary, end_known: bool = True, end_base: float = 0.0, base: float = 0.0) -> DataFrame:
    """Each text in symbols, a row per piece; the first one also has the text's counts, and the words outside the head with their times.

    ``rid`` numbers the rows of ``docs``, ``key`` is a hash of doc_id and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in PARTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        share = np.log10(words.count + 1) - base
        share[0] = 0  # words outside the head count later
        for b in batches:
            text, of, found = b.num_rows, *_split(b.column("text"))
            number = pc.fill_null(pc.index_in(found, value_set=words.words), -1).to_numpy(zero_copy_only=False) + 1  # 0: outside the head
            symbols, outside = words.symbol[number], np.flatnonzero(number == 0)
            coded = found.take(pa.array(outside)).dictionary_encode()
            code, unknown = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            symbols[outside] = _classes(unknown)[code]
            pair, times = np.unique(of[outside] * max(len(unknown), 1) + code, return_counts=True)
            edges = np.searchsorted(pair, np.arange(text + 1) * max(len(unknown), 1)).astype(np.int32)
            of_text = lambda values, edges=edges: pa.ListArray.from_arrays(pa.array(edges), values)
            tails = of_text(unknown.cast(pa.string()).take(pa.array(pair % max(len(unknown), 1)))), of_text(pa.array(times.astype(np.int32)))
            n = np.bincount(of, minlength=text)
            known = n - np.bincount(of[outside], minlength=text)
            scores = np.bincount(of, weights=share[number], minlength=text) + end_base
            row, part, packed = [], [], []
            ends = np.cumsum(n)
            for k in range(text):
                for turn, piece in enumerate(pieces(np.append(symbols[ends[k] - n[k] : ends[k]], 0))):
                    row.append(k), part.append(turn), packed.append(pack(piece))
            first = np.array(part, np.int32) == 0
            row = np.array(row, np.int64)
            once = pa.array(row, mask=~first)
            told = [b.column("doc_id").take(pa.array(row)), b.column("rid").take(pa.array(row)), pa.array(part, pa.int32()), b.column("key").take(pa.array(row)), pa.array(packed, pa.binary())]
            told += [pa.array(np.where(first, x[row], 0).astype(t)) for x, t in ((n + 1, np.int64), (known + int(end_known), np.int64), (scores, np.float64))]
            yield pa.RecordBatch.from_arrays([*told, *(x.take(once) for x in tails)], names=names)

    doc_id = F.col("doc_id").cast("string").alias("doc_id")
    key = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key")
    return docs.select(doc_id, F.monotonically_increasing_id().alias("rid"), key, "text").mapInArrow(read, PARTS)


def train(docs: DataFrame, vocabulary: Vocabulary, unigram: np.ndarray) -> Model:
    """The model after training on all positions of ``docs``; ``seen`` counts them."""
    return train_parts(stored(read_parts(docs, vocabulary), "lm-parts"), vocabulary, unigram)


def shard(rounds: int, shards: int) -> tuple[Column, Column]:
    """The round and the shard that a piece is trained in."""
    place = F.pmod(F.xxhash64("key", "part"), F.lit(rounds * shards))
    return (place % rounds).cast("int"), F.floor(place / rounds).cast("int")


def train_parts(parts: DataFrame, vocabulary: Vocabulary, unigram: np.ndarray) -> Model:
    """In each round every shard trains a copy of the model on its pieces, in the order of their keys. The copies' mean goes on,
    each parameter weighted by the steps that touched it; it is taken of at most FAN copies at once, so that no task reads more.

    The copies of one repeated row (doc_id and text) are trained in one shard.
    """
    model = Model(unigram, vocabulary.grouped())
    spark = parts.sparkSession
    own = parts.select("key", "part", "symbols")
    positions = parts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(positions / (ROUNDS * SHARE)))
    turn_of, shard_of = shard(ROUNDS, shards)
    schema = "copy long, name string, at int, row binary, value binary, uses binary, seen long"
    names = [c.split()[0] for c in schema.split(", ")]
    seen = 0
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pd.DataFrame], turn: int = turn, shared=shared) -> Iterator[pd.DataFrame]:
            trainer, waiting, n, number = None, [], 0, 0
            for b in batches:
                for symbols in b["symbols"]:
                    if trainer is None:
                        trainer, number = Trainer(shared.value.copy(), turn), int(b["shard"].iloc[0])
                    waiting.append(unpack(symbols))
                    n += len(waiting[-1])
                    if n >= 16 * BATCH:
                        trainer.learn(waiting)
                        waiting, n = [], 0
            if trainer is None:
                return
            if waiting:
                trainer.learn(waiting)
            yield pd.DataFrame([(number, "", 0, b"", b"", b"", trainer.seen)], columns=names)
            for part in trainer.learned():
                yield pd.DataFrame([(number, *part, 0)], columns=names)

        def mean(key: tuple, copies: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, steps, n = np.zeros((ROWS, DIM)), np.zeros(ROWS), 0
            for b in copies:
                n += int(b["seen"].sum())
                for row, value, uses in zip(b["row"], b["value"], b["uses"], strict=True):
                    row, uses = np.frombuffer(row, np.int32), np.frombuffer(uses, np.float32)
                    if len(row):
                        total[row] += np.frombuffer(value, np.float32).reshape(len(row), DIM).astype(np.float64) * uses[:, None]
                        steps[row] += uses
            row = np.flatnonzero(steps)
            value = (total[row] / steps[row, None]).astype(np.float32)
            yield pd.DataFrame([(*key, row.astype(np.int32).tobytes(), value.tobytes(), steps[row].astype(np.float32).tobytes(), n)], columns=names)

        pieces_of = own.filter(turn_of == turn).withColumn("shard", shard_of).repartitionById(shards, F.col("shard"))
        copies = pieces_of.sortWithinPartitions("key", "part").mapInPandas(learn, schema)
        left = shards
        while left > 1:
            left = math.ceil(left / FAN)
            copies = copies.withColumn("copy", F.floor(F.col("copy") / FAN)).groupBy("copy", "name", "at").applyInPandas(mean, schema)
        learned = copies.select("name", "at", "row", "value", "seen").toArrow()  # unlike rows, columns pass the driver's JVM as bytes
        for name, at, row, value, n in zip(*learned.columns, strict=True):
            seen += n.as_py()
            if name.as_py():
                row = at.as_py() + np.frombuffer(row.as_buffer(), np.int32)
                getattr(model, name.as_py())[row] = np.frombuffer(value.as_buffer(), np.float32).reshape(len(row), DIM)
        shared.destroy()
    model.seen = seen
    return model


def score(docs: DataFrame) -> DataFrame:
    """Score of every text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the texts that are not held out;
    without any, every word is unknown to a uniform model. Null and empty texts are their end alone; repeated rows are scored
    alike; a null doc_id is not held out; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    learned = docs.filter(~held_out(F.col("doc_id")))
    counts = stored(count_words(learned), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0)).alias("ends")).first()
    n, v, ends = total["tokens"], total["words"], total["ends"]
    head = head_words(counts.filter("word <> ''"))
    vocabulary = Vocabulary(head)
    by_class = counts.filter("word <> ''").groupBy(_of_class(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    classes = {r["c"]: [r["n"], r["v"]] for r in by_class.collect()}
    for b in head.to_batches(max_chunksize=ROWS):  # what is left are the words outside the head
        for w, c in zip(*b.to_pydict().values(), strict=True):
            of = classes[word_class(w.encode())]
            of[0], of[1] = of[0] - c, of[1] - 1
    unigram = np.ones(SIZE)
    unigram[0] += ends
    unigram[1 : 1 + min(FREQUENT, len(head))] += head["n"][:FREQUENT].to_numpy()
    room = np.ones(SIZE)  # counts, words and the unknown place of each class
    for c, (c_n, c_v) in classes.items():
        unigram[c] += c_n
        room[c] = c_n + c_v + 1
    base = float(np.log10(n + v + 1))
    parts = stored(read_parts(docs, vocabulary, ends > 0, float(np.log10(ends + 1)) - base, base), "lm-parts")
    model = train_parts(parts.filter(~held_out(F.col("doc_id"))), vocabulary, unigram)
    shared = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, waiting, n = shared.value, [], 0

        def out() -> pd.DataFrame:
            frame = pd.concat(waiting)
            found = [unpack(x) for x in frame["symbols"]]
            stream, wanted = joined(found)
            at = np.flatnonzero(wanted[CONTEXT:])
            logs = m.of_contexts(_rows(m.contexts(stream), at), stream[CONTEXT:].take(at))
            sizes = [len(x) - CONTEXT for x in found]
            starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
            return pd.DataFrame({"rid": frame["rid"].to_numpy(), "score": np.add.reduceat(logs, starts) / np.log(10)})

        for b in batches:
            size = b["symbols"].str.len() // 3
            first = 0
            for k, s in enumerate(size.tolist()):
                n += s
                if n > WAIT:
                    waiting.append(b.iloc[first : k + 1])
                    yield out()
                    waiting, n, first = [], 0, k + 1
            if first < len(b):
                waiting.append(b.iloc[first:])
        if waiting:
            yield out()

    texts = parts.select("rid", "symbols").mapInPandas(of, "rid long, score double")
    first = parts.filter("part = 0")
    rest = first.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), "x.times")
    # Counts are dealt into hash tables of a size that follows from the distinct words, which spares sorting all rare words as text.
    # No word is frequent here, so all parts are alike.
    dealt = max(1, math.ceil(v / KEYS), math.ceil((n - ends - pc.sum(head["n"], min_count=0).as_py()) / PAIRS))
    found = counts.repartition(dealt, "word").hint("shuffle_hash")
    c = F.coalesce("n", F.lit(0))
    of_class = F.element_at(F.array(*[F.lit(float(x)) for x in room]), _of_class(F.col("word")) + 1)
    tails = rest.repartition(dealt, "word").join(found, "word", "left").select(
        "rid", F.when(c > 0, F.col("times").cast("long")).otherwise(0).alias("n_known"), (F.col("times") * (F.log10(c + 1) - base)).alias("base_score"),
        (F.col("times") * F.log10((c + 1) / of_class)).alias("score"),
    )
    # Numbers alone are summed by hash; with the ids, which are text, all rows would be sorted.
    tails = tails.groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")])
    told = first.select("rid", "doc_id", "n_tokens", "n_known", "base_score").unionByName(texts, True).unionByName(tails, True)
    sums = told.groupBy("rid").agg(F.max("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
