"""Packing documents into sequences with a grouping genetic algorithm on islands.

Documents become pieces of at most a sequence's length. Full pieces are sequences already; the others are dealt into blocks of
bounded size, and several islands evolve packings of each block. A packing is a set of bins. Crossover injects the well-filled
bins of one parent into the other, removes bins that hold the same pieces twice, and best-fits the displaced pieces. Between
epochs each island sends its elite to the next island of its block. At the end the pieces of all badly filled bins are dealt
anew, in far fewer blocks, and evolved once more, so that blocks cost hardly any sequence.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphreports.runtime import cut_lineage

LENGTH = 2048
BLOCK = 1500  # pieces of a block, about
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 3
FULL = 0.995  # bins filled less are dealt anew
CACHE = 500_000  # words in each of the two generations a worker remembers
# Lower-case words of printable ASCII and the Latin letters beside it, and the pieces that the vocabulary's steps before the model split
# them into; the model is given bytes as characters.
_LATIN = rb"\xc3[\x9f-\xb6\xb8-\xbf]"
_PLAIN = re.compile(rb"(?:[!-~]|" + _LATIN + rb")+")
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|" + _LATIN + rb")+|[0-9]|[!-/:-@\[-`{-~]+")
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Words:
    """Ids of words as little-endian 32-bit numbers, each word encoded once while it is in use.

    White space ends every token of the vocabulary and A-Z count as a-z, so a text's ids are those of its lower-case words.
    A plain word is put together from its pieces, each encoded once whatever word it is in. When the words in use are too many,
    those not used since the last time are forgotten.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model

    def _encode(self, words: list[bytes]) -> None:
        """Words as a whole, by all steps of the tokenizer."""
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            e = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            cuts = np.searchsorted(e.word_ids, np.arange(len(part) + 1))
            coded = np.array(e.ids, "<u4").tobytes()
            for w, i, j in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.young[w] = coded[4 * i : 4 * j]

    def _encode_pieces(self, pieces: list[bytes]) -> None:
        """Pieces of plain words, by the model alone."""
        tokenize, young = self.model.tokenize, self.young
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTES))] for w in part]
            coded = np.array(list(chain.from_iterable(ids)), "<u4").tobytes()
            end = 0
            for w, x in zip(part, ids, strict=True):
                start, end = end, end + 4 * len(x)
                young[w] = coded[start:end]

    def _learn(self, words: set[bytes]) -> None:
        young, old = self.young, self.old
        if len(young) > CACHE:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        parts, new, other = [], set(), []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w.isalpha():  # ASCII letters: one piece
                new.add(w)
            elif _PLAIN.fullmatch(w):
                split = _SPLIT.findall(w)
                new.update(split)
                if len(split) > 1:
                    parts.append((w, split))
            else:
                other.append(w)
        wanted = []
        for x in new:
            if x in old:
                young[x] = old[x]
            elif x not in young:
                wanted.append(x)
        self._encode_pieces(wanted)
        self._encode(other)
        for w, split in parts:
            young[w] = b"".join([young[x] for x in split])

    def ids(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        if b"<|" in raw:  # may hold the name of a special token, which is read before case is
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        found = raw.lower().split()
        got = list(map(self.young.get, found))
        if None in got:
            self._learn({w for w, x in zip(found, got, strict=True) if x is None})
            got = [self.young[w] if x is None else x for w, x in zip(found, got, strict=True)]
        return b"".join(got)


_words: dict[str, Words] = {}


def pieces(docs: DataFrame, path: str, length: int = LENGTH, separator: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words.get(path) or _words.setdefault(path, Words(path))
        end = np.array([separator], "<u4").tobytes()
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                rows = []
                for k, text in enumerate(part["text"]):
                    ids = words.ids(text) + end
                    for start in range(0, len(ids), 4 * length):
                        chunk = ids[start : start + 4 * length]
                        rows.append((k, start // (4 * length), start // 4, len(chunk) // 4, zlib.crc32(chunk)))
                at_row, *columns = (np.array(c) for c in zip(*rows, strict=True))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[at_row], **dict(zip(("piece", "start", "length", "ids_crc32"), columns, strict=True))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """A packing in the making: bins with room left, by the room they have."""

    def __init__(self, length: int):
        self.length, self.bins, self.room = length, [], []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if a bin with room r is listed

    def open(self, items: list[int], used: int) -> None:
        self.bins.append(items), self.room.append(self.length - used)
        self._list(len(self.bins) - 1)

    def _list(self, k: int) -> None:
        r = self.room[k]
        if r:
            self.by_room.setdefault(r, []).append(k)
            self.rooms |= 1 << r

    def fit(self, item: int, size: int) -> None:
        """Best fit: the bin with the least room that is enough."""
        able = self.rooms >> size
        if not able:
            self.open([item], size)
            return
        r = size + (able & -able).bit_length() - 1
        ks = self.by_room[r]
        k = ks.pop()
        if not ks:
            self.rooms &= ~(1 << r)
        self.bins[k].append(item)
        self.room[k] = r - size
        self._list(k)


def best_fit(size: list[int], order: list[int], length: int) -> list[list[int]]:
    b = Bins(length)
    for i in order:
        b.fit(i, size[i])
    return b.bins


def fitness(bins: list[list[int]], size: list[int], length: int) -> float:
    """Mean squared fill: of packings with as many bins, the one with fuller bins is nearer to saving one."""
    return sum((sum(size[i] for i in b) / length) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], length: int, rng: random.Random) -> list[list[int]]:
    """Inject fuller-than-average bins of ``b`` into ``a``, drop bins of ``a`` that clash, and best-fit what they displace."""
    filled = sorted(b, key=lambda x: -sum(size[i] for i in x))
    injected = [x for x in filled[: max(1, len(filled) // 2)] if rng.random() < 0.7]
    taken = {i for x in injected for i in x}
    out = Bins(length)
    for x in injected:
        out.open(list(x), sum(size[i] for i in x))
    displaced = []
    for x in a:
        if taken.isdisjoint(x):
            out.open(list(x), sum(size[i] for i in x))
        else:
            displaced += [i for i in x if i not in taken]
    for i in sorted(displaced, key=lambda i: -size[i]):
        out.fit(i, size[i])
    return out.bins


def mutate(a: list[list[int]], size: list[int], length: int, rng: random.Random) -> list[list[int]]:
    """Empty the worst filled bins and a few others, and best-fit their pieces."""
    by_fill = sorted(a, key=lambda x: sum(size[i] for i in x))
    cut = max(1, len(by_fill) // 20)
    gone = by_fill[:cut] + rng.sample(by_fill[cut:], min(cut, len(by_fill) - cut))
    lost = {id(x) for x in gone}
    out = Bins(length)
    for x in a:
        if id(x) not in lost:
            out.open(list(x), sum(size[i] for i in x))
    freed = [i for x in gone for i in x]
    for i in sorted(freed, key=lambda i: -size[i] * (0.8 + 0.4 * rng.random())):
        out.fit(i, size[i])
    return out.bins


def evolve(size: list[int], start: list[list[list[int]]], seed: int, length: int, generations: int, population: int) -> list[list[list[int]]]:
    """The population after some generations, best first. It ends early at the least number of bins there can be."""
    rng = random.Random(int(seed))
    everyone = list(start)
    by_size = sorted(range(len(size)), key=lambda i: -size[i])
    while len(everyone) < population:
        loose = sorted(by_size, key=lambda i: -size[i] * (0.9 + 0.2 * rng.random())) if everyone else by_size
        everyone.append(best_fit(size, loose, length))
    rank = lambda bins: (len(bins), -fitness(bins, size, length))
    everyone.sort(key=rank)
    least = -(-sum(size) // length)
    for _ in range(generations):
        if len(everyone[0]) == least:
            break
        a, b = rng.sample(everyone, 2) if len(everyone) > 1 else (everyone[0], everyone[0])
        for child in (crossover(a, b, size, length, rng), mutate(everyone[0], size, length, rng)):
            everyone.append(child)
        everyone = sorted(everyone, key=rank)[:population]
    return everyone


def _coded(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u2")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(coded: bytes) -> list[list[int]]:
    at = np.frombuffer(coded, "<u2")
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


_ORDER = ["length", "doc_id", "piece", "ids_crc32"]


def _islands(items: DataFrame, length: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(block, items...) to each block's best packing: rows (block, coded)."""
    copies = items.select("block", "length", "doc_id", "piece", "ids_crc32", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    out = "block long, island int, n_bins int, fill double, population array<binary>"

    def state(block: int, island: int, size: list[int], everyone: list[list[list[int]]]) -> pd.DataFrame:
        best = everyone[0]
        return pd.DataFrame({"block": [block], "island": [island], "n_bins": [len(best)], "fill": [fitness(best, size, length)], "population": [[_coded(x, len(size)) for x in everyone]]})

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = rows.sort_values(_ORDER, ascending=[False, True, True, True])["length"].tolist()
        return state(*key, size, evolve(size, [], key[0] * islands + key[1], length, generations, population))

    def go_on(key: tuple, rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        size = rows.sort_values(_ORDER, ascending=[False, True, True, True])["length"].tolist()
        start = [_bins(x) for own in sent.sort_values("elite")["population"] for x in own]
        return state(*key, size, evolve(size, start, (key[0] * islands + key[1]) * 31 + 7, length, generations, population + 1))

    states = copies.groupBy("block", "island").applyInPandas(begin, out)
    for _ in range(1, epochs):
        states = cut_lineage(states)
        own = states.select("block", "island", F.lit(False).alias("elite"), "population")
        elite = states.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.lit(True).alias("elite"), F.slice("population", 1, 1).alias("population"))
        states = copies.groupBy("block", "island").cogroup(own.union(elite).groupBy("block", "island")).applyInPandas(go_on, out)
    best = states.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("n_bins", -F.col("fill"), "island")).alias("coded"))
    return best


def _packed(items: DataFrame, best: DataFrame, length: int) -> DataFrame:
    """Items with their bin, offset and the bin's fill."""
    kind = items.schema["doc_id"].dataType.simpleString()

    def place(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_ORDER, ascending=[False, True, True, True]).reset_index(drop=True)
        rows["bin"] = np.frombuffer(chosen["coded"].iloc[0], "<u2").astype(np.int64)
        by_bin = rows.groupby("bin")["length"]
        return rows.assign(offset=by_bin.cumsum() - rows["length"], used=by_bin.transform("sum"))

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block long, bin long, offset long, used long"
    return items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, schema)


def _dealt(items: DataFrame, n: int, block: int, seed: int) -> DataFrame:
    blocks = max(1, -(-n // block))
    return items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), F.lit(blocks)))


def pack(docs: DataFrame, path: str, length: int = LENGTH, separator: int = 0, block: int = BLOCK, islands: int = ISLANDS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a tokenizers file whose tokens end at white space. A null or empty text is the separator alone. Repeated rows
    are packed like different documents (rows that agree in all but their doc_id's order are interchangeable); a null doc_id
    stays null; an empty table gives no rows; other columns are not read. ``length`` is at most 65,535.
    """
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    cut = cut_lineage(pieces(docs, path, length, separator))
    short = cut.filter(F.col("length") < length)
    first = _dealt(short, short.count(), block, 1)
    settings = (length, islands, epochs, generations, population)
    once = cut_lineage(_packed(first, _islands(first, *settings), length))
    good = F.col("used") >= FULL * length
    loose = once.filter(~good).select(*fields)
    second = _dealt(loose, loose.count(), 4 * block, 2)
    again = _packed(second, _islands(second, *settings), length)
    # Ids: rounds 0 to 2 in the top bits; full pieces by place in their partition, bins by block.
    number = lambda turn, block_id, bin_id: F.lit(turn * (1 << 60)).cast("long") + block_id * 65536 + bin_id
    whole = cut.filter(F.col("length") == length).select(*fields, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = [x.select(*fields, number(k, F.col("block"), F.col("bin")).alias("sequence_id"), "offset") for k, x in ((1, once.filter(good)), (2, again))]
    return whole.union(rest[0]).union(rest[1])
