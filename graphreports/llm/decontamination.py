"""Benchmark decontamination with a generalised suffix automaton.

Texts are read as words of a-z, 0-9 and characters beyond ASCII, with A-Z lower-cased. The automaton of all test items accepts
exactly their runs of consecutive words. A document's words are streamed through it; the state and the length of the longest match
that ends at a word tell which windows of test items end there: a window is a number of consecutive words of an item, or the whole of
a shorter item. Words inside windows are hit.

Equal items are one text. Long texts are cut into pieces that share all but one word of a window, and pieces are dealt by hash into shards of
a bounded number of words. One shard at a time is sent to the tasks, which build its automaton once per Python worker; so memory is
bounded however large the benchmark is, and documents are read once per shard. A benchmark of ordinary size is one shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from graphreports.llm.common import free_names, stored

WINDOW = 10
SHARD_WORDS = 200_000  # words of the items that a task holds at once, about
PIECE = 2_000  # words of the longest piece
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "n_words long, starts array<int>, ends array<int>, texts array<string>"
_BREAKS = bytes(
    c if c >= 0x80 or chr(c) in "0123456789" + LOWER else ord(chr(c).lower()) if chr(c) in UPPER else 0x20 for c in range(256)
)
_built: dict[str, Automaton] = {}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8, where no byte of a character beyond ASCII is an ASCII character."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def words(text: Column) -> Column:
    """The same as a column."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


class Automaton:
    """Generalised suffix automaton of word sequences, with the texts that own each window."""

    def __init__(self, window: int, pieces: list[tuple[str, list[bytes]]]) -> None:
        self.window = window
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]
        self.number: dict[bytes, int] = {}
        numbered = [(text, [self.number.setdefault(w, len(self.number)) for w in found]) for text, found in pieces]
        for _, found in numbered:
            state = 0
            for w in found:
                state = self._extend(state, w)
        self._own(numbered)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of ``q`` for the shorter matches that come from ``p`` and its suffixes."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier text has this run of words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _own(self, numbered: list[tuple[str, list[int]]]) -> None:
        size = len(self.length)
        # The state of a match's last ``window`` words: the first one up the links that is reached by so few.
        self.top = [0] * size
        # The nearest state up the links at which a whole short text ends.
        self.up = [0] * size
        self.owners: list[set[str] | None] = [None] * size
        self.whole: list[list[tuple[int, str]] | None] = [None] * size
        order = sorted(range(1, size), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                self.top[s] = s if self.length[self.link[s]] < self.window else self.top[self.link[s]]
        for text, found in numbered:
            state = 0
            for k, w in enumerate(found):
                state = self.next[state][w]
                if k + 1 >= self.window:
                    at = self.top[state]
                    if self.owners[at] is None:
                        self.owners[at] = set()
                    self.owners[at].add(text)
            if 0 < len(found) < self.window:
                if self.whole[state] is None:
                    self.whole[state] = []
                self.whole[state].append((len(found), text))
        for s in order:
            self.up[s] = self.link[s] if self.whole[self.link[s]] else self.up[self.link[s]]
        self.short = any(self.whole)

    def hits(self, found: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Stretches of hit words, apart from each other, by start and end; and the texts that own a window in them."""
        following, link, size, window = self.next, self.link, self.length, self.window
        starts: list[int] = []
        ends: list[int] = []
        windows: set[int] = set()
        texts: set[str] = set()
        state = length = 0
        for k, w in enumerate(map(self.number.get, found)):
            to = following[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = following[state].get(w)
                if to is None:
                    length = 0
                    continue
                length = size[state]
            state = to
            length += 1
            if length >= window:
                windows.add(self.top[state])
                longest = window
            else:
                longest = 0
            if self.short:
                s = state if self.whole[state] else self.up[state]
                while s:
                    for n, text in self.whole[s]:
                        if n <= length:
                            texts.add(text)
                            longest = max(longest, n)
                    s = self.up[s]
            if longest:
                start = k + 1 - longest
                while ends and ends[-1] >= start:
                    start = min(start, starts.pop())
                    ends.pop()
                starts.append(start)
                ends.append(k + 1)
        return starts, ends, texts.union(*(self.owners[s] for s in windows))


def pieces(items: DataFrame, window: int, longest: int = PIECE) -> DataFrame:
    """(text, piece): key of each different text that has words, and its pieces as words joined by one space."""
    step = longest - window + 1
    split = items.select(words(F.col("text")).alias("w")).filter(F.size("w") > 0).select("w", F.sha2(F.array_join("w", " "), 256).alias("text"))
    last = F.floor(F.greatest(F.size("w") - window, F.lit(0)) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(F.col("w"), k * step + 1, longest), " "))
    return split.select("text", F.explode(cut).alias("piece")).distinct()


def sharded(table: DataFrame, most: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """Pieces with the shard of each, and how many shards there are: so many that none has over ``most`` words or a piece more."""
    n = F.size(F.split("piece", " "))
    total = table.agg(F.sum(n)).first()[0] or 0
    shards = max(1, -(-total // most))
    while True:
        dealt = table.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("int"))
        fullest = dealt.groupBy("shard").agg(F.sum(n).alias("n")).agg(F.max("n")).first()[0] or 0
        if fullest <= most + PIECE or shards > total:
            return dealt, shards
        shards *= 2


def _search(shared, name: str, window: int):
    """A function from texts and what was found in them before to what is found now."""

    def of(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(window, [(text, piece.encode("utf-8", "surrogatepass").split()) for text, piece in shared.value])
        automaton = _built[name]
        for texts, before in batches:
            rows = []
            for text, starts, ends, owners in zip(texts, before["starts"], before["ends"], before["texts"], strict=True):
                found = words_of(text)
                own_starts, own_ends, own = automaton.hits(found)
                if len(starts):
                    own_starts, own_ends = _joined(list(zip(starts, ends, strict=True)) + list(zip(own_starts, own_ends, strict=True)))
                rows.append((len(found), own_starts, own_ends, sorted(own.union(owners))))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "texts"])

    return pandas_udf(of, FOUND)


def _joined(stretches: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(stretches):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(int(start))
            ends.append(int(end))
    return starts, ends


def marked(docs: DataFrame, items: DataFrame, column: str, window: int = WINDOW, most: int = SHARD_WORDS) -> DataFrame:
    """``docs`` and a struct ``column``: number of words, starts and ends of hit stretches of words (from 0, ends behind), and keys of the
    texts that own a window. All columns of ``docs`` stay, but for one called ``column``."""
    spark = docs.sparkSession
    dealt, shards = sharded(stored(pieces(items, window), "decontamination-pieces"), most)
    nothing = F.expr("struct(0L AS n_words, cast(array() AS array<int>) AS starts, cast(array() AS array<int>) AS ends, cast(array() AS array<string>) AS texts)")
    out = docs.withColumn(column, nothing)
    for shard in range(shards):
        rows = dealt.filter(F.col("shard") == shard).select("text", "piece").collect()  # at most ``most`` words and a piece
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        if shard:
            out = stored(out, "decontamination-marked")  # else all shards would be held at once
        out = out.withColumn(column, _search(shared, uuid.uuid4().hex, window)(F.col("text"), F.col(column)))
    return out


def _hit(found: Column) -> Column:
    return F.aggregate(F.zip_with(found["ends"], found["starts"], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def _cut(window: int, longest: int):
    """A function that removes stretches of over ``longest`` words from a text, with what lies between their words."""
    import regex

    word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # as before A-Z are lower-cased

    @pandas_udf("string")
    def of(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, first, behind in zip(texts, starts, ends, strict=True):
            long = [(s, e) for s, e in zip(first, behind, strict=True) if e - s > longest]
            if long:
                at = [m.span() for m in word.finditer(text)]
                kept, done = [], 0
                for s, e in long:
                    kept.append(text[done : at[s][0]])
                    done = at[e - 1][1]
                text = "".join([*kept, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return of


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, share: float = 0.5) -> DataFrame:
    """``docs`` without hit stretches of more than ``longest`` words, and without documents of whose words more than ``share`` are hit.

    All columns stay as they are but ``text``; whatever they are called. A null text stays null; repeated rows stay rows; an empty table of
    documents gives no rows, an empty benchmark changes nothing.
    """
    (column,) = free_names(docs, "found")
    found = marked(docs, items, column, window)
    c = F.col(column)
    covered = _hit(c) > share * c["n_words"]
    text = F.when(F.size(c["starts"]) > 0, _cut(window, longest)(F.col("text"), c["starts"], c["ends"])).otherwise(F.col("text"))
    return found.filter(~covered).withColumn("text", text).drop(column)


def _digests(sets: DataFrame, owned: DataFrame) -> DataFrame:
    """(key, n_items, items_sha256) of each set of texts: how many items have one of them, and the digest of their sorted ids.

    Ids are streamed in order, so a set with very many items is never held at once.
    """
    rows = sets.select("key", F.explode("texts").alias("text")).join(owned, "text").select("key", "item").distinct()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, digest = None, 0, hashlib.sha256()
        for b in batches:
            out = []
            for k, item in zip(b["key"], b["item"], strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, n, digest.hexdigest()))
                    key, n, digest = k, 0, hashlib.sha256()
                digest.update((("," if n else "") + item).encode("utf-8", "surrogatepass"))
                n += 1
            yield pd.DataFrame(out, columns=["key", "n_items", "items_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, n, digest.hexdigest())], columns=["key", "n_items", "items_sha256"])

    return rows.repartition("key").sortWithinPartitions("key", "item").mapInPandas(of, "key string, n_items long, items_sha256 string")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; an item without words has no window; items with one id are one item, and a null id is the empty string; repeated
    documents stay rows; no documents give no rows; other columns are not read. Items are looked up once for each set of texts
    that some document holds, not once for each document; the digests join back on the set and one of 16 salts, as one set may belong to a
    third of all documents.
    """
    salts = 16
    found = marked(docs.select("doc_id", "text"), items, "found", window, most).select(
        "doc_id", F.col("found.n_words").alias("n_words"), _hit(F.col("found")).alias("n_hit"), F.col("found.texts").alias("texts")
    )
    found = stored(found.withColumn("key", F.when(F.size("texts") > 0, F.sha2(F.array_join("texts", ","), 256))), "decontamination-found")
    owned = items.select(
        F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("text"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    ).distinct()
    sets = found.filter(F.col("key").isNotNull()).select("key", "texts").distinct()
    salted = _digests(sets, owned).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = found.drop("texts").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    clear = named.filter(F.col("key").isNull()).select("*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    held = named.filter(F.col("key").isNotNull()).join(salted, ["key", "salt"])
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    return held.select(*columns).unionByName(clear.select(*columns)).withColumn("contaminated", F.col("n_hit") > 0)


SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
),
i AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
),
iw AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[k : k + {WINDOW} - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)
),
dw AS (
    SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hit AS (
    SELECT dw.r, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
),
place AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS j FROM hit) GROUP BY r
),
named AS (
    SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(place.n_hit, 0) AS n_hit, coalesce(named.n_items, 0) AS n_items,
    coalesce(named.items_sha256, sha256('')) AS items_sha256, coalesce(place.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN named USING (r)
"""
