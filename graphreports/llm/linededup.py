"""Line de-duplication across documents with a deletion-neighbourhood join.

Two lines are the same if at most one character was inserted, deleted or replaced. Every line that can have a partner emits
the hash of each variant with one character left out, and its own hash; equal hashes meet, which finds insertions, deletions
(own hash against variant) and replacements (variants that miss the same position). Only the earliest line of a key is kept
as its representative, so a key shared by many lines costs one row for each line and no pairs. Partners are verified by
their edit distance.

A line can have a partner only if another line begins with the same half or ends with the same half; all others emit nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphreports.llm.common import SPACES, free_names, once, stored

MIN_CHARS = 20  # shorter lines recur for good reason, and one edit changes what they say
_SPLIT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(SPACES)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line itself (position -1) and of the line without the character at each position, and the positions.

    The hash is a polynomial in the code points, so that all variants follow from prefix sums.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes)
    power = np.ones(n, np.uint64)
    if n > 1:
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
    upto = np.cumsum(_mixed(codes * _SPLIT + np.uint64(1)) * power, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), upto[:-1]])
    whole = upto[-1] if n else np.uint64(0)
    shorter = before + (whole - upto) * _INVERSE
    sums = np.concatenate([np.array([whole], np.uint64), shorter])
    lengths = np.concatenate([np.array([n]), np.full(n, n - 1)]).astype(np.uint64)
    return _mixed(sums + lengths * _SPLIT).view(np.int64), np.arange(-1, n, dtype=np.int32)


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, positions, counts, out = [], [], [], 0
        start = 0
        for k, line in enumerate(batch["line"]):
            key, position = deletion_keys(line)
            keys.append(key), positions.append(position), counts.append(len(key))
            out += len(key)
            if out > 200_000 or k == len(batch) - 1:
                rows = batch[["doc_id", "row_key", "line_no"]].iloc[start : k + 1]
                done = rows.loc[rows.index.repeat(counts)].reset_index(drop=True)
                yield done.assign(key=np.concatenate(keys), position=np.concatenate(positions))
                keys, positions, counts, out, start = [], [], [], 0, k + 1


PLACE = ("doc_id", "row_key", "line_no")


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in PLACE])


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: its place (doc_id, hash of the text, number) and normal form."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), split)
    return rows.select(*PLACE, normal(F.col("line")).alias("line")).filter(F.length("line") >= min_chars)


def _halves(line: Column) -> Column:
    """Hashes of the halves a partner must share: a partner is as long, or one longer or shorter."""
    n = F.length(line)
    ends = []
    for kind in (0, 1):
        for h in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
            part = F.substring(line, F.lit(1), h) if kind == 0 else F.right(line, h)
            ends.append(F.xxhash64(F.lit(kind), part))
    return F.array_distinct(F.array(*ends))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each different line once: 128 bits of its hash, its earliest place, and the hashes of its halves."""
    hashed = lines.select(_place().alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), _halves(F.col("line")).alias("halves"))
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.any_value("halves").alias("halves"))


def near_repeats(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the different lines that have an earlier line within one edit."""
    halves = distinct.select("h1", "h2", "place", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("half")
    able = halves.join(shared, "half", "left_semi").select("place.*").distinct()
    texts = stored(lines.join(able, _same(lines, able), "left_semi").dropDuplicates(list(PLACE)), "line-candidates")
    keyed = texts.mapInPandas(_variants, texts.select(*PLACE).withColumn("key", F.lit(0).cast("long")).withColumn("position", F.lit(0)).schema)
    keyed = keyed.select(_place().alias("place"), "key", "position")
    by_key, by_gap = Window.partitionBy("key"), Window.partitionBy("key", "position")
    whole = F.col("position") < 0
    met = keyed.select(
        "place", "position", F.min("place").over(by_gap).alias("gap"),
        F.min(F.when(whole, F.col("place"))).over(by_key).alias("own"),
        F.min(F.when(~whole, F.col("place"))).over(by_key).alias("shorter"),
    )
    earlier = F.when(whole, F.col("shorter")).otherwise(F.least(F.col("gap"), F.coalesce("own", "gap")))
    pairs = met.select("place", earlier.alias("earlier")).filter("earlier < place").distinct()
    text = lambda name, to: texts.select(_place().alias(to), F.col("line").alias(name))
    both = pairs.join(text("a", "place"), "place").join(text("b", "earlier"), "earlier")
    return both.filter(F.levenshtein("a", "b", 1) >= 0).select("place").distinct()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"]) & (a["line_no"] == b["line_no"])


def _with_kept(docs: DataFrame, min_chars: int) -> tuple[DataFrame, Column, Column]:
    """Documents with their lines and the numbers of those that stay, in two columns whose names no column has; and these columns."""
    doc, row, first_, lines_, left_ = free_names(docs, "doc", "row", "first", "lines", "left")
    lines = lines_of(docs, min_chars)
    distinct = stored(distinct_lines(lines), "distinct-lines")
    first = distinct.join(near_repeats(lines, distinct), "place", "left_anti")
    kept = first.groupBy(F.col("place.doc_id").alias(doc), F.col("place.row_key").alias(row)).agg(F.collect_list("place.line_no").alias(first_))
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(row)), "left")
    # Split once: merged into the expressions below, the text would be split for each of its lines.
    split = joined.select("*", once(F.split(F.coalesce("text", F.lit("")), "\n"), lines_))
    short = F.filter(F.sequence(F.lit(0), F.size(lines_) - 1), lambda i: F.length(normal(F.get(lines_, i))) < min_chars)
    stays = F.array_union(short, F.coalesce(F.col(first_), F.array().cast("array<int>")))  # sets, so a text's lines cost linear time
    return split.select("*", once(F.array_sort(stays), left_)).drop(doc, row, first_), F.col(lines_), F.col(left_)


def _rest(lines: Column, left: Column) -> Column:
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """What is left of every document.

    Returns doc_id, n_lines, n_removed, removed_lines (numbers from 0) and text. A line stays if it has fewer than
    ``min_chars`` characters after trimming, or if no line at an earlier place (by doc_id, null first, then text hash, then
    number) is within one edit of it, case aside. Rows equal in doc_id and text have the same places and fare alike. A null text
    counts as one empty line; an empty table gives no rows; other columns are not read.
    """
    done, lines, left = _with_kept(docs.select("doc_id", "text"), min_chars)
    gone = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), left)
    return done.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"), _rest(lines, left).alias("text"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without repeated lines, with the columns they came with, whatever those are called; those that lose every line with a word go."""
    done, lines, numbers = _with_kept(docs, min_chars)
    whole = F.size(numbers) == F.size(lines)
    left = F.when(whole, F.col("text")).otherwise(_rest(lines, numbers))
    out = done.withColumn("text", left).filter(whole | (F.trim("text", F.lit(SPACES)) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
