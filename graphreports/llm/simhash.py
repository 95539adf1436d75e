"""SimHash fingerprints and their near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into partitions, correlated bits together. Partition i gets u_i >= 0 units, in all one more than the
bound on differing bits. If two fingerprints differ in at most that bound, some partition differs in fewer than u_i bits: so it
is enough to look, in each partition with u_i units, for values that differ in at most u_i - 1 bits. Number of partitions and
units come from a dynamic program over estimated candidate counts; they decide the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from graphreports.llm.common import free_names, stored
from graphreports.llm.components import components
from graphreports.runtime import cut_lineage

BOUND = 4  # differing bits
WIDTH = 4  # words of a shingle
BLOCK = 2048  # fingerprints of a bucket that one task compares with as many others
SAMPLE = 2048  # fingerprints whose pairs estimate candidate counts


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Majority of the bits of XXH64 (seed 42) over all word shingles of the lower-cased text, as a signed 64-bit number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    k = min(width, len(found))
    n = len(found) - k + 1
    stop = (start + size)[k - 1 :]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        spans = zip(start[at : min(n, at + 16384)].tolist(), stop[at : at + 16384].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` of every document; no words give 0."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({**{k: b[k] for k in keys}, "fp": np.array([fingerprint(t, width) for t in b["text"]], np.int64)})

    return docs.select(*keys, "text").mapInPandas(of, docs.select(*keys).withColumn("fp", F.lit(0).cast("long")).schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many both of any two bits are set; 4,096 sums, over all of them."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b["fp"].to_numpy()).astype(np.float32)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(4096), "n": total.astype(np.int64).ravel()})

    rows = fps.select("fp").mapInPandas(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros(4096)
    for r in rows:
        joint[r["cell"]] = r["n"]
    return fps.count(), joint.reshape(64, 64)


def partition_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of nearly equal width; each takes the bits most correlated with those it has."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(alike, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(sorted(free), key=lambda b: alike[b, sorted(free)].sum())]
        free -= set(group)
        while len(group) < width:
            group.append(max(sorted(free), key=lambda b: alike[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _within(n: int, joint: np.ndarray, sample: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1 ... ``most`` bits of a group."""
    p = np.diag(joint)[group] / max(n, 1)
    share = np.zeros(len(group) + 1)
    share[0] = 1
    for q in 2 * p * (1 - p):
        share[1:] = share[1:] * (1 - q) + share[:-1] * q
        share[0] *= 1 - q
    told = np.cumsum(share)[: most + 1]
    if len(sample) > 1:
        value = sample & np.uint64(sum(1 << b for b in group))
        seen = np.zeros(65)
        for at in range(0, len(value), 256):
            seen += np.bincount(np.bitwise_count(value[at : at + 256, None] ^ value[None, :]).ravel(), minlength=65)
        seen[0] -= len(value)
        told = np.maximum(told, np.cumsum(seen)[: most + 1] / (len(value) * (len(value) - 1)))
    return told


def allocate(n: int, joint: np.ndarray, sample: np.ndarray, bound: int = BOUND) -> list[tuple[list[int], int]]:
    """Partitions with the number of bits each may differ in: the cheapest by estimate over 2 to ``2 * bound`` partitions.

    A probe costs as much as 200 comparisons. Partitions that get no unit are not probed.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, 2 * bound + 1):
        groups = partition_bits(n, joint, parts)
        cost = []  # by partition and units
        for g in groups:
            share = _within(n, joint, sample, g, bound)
            probes = np.cumsum([comb(len(g), t) for t in range(bound + 1)])
            cost.append([0.0] + [200.0 * n * probes[t] / (2 if t else 1) + n * n / 2 * share[t] for t in range(bound + 1)])
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            table = {u: min((table[v][0] + c[u - v], [*table[v][1], u - v]) for v in table if v <= u) for u in range(bound + 2)}
        if table[bound + 1][0] < best[0]:
            best = (table[bound + 1][0], [(g, u - 1) for g, u in zip(groups, table[bound + 1][1], strict=True) if u])
    return best[1]


def _flips(group: list[int], most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for t in range(1, most + 1) for c in combinations(group, t)], np.uint64)


def probe(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (bucket, part, fp, own): each fingerprint at its own value and at those larger values it may differ by."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for k, (group, most) in enumerate(plan):
                value = fp & np.uint64(sum(1 << b for b in group))
                yield pd.DataFrame({"part": np.int32(k), "bucket": value.view(np.int64), "fp": fp.view(np.int64), "own": True})
                for flip in _flips(group, most):
                    near = value ^ flip
                    up = near > value
                    yield pd.DataFrame({"part": np.int32(k), "bucket": near[up].view(np.int64), "fp": fp[up].view(np.int64), "own": False})

    return fps.select("fp").mapInPandas(emit, "part int, bucket long, fp long, own boolean")


def forest(fp: np.ndarray, own: np.ndarray, side: np.ndarray, cross: bool, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what is linked among the rows of one block pair, at most one for each row.

    Rows are compared if one of them at least is at its own value and, for a pair of different blocks, if they come from both.
    """
    n = len(fp)
    value, root, open_ = fp.view(np.uint64), np.arange(n), np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        edge = np.array([seed])
        while len(edge):
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(edge), 256):
                e = edge[at : at + 256]
                near = np.bitwise_count(value[e][:, None] ^ value[rest][None, :]) <= bound
                near &= own[e][:, None] | own[rest][None, :]
                if cross:
                    near &= side[e][:, None] != side[rest][None, :]
                reached |= near.any(axis=0)
            edge = rest[reached]
            root[edge], open_[edge] = seed, False
    linked = np.flatnonzero(root != np.arange(n))
    return fp[root[linked]], fp[linked]


def links(fps: DataFrame, plan: list[tuple[list[int], int]], bound: int = BOUND, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that connect every two fingerprints within ``bound`` bits, directly or through others.

    A bucket of more than ``block`` rows is cut into blocks, and each two blocks meet in one place, so no task holds more than two.
    """
    probed = stored(probe(fps, plan), "probes")
    sizes = probed.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("met")).filter("n > 1 and met")
    blocks = sizes.select("part", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    there = probed.join(blocks, ["part", "bucket"])
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = there.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "own", "mine")
    keys = ["part", "bucket", "lo", "hi"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None

        def linked(rows: pd.DataFrame) -> pd.DataFrame:
            values = rows[keys].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            fp, own, side = rows["fp"].to_numpy(), rows["own"].to_numpy(bool), rows["mine"].to_numpy()
            a, b = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                x, y = forest(fp[s:e], own[s:e], side[s:e], values[s][2] != values[s][3], bound)
                a.append(x), b.append(y)
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            left = rows.iloc[first:].reset_index(drop=True)  # the last group may go on in the next batch
            if first:
                yield linked(rows.iloc[:first])
        if left is not None and len(left):
            yield linked(left)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long").distinct()


def roots_of(fps: DataFrame, bound: int = BOUND) -> DataFrame:
    """(fp, root) of different fingerprints."""
    n, joint = bit_counts(fps)
    place = F.xxhash64("fp", F.lit(3))
    near = fps.filter(F.pmod(place, F.lit(max(n, 1))) < 2 * SAMPLE)  # about twice as many, from all partitions together
    sample = near.orderBy(place, "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = allocate(n, joint, sample, bound)
    roots = components(links(fps, plan, bound)).withColumnRenamed("node", "fp")
    return fps.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components_of(hashed: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, fp) of documents to (doc_id, fp, component_id)."""
    fps = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    grouped = fps.join(roots_of(fps, bound), "fp")
    first = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(first, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, bound: int = BOUND, width: int = WIDTH) -> DataFrame:
    """Class of every document.

    Returns doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links; null ids count only
    if there is no other). Null, empty and blank texts have fingerprint zero and are linked like any other; rows that repeat
    stay rows; an empty table gives no rows; other columns are not read.
    """
    found = components_of(cut_lineage(fingerprints(docs, width)), bound)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bound: int = BOUND, width: int = WIDTH) -> DataFrame:
    """One document of each class, that of the smallest doc_id (of its rows, the one of the first text), with the columns it came with,
    whatever those are called.

    A class is known by its texts: rows without a doc_id, and texts that share one, stand for their own classes. Null ids count
    only if the class has no other.
    """
    *hashes, one, two, root_, first_, nth = free_names(docs, "h1", "h2", "chosen1", "chosen2", "root", "first", "nth")
    hashed = docs.withColumns({hashes[0]: F.xxhash64("text"), hashes[1]: F.xxhash64(F.lit(7), "text")})
    fps = cut_lineage(fingerprints(hashed, width, tuple(hashes)).distinct())
    roots = roots_of(cut_lineage(fps.select("fp").distinct()), bound).withColumnRenamed("root", root_)
    least = hashed.groupBy(*hashes).agg(F.min("doc_id").alias("id"))
    texts = cut_lineage(fps.join(roots, "fp").join(least, hashes).select(*hashes, "id", root_))
    first = texts.groupBy(root_).agg(F.min("id").alias(first_))
    chosen = texts.join(first, root_).filter(F.col("id").eqNullSafe(F.col(first_))).select(F.col(hashes[0]).alias(one), F.col(hashes[1]).alias(two), root_, first_)
    same = F.col("doc_id").eqNullSafe(F.col(first_)) & (F.col(hashes[0]) == F.col(one)) & (F.col(hashes[1]) == F.col(two))
    kept = hashed.join(chosen, same)
    alike = Window.partitionBy(root_).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn(nth, F.row_number().over(alike)).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
