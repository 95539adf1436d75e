"""Conversation structure repair by prefix-doubling path ranking.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Each row is kept (cost 0), given the role user or assistant (2) or
deleted (3), and empty user or assistant rows can be put anywhere (2 each); a truncated row that stays costs 1 more, a blank or repeated one
has to go. These edits are the arcs of a graph whose nodes are a place between rows and a state of the pattern. A dynamic programme gives
each node the cost of the cheapest way to the end; an arc is optimal if it leads on at that cost. The audit of a path is the
initials of its edits, D, I, K or R. Nodes are ranked by their least audit of one letter, then two, four and so on: the rank for a length
is that of the pair of ranks for half of it, of the node and of the node its pointer reaches, and pointers are doubled with it. No two optimal arcs
of a node have the same letter, so each length has one least path, which the doubled pointers spell out from the start.

No task holds a conversation whole. Rows are numbered by a sort over ranges, so a long conversation lies in several partitions; each of its
segments becomes a string of one letter a row. Costs of the 4 states behind a segment follow from those before it by a matrix in
the (min, +) sense, so segments are chained by 16 numbers each. The texts are read in order last, as the digest of a
conversation needs them, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from graphreports.llm.common import SPACES, stored

# States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = np.array([USER, USER, ASSISTANT, USER])  # the state behind a row that is put in or given the role the pattern wants
ROLES = "sua"  # initials; any other role has number 3
FINE, TRUNCATED, BLANK, REPEATED = range(4)  # faults
END = 16  # kind of the end of a conversation; a row's kind is 4 * role + fault
NEVER = 1 << 40
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_DELETE, _INSERT, _KEEP, _REROLE = range(1, 5)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By kind of row: cost of deleting, cost and state of keeping by state before, cost of a new role."""
    delete, keep, to, rerole = np.full(17, 3), np.full((17, 4), NEVER), np.zeros((17, 4), np.int64), np.full(17, NEVER)
    for kind in range(16):
        role, fault = divmod(kind, 4)
        if fault in (FINE, TRUNCATED):
            rerole[kind] = 2 + (fault == TRUNCATED)
            for state in range(4):
                if role == 0 and state == START or role in (1, 2) and ADDED[state] == role + 1:
                    keep[kind, state], to[kind, state] = int(fault == TRUNCATED), role + 1
    delete[END] = NEVER
    for state in (START, ASSISTANT):  # the end is passed, with no letter, in the states that the pattern may end in
        keep[END, state], to[END, state] = 0, state
    return delete, keep, to, rerole


_DELETED, _KEPT, _KEPT_TO, _REROLED = _tables()


def _step(kinds: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Cost of the cheapest way from each state before a row, given those behind it. (texts, ends, 4)"""
    kept = np.take_along_axis(behind, np.broadcast_to(_KEPT_TO[kinds][:, None], behind.shape), axis=2) + _KEPT[kinds][:, None]
    w = np.minimum(np.minimum(behind + _DELETED[kinds][:, None, None], kept), behind[..., ADDED] + _REROLED[kinds][:, None, None])
    user, assistant = np.minimum(w[..., USER], 2 + w[..., ASSISTANT]), np.minimum(w[..., ASSISTANT], 2 + w[..., USER])
    return np.minimum(np.stack([np.minimum(w[..., START], 2 + user), np.minimum(w[..., SYSTEM], 2 + user), user, assistant], axis=-1), NEVER)


def matrices(kinds: np.ndarray) -> np.ndarray:
    """For segments of one length, the cost from each state before to each state behind. (texts, behind, before)"""
    cost = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(kinds), 4, 4))
    for k in range(kinds.shape[1] - 1, -1, -1):
        cost = _step(kinds[:, k], cost)
    return cost


def _arcs(kinds: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least letter of an optimal arc of each node and the node it leads to; a node is 4 * place + state, counted through all segments.
    Nodes behind the last row, and such as lead nowhere, have no letter and lead to themselves."""
    texts, rows = kinds.shape
    size = 4 * (rows + 1)
    letter, to = np.zeros((texts, size), np.int64), np.tile(np.arange(size), (texts, 1))
    cost = behind[:, None]
    states = np.arange(4)
    for k in range(rows - 1, -1, -1):
        kind, after = kinds[:, k], cost[:, 0]
        cost = _step(kind, cost)
        here = cost[:, 0]
        kept = np.take_along_axis(after, _KEPT_TO[kind], axis=1) + _KEPT[kind]
        ways = (
            (_DELETE, after + _DELETED[kind][:, None], 4 * (k + 1) + states),
            (_INSERT, here[:, ADDED] + 2, 4 * k + ADDED),
            (_KEEP, kept, 4 * (k + 1) + _KEPT_TO[kind]),
            (_REROLE, after[:, ADDED] + _REROLED[kind][:, None], 4 * (k + 1) + ADDED),
        )
        own, own_to = letter[:, 4 * k : 4 * k + 4], to[:, 4 * k : 4 * k + 4]
        for name, total, target in reversed(ways):  # the least letter is written last
            best = (total == here) & (here < NEVER)
            own[best] = name
            own_to[best] = np.broadcast_to(target, best.shape)[best]
        own[(kind == END)[:, None] & (own == _KEEP)] = 0  # the end has no letter
    return letter.ravel(), (to + size * np.arange(texts)[:, None]).ravel()


def ranked(letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of each node by its least audit, and its pointers over 1, 2, 4, ... letters, until every path has ended."""
    rank, pointers = letter, [to]
    while True:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[to], return_inverse=True)[1].astype(np.int64)
        further = to[to]
        if (further == to).all():
            return rank, pointers
        to = further
        pointers.append(to)


def audits(kinds: np.ndarray, behind: np.ndarray, entries: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For segments of one length: the least of the cheapest audits from each of the ``entries`` (states), and the state each ends in."""
    texts, rows = kinds.shape
    letter, to = _arcs(kinds, behind)
    _, pointers = ranked(letter, to)
    first = 4 * (rows + 1) * np.arange(texts)[:, None] + entries[None]
    path = first.reshape(-1, 1)
    for p in pointers:
        path = np.concatenate([path, p[path]], axis=1)
    spelt = LETTERS[letter[path]]
    found = [row.tobytes().replace(b"\0", b"").decode() for row in spelt]
    n = len(entries)
    return [found[k * n : k * n + n] for k in range(texts)], (pointers[-1][first] % 4).astype(np.int64)


def _by_length(codes: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Segments of equal length together, as many as fit a bounded number of nodes: their places and kinds."""
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    start = 0
    while start < len(order):
        n = len(codes[order[start]])
        stop = start + 1
        while stop < len(order) and len(codes[order[stop]]) == n and (stop - start) * (n + 1) < 100_000:
            stop += 1
        some = order[start:stop]
        yield some, np.frombuffer("".join(codes[k] for k in some).encode(), np.uint8).reshape(len(some), n).astype(np.int64) - ord("a")
        start = stop


def _ended(codes: str) -> str:
    return codes + chr(ord("a") + END)


# --- rows to segments


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest of the text and kind of each row; a null role or text is one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    inner = F.trim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(inner == "", BLANK).when(F.substring(inner, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "*", F.unhex(F.sha2("text", 256)).alias("digest"), (4 * number + fault).alias("kind")
    )


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, part, codes (a letter for the kind of each row, in order), and the turn, role and digest of the first row.

    Rows are in order of conversation, turn (nulls first), role and digest; equal rows stand side by side. A segment is what a range of that order holds of a conversation.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    narrow = rows.select("conv_id", "turn", "role", "digest", "kind").withColumn("tie", F.monotonically_increasing_id())
    numbered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("tie")
    placed = stored(numbered, "conversation-rows")
    blank = F.col("kind") % 4 == BLANK
    first = placed.filter(~blank).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    again = ~blank & F.col("new").isNull()
    kind = F.when(again, F.col("kind") - F.col("kind") % 4 + REPEATED).otherwise(F.col("kind"))
    told = placed.join(first, "pos", "left").withColumn("code", F.char(kind + ord("a")))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    return told.groupBy("conv_id", F.shiftright("pos", 33).cast("int").alias("part")).agg(
        F.array_join(letters, "").alias("codes"), F.min(F.struct("pos", "turn", "role", "digest")).alias("first")
    ).select("conv_id", "part", "codes", "first.turn", "first.role", "first.digest")


@pandas_udf(T.ArrayType(T.StringType()))
def _audit(codes: pd.Series) -> pd.Series:
    """The audit of conversations in one segment."""
    out: list[list[str]] = [[]] * len(codes)
    for some, kinds in _by_length([_ended(c) for c in codes]):
        for k, found in zip(some, audits(kinds, np.zeros((len(some), 4), np.int64), np.array([START]))[0], strict=True):
            out[k] = found
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.LongType()))
def _matrix(codes: pd.Series, last: pd.Series) -> pd.Series:
    out: list[list[int]] = [[]] * len(codes)
    for some, kinds in _by_length([_ended(c) if end else c for c, end in zip(codes, last, strict=True)]):
        for k, m in zip(some, matrices(kinds), strict=True):
            out[k] = m.ravel().tolist()
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _chain(found: pd.Series) -> pd.Series:
    """Costs of the states behind each segment of a conversation, from the matrices of its segments in order."""
    out = []
    for segments_of in found:
        behind, costs = np.zeros(4, np.int64), []
        for m in reversed(list(segments_of)):
            costs.append(behind.tolist())
            behind = np.minimum((np.asarray(m, np.int64).reshape(4, 4) + behind[:, None]).min(axis=0), NEVER)
        out.append(costs[::-1])
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.StringType()))
def _audits(codes: pd.Series, last: pd.Series, behind: pd.Series) -> pd.Series:
    """The audits of segments from each of the four states before them."""
    out: list[list[str]] = [[]] * len(codes)
    costs = np.array([list(c) for c in behind], np.int64).reshape(-1, 4)
    for some, kinds in _by_length([_ended(c) if end else c for c, end in zip(codes, last, strict=True)]):
        for k, found in zip(some, audits(kinds, costs[some], np.arange(4))[0], strict=True):
            out[k] = found
    return pd.Series(out)


def audited(rows: DataFrame) -> DataFrame:
    """:func:`segments` with ``pieces``: the audit of each, one for a conversation in one segment, else one for each state before it."""
    parts = stored(segments(rows), "conversation-segments")
    # Between two neighbouring ranges lies one conversation at most, so there are fewer of these than partitions.
    spans = parts.groupBy(F.col("conv_id").alias("id")).agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    both = parts.join(F.broadcast(spans), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id", "low")
    one = both.filter(F.col("high").isNull()).drop("high").withColumn("pieces", _audit("codes"))
    many = both.filter(F.col("high").isNotNull()).withColumn("last", F.col("part") == F.col("high")).drop("high")
    found = many.select("conv_id", "part", _matrix("codes", "last").alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("all"))
    costs = found.select("conv_id", F.explode(F.arrays_zip(F.col("all.part").alias("part"), _chain(F.col("all.m")).alias("behind"))).alias("x"))
    costs = costs.select(F.col("conv_id").alias("id"), F.col("x.part").alias("at"), "x.behind")
    same = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("at"))
    return one.unionByName(many.join(costs, same).withColumn("pieces", _audits("codes", "last", "behind")).select(*one.columns))


# --- segments and texts to repaired conversations


class _Conversation:
    """What is known of a conversation while its rows come by."""

    def __init__(self) -> None:
        self.gaps = self.illegal = self.cost = self.rows = self.said = 0
        self.faults = [0, 0, 0, 0]
        self.waiting: list[tuple[str, list[str]]] = []
        self.codes = self.piece = ""
        self.row = self.letter = 0
        self.state, self.before = START, -1
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((("\n" if self.said else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.said += 1
        return role, text

    def _wanted(self) -> str:
        self.state = int(ADDED[self.state])
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> Iterator[tuple[str, str]]:
        """Rows put in before the next row, or at the end."""
        while self.letter < len(self.piece) and self.piece[self.letter] == "I":
            self.letter += 1
            self.cost += 2
            yield self._say(self._wanted(), "")

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Rows that come of one row."""
        if self.row == len(self.codes):
            self.codes, pieces = self.waiting.pop(0)
            self.piece = pieces[self.state if len(pieces) > 1 else 0]
            self.audit.append(self.piece)
            self.row = self.letter = 0
        yield from self.inserts()
        number, fault = divmod(ord(self.codes[self.row]) - ord("a"), 4)
        edit = self.piece[self.letter]
        self.row += 1
        self.letter += 1
        self.faults[fault] += 1
        self.illegal += self.before >= 0 and (self.before, number) not in ((0, 1), (1, 2), (2, 1))
        self.before = number
        if edit == "D":
            self.cost += 3
            return
        self.cost += (fault == TRUNCATED) + 2 * (edit == "R")
        if edit == "K":
            self.state = number + 1
        yield self._say(self._wanted() if edit == "R" else role, text)

    def summary(self) -> tuple:
        return self.gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _stream(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Audits and texts of each conversation in one order: its gaps, then before the first row of each segment that segment's audit."""
    order = ["id", "lead", F.col("turn").asc_nulls_first(), "role", "digest", "flag", "part"]
    texts = rows.select("conv_id", "turn", "role", "digest", "text", F.lit(1).alias("lead"), F.lit(1).alias("flag"))
    parts = audited(rows).withColumns({"lead": F.lit(1), "flag": F.lit(0)})
    known = gaps.withColumn("lead", F.lit(0))
    all_rows = known.unionByName(parts, True).unionByName(texts, True).withColumn("id", F.col("conv_id").cast("string"))
    return all_rows.repartition("id").sortWithinPartitions(*order).select("id", "lead", "flag", "gaps", "codes", "pieces", "role", "text")


def _walk(b: Iterator[pd.DataFrame]) -> Iterator[tuple[object, _Conversation, list[tuple[str, str]], bool]]:
    """(id, conversation, rows said, whether it is over), as rows come by."""
    now, here = None, None
    for batch in b:
        for id_, lead, flag, gaps, codes, pieces, role, text in zip(*[batch[c] for c in batch.columns], strict=True):
            if here is None or id_ != now:
                if here is not None:
                    yield now, here, list(here.inserts()), True
                now, here = id_, _Conversation()
            if lead == 0:
                here.gaps += int(gaps)
            elif flag == 0:
                here.waiting.append((codes, list(pieces)))
            else:
                yield now, here, list(here.take(role, text)), False
        yield now, here, [], False
    if here is not None:
        yield now, here, list(here.inserts()), True


def gaps_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps): 0 for each of ``ids``, and for each conversation with turns the turns that are missing between its first and last."""
    counted = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    return ids.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("gaps")).unionByName(counted)


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv_id, place (from 0), role and text. Rows put in have an empty text.

    Nulls in role or text are one space; null turns come first; rows of one turn are ordered by role and digest of the text; equal rows are repeats;
    rows without a conversation are one conversation; other columns are not read; an empty table gives no rows.
    """
    kind = rows.schema["conv_id"].dataType

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["id", "place", "role", "text"], []
        for id_, conversation, said, _ in _walk(batches):
            out += [(id_, conversation.said - len(said) + k, role, text) for k, (role, text) in enumerate(said)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    table = keyed(rows)
    said = _stream(table, gaps_of(table, table)).mapInPandas(of, "id string, place long, role string, text string")
    return said.select(F.col("id").cast(kind).alias("conv_id"), "place", "role", "text")


def summarised(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Edge cases as in :func:`repaired`;
    a conversation without rows has zeros, an empty audit and the digest of the empty string."""
    kind = ids.schema["conv_id"].dataType

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for id_, conversation, _, over in _walk(batches):
            if over:
                out.append((id_, *conversation.summary()))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["id", *_SUMMARY])
                out = []
        yield pd.DataFrame(out, columns=["id", *_SUMMARY])

    table = keyed(rows)
    schema = "id string, " + ", ".join(f"{c} long" for c in _SUMMARY[:6]) + ", audit string, repaired_sha256 string"
    told = _stream(table, gaps_of(table, ids)).mapInPandas(of, schema)
    return told.select(F.col("id").cast(kind).alias("conv_id"), *_SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query's contract, by a checksum of conversation and turn; a null in either is one space there, as in role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = part("text")
    some = rows.select("conv_id", "turn", "role", "text", hit.alias("hit")).filter("hit != 0")
    return some.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(part("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation after ``damaged``, as :func:`summarised` has it."""
    return summarised(damaged(conversations), conversations)
