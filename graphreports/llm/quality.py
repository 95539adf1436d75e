"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio of a document. Labelled documents are the holdout: in each stratum (language) the documents of good
quality that a cutoff rejects are counted, and a cutoff may be used only if the exact binomial tail shows, at the corrected
level, that it rejects at most ``risk`` / rules of good documents. Cutoffs of a rule are tested as a fixed sequence from the
one that rejects least, so their number needs no correction; strata and rules are corrected by Bonferroni. Together the rules
then reject at most ``risk`` of the good documents in every stratum, with probability 1 - ``error``. Of the allowed cutoffs
of a rule the one that parts good and bad best is taken, none if none parts them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphreports.llm.common import SPACES, once, stored, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("symbols", "repeated_lines", "repeated_words", "exclamations", "capitals", "long_words")
STEPS = 100  # cutoffs of a rule
RISK, ERROR = 0.03, 0.05


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _window_keys(w: Column, n: Column) -> Column:
    """One long per 3-word window: leading bits of its hash, then its position in as few bits as the positions need."""
    bits = F.length(F.bin(n))
    at = lambda i, k: F.get(w, i + k)
    # 63 - bits of the hash tell windows of a text apart: for 20,000 words a chance of a false repeat of 1e-6.
    key = lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))
    low = lambda i: F.call_function("shiftleft", F.call_function("shiftright", key(i), bits + 1), bits).bitwiseOR(i.cast("long"))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), low)).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame) -> DataFrame:
    """Add a struct column ``__quality`` with the counts of each whole text; all other columns stay.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a word, equal to an earlier one);
    n_repeat_words (words in a 3-word window found twice or more in the text); base_failed; and ``steps``, the ratio of each
    rule in hundredths. A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*kept, once(words(F.col("text")), "__w"))
    named = named.withColumn("__n", F.size("__w"))
    keys = named.select(*kept, "__n", once(F.sort_array(_window_keys(F.col("__w"), F.col("__n"))), "__keys"))
    bits = F.length(F.bin("__n"))
    bucket = lambda x: F.call_function("shiftright", x, bits)
    twice = F.filter("__keys", lambda x, i: (bucket(x) == bucket(F.get("__keys", i - 1))) | (bucket(x) == bucket(F.get("__keys", i + 1))))
    position = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)))
    spans = keys.select(*kept, "__n", once(position, "__at"))
    # Windows that start at sorted positions cover three words each, less what the next one covers again.
    gaps = F.transform("__at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__at", i + 1) - x, F.lit(3).cast("long"))))
    repeat_words = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    lines = spans.select(*kept, "__n", repeat_words.alias("__repeat"), once(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""), "__lines"))
    long = lambda c: c.cast("long")
    counted = lines.select(*kept, once(F.struct(
        long(F.col("__n")).alias("n_words"),
        long(F.length(_without(text, SPACES))).alias("word_chars"),
        long(F.length(text) - F.length(_without(text, SYMBOLS))).alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        long(F.size("__lines")).alias("n_lines"),
        long(F.length(text) - F.length(_without(text, CAPITALS))).alias("n_capitals"),
        long(F.length(text) - F.length(_without(text, "!"))).alias("n_exclamations"),
    ), "__c"))
    c = lambda name: F.col(f"__c.{name}")
    ratio = lambda a, b, scale=STEPS: F.when(b > 0, F.least(F.lit(STEPS), F.floor(a * scale / b))).otherwise(0).cast("int")
    steps = F.array(
        ratio(c("n_symbols"), c("word_chars")), ratio(c("n_dup_lines"), c("n_lines")), ratio(c("n_repeat_words"), c("n_words")),
        ratio(c("n_exclamations"), c("n_words")), ratio(c("n_capitals"), c("word_chars")), ratio(c("word_chars"), c("n_words"), 2),
    )
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    fields = [c(f).alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return counted.select(*kept, F.struct(*fields, failed.alias("base_failed"), steps.alias("steps")).alias("__quality"))


def allowed_rejections(n: Column, risk: float, level: Column) -> Column:
    """The most good documents of ``n`` a cutoff may reject: the largest k with P(Binomial(n, risk) <= k) <= level; -1 if none.

    Terms are summed as logarithms, so that large ``n`` neither underflows nor needs tables.
    """
    odds = math.log(risk / (1 - risk))
    term = lambda s, i: s["term"] + F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1) / F.greatest(i, F.lit(1))) + F.lit(odds))
    both = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    def step(s: Column, i: Column) -> Column:
        total = F.when(i == 0, term(s, i)).otherwise(both(s["total"], term(s, i)))
        return F.struct(term(s, i).alias("term"), total.alias("total"), (s["k"] + (total <= F.log(level)).cast("int")).alias("k"))

    start = F.struct((n * math.log1p(-risk)).alias("term"), F.lit(0.0).alias("total"), F.lit(-1).alias("k"))
    upto = F.least(F.ceil(n * risk), n).cast("int")
    return F.aggregate(F.sequence(F.lit(0), upto), start, step, lambda s: s["k"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum: ``cutoff``, for each rule the step from which it rejects, null where it may not or need not.

    Labels are doc_id and quality (1 good, 0 bad); several of a document count as bad if one is; null ones are left out.
    """
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    seen = measured.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "__quality").filter("not __quality.base_failed").join(one, "doc_id")
    held = seen.select("stratum", "good", F.posexplode("__quality.steps").alias("rule", "step"))
    sums = held.groupBy("stratum", "rule", "step").agg(F.sum((F.col("good") > 0).cast("long")).alias("good"), F.sum((F.col("good") <= 0).cast("long")).alias("bad"))
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    curve = sums.select("stratum", "rule", "step", *[F.sum(x).over(above).alias(f"{x}_cut") for x in ("good", "bad")], *[F.sum(x).over(group).alias(f"n_{x}") for x in ("good", "bad")])
    sizes = curve.select("stratum", F.col("n_good").alias("n")).distinct()
    strata = F.count(F.lit(1)).over(Window.partitionBy())
    limits = sizes.select("stratum", "n", (F.lit(error) / (strata * len(RULES))).alias("level"))
    limits = limits.select("stratum", allowed_rejections(F.col("n"), risk / len(RULES), F.col("level")).alias("most"))
    parts = F.col("bad_cut") / F.greatest("n_bad", F.lit(1)) - F.col("good_cut") / F.greatest("n_good", F.lit(1))
    usable = curve.join(limits, "stratum").filter((F.col("good_cut") <= F.col("most")) & (parts > 0) & (F.col("step") > 0))
    best = usable.groupBy("stratum", "rule").agg(F.max(F.struct(parts.alias("gain"), "step")).alias("best"))
    pick = lambda k: F.max(F.when(F.col("rule") == k, F.col("best.step")))
    return best.groupBy("stratum").agg(F.array(*[pick(k) for k in range(len(RULES))]).alias("cutoff"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``__kept``: false if a base rule fails, else whether no rule reaches its cutoff in the document's stratum."""
    # Stored, so that the planner knows its size and sends it to the texts if it is small, instead of shuffling the texts.
    named = stored(limits.select(F.col("stratum").alias("__stratum"), "cutoff"), "cutoffs")
    joined = measured.join(named, F.coalesce(measured["lang"], F.lit("")) == F.col("__stratum"), "left")
    hit = [F.coalesce(F.get("__quality.steps", F.lit(k)) >= F.get("cutoff", F.lit(k)), F.lit(False)) for k in range(len(RULES))]
    rejected = F.col("__quality.base_failed")
    for h in hit:
        rejected = rejected | h
    return joined.withColumn("__kept", ~rejected).drop("__stratum", "cutoff")


def report(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A null or empty text has
    no words and fails the base rule; rows that repeat are judged alike; without labels only base rules reject; a null
    language is a stratum of its own; empty tables give no rows; other columns are not read.
    """
    measured = stored(measure(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    judged = judge(measured, cutoffs(measured, labels, risk, error))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc_id", *[F.col(f"__quality.{f}").alias(f) for f in fields], F.col("__kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that are kept, with the columns they came with, whatever those are called."""
    others = [c for c in docs.columns if c not in ("doc_id", "lang", "text")]
    renamed = docs.select("doc_id", "lang", "text", *[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(others)])
    measured = stored(measure(renamed), "quality")
    judged = judge(measured, cutoffs(measured, labels, risk, error))
    back = {c: F.col(f"own_{k}").alias(c) for k, c in enumerate(others)}
    return judged.filter("__kept").select(*[back.get(c, F.col(c)) for c in docs.columns])
