"""Exact distinct counts per unit.

All metrics start from ``unit_session`` or ``unit_item`` (see ``sessions``), whose rows are already
distinct per unit. Metrics differ on purpose in whether they require a planned start and a typed
item. Nothing is grouped by unit before it is reduced to distinct rows, which are spread over all
tasks by the counted resource: a unit with most of the data costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphreports.operators.resources import non_zero
from graphreports.operators.sessions import UNIT, unit_items, unit_sessions, with_planned_start
from graphreports.runtime import stored
from graphreports.vocabulary import METRIC_LABELS, RDF_TYPE

ITEM = ["harvester", "item_uri"]
Tables = Mapping[str, DataFrame]


def _count_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))


def _count_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(*UNIT).agg(F.count_distinct(column).alias("n"))


def items_without(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items that have no row in ``links``."""
    return items.join(links.select(*ITEM).distinct(), ITEM, "left_anti")


def started_typed(unit_item: DataFrame, item: DataFrame) -> DataFrame:
    """Typed agenda items of sessions with a planned start."""
    return unit_item.filter("started").join(item.select(*ITEM).distinct(), ITEM, "left_semi")


def session_count(unit_session: DataFrame) -> DataFrame:
    return _count_rows(unit_session.filter("started"))


def item_count(unit_item: DataFrame) -> DataFrame:
    return _count_rows(unit_item)


def item_resolutions(tables: Tables) -> DataFrame:
    """``(harvester, item_uri, resolution_uri)`` of typed resolutions."""
    typed = tables["handling_resolution"].join(
        tables["resolution"].distinct(), ["harvester", "resolution_uri"], "left_semi"
    )
    return (
        tables["handling_subject"]
        .join(typed, ["harvester", "handling_uri"])
        .select(*ITEM, "resolution_uri")
    )


def item_votes(tables: Tables) -> DataFrame:
    """``(harvester, item_uri, vote_uri)``."""
    return (
        tables["handling_subject"]
        .join(tables["handling_vote"], ["harvester", "handling_uri"])
        .select(*ITEM, "vote_uri")
    )


def resolution_count(typed_item: DataFrame, tables: Tables) -> DataFrame:
    return _count_distinct(typed_item.join(item_resolutions(tables), ITEM), "resolution_uri")


def vote_count(unit_item: DataFrame, tables: Tables) -> DataFrame:
    """Votes on items of sessions with a planned start; the item need not be typed."""
    return _count_distinct(unit_item.filter("started").join(item_votes(tables), ITEM), "vote_uri")


def duplicate_titles(typed_item: DataFrame, tables: Tables) -> DataFrame:
    """``(harvester, unit_uri, title…, n)`` of titles used by two or more items that come from
    more than one document.

    Whether a title has more than one document only needs the lowest and the highest of them, so
    documents are reduced per item first and do not multiply the titles."""
    docs = tables["item_doc"].groupBy(*ITEM).agg(
        F.min("doc_uri").alias("low_doc"), F.max("doc_uri").alias("high_doc")
    )
    title = ["title", "title_datatype", "title_lang"]
    return (
        typed_item.join(tables["item_title"], ITEM)
        .join(docs, ITEM)
        .groupBy(*UNIT, *title)
        .agg(
            F.count_distinct("item_uri").alias("n"),
            F.min("low_doc").alias("low_doc"),
            F.max("high_doc").alias("high_doc"),
        )
        .filter((F.col("n") >= 2) & (F.col("low_doc") < F.col("high_doc")))
        .select(*UNIT, *title, "n")
    )


def duplicate_count(typed_item: DataFrame, tables: Tables) -> DataFrame:
    """Sum over duplicate titles; an item with two such titles counts twice."""
    return duplicate_titles(typed_item, tables).groupBy(*UNIT).agg(F.sum("n").alias("n"))


def with_zeros(counts: DataFrame, units: DataFrame) -> DataFrame:
    """A row for every unit, 0 where it has no count."""
    return (
        units.select(*UNIT)
        .join(counts, UNIT, "left")
        .select(*UNIT, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    )


# One function per metric, for use on its own.


def _prefix(tables: Tables, unit_body: DataFrame) -> tuple[DataFrame, DataFrame]:
    sessions = unit_sessions(tables["session"], unit_body)
    return sessions, unit_items(sessions, tables["session_item"])


def count_sessions(tables: Tables, unit_body: DataFrame) -> DataFrame:
    return session_count(_prefix(tables, unit_body)[0])


def count_items(tables: Tables, unit_body: DataFrame) -> DataFrame:
    return item_count(_prefix(tables, unit_body)[1])


def count_items_without_title(tables: Tables, unit_body: DataFrame) -> DataFrame:
    typed = started_typed(_prefix(tables, unit_body)[1], tables["item"])
    return _count_rows(items_without(typed, tables["item_title"]))


def count_items_without_description(tables: Tables, unit_body: DataFrame) -> DataFrame:
    typed = started_typed(_prefix(tables, unit_body)[1], tables["item"])
    return _count_rows(items_without(typed, tables["item_description"]))


def count_resolutions(tables: Tables, unit_body: DataFrame) -> DataFrame:
    typed = started_typed(_prefix(tables, unit_body)[1], tables["item"])
    return resolution_count(typed, tables)


def count_votes(tables: Tables, unit_body: DataFrame) -> DataFrame:
    return vote_count(_prefix(tables, unit_body)[1], tables)


def count_duplicate_items(tables: Tables, unit_body: DataFrame) -> DataFrame:
    typed = started_typed(_prefix(tables, unit_body)[1], tables["item"])
    return duplicate_count(typed, tables)


# Bits of what is known about an item.
TYPED, TITLED, DESCRIBED = 1, 2, 4


def item_flags(tables: Tables) -> DataFrame:
    """``(harvester, item_uri, flags)`` of items that are typed, titled or described. The three
    tables meet in one aggregation instead of one join each; a task sends an item once."""
    parts = [("item", TYPED), ("item_title", TITLED), ("item_description", DESCRIBED)]
    marked = [tables[name].select(*ITEM, F.lit(bit).alias("flag")) for name, bit in parts]
    return reduce(DataFrame.unionByName, marked).groupBy(*ITEM).agg(F.bit_or("flag").alias("flags"))


def flagged_items(unit_item: DataFrame, tables: Tables) -> DataFrame:
    """``unit_item`` with the ``flags`` of the item, NULL for one that has none."""
    return unit_item.join(item_flags(tables), ITEM, "left")


def typed_of(flagged: DataFrame) -> DataFrame:
    """As :func:`started_typed`, from items with their flags.

    The condition needs both sides of the join above, so it stays behind it and the join's shuffles are those of all items."""
    return flagged.filter(F.when(F.col("started"), F.col("flags")).bitwiseAND(F.lit(TYPED)) == TYPED)


def item_counts(flagged: DataFrame) -> DataFrame:
    """The three counts that need no more than a flag per item, in one pass over the items."""
    without = lambda bit: F.count_if(
        F.col("started") & (F.col("flags").bitwiseAND(F.lit(TYPED | bit)) == TYPED)
    )
    return flagged.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("items"),
        without(TITLED).alias("items_without_title"),
        without(DESCRIBED).alias("items_without_description"),
    )


def unit_metrics(tables: Tables, unit_body: DataFrame) -> DataFrame:
    """``(harvester, unit_uri, metric, n)`` with the seven metrics, zero counts left out, and
    nothing at all for a unit without planned sessions.

    The branches share the shuffles that reduce items to distinct rows per unit and bring them to their flags. What is
    combined afterwards is one row per unit and metric. Sessions, and links from items to resolutions and votes, which need no units, are
    set down before: the shuffles they come from are gone when those of items begin."""
    sessions = stored(unit_sessions(tables["session"], unit_body))
    items = unit_items(sessions, tables["session_item"])
    resolutions, votes = stored(item_resolutions(tables)), stored(item_votes(tables))
    flagged = flagged_items(items, tables)
    typed = typed_of(flagged)
    one = lambda name, df: df.select(*UNIT, F.lit(name).alias("metric"), "n")
    flags = item_counts(flagged).unpivot(
        UNIT, ["items", "items_without_title", "items_without_description"], "metric", "n"
    )
    counts = (
        one("sessions", session_count(sessions))
        .unionByName(flags)
        .unionByName(one("resolutions", _count_distinct(typed.join(resolutions, ITEM), "resolution_uri")))
        .unionByName(one("votes", _count_distinct(items.filter("started").join(votes, ITEM), "vote_uri")))
        .unionByName(one("duplicate_items", duplicate_count(typed, tables)))
    )
    wide = counts.groupBy(*UNIT).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in METRIC_LABELS]
    )
    gated = wide.filter(F.col("sessions") > 0)
    return non_zero(gated.unpivot(UNIT, list(METRIC_LABELS), "metric", "n"))


def decisions_by_class(tables: Tables, unit_body: DataFrame) -> DataFrame:
    """``(harvester, unit_uri, class_label, n)`` distinct resolutions per class of the body that
    holds the session. A session held by bodies of two classes counts in both."""
    key = [*UNIT, "class_label"]
    sessions = (
        with_planned_start(tables["session"])
        .join(unit_body.withColumnRenamed("body_uri", "held_by"), ["harvester", "held_by"])
        .select(*key, "session_uri")
        .distinct()
    )
    items = (
        sessions.join(tables["session_item"], ["harvester", "session_uri"])
        .select(*key, "item_uri")
        .distinct()
        .join(tables["item"].select(*ITEM).distinct(), ITEM, "left_semi")
    )
    return (
        items.join(item_resolutions(tables), ITEM)
        .groupBy(*key)
        .agg(F.count_distinct("resolution_uri").alias("n"))
    )


def count_by_class(quads: DataFrame, classes: list[str]) -> DataFrame:
    """One row with the number of distinct instances of each class, a column per class named
    ``res_count_<index>``; 0 where a class has none."""
    found = quads.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(classes))
    per_class = found.groupBy("o").agg(F.count_distinct("s").alias("n"))
    return per_class.agg(
        *[
            F.coalesce(F.max(F.when(F.col("o") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"res_count_{i}")
            for i, c in enumerate(classes)
        ]
    )
