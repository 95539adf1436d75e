"""What all reports of a run start from, stored once: sessions and items of every unit, and what is known of items.

Without it each report joins sessions with bodies and items anew. ``held`` has the sessions of a unit by class of the body that holds
them; the tables keyed by item are laid out in buckets, so the metrics join and group them without shuffling items.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphreports.operators import metrics
from graphreports.operators.metrics import ITEM
from graphreports.operators.publications import latest_of
from graphreports.operators.resources import non_zero
from graphreports.operators.sessions import UNIT, has_start, held_by_unit
from graphreports.runtime import freeing
from graphreports.sources.buckets import Split, save_split
from graphreports.vocabulary import METRIC_LABELS

CLASS = [*UNIT, "class_label"]


@dataclass(frozen=True)
class Prefix:
    held: DataFrame
    items: Mapping[str, Split]


def store_prefix(tables: Mapping[str, DataFrame], unit_body: DataFrame, path: str, buckets: int) -> Prefix:
    """Join sessions with bodies and items, once, into ``path``."""
    spark = unit_body.sparkSession

    def kept(name: str, df: DataFrame) -> DataFrame:
        with freeing(spark):
            df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    bodies = unit_body.select(*CLASS, "body_uri").distinct()
    held = kept(
        "held",
        held_by_unit(tables["session"], bodies).groupBy(*CLASS, "session_uri", "planned_start").agg(F.max(has_start(tables["session"])).alias("started")),
    )
    item = (
        held.groupBy(*CLASS, "session_uri").agg(F.max("started").alias("started"))
        .join(tables["session_item"], ["harvester", "session_uri"])
        .groupBy(*CLASS, "item_uri").agg(F.max("started").alias("started"))
    )
    docs = tables["item_doc"].groupBy(*ITEM).agg(F.min("doc_uri").alias("low_doc"), F.max("doc_uri").alias("high_doc"))
    keyed = {
        "unit_item": item,
        "flags": metrics.item_flags(tables),
        "resolution": metrics.item_resolutions(tables).distinct(),
        "vote": metrics.item_votes(tables).distinct(),
        "title": tables["item_title"].select(*ITEM, *TITLE).distinct(),
        "doc": docs,
    }
    return Prefix(held, save_split({n: kept(f"whole/{n}", df) for n, df in keyed.items()}, ITEM, f"{path}/items", buckets))


TITLE = ["title", "title_datatype", "title_lang"]


def _unit_items(prefix: Prefix) -> Split:
    """One row per unit and item, with the flags of the item."""
    reduced = prefix.items["unit_item"].map(lambda df: df.groupBy(*ITEM, "unit_uri").agg(F.max("started").alias("started")))
    return reduced.join(prefix.items["flags"], "left")


def _typed(items: Split) -> Split:
    return items.map(lambda df: df.filter(F.col("started") & (F.col("flags").bitwiseAND(F.lit(metrics.TYPED)) != 0)))


def _distinct(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count_distinct(column).alias("n"))


def metrics_of(prefix: Prefix) -> DataFrame:
    """As :func:`graphreports.operators.metrics.unit_metrics`."""
    items, known = _unit_items(prefix), prefix.items
    typed = _typed(items)
    without = lambda bit: F.count_if(F.col("started") & (F.col("flags").bitwiseAND(F.lit(metrics.TYPED | bit)) == metrics.TYPED))
    flagged = items.whole().groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("items"),
        without(metrics.TITLED).alias("items_without_title"),
        without(metrics.DESCRIBED).alias("items_without_description"),
    )
    titles = (
        typed.join(known["title"]).join(known["doc"]).whole()
        .groupBy(*UNIT, *TITLE)
        .agg(F.count(F.lit(1)).alias("n"), F.min("low_doc").alias("low_doc"), F.max("high_doc").alias("high_doc"))
        .filter((F.col("n") >= 2) & (F.col("low_doc") < F.col("high_doc")))
    )
    planned = prefix.held.filter("started").select(*UNIT, "session_uri")
    started = items.map(lambda df: df.filter("started"))
    counts = {
        "sessions": _distinct(planned, UNIT, "session_uri"),
        "resolutions": _distinct(typed.join(known["resolution"]).whole(), UNIT, "resolution_uri"),
        "votes": _distinct(started.join(known["vote"]).whole(), UNIT, "vote_uri"),
        "duplicate_items": titles.groupBy(*UNIT).agg(F.sum("n").alias("n")),
    }
    one = [df.select(*UNIT, F.lit(name).alias("metric"), "n") for name, df in counts.items()]
    three = flagged.unpivot(UNIT, ["items", "items_without_title", "items_without_description"], "metric", "n")
    wide = reduce(DataFrame.unionByName, [*one, three]).groupBy(*UNIT).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in METRIC_LABELS]
    )
    return non_zero(wide.filter(F.col("sessions") > 0).unpivot(UNIT, list(METRIC_LABELS), "metric", "n"))


def decisions_of(prefix: Prefix) -> DataFrame:
    """As :func:`graphreports.operators.metrics.decisions_by_class`."""
    flags = prefix.items["flags"].map(lambda df: df.filter(F.col("flags").bitwiseAND(F.lit(metrics.TYPED)) != 0))
    items = prefix.items["unit_item"].map(lambda df: df.filter("started")).join(flags, "left_semi")
    return _distinct(items.join(prefix.items["resolution"]).whole(), CLASS, "resolution_uri")


def bounds_of(prefix: Prefix) -> DataFrame:
    """As :func:`graphreports.operators.sessions.session_bounds`."""
    dated = prefix.held.filter(F.col("planned_start").isNotNull())
    return dated.groupBy(*UNIT).agg(F.min("planned_start").alias("first_session"), F.max("planned_start").alias("last_session"))


def latest_publication_of(prefix: Prefix, publication: DataFrame, publication_source: DataFrame) -> DataFrame:
    """As :func:`graphreports.operators.publications.latest_publication`."""
    return latest_of(prefix.held.filter("started").select(*UNIT, "session_uri", "planned_start"), publication, publication_source)
