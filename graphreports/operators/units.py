"""The unit dimension: repair, selection, matching by name, merging of paired units."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphreports.functions.text import join_list, label_parts, norm_label, trim_space
from graphreports.operators.resources import assemble
from graphreports.runtime import stored
from graphreports.sources.graph import instances_of, isin_values
from graphreports.sources.links import unit_properties
from graphreports.vocabulary import PROVINCE, REPORTED_CLASSIFICATIONS, WELFARE_CENTRE, iri

UNIT_COLUMNS = ["unit_uri", "unit_id", "label", "classification"]


def select_units(quads: DataFrame, override: Iterable[str] | None = None) -> DataFrame:
    """Properties of the units to report on: those in ``override`` if it lists any, else every
    unit of a reported classification. One row per combination of values."""
    properties = unit_properties(quads)
    chosen = list(override or ())
    if chosen:
        return isin_values(properties, "unit_uri", chosen)
    typed = instances_of(quads, iri("besluit:Bestuurseenheid")).select(F.col("uri").alias("unit_uri"))
    reported = isin_values(properties, "classification", REPORTED_CLASSIFICATIONS).select("unit_uri")
    return properties.join(typed, "unit_uri", "left_semi").join(
        reported.distinct(), "unit_uri", "left_semi"
    )


def clean_units(properties: DataFrame) -> DataFrame:
    """One row per unit; several ids or labels are joined by a comma and the unit marked."""
    units = assemble(properties, "unit_uri", ["unit_id", "label", "classification"])
    return units.select(
        "unit_uri",
        join_list(F.col("unit_id")).alias("unit_id"),
        join_list(F.col("label")).alias("label"),
        join_list(F.col("classification")).alias("classification"),
        ((F.size("unit_id") > 1) | (F.size("label") > 1)).alias("dirty"),
    )


def match_units_any_token(admin_unit: DataFrame, harvest_title: DataFrame) -> DataFrame:
    """Units published by each harvester: any part of the label equals a harvested title."""
    parts = admin_unit.select(*UNIT_COLUMNS, F.explode(label_parts(F.col("label"))).alias("part"))
    named = parts.select(*UNIT_COLUMNS, F.lower(trim_space(F.col("part"))).alias("name"))
    titles = harvest_title.select("harvester", F.lower(F.col("title")).alias("name")).distinct()
    return named.join(titles, "name").select("harvester", *UNIT_COLUMNS).distinct()


def _merge_keys(harvester_unit: DataFrame) -> DataFrame:
    """Units with the key under which they are merged. A province only merges with itself."""
    return harvester_unit.withColumn(
        "merge_key",
        F.when(
            F.col("classification") == PROVINCE, F.concat(F.lit("unit:"), F.col("unit_uri"))
        ).otherwise(F.concat(F.lit("label:"), norm_label(F.col("label")))),
    )


def _survivors(keyed: DataFrame) -> DataFrame:
    """One unit per harvester and merge key: not a welfare centre if possible, then the lowest
    URI. An aggregate, so a label shared by very many units is reduced in every task first."""
    rank = F.struct((F.col("classification") == WELFARE_CENTRE).alias("welfare"), *UNIT_COLUMNS)
    return (
        keyed.groupBy("harvester", "merge_key")
        .agg(F.min(rank).alias("best"))
        .select("harvester", "merge_key", *[F.col(f"best.{c}").alias(c) for c in UNIT_COLUMNS])
    )


def survivors(harvester_unit: DataFrame) -> DataFrame:
    """Each matched unit, as ``member_uri``, with the unit it is merged into: per harvester, units
    with the same normalised label become one."""
    keyed = stored(_merge_keys(harvester_unit))
    return _mapped(keyed, _survivors(keyed))


def _mapped(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    members = keyed.select("harvester", "merge_key", F.col("unit_uri").alias("member_uri"))
    return members.join(kept, ["harvester", "merge_key"]).drop("merge_key")


def merge_units(harvester_unit: DataFrame, unit_body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged units ``(harvester, unit_uri, unit_id, label, classification)`` and their bodies
    ``(harvester, unit_uri, body_uri, class_label)``, each body once."""
    # Written once: units, survivors and bodies all follow from it, and the keys cost a pass in Python.
    keyed = stored(_merge_keys(harvester_unit))
    kept = _survivors(keyed)
    units = kept.drop("merge_key")
    mapping = _mapped(keyed, kept).select("harvester", "member_uri", "unit_uri")
    bodies = (
        unit_body.select(F.col("unit_uri").alias("member_uri"), "body_uri", "class_label")
        .join(mapping, "member_uri")
        .select("harvester", "unit_uri", "body_uri", "class_label")
        .distinct()
    )
    return units, bodies


def unit_totals(harvester_unit: DataFrame) -> DataFrame:
    """Units per harvester and, with a NULL harvester, over all of them."""
    return harvester_unit.rollup("harvester").agg(F.count(F.lit(1)).alias("units"))


def build_dimension(
    admin_unit: DataFrame, unit_body: DataFrame, harvest_title: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Matched and merged units, and their bodies."""
    return merge_units(match_units_any_token(admin_unit, harvest_title), unit_body)
