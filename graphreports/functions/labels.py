"""Texts and URIs that appear in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphreports.vocabulary import MUNICIPALITY, PREFIXES, Names


def unit_kind(classification: Column) -> Column:
    """``gemeente`` for a municipality, ``provincie`` for every other unit."""
    return F.when(classification == MUNICIPALITY, "gemeente").otherwise("provincie")


def report_graph(unit_id: Column, names: Names = Names()) -> Column:
    return F.concat(F.lit(names.graph_base), unit_id, F.lit(names.graph_suffix))


def metric_class(metric_label: Column) -> Column:
    return F.concat(F.lit(PREFIXES["besluit"]), metric_label)


# Wording of the labels.
def body_report_label(kind: Column, day: Column, unit_label: Column) -> Column:
    return F.format_string(
        "Count report for governing body of class %s on %s for admin unit '%s'",
        kind, day.cast("string"), unit_label,
    )


def unit_report_label(unit_label: Column, day: Column) -> Column:
    return F.format_string("Count report for admin unit '%s' on %s", unit_label, day.cast("string"))


def metric_count_label(metric_label: Column) -> Column:
    return F.format_string("Count of '%s'", metric_label)


def decision_label(unit_label: Column, day: Column) -> Column:
    return F.format_string("Report of decisions for %s on %s", unit_label, day.cast("string"))


def harvest_label(unit_label: Column, day: Column) -> Column:
    return F.format_string(
        "Report of last harvesting execution times for %s on %s", unit_label, day.cast("string")
    )


def maturity_label(day: Column) -> Column:
    return F.format_string("Report of maturity level for day %s", day.cast("string"))


def session_label(unit_label: Column, day: Column) -> Column:
    return F.format_string(
        "Report of session timestamps for %s on %s", unit_label, day.cast("string")
    )
