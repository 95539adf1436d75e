"""Patterns over the quads table: scopes, class and property scans, stars and paths."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphreports.schemas import QUADS, conform
from graphreports.vocabulary import RDF_TYPE


def federate(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Quads of several harvesters side by side; the name becomes part of every join key."""
    tagged = [conform(df.withColumn("harvester", F.lit(name)), QUADS) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged)


def in_graph(quads: DataFrame, graph: str) -> DataFrame:
    """Quads of one named graph."""
    return quads.filter(F.col("g") == graph)


def instances_of(quads: DataFrame, cls: str) -> DataFrame:
    """``(harvester, uri)`` of every resource of a class, once."""
    return (
        quads.filter((F.col("p") == RDF_TYPE) & (F.col("o") == cls) & (F.col("o_kind") == "iri"))
        .select("harvester", F.col("s").alias("uri"))
        .distinct()
    )


def property_of(
    quads: DataFrame,
    predicate: str,
    subject: str = "subject",
    object: str = "object",
    nodes: bool = False,
) -> DataFrame:
    """``(harvester, subject, object)`` link table of one predicate, each pair once. ``nodes``
    leaves out literals, for objects that are joined to subjects: text never equals a node."""
    found = quads.filter(F.col("p") == predicate)
    if nodes:
        found = found.filter(F.col("o_kind") != "literal")
    return (
        found.select("harvester", F.col("s").alias(subject), F.col("o").alias(object)).distinct()
    )


def star(quads: DataFrame, cls: str | None, properties: Mapping[str, str]) -> DataFrame:
    """One row per combination of values of the properties of each resource of ``cls``; every
    property is required. All tables share the key ``(harvester, uri)``, so each is shuffled once.
    """
    tables = [property_of(quads, p, "uri", name) for name, p in properties.items()]
    if cls is not None:
        tables.insert(0, instances_of(quads, cls))
    return reduce(lambda a, b: a.join(b, ["harvester", "uri"]), tables)


def follow_path(quads: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """``(harvester, start, end)`` of a sequence of predicates, one row per way through."""
    last = len(predicates) - 1
    hops = [
        property_of(quads, p, f"n{i}", f"n{i + 1}", nodes=i < last) for i, p in enumerate(predicates)
    ]
    path = hops[0].withColumnsRenamed({"n0": "start", "n1": "end"})
    for i, hop in enumerate(hops[1:], start=1):
        step = hop.withColumnsRenamed({f"n{i}": "end", f"n{i + 1}": "next"})
        path = path.join(step, ["harvester", "end"]).select("harvester", "start", F.col("next").alias("end"))
    return path


def with_any_value(quads: DataFrame, predicate: str, values: Iterable[str]) -> DataFrame:
    """``(harvester, g, s)`` of subjects having one of ``values``; no values means any value."""
    found = quads.filter(F.col("p") == predicate)
    wanted = list(values)
    if wanted:
        found = found.filter(F.col("o").isin(wanted))
    return found.select("harvester", "g", "s").distinct()


def isin_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose column is in an inline list."""
    return df.filter(F.col(column).isin(list(values)))
