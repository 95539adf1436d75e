"""The newest publication of each unit and where it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphreports.operators.sessions import UNIT, held_by_unit, with_planned_start


def sessions_with_minutes(publication: DataFrame) -> DataFrame:
    """Keys of sessions that have minutes."""
    return (
        publication.filter(F.col("kind") == "notulen").select("harvester", "session_uri").distinct()
    )


def publications(publication: DataFrame) -> DataFrame:
    """Publications of every kind of the sessions that have minutes."""
    return publication.join(
        sessions_with_minutes(publication), ["harvester", "session_uri"], "left_semi"
    )


def _newest(df: DataFrame) -> DataFrame:
    """The session with the latest start per unit, of equal ones the first by URI; starts that
    can't be read come last. An aggregate, so every task sends one row per unit."""
    age = F.timestamp_diff("MICROSECOND", F.col("planned_start"), F.lit("2100-01-01 00:00:00").cast(df.schema["planned_start"].dataType))
    order = F.struct(F.coalesce(age, F.lit(2**62)).alias("age"), "session_uri", "planned_start")
    return df.groupBy(*UNIT).agg(F.min(order).alias("first")).select(*UNIT, "first.planned_start", "first.session_uri")


def latest_publication(
    session: DataFrame, unit_body: DataFrame, publication: DataFrame, publication_source: DataFrame
) -> DataFrame:
    """``(harvester, unit_uri, planned_start, session_uri, url, derived_from)``: the publication
    that is first by newest session, session, URL and source.

    Every session with minutes has a publication, so the newest session is found first. Only
    its few publications, one session per unit, are then looked up and ordered."""
    candidates = with_planned_start(session).join(
        sessions_with_minutes(publication), ["harvester", "session_uri"], "left_semi"
    )
    bodies = unit_body.select(*UNIT, "body_uri").distinct()
    return _first_of(_newest(held_by_unit(candidates, bodies).select(*UNIT, "planned_start", "session_uri")), publication, publication_source)


def latest_of(held: DataFrame, publication: DataFrame, publication_source: DataFrame) -> DataFrame:
    """The same from the planned sessions of each unit, ``(harvester, unit_uri, session_uri, planned_start)``."""
    candidates = held.join(sessions_with_minutes(publication), ["harvester", "session_uri"], "left_semi")
    return _first_of(_newest(candidates), publication, publication_source)


def _first_of(newest: DataFrame, publication: DataFrame, publication_source: DataFrame) -> DataFrame:
    urls = newest.join(
        publication.select("harvester", "session_uri", "url").distinct(), ["harvester", "session_uri"]
    )
    first_url = urls.groupBy(*UNIT, "planned_start", "session_uri").agg(F.min("url").alias("url"))
    return (
        first_url.join(publication_source, ["harvester", "url"], "left")
        .groupBy(*UNIT, "planned_start", "session_uri", "url")
        .agg(F.min("derived_from").alias("derived_from"))
    )
