"""From sessions to the units they belong to: the prefix every metric shares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphreports.functions.times import in_local_day, local_day_bounds

UNIT = ["harvester", "unit_uri"]


def has_start(session: DataFrame) -> Column:
    """True for a session that has a planned start, readable or not. Link tables say so in
    ``has_start``; without that column a start that has a value counts."""
    return F.col("has_start") if "has_start" in session.columns else F.col("planned_start").isNotNull()


def with_planned_start(session: DataFrame) -> DataFrame:
    """Sessions that have a planned start."""
    return session.filter(has_start(session))


def on_day(session: DataFrame, day: date | None) -> DataFrame:
    """Sessions planned on a local day; all sessions when no day is given, which is the default
    of every report. Starts are instants (TIMESTAMP) or local wall-clock times (TIMESTAMP_NTZ)."""
    if day is None:
        return session
    start, kind = F.col("planned_start"), session.schema["planned_start"].dataType
    if isinstance(kind, T.TimestampNTZType):
        return session.filter(in_local_day(start, day))
    if not isinstance(kind, T.TimestampType):
        raise TypeError(f"planned_start is {kind.simpleString()}, expected a timestamp")
    # Text of a known offset, since a literal without one would be read in the session's zone.
    first, after = (F.lit(f"{bound:%Y-%m-%d %H:%M:%S}+00:00").cast("timestamp") for bound in local_day_bounds(day))
    return session.filter((start >= first) & (start < after))


def held_by_unit(session: DataFrame, unit_body: DataFrame) -> DataFrame:
    """Sessions with the unit whose body holds them, for all units at once. A session held by two
    bodies, or a body shared by two units, gives one row each."""
    bodies = unit_body.withColumnRenamed("body_uri", "held_by")
    return session.join(bodies, ["harvester", "held_by"])


def unit_sessions(session: DataFrame, unit_body: DataFrame) -> DataFrame:
    """``(harvester, unit_uri, session_uri, started)``, one row per unit and session; ``started``
    tells whether the session has a planned start."""
    return (
        held_by_unit(session, unit_body.select(*UNIT, "body_uri").distinct())
        .groupBy(*UNIT, "session_uri")
        .agg(F.max(has_start(session)).alias("started"))
    )


def unit_items(unit_session: DataFrame, session_item: DataFrame) -> DataFrame:
    """``(harvester, unit_uri, item_uri, started)``, one row per unit and agenda item, whatever
    the number of sessions that treat the item. A null is no item; said here, it holds for every join behind it, and they share shuffles."""
    return (
        unit_session.join(session_item.filter(F.col("item_uri").isNotNull()), ["harvester", "session_uri"])
        .groupBy(*UNIT, "item_uri")
        .agg(F.max("started").alias("started"))
    )


def session_bounds(session: DataFrame, unit_body: DataFrame) -> DataFrame:
    """First and last planned start per unit; a unit without readable starts gives no row."""
    return (
        held_by_unit(session.filter(F.col("planned_start").isNotNull()), unit_body.select(*UNIT, "body_uri").distinct())
        .groupBy(*UNIT)
        .agg(F.min("planned_start").alias("first_session"), F.max("planned_start").alias("last_session"))
    )
