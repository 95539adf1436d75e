"""Dates, times of day and instants in the local time zone of the reports.

Wall-clock values are TIMESTAMP_NTZ. Conversions name the zone, so results do not depend on the
session's time zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphreports.vocabulary import LOCAL_TIMEZONE

# Accepted notations.
DATE_FORM = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
TIME_SHORT = r"^(\d{1,2}):(\d{1,2})$"
TIME_MILLIS = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,3})$"
TIME_ZONED = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})([+-])(\d{1,2}):(\d{1,2})$"
TIME_MILLIS_ZONED = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,3})([+-])(\d{1,2}):(\d{1,2})$"


def parse_date(c: Column) -> Column:
    """Date from ``YYYY-M-D``; other text, and a day that does not exist, give NULL."""
    padded = F.concat_ws(
        "-",
        F.regexp_extract(c, DATE_FORM, 1),
        F.lpad(F.regexp_extract(c, DATE_FORM, 2), 2, "0"),
        F.lpad(F.regexp_extract(c, DATE_FORM, 3), 2, "0"),
    )
    return F.when(c.rlike(DATE_FORM), padded.try_cast("date"))


def _group(c: Column, form: str, n: int) -> Column:
    return F.regexp_extract(c, form, n).try_cast("int")


def parse_time(c: Column, local_offset: int = 60) -> Column:
    """Struct ``(ms_of_day, offset_min)`` from any accepted notation; other text gives NULL.

    ``local_offset`` is the offset in minutes taken where the text has none.
    """
    local = F.lit(local_offset)

    def value(form: str, seconds: bool, millis: bool, zone: int | None) -> Column:
        ms = (_group(c, form, 1) * 60 + _group(c, form, 2)) * 60000
        if seconds:
            ms = ms + _group(c, form, 3) * 1000
        if millis:
            ms = ms + F.rpad(F.regexp_extract(c, form, 4), 3, "0").try_cast("int")
        offset = local
        if zone is not None:
            size = _group(c, form, zone + 1) * 60 + _group(c, form, zone + 2)
            offset = F.when(F.regexp_extract(c, form, zone) == "-", -size).otherwise(size)
        return F.when(
            c.rlike(form), F.struct(ms.alias("ms_of_day"), offset.cast("int").alias("offset_min"))
        )

    return F.coalesce(
        value(TIME_MILLIS_ZONED, True, True, 5),
        value(TIME_ZONED, True, False, 4),
        value(TIME_MILLIS, True, True, None),
        value(TIME_SHORT, False, False, None),
    )


def format_time(ms_of_day: Column, offset_min: Column) -> Column:
    """``HH:mm:ss.SSS±hh:mm``."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    whole = lambda n, d: F.floor(n / d)
    size = F.abs(offset_min)
    return F.concat(
        two(whole(ms_of_day, 3600000)), F.lit(":"),
        two(whole(ms_of_day, 60000) % 60), F.lit(":"),
        two(whole(ms_of_day, 1000) % 60), F.lit("."),
        F.lpad((ms_of_day % 1000).cast("string"), 3, "0"),
        F.when(offset_min < 0, "-").otherwise("+"),
        two(whole(size, 60)), F.lit(":"), two(size % 60),
    )


def make_local_ts(day: Column, ms_of_day: Column) -> Column:
    """Instant of a wall-clock date and time in the local zone (TIMESTAMP)."""
    seconds = ((ms_of_day % 60000) / 1000).cast("decimal(8,6)")
    return F.make_timestamp_ltz(
        F.year(day), F.month(day), F.dayofmonth(day),
        F.floor(ms_of_day / 3600000).cast("int"),
        (F.floor(ms_of_day / 60000) % 60).cast("int"),
        seconds, F.lit(LOCAL_TIMEZONE),
    )


def local_wall(instant: Column) -> Column:
    """Local wall-clock time (TIMESTAMP_NTZ) of an instant."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TIMEZONE), utc)


def local_offset_minutes(wall: Column) -> Column:
    """Offset from UTC, in minutes, of a local wall-clock time."""
    utc = F.convert_timezone(F.lit(LOCAL_TIMEZONE), F.lit("UTC"), wall)
    return F.timestamp_diff("MINUTE", utc, wall).cast("int")


def format_local_datetime(wall: Column) -> Column:
    """``YYYY-MM-DDTHH:mm:ss±hh:mm`` of a local wall-clock time."""
    offset = local_offset_minutes(wall)
    size = F.abs(offset)
    return F.concat(
        F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(offset < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def in_half_open(x: Column, a: Column, b: Column) -> Column:
    """``a <= x < b`` on whole milliseconds."""
    ms = lambda c: F.date_trunc("MILLISECOND", c)
    return (ms(x) >= ms(a)) & (ms(x) < ms(b))


def in_local_day(wall: Column, day: date) -> Column:
    """True when a local wall-clock time lies on ``day``. The bounds are constants on the bare
    column, so the test is pushed down to the file scan."""
    return (wall >= F.lit(f"{day} 00:00:00").cast("timestamp_ntz")) & (
        wall < F.lit(f"{day + timedelta(days=1)} 00:00:00").cast("timestamp_ntz")
    )


def local_day_bounds(day: date) -> tuple[datetime, datetime]:
    """First instant of a local day and of the next one, in UTC."""
    zone = ZoneInfo(LOCAL_TIMEZONE)
    start = lambda d: datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(ZoneInfo("UTC"))
    return start(day), start(day + timedelta(days=1))


def created_on(created_at: Column, day: date) -> Column:
    """True when the text of a timestamp starts with the date."""
    return created_at.cast("string").startswith(day.isoformat())


def day_of_week(c: Column) -> Column:
    """Day number with Sunday as 0."""
    return (F.dayofweek(c) - 1).cast("int")


def local_now() -> datetime:
    """Wall-clock time in the local zone."""
    return datetime.now(ZoneInfo(LOCAL_TIMEZONE)).replace(tzinfo=None)


def local_today() -> date:
    return local_now().date()


def local_yesterday() -> date:
    return local_today() - timedelta(days=1)
