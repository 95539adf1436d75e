"""Decoding RDF terms to typed values, and writing values as RDF terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphreports.functions.text import escape_literal
from graphreports.functions.times import format_local_datetime, format_time, parse_date, parse_time
from graphreports.vocabulary import LOCAL_TIMEZONE, iri

XSD_STRING = iri("xsd:string")
XSD_BOOLEAN = iri("xsd:boolean")
XSD_DATETIME = iri("xsd:dateTime")
XSD_DATE = iri("xsd:date")
XSD_TIME = iri("xsd:time")
XSD_INTEGER = iri("xsd:integer")
XSD_DOUBLE = iri("xsd:double")
INTEGER_TYPES = (XSD_INTEGER, iri("xsd:int"), iri("xsd:long"))
FLOAT_TYPES = (iri("xsd:float"), XSD_DOUBLE)

_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


def parse_datetime(c: Column) -> Column:
    """Instant of an ``xsd:dateTime``; text without an offset is local wall-clock time. An offset
    may lack its colon, and a date alone (with or without an offset) is its first instant."""
    dated = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1T00:00:00$2")
    text = F.regexp_replace(dated, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(text.rlike(_OFFSET), text).otherwise(F.concat(text, F.lit(LOCAL_TIMEZONE)))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), zoned).try_cast("timestamp")


def parse_boolean(c: Column) -> Column:
    return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)


def parse_double(c: Column) -> Column:
    special = (
        F.when(c.isin("INF", "+INF"), F.lit(float("inf")))
        .when(c == "-INF", F.lit(float("-inf")))
        .when(c == "NaN", F.lit(float("nan")))
    )
    return F.coalesce(special, c.try_cast("double"))


def decode_terms(df: DataFrame, prefix: str = "value") -> DataFrame:
    """Add typed value columns for the object term, and ``status``: ``ok``, ``unbound``,
    ``malformed`` or ``unsupported_datatype``. A term of another datatype never fails the job.
    """
    o, kind, datatype = F.col("o"), F.col("o_kind"), F.col("o_datatype")
    literal = kind == "literal"
    typed = lambda *types: literal & datatype.isin(*types)
    time = F.when(typed(XSD_TIME), parse_time(o))
    values = {
        "text": F.when((kind == "iri") | typed(XSD_STRING), o).when(kind == "bnode", F.lit("_")),
        "boolean": F.when(typed(XSD_BOOLEAN), parse_boolean(o)),
        "long": F.when(typed(*INTEGER_TYPES), o.try_cast("long")),
        "double": F.when(typed(*FLOAT_TYPES), parse_double(o)),
        "timestamp": F.when(typed(XSD_DATETIME), parse_datetime(o)),
        "date": F.when(typed(XSD_DATE), parse_date(o)),
        "time_ms": time["ms_of_day"],
        "time_offset": time["offset_min"],
    }
    out = df.withColumns({f"{prefix}_{name}": c for name, c in values.items()})
    bound = F.coalesce(*[F.col(f"{prefix}_{name}").isNotNull() for name in ("text",)], F.lit(False))
    for name in list(values)[1:]:
        bound = bound | F.col(f"{prefix}_{name}").isNotNull()
    supported = datatype.isin(
        XSD_STRING, XSD_BOOLEAN, *INTEGER_TYPES, *FLOAT_TYPES, XSD_DATETIME, XSD_DATE, XSD_TIME
    )
    return out.withColumn(
        "status",
        F.when(o.isNull(), "unbound")
        .when(literal & ~F.coalesce(supported, F.lit(False)), "unsupported_datatype")
        .when(bound, "ok")
        .otherwise("malformed"),
    )


def format_double(c: Column) -> Column:
    """Shortest decimal text of a double without an exponent for 1e-6 <= |x| < 1e21, and
    ``INF``, ``-INF`` or ``NaN``. Values outside keep exponent notation."""
    text = c.cast("string")
    # Two widths, since a 38-digit decimal cannot hold both ends of the range.
    digits = F.when(F.abs(c) >= 1, text.try_cast("decimal(38,16)").cast("string")).otherwise(
        text.try_cast("decimal(38,37)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "NaN")
        .when(c == float("inf"), "INF")
        .when(c == float("-inf"), "-INF")
        .when(c == 0, "0")
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(text)
    )


def lexical(c: Column, datatype: str) -> Column:
    """Lexical form of a value for ``datatype``; text is given as it is."""
    if datatype == XSD_DATE:
        return F.date_format(c, "yyyy-MM-dd")
    if datatype == XSD_DATETIME:
        return format_local_datetime(c)
    if datatype == XSD_TIME:
        return format_time(c["ms_of_day"], c["offset_min"])
    if datatype == XSD_DOUBLE:
        return format_double(c)
    return c.cast("string")


def to_literal(c: Column, datatype: str = XSD_STRING) -> Column:
    """RDF text of a literal: escaped and quoted, with its datatype unless it is plain text."""
    text = lexical(c, datatype)
    if datatype == XSD_STRING:
        return F.concat(F.lit('"'), escape_literal(text), F.lit('"'))
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{datatype}>'))
