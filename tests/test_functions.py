import math
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from graphreports.functions import labels, terms, text, times, uris
from graphreports.vocabulary import DAY_OF_WEEK, MUNICIPALITY, WELFARE_CENTRE, iri


def values(rows, function, *inputs, type="string"):
    df = rows(f"i int, v {type}", *enumerate(inputs))
    return [r[0] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_norm_label_trims_lowers_and_decomposes(rows):
    assert values(rows, text.norm_label, "  Aalst\t", " ﻿ÉEN ", "Éen", "", None) == [
        "aalst", "éen", "éen", "", None,
    ]


def test_strip_once_removes_one_end_only(rows):
    assert values(rows, text.strip_once_lower, " Unit 1 ", "Unit 1 \n", "Unit 1", "  ", None) == [
        "unit 1 ", "unit 1", "unit 1", "", None,
    ]


def test_label_parts(rows):
    assert values(rows, text.label_parts, "a, b,", "a", "") == [["a", " b", ""], ["a"], [""]]
    assert values(rows, text.label_head, "a, b", "a") == ["a", "a"]


def test_escape_and_unescape(rows):
    raw = "tab\t quote\" it's \\n \n\r\f end\\"
    assert values(rows, text.escape_literal, raw) == [r"tab\t quote\" it\'s \\n \n\r\f end\\"]
    escaped = values(rows, text.escape_literal, raw, "plain", "")
    assert values(rows, text.unescape_literal, *escaped) == [raw, "plain", ""]
    assert values(rows, text.unescape_literal, r"é \U0001F600 \b") == ["é \U0001F600 \b"]


def test_unescape_long_text_with_many_escapes(rows):
    raw = "line\n" * 40000
    assert values(rows, lambda c: text.unescape_literal(text.escape_literal(c)), raw) == [raw]


def test_expand_uri(rows):
    assert values(rows, uris.expand_uri, "besluit:Zitting", "mu:x", "nowhere:x", "http://a.b/c", None) == [
        "http://data.vlaanderen.be/ns/besluit#Zitting", "http://mu.semte.ch/vocabularies/core/x", None, "http://a.b/c", None,
    ]


@pytest.mark.parametrize(
    "uri, plain",
    [
        ("http://example.com/ns/example#Item", True),
        ("http://example.com:80/a", True),  # the scheme's own port
        ("http://example.com:8080/a", False),
        ("https://user@example.com/a", False),
        ("http://example.com/a?q=1", False),
        ("http://example.com/a#b?c", True),
        ("urn:x:y", True),
        ("no scheme", False),
        ("http://", False),
    ],
)
def test_is_plain_uri(rows, uri, plain):
    assert values(rows, uris.is_plain_uri, uri) == [plain]
    assert values(rows, uris.to_node, uri) == [f"<{uri}>" if plain else None]


def test_enumerations(rows):
    assert values(rows, lambda c: uris.enum_key(c, DAY_OF_WEEK), DAY_OF_WEEK["SUNDAY"], "x") == ["SUNDAY", None]
    assert values(rows, lambda c: uris.enum_uri(c, DAY_OF_WEEK), "monday", "x") == [DAY_OF_WEEK["MONDAY"], None]
    with pytest.raises(SparkRuntimeException, match="unknown enumeration URI"):
        values(rows, lambda c: uris.enum_key(c, DAY_OF_WEEK, strict=True), "x")


def test_stable_id_has_uuid_form_and_tells_null_from_text(rows):
    ids = values(rows, lambda c: uris.stable_id(F.lit("k"), c), "a", "a", None, "")
    assert ids[0] == ids[1] and len(set(ids)) == 3
    assert all(values(rows, uris.is_uuid, *ids))
    assert values(rows, uris.is_uuid, ids[0].upper(), ids[0] + "0") == [False, False]


def test_parse_date(rows):
    assert values(rows, times.parse_date, "2024-3-1", "2024-03-01", "2024-02-30", "24-1-1", "x") == [
        date(2024, 3, 1), date(2024, 3, 1), None, None, None,
    ]


def test_parse_time_keeps_the_sign(rows):
    got = values(
        rows, lambda c: times.parse_time(c, 60),
        "9:05", "10:00:01.5", "11:30:00-05:00", "11:30:00.250+05:30", "noon",
    )
    assert [tuple(g) if g else None for g in got] == [
        (32700000, 60), (36001500, 60), (41400000, -300), (41400250, 330), None,
    ]


def test_local_day_has_23_or_25_hours_when_clocks_change():
    hours = lambda d: (lambda a, b: (b - a) / timedelta(hours=1))(*times.local_day_bounds(d))
    assert [hours(date(2024, 3, 31)), hours(date(2024, 10, 27)), hours(date(2024, 6, 1))] == [23, 25, 24]


def test_local_times_do_not_depend_on_the_session_zone(spark, rows):
    frame = rows("wall timestamp_ntz", (datetime(2024, 7, 1, 12),), (datetime(2024, 1, 1, 12),))
    results = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        instant = times.make_local_ts(F.to_date("wall"), F.lit(43200000))
        results.append(
            [
                tuple(r)
                for r in frame.select(
                    F.unix_micros(instant), times.local_wall(instant).cast("string"), times.format_local_datetime(F.col("wall")),
                    F.unix_micros(terms.parse_datetime(times.format_local_datetime(F.col("wall")))),
                    F.unix_micros(terms.parse_datetime(F.date_format("wall", "yyyy-MM-dd'T'HH:mm:ss"))),
                ).collect()
            ]
        )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    summer = 1719828000000000
    assert results[0] == results[1]
    assert results[0][0] == (summer, "2024-07-01 12:00:00", "2024-07-01T12:00:00+02:00", summer, summer)
    assert results[0][1][2] == "2024-01-01T12:00:00+01:00"


def test_half_open_interval_and_days(rows):
    frame = rows("x timestamp_ntz", (datetime(2024, 1, 1),), (datetime(2024, 1, 2),), (datetime(2023, 12, 31, 23, 59, 59),))
    a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01", "2024-01-02"))
    assert [r[0] for r in frame.select(times.in_half_open(F.col("x"), a, b)).collect()] == [True, False, False]
    assert [r[0] for r in frame.select(times.in_local_day(F.col("x"), date(2024, 1, 1))).collect()] == [True, False, False]
    assert [r[0] for r in frame.select(times.day_of_week(F.col("x"))).collect()] == [1, 2, 0]
    assert times.local_yesterday() == times.local_today() - timedelta(days=1)


def test_doubles_are_written_without_exponent(rows):
    got = values(
        rows, lambda c: terms.to_literal(c, terms.XSD_DOUBLE),
        1.5, 100.0, 12345678.9, 0.00012, -2e-6, 1e20, 0.0, math.inf, -math.inf, math.nan, type="double",
    )
    assert [g.split('"')[1] for g in got] == [
        "1.5", "100", "12345678.9", "0.00012", "-0.000002", "100000000000000000000", "0", "INF", "-INF", "NaN",
    ]


def test_literals(rows):
    assert values(rows, terms.to_literal, 'a"b') == ['"a\\"b"']
    got = values(rows, lambda c: terms.to_literal(times.parse_time(c), terms.XSD_TIME), "9:05")
    assert got == [f'"09:05:00.000+01:00"^^<{iri("xsd:time")}>']


def test_decode_never_fails(rows):
    frame = rows(
        "o string, o_kind string, o_datatype string",
        ("1", "literal", iri("xsd:boolean")), ("1.5", "literal", iri("xsd:decimal")),
        ("dag", "literal", iri("rdf:langString")), (None, None, None), ("x", "bnode", None),
        ("http://a", "iri", None), ("seven", "literal", iri("xsd:int")), ("INF", "literal", iri("xsd:double")),
    )
    got = terms.decode_terms(frame).collect()
    assert [r.status for r in got] == [
        "ok", "unsupported_datatype", "unsupported_datatype", "unbound", "ok", "ok", "malformed", "ok",
    ]
    assert got[0].value_boolean is True and got[4].value_text == "_" and got[7].value_double == math.inf


def test_report_texts(rows):
    assert values(rows, labels.unit_kind, MUNICIPALITY, WELFARE_CENTRE) == ["gemeente", "provincie"]
    assert values(rows, labels.report_graph, "7") == ["http://example.org/graphs/organizations/7/reports"]


def test_decomposition_is_that_of_the_standard(spark):
    """Of every character, and of texts in which marks stand in any order."""
    import random
    import unicodedata

    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    marks = [c for c in every if unicodedata.combining(c)]
    composed = [c for c in every if unicodedata.normalize("NFD", c) != c]
    some = ["".join(rng.choice([rng.choice(marks), rng.choice(composed), "a", "한", "😀", chr(0x100000 + rng.randrange(50)), "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    df = spark.createDataFrame(pd.DataFrame({"s": every + some})).repartition(8).select("s", text.nfd(F.col("s")).alias("d"))
    assert "Python" not in df.select("d")._jdf.queryExecution().executedPlan().toString()
    assert [s for s, d in df.toPandas().itertuples(index=False) if unicodedata.normalize("NFD", s) != d] == []


def test_merging_units_needs_no_python(spark):
    from checks.catalogue import QUERIES

    plan = QUERIES["merge_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
