from datetime import date, datetime

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from graphreports.operators import harvests, metrics, publications, resources, rewrite, sessions, units
from graphreports.schemas import QUADS
from graphreports.vocabulary import MUNICIPALITY, PROVINCE, RDF_TYPE, RUN_FAILED, RUN_SUCCESS, WELFARE_CENTRE, iri

T0, T1 = datetime(2024, 1, 1, 10), datetime(2024, 2, 1, 10)
SCHEMAS = {
    "session": "harvester string, session_uri string, held_by string, planned_start timestamp_ntz",
    "session_item": "harvester string, session_uri string, item_uri string",
    "item": "harvester string, item_uri string",
    "item_title": "harvester string, item_uri string, title string, title_datatype string, title_lang string",
    "item_description": "harvester string, item_uri string, description string",
    "item_doc": "harvester string, item_uri string, doc_uri string",
    "handling_subject": "harvester string, handling_uri string, item_uri string",
    "handling_resolution": "harvester string, handling_uri string, resolution_uri string",
    "handling_vote": "harvester string, handling_uri string, vote_uri string",
    "resolution": "harvester string, resolution_uri string",
}


@pytest.fixture
def tables(rows):
    data = {
        # s1 is held by two bodies of the unit; s2 has no start; s3 belongs to another harvester.
        "session": [("h", "s1", "b1", T0), ("h", "s1", "b2", T0), ("h", "s2", "b1", None), ("k", "s3", "b1", T1)],
        "session_item": [("h", "s1", "i1"), ("h", "s1", "i2"), ("h", "s2", "i3"), ("h", "s1", "i4"), ("h", "s2", "i4")],
        "item": [("h", "i1"), ("h", "i1"), ("h", "i2"), ("h", "i3")],
        "item_title": [("h", i, t, "d", lang) for i, t, lang in (
            ("i1", "A", None), ("i1", "B", None), ("i2", "A", None), ("i2", "B", "fr"), ("i1", "A", None))],
        "item_description": [("h", "i1", "text")],
        "item_doc": [("h", "i1", "d1"), ("h", "i2", "d2"), ("h", "i3", "d1")],
        "handling_subject": [("h", "x1", "i1"), ("h", "x2", "i2"), ("h", "x4", "i4")],
        "handling_resolution": [("h", "x1", "r1"), ("h", "x2", "r1"), ("h", "x2", "r2"), ("h", "x4", "r4")],
        "handling_vote": [("h", "x1", "v1"), ("h", "x4", "v2")],
        "resolution": [("h", "r1"), ("h", "r4")],
    }
    return {name: rows(schema, *data[name]) for name, schema in SCHEMAS.items()}


@pytest.fixture
def bodies(rows):
    return rows(
        "harvester string, unit_uri string, body_uri string, class_label string",
        ("h", "u", "b1", "Raad"), ("h", "u", "b2", "College"), ("h", "w", "b9", "Raad"), ("k", "u", "b7", "Raad"),
    )


EXPECTED = {
    "count_sessions": 1, "count_items": 4, "count_items_without_title": None, "count_items_without_description": 1,
    "count_resolutions": 1, "count_votes": 2, "count_duplicate_items": 2,
}


@pytest.mark.parametrize("name, n", EXPECTED.items())
def test_metrics(tables, bodies, name, n):
    got = [tuple(r) for r in getattr(metrics, name)(tables, bodies).collect()]
    assert got == ([("h", "u", n)] if n else [])


def test_a_null_is_no_item(tables, bodies, rows):
    more = {**tables, "session_item": tables["session_item"].union(rows(SCHEMAS["session_item"], ("h", "s1", None)))}
    assert [r["n"] for r in metrics.count_items(more, bodies).collect()] == [4]
    assert sorted(metrics.unit_metrics(more, bodies).collect()) == sorted(metrics.unit_metrics(tables, bodies).collect())


def test_item_in_two_duplicate_titles_counts_twice(tables, bodies, rows):
    tables = {**tables, "item_title": tables["item_title"].union(rows(SCHEMAS["item_title"], ("h", "i2", "B", "d", None)))}
    assert metrics.count_duplicate_items(tables, bodies).first().n == 4


def test_one_document_is_no_duplicate(tables, bodies, rows):
    tables = {**tables, "item_doc": rows(SCHEMAS["item_doc"], ("h", "i1", "d"), ("h", "i2", "d"))}
    assert metrics.count_duplicate_items(tables, bodies).isEmpty()


def test_unit_metrics_agree_with_single_ones(tables, bodies):
    combined = {(r.unit_uri, r.metric): r.n for r in metrics.unit_metrics(tables, bodies).collect()}
    single = {("u", k.removeprefix("count_")): v for k, v in EXPECTED.items() if v}
    assert combined == single


def test_no_planned_session_means_no_metrics(tables, bodies):
    unplanned = {**tables, "session": tables["session"].withColumn("planned_start", F.lit(None).cast("timestamp_ntz"))}
    assert metrics.count_items(unplanned, bodies).first().n == 4
    assert metrics.unit_metrics(unplanned, bodies).isEmpty()
    assert sessions.session_bounds(unplanned["session"], bodies).isEmpty()


def test_decisions_count_in_each_class_of_a_shared_session(tables, bodies):
    got = sorted(tuple(r) for r in metrics.decisions_by_class(tables, bodies).collect())
    assert got == [("h", "u", "College", 1), ("h", "u", "Raad", 1)]


def test_count_by_class_gives_zero(rows):
    quads = rows(QUADS, ("h", "g", "a", RDF_TYPE, "C", "iri", None, None), ("h", "g2", "a", RDF_TYPE, "C", "iri", None, None))
    assert tuple(metrics.count_by_class(quads, ["C", "D"]).first()) == (1, 0)


def _unit(harvester, uri, label, classification):
    return (harvester, uri, "id-" + uri, label, classification)


UNIT_SCHEMA = "harvester string, unit_uri string, unit_id string, label string, classification string"


def test_merge(rows):
    matched = rows(
        UNIT_SCHEMA,
        _unit("h", "a-ocmw", "Éen", WELFARE_CENTRE), _unit("h", "m-town", " éen ", MUNICIPALITY),
        _unit("h", "p", "éen", PROVINCE), _unit("k", "a-ocmw", "Éen", WELFARE_CENTRE),
    )
    body = rows(
        "unit_uri string, body_uri string, class_label string, kind string",
        ("a-ocmw", "b1", "Raad", "abstract"), ("m-town", "b1", "Raad", "abstract"), ("m-town", "b2", "Raad", "abstract"), ("p", "b3", "Raad", "abstract"),
    )
    unit, merged = units.merge_units(matched, body)
    assert sorted((r.harvester, r.unit_uri) for r in unit.collect()) == [("h", "m-town"), ("h", "p"), ("k", "a-ocmw")]
    assert sorted((r.harvester, r.unit_uri, r.body_uri) for r in merged.collect()) == [
        ("h", "m-town", "b1"), ("h", "m-town", "b2"), ("h", "p", "b3"), ("k", "a-ocmw", "b1"),
    ]
    again, _ = units.merge_units(unit.select(matched.columns), body)
    assert sorted(map(str, again.collect())) == sorted(map(str, unit.select(again.columns).collect()))


def test_matching_and_repair(rows):
    properties = rows(
        "unit_uri string, unit_id string, label string, classification string",
        ("u", "1", "B", "c"), ("u", "1", "A", "c"), ("v", "2", "C", "c"),
    )
    clean = units.clean_units(properties)
    assert sorted((r.unit_uri, r.label, r.dirty) for r in clean.collect()) == [("u", "A,B", True), ("v", "C", False)]
    titles = rows("harvester string, title string", ("h", "b"), ("h", "B"), ("k", " c"))
    matched = units.match_units_any_token(clean, titles).collect()
    assert [(r.harvester, r.unit_uri) for r in matched] == [("h", "u")]  # titles are not trimmed


def test_unit_totals(rows):
    frame = rows(UNIT_SCHEMA, _unit("h", "a", "", ""), _unit("h", "b", "", ""), _unit("k", "a", "", ""))
    assert {(r.harvester, r.units) for r in units.unit_totals(frame).collect()} == {("h", 2), ("k", 1), (None, 3)}


RUN = "harvester string, scheduled_job string, title string, status string, modified timestamp_ntz"


def test_harvest_matching(rows):
    runs = harvests.last_runs(
        rows(
            RUN, ("h", "j", " Aalst", RUN_SUCCESS, T0), ("h", "j", " Aalst", RUN_SUCCESS, T1), ("h", "j", " Aalst", RUN_FAILED, T0),
            ("h", "j", " Gent ", RUN_SUCCESS, T0), ("h", "j", "Aalst", "busy", T1), ("k", "j", "Gent", RUN_SUCCESS, T0),
        )
    )
    unit = rows(UNIT_SCHEMA, _unit("h", "a", "aalst,other", ""), _unit("h", "g", "Gent", ""), _unit("h", "c", "other", ""))
    matched = harvests.match_units_first_token(unit, runs).collect()
    assert sorted((r.unit_uri, r.status == RUN_SUCCESS, r.last_modified) for r in matched) == [("a", False, T0), ("a", True, T1)]
    assert sorted(r.unit_uri for r in harvests.unmatched_units(unit, runs).collect()) == ["c", "g"]
    assert tuple(harvests.match_rate(unit, runs).first()) == ("h", 2, 3, 66.7)


def test_newest_publication_without_source_is_kept_as_such(rows, bodies):
    session = rows(SCHEMAS["session"], ("h", "s1", "b1", T0), ("h", "s2", "b1", T1), ("h", "s3", "b1", datetime(2024, 3, 1)))
    publication = rows(
        "harvester string, session_uri string, kind string, url string",
        ("h", "s1", "notulen", "n1"), ("h", "s2", "notulen", "n2"), ("h", "s2", "uittreksel", "a2"), ("h", "s3", "uittreksel", "a3"),
    )
    source = rows("harvester string, url string, derived_from string", ("h", "n1", "d1"), ("h", "n2", "d2"))
    got = publications.latest_publication(session, bodies, publication, source).collect()
    assert [(r.session_uri, r.url, r.derived_from) for r in got] == [("s2", "a2", None)]


def test_single_row(rows):
    assert resources.single_row(rows("a int", (1,))).first().a == 1
    for frame in (rows("a int"), rows("a int", (1,), (2,))):
        with pytest.raises(SparkRuntimeException, match="exactly one row"):
            resources.single_row(frame).collect()


def test_limits(rows):
    frame = rows("a int", (1,), (2,))
    assert (resources.limit_or_all(frame, 0).count(), resources.limit_or_all(frame, 1).count()) == (2, 1)
    with pytest.raises(ValueError):
        resources.limit_or_all(frame, -1)


def test_replacing_twice_is_replacing_once(rows):
    old = rows("k string, day string, n int", ("a", "1", 1), ("a", "2", 2), ("b", "1", 3))
    new = rows("k string, day string, n int", ("a", "1", 10), ("a", "1", 11))
    once = rewrite.replace_same_day(old, new, ["k", "day"])
    twice = rewrite.replace_same_day(once, new, ["k", "day"])
    expected = [("a", "1", 10), ("a", "1", 11), ("a", "2", 2), ("b", "1", 3)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == expected


def _quad(s, p, o, kind="iri", g="g"):
    return ("h", g, s, p, o, kind, None, None)


def test_report_is_replaced_with_parts_and_inbound_links(rows):
    dm = lambda name: iri(f"monitoring:{name}")
    cls = dm("GoverningBodyCountReport")

    def report(uri, stamp, g="g"):
        return [
            _quad(uri, RDF_TYPE, cls, g=g), _quad(uri, dm("createdAt"), stamp, "literal", g),
            _quad(uri, dm("publicationCountReports"), uri + "/c", g=g), _quad(uri + "/c", dm("count"), "1", "literal", g),
            _quad("parent", dm("governingBodyReports"), uri, g=g),
        ]

    keep = report("yesterday", "2024-01-01T23:00:00") + report("elsewhere", "2024-01-02T01:00:00", g="g2")
    old = rows(QUADS, *keep, *report("today", "2024-01-02T01:00:00"))
    new = rows(QUADS, *report("new", "2024-01-02T05:00:00"))
    got = rewrite.replace_reports(old, new, cls, date(2024, 1, 2))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows(QUADS, *keep).unionByName(new).collect()))


def test_properties_are_set_together_or_not_at_all(rows):
    quads = rows(
        QUADS, _quad("a", "status", "old"), _quad("a", "modified", "1", "literal"), _quad("a", RDF_TYPE, "Job"),
        _quad("b", "status", "old"), _quad("b", RDF_TYPE, "Job"), _quad("c", "status", "old"), _quad("c", "modified", "1"),
    )
    updates = rows(QUADS, *[q for s in "abc" for q in (_quad(s, "status", "new"), _quad(s, "modified", "2", "literal"))])
    got = rewrite.replace_properties(quads, updates, ["Job"])
    assert sorted((r.s, r.p, r.o) for r in got.collect() if r.p != RDF_TYPE) == [
        ("a", "modified", "2"), ("a", "status", "new"), ("b", "status", "old"), ("c", "modified", "1"), ("c", "status", "old"),
    ]


def test_deletes_reach_blank_nodes_and_quads_without_graph(rows):
    from graphreports.schemas import QUADS

    quads = rows(
        QUADS, ("h", None, "_:n", "p", "x", "literal", None, None), ("h", None, "s", "q", "_:n", "bnode", None, None),
        ("h", None, "s", "q", "_:n", "literal", None, None), ("h", "g", "_:n", "p", "x", "literal", None, None),
    )
    left = rewrite.delete_subjects(quads, rows("harvester string, g string, s string", ("h", None, "_:n")), inbound=True)
    assert sorted((str(r.g), r.s, r.o_kind) for r in left.collect()) == [("None", "s", "literal"), ("g", "_:n", "literal")]


def test_ids_of_different_keys_differ(rows):
    from pyspark.sql import functions as F

    from graphreports.functions.uris import stable_id

    ids = rows("a string, b string", ("a|b", "c"), ("a", "b|c"), ("1:a", ""), (None, "a")).select(stable_id(F.col("a"), F.col("b")))
    assert ids.distinct().count() == 4


def test_assembly_in_parts(spark, rows):
    from graphreports.operators.resources import assemble, assemble_parts

    df = rows("s string, p string, q int", *[("a", f"v{k % 5}", k % 3) for k in range(40)], ("b", None, None), (None, "x", 1), ("c", None, 7))
    small = {r.s: (r.part, r.parts, r.p, r.q) for r in assemble_parts(df, "s", ["p", "q"]).collect()}
    assert small == {r.s: (0, 1, r.p, r.q) for r in assemble(df, "s", ["p", "q"]).collect()}
    n = 1_000_000
    hot = spark.range(n).select(F.lit("hot").alias("s"), F.col("id").alias("v")).unionByName(spark.range(1000).select(F.concat(F.lit("s"), F.col("id")).alias("s"), F.col("id").alias("v")))
    out = assemble_parts(hot.unionByName(hot), ["s"], ["v"], 100_000).withColumn("n", F.size("v")).withColumn("low", F.array_min("v"))
    got = out.select("s", "part", "parts", "n").collect()
    parts = [r for r in got if r.s == "hot"]
    assert sorted(r.part for r in parts) == list(range(20)) and sum(r.n for r in parts) == n and max(r.n for r in parts) <= 100_000
    assert len(got) == 1020 and all(r.parts == 1 and r.n == 1 for r in got if r.s != "hot")
    assert out.filter("s = 'hot'").agg(F.count_distinct(F.col("low"))).first()[0] == 20


def test_unit_metrics_are_counted_from_stored_steps(tables, bodies):
    """Behind the last step no link table of handlings or bodies is joined again: their shuffles are gone."""
    text = metrics.unit_metrics(tables, bodies)._jdf.queryExecution().optimizedPlan().toString()
    assert "handling_uri" not in text and "held_by" not in text and "body_uri" not in text, text


def test_an_ordered_digest_streams(spark, rows):
    """The values of a key are never held as one: batches of three rows, keys that begin and end within them."""
    import hashlib

    from graphreports.operators.resources import ordered_digest

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        many = [("b", f"v\u00e9{i}") for i in range(100)] + [("a", "z"), ("a", None), ("c", "y"), ("c", "x"), (None, "n"), ("d", None)]
        out = ordered_digest(rows("k string, v string", *many), "k", "v")
        digest = lambda *v: hashlib.md5(" ".join(sorted(v, key=str.encode)).encode()).hexdigest()
        want = {"a": digest("z"), "b": digest(*[v for k, v in many if k == "b"]), "c": digest("x", "y"), None: digest("n")}
        assert {r.k: r.digest for r in out.collect()} == want
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in text and "Aggregate" not in text
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
