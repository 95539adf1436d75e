from datetime import date, datetime

import pytest

from checks.catalogue import dimension
from checks.projection import Projection
from graphreports.plans import reports
from graphreports.plans.queries import query
from graphreports.plans.quads import RESOURCES, reports_to_quads
from graphreports.sources.store import write_reports
from graphreports.vocabulary import RDF_TYPE, iri

DAY = date(2024, 3, 31)


@pytest.fixture(scope="module")
def run(spark):
    p = Projection(spark, "/root/testdata/sf0.001")
    unit, body = dimension(p)
    return reports.Run(p, unit, body, DAY, datetime(2024, 3, 31, 1, 30))


def test_every_report_runs_and_links_only_what_exists(run):
    tables = reports.run_report("COUNT_RESOURCES", run)
    bodies = {r.report_uri for r in tables["governing_body_count_report"].collect()}
    linked = {u for r in tables["admin_unit_count_report"].collect() for u in r.governing_body_reports}
    counted = {r.report_uri for r in tables["publication_count_report"].collect()}
    assert bodies == linked == counted
    assert tables["admin_unit_count_report"].count() == run.units.count() > len(bodies)
    assert not reports.quads_of(tables).isEmpty()
    with pytest.raises(ValueError, match="unknown report"):
        reports.run_report("DUMMY", run)


def test_a_day_window_restricts_the_sessions(spark, run):
    p = run.tables
    day = p["session"].filter("planned_start is not null").first().planned_start.date()
    windowed = reports.Run(p, run.units, run.bodies, DAY, run.created_at, window=day)
    found = {r.first_session.date() for r in reports.session_timestamp_report(windowed).collect()}
    assert found <= {day}


def test_quads_of_a_report(rows):
    row = rows(
        "harvester string, graph string, report_uri string, uuid string, created_at timestamp_ntz, day date, label string,"
        " first_session timestamp_ntz, last_session timestamp",
        ("h", "g", "r", "id", datetime(2024, 3, 31, 1, 30), DAY, "it's", datetime(2024, 10, 27, 12), None),
    )
    quads = {(q.p, q.o, q.o_datatype) for q in reports_to_quads(row, RESOURCES["session_timestamp_report"]).collect()}
    dm = lambda name: iri(f"monitoring:{name}")
    assert quads == {
        (RDF_TYPE, dm("SessionTimestampReport"), None),
        (dm("createdAt"), "2024-03-31T01:30:00+01:00", iri("xsd:dateTime")),
        (dm("day"), "2024-03-31", iri("xsd:date")),
        (iri("skos:prefLabel"), "it's", iri("xsd:string")),
        (iri("mu:uuid"), "id", iri("xsd:string")),
        (dm("firstSession"), "2024-10-27T12:00:00+01:00", iri("xsd:dateTime")),
    }


@pytest.mark.parametrize("key", sorted(set(reports.REPORTS) - {"COUNT_RESOURCES"}))
def test_other_reports_become_quads(run, key):
    assert not reports.quads_of(reports.run_report(key, run)).isEmpty()


def test_written_reports_are_replaced_per_unit(spark, rows, tmp_path):
    path, schema = str(tmp_path / "reports"), "harvester string, unit_uri string, n int, day date"
    keys = ["harvester", "unit_uri", "day"]
    before = date(2024, 3, 30)
    write_reports(rows(schema, ("h", "a", 1, DAY), ("h", "b", 2, DAY), ("h", "a", 3, before)), path, keys)
    for _ in range(2):
        write_reports(rows(schema, ("h", "a", 10, DAY), ("h", "c", 11, DAY)), path, keys)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("unit_uri", "n", "day").collect())
    assert got == [("a", 3, before), ("a", 10, DAY), ("b", 2, DAY), ("c", 11, DAY)]


def test_parameters_are_values_not_text(spark, rows):
    frame = rows("name string", ("x' or '1'='1",), ("y",))
    got = query(spark, "select name from {t} where name = :n", {"t": frame}, n="x' or '1'='1")
    assert got.count() == 1


def test_reports_are_computed_once_when_written(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows_ = spark.range(10).select(F.col("id").cast("string").alias("unit_uri"), F.lit("h").alias("harvester"), F.lit(DAY).alias("day"))
    made = rows_.mapInPandas(count, rows_.schema)
    for turn in (1, 2):
        write_reports(made, str(tmp_path / "r"), ["harvester", "unit_uri"], DAY)
        assert seen.value == 10 * turn
    assert spark.read.parquet(str(tmp_path / "r")).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["r"]


def test_reports_join_metrics_that_are_set_down(run):
    """No report holds the shuffles that metrics and decisions come from."""
    for report in (reports.publication_count_report, reports.governing_body_count_report, reports.admin_unit_count_report, reports.decision_report):
        text = report(run)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in text and "o_orderkey" not in text.split("best")[0], report.__name__
