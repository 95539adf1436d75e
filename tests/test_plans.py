"""The plans that matter at scale: join kinds, early reduction, pruning, and behaviour on hot keys."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.catalogue import QUERIES
from checks.projection import Projection
from graphreports.operators import metrics, publications, sessions
from graphreports.sources import nquads
from graphreports.sources.store import load_dimension, save_dimension

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def p(spark):
    return Projection(spark, SF)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_missing_values_are_anti_joins(p):
    text = plan(metrics.items_without(p["session_item"], p["item_title"]))
    assert "LeftAnti" in text and "NestedLoop" not in text


def test_newest_session_is_limited_before_the_shuffle(spark, p):
    bodies = p["unit_body"].withColumn("harvester", F.lit("https://harvester-0.example.org/sparql"))
    text = plan(publications.latest_publication(p["session"], bodies, p["publication"], p["publication_source"]))
    # One row per unit leaves each task: an aggregate with a partial step, and no window.
    assert "Window" not in text and "partial_min(" in text


@pytest.mark.parametrize(
    "name",
    [
        "unit_metrics", "decision_report", "maturity_report", "last_harvest_report", "match_rate", "merge_units",
        "unmatched_units", "harvest_titles", "unit_bodies", "follow_path", "delete_subjects_inbound", "replace_properties",
    ],
)
def test_no_query_multiplies_rows_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["count_sessions"](spark, SF))
    assert "l_orderkey" not in text and "o_comment" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate" in text


def test_metrics_share_the_reduction_of_items(spark, p, no_broadcast):
    bodies = p["unit_body"].withColumn("harvester", F.lit("https://harvester-0.example.org/sparql"))
    assert final_plan(metrics.unit_metrics(p, bodies)).count("ReusedExchange") >= 3


def test_small_snapshot_is_broadcast_by_its_file_size(spark, p, tmp_path):
    path = str(tmp_path / "bodies")
    bodies = p["unit_body"].withColumn("harvester", F.lit("https://harvester-0.example.org/sparql"))
    save_dimension(bodies, path, date(2024, 1, 1))
    joined = sessions.held_by_unit(p["session"], load_dimension(spark, path))
    assert "BroadcastHashJoin" in plan(joined)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(sessions.held_by_unit(p["session"], load_dimension(spark, path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def tiny_partitions(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _hot(spark, n):
    """A third of all sessions with one body, and a third of all items in one session."""
    part = lambda i: F.when(F.col("id") % 3 == 0, F.lit(f"{i}-hot")).otherwise(F.concat(F.lit(f"{i}-"), F.col("id")))
    ids = spark.range(n, numPartitions=8)
    session = ids.select(
        F.lit("h").alias("harvester"), F.concat(F.lit("s-"), F.col("id")).alias("session_uri"), part("b").alias("held_by"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("planned_start"),
    )
    bodies = ids.select(F.lit("h").alias("harvester"), part("u").alias("unit_uri"), part("b").alias("body_uri"), F.lit("c").alias("class_label"))
    item = ids.select(
        F.lit("h").alias("harvester"),
        F.when(F.col("id") % 3 == 0, F.lit("s-0")).otherwise(F.concat(F.lit("s-"), F.col("id"))).alias("session_uri"),
        F.concat(F.lit("i-"), F.col("id")).alias("item_uri"),
    )
    return session, bodies, item


def test_hot_body_is_split(spark, tiny_partitions):
    session, bodies, _ = _hot(spark, 30000)
    joined = sessions.held_by_unit(session, bodies.distinct())
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 30000


def test_hot_session_and_unit_are_counted_whole(spark, tiny_partitions):
    session, bodies, item = _hot(spark, 30000)
    tables = {"session": session, "session_item": item}
    counts = metrics.count_items(tables, bodies)
    text = final_plan(counts)
    assert "skew=true" in text
    hot = counts.filter("unit_uri = 'u-hot'").first().n
    assert hot == 10000 and counts.agg(F.sum("n")).first()[0] == 30000


def test_a_line_is_checked_once(spark):
    lines = spark.createDataFrame([("<s> <p> \"a\\u0041\" .",), ("broken",), ("<s> <p> <o> . # said",), (None,)], "value string")
    quads = nquads.parse_nquads(lines, "h")
    above = quads._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_replace" not in above, "terms are read from fields, not from the line again"
    assert sorted(r["o"] for r in quads.collect()) == ["aA", "o"]
