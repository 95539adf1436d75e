"""The stored prefix and its tables in buckets: no shuffle under the item joins, hot keys apart, results as without it."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from graphreports.operators import metrics, publications, sessions
from graphreports.plans import prefix, reports
from graphreports.sources import buckets
from tests.test_plans import final_plan, no_broadcast, plan, tiny_partitions  # noqa: F401

H = "harvester string, "


def tables_of(rows, rng, n, hot=0):
    """Link tables of ``n`` items; item i0 is in ``hot`` sessions and has as many handlings."""
    pick = lambda kind, k: f"{kind}{rng.randrange(k)}"
    some = lambda make, m=n: [("h", *make()) for _ in range(m)]
    start = lambda: rng.choice([None, datetime(2024, 1, rng.randint(1, 28))])
    return {
        "session": rows(H + "session_uri string, held_by string, planned_start timestamp_ntz", *some(lambda: (pick("s", n), pick("b", 9), start()), 2 * n)),
        "session_item": rows(H + "session_uri string, item_uri string", *some(lambda: (pick("s", n), pick("i", n))), *[("h", f"s{k}", "i0") for k in range(hot)]),
        "item": rows(H + "item_uri string", *some(lambda: (pick("i", n),)), ("h", "i0")),
        "item_title": rows(H + "item_uri string, title string, title_datatype string, title_lang string", *some(lambda: (pick("i", n), pick("t", n // 4), "d", rng.choice([None, "nl"])))),
        "item_description": rows(H + "item_uri string, description string", *some(lambda: (pick("i", n), "x"))),
        "item_doc": rows(H + "item_uri string, doc_uri string", *some(lambda: (pick("i", n), pick("d", n)))),
        "handling_subject": rows(H + "handling_uri string, item_uri string", *some(lambda: (pick("a", n), pick("i", n))), *[("h", f"hot{k}", "i0") for k in range(hot)]),
        "handling_resolution": rows(H + "handling_uri string, resolution_uri string", *some(lambda: (pick("a", n), pick("r", n))), *[("h", f"hot{k}", f"r{k}") for k in range(hot)]),
        "handling_vote": rows(H + "handling_uri string, vote_uri string", *some(lambda: (pick("a", n), pick("v", n)))),
        "resolution": rows(H + "resolution_uri string", *some(lambda: (pick("r", n),)), *[("h", f"r{k}") for k in range(0, hot, 2)]),
        "publication": rows(H + "session_uri string, kind string, url string", *some(lambda: (pick("s", n), rng.choice(["notulen", "other"]), pick("u", n)))),
        "publication_source": rows(H + "url string, derived_from string", *some(lambda: (pick("u", n), pick("f", n)))),
    }


def bodies_of(rows):
    return rows(H + "unit_uri string, body_uri string, class_label string", *[("h", f"u{k % 4}", f"b{k}", "xyz"[k % 3]) for k in range(9)], ("h", "u0", "b0", "z"))


def same(a, b):
    cut = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return cut(a) == cut(b)


@pytest.mark.parametrize("hot", [0, 4000])
def test_reports_are_those_without_a_prefix(spark, rows, tmp_path, hot):
    t, bodies = tables_of(rows, random.Random(3), 120, hot), bodies_of(rows)
    stored = prefix.store_prefix(t, bodies, str(tmp_path / "p"), 4)
    assert stored.items["resolution"].hot.select("item_uri").distinct().count() == (1 if hot else 0)
    assert same(prefix.metrics_of(stored), metrics.unit_metrics(t, bodies))
    assert same(prefix.decisions_of(stored), metrics.decisions_by_class(t, bodies))
    assert same(prefix.bounds_of(stored), sessions.session_bounds(t["session"], bodies))
    newest = publications.latest_publication(t["session"], bodies, t["publication"], t["publication_source"])
    assert same(prefix.latest_publication_of(stored, t["publication"], t["publication_source"]), newest) and newest.count() > 1


def test_item_joins_need_no_exchange(spark, rows, tmp_path, no_broadcast):  # noqa: F811
    path = str(tmp_path / "p")
    stored = prefix.store_prefix(tables_of(rows, random.Random(4), 100), bodies_of(rows), path, 4)
    typed, known = prefix._typed(prefix._unit_items(stored)), stored.items
    for joined in (typed.join(known["resolution"]), typed.join(known["vote"]), typed.join(known["title"]).join(known["doc"])):
        text = final_plan(joined.cold)
        assert "SortMergeJoin" in text and "Exchange" not in text
    # Another application names the same files.
    again = buckets.load_split(spark, f"{path}/items", "resolution", H + "item_uri string, resolution_uri string", metrics.ITEM, 4)
    text = final_plan(typed.join(again).cold)
    assert "Exchange" not in text and same(typed.join(again).whole(), typed.join(known["resolution"]).whole())


def test_hot_keys_are_joined_apart_and_split(spark, tmp_path, tiny_partitions):  # noqa: F811
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
    many = spark.range(n, numPartitions=4).select(key.alias("key"), F.md5(F.col("id").cast("string")).alias("x"))
    one = spark.range(n, numPartitions=4).select(key.alias("key")).distinct().withColumn("y", F.lit(1))
    stored = buckets.save_split({"many": many, "one": one}, ["key"], str(tmp_path / "b"), 4)
    assert stored["many"].hot.count() == n // 3 and stored["one"].hot.count() == 1 and stored["many"].cold.filter("key = 'hot'").isEmpty()
    joined = stored["many"].join(stored["one"])
    assert joined.whole().count() == n
    text = final_plan(joined.hot)
    assert "skew=true" in text and "Exchange" not in final_plan(joined.cold)


def test_the_prefix_is_joined_once_for_all_reports(spark, rows, tmp_path, monkeypatch):
    t, made = tables_of(rows, random.Random(5), 60), []
    t["harvest_run"] = rows(H + "scheduled_job string, title string, status string, modified timestamp_ntz", ("h", "j", "Label", "s", datetime(2024, 1, 1)))
    units = rows(H + "unit_uri string, unit_id string, label string, classification string", *[("h", f"u{k}", f"id{k}", f"Label {k}", "c") for k in range(4)])
    run = reports.Run(t, units, bodies_of(rows), date(2024, 3, 31), datetime(2024, 3, 31, 3, 30))
    plain = {name: df for key in reports.REPORTS for name, df in reports.run_report(key, run).items()}
    join = prefix.held_by_unit
    monkeypatch.setattr(prefix, "held_by_unit", lambda *a: made.append(1) or join(*a))
    found = reports.run_reports(run, str(tmp_path / "reports"), 4)
    assert len(made) == 1 and set(found) == set(plain)
    for name, df in found.items():
        assert same(df, plain[name]), name
        assert "held_by" not in plan(df)  # no report joins sessions with bodies itself
        assert spark.read.schema(df.schema).parquet(f"{tmp_path}/reports/{name}").count() == plain[name].count()


def test_buckets_do_not_fill_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FULL", 1000)
    key = F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    many = spark.range(10_000).select(key, F.col("id").alias("x"))
    stored = buckets.save_split({"many": many, "few": many.limit(10)}, ["key"], str(tmp_path / "b"), 4)["many"]
    assert stored.cold.groupBy("key").count().rdd.getNumPartitions() == 12
    assert stored.hot.count() == 2500 and stored.cold.count() == 7500 and stored.cold.filter("key = 'hot'").isEmpty()
    assert buckets.enough([0], 8) == 8 and buckets.enough([4001], 4) == 8
