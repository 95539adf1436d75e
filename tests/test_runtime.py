"""Bounds of what one task holds, and what is set down between steps."""

import os
import time

from pyspark.sql import functions as F

from graphreports import runtime
from graphreports.schemas import PLACE, once
from tests.test_plans import final_plan
from tests.test_sources import _quads


def test_parts_of_a_shuffle_are_bounded_whatever_the_width(spark):
    narrow = runtime.configure(spark.newSession())
    narrow.conf.set("spark.sql.shuffle.partitions", "2")
    keys = narrow.range(1_500_000).select(F.md5(F.col("id").cast("string")).alias("k")).groupBy("k").count()
    assert keys.rdd.getNumPartitions() > 4


def test_a_session_keeps_its_own_bounds(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    assert runtime.configure(own).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"


def test_quads_are_stored_in_columns(spark, tmp_path):
    text = F.concat(F.lit("http://data.example.org/id/"), F.col("id").cast("string"))
    df = spark.range(50_000).select(*[text.alias(c) for c in "abcdef"], F.lit(None).cast("string").alias("none"))
    back = runtime.stored(df)
    held = sum(os.path.getsize(os.path.join(d, n)) for f in back.inputFiles() for d, n in [os.path.split(f.removeprefix("file://"))])
    assert held < 0.2 * df.select(F.sum(sum(F.length(c) for c in "abcdef"))).first()[0]
    assert back.schema.names == df.schema.names and back.exceptAll(df).isEmpty() and back.count() == 50_000
    assert runtime.stored(df.limit(0)).collect() == []


def test_equal_quads_are_left_out_by_one_sort(spark, rows):
    some = _quads(rows, ("a", "p", "x"), ("a", "p", "x", "literal"), ("a", "p", "y"), ("b", "p", "x"))
    none = some.withColumns({"g": F.lit(None).cast("string"), "o_kind": F.lit(None).cast("string")})
    many = some.unionByName(none).unionByName(some).unionByName(none)
    found = once(many.repartitionByRange(*PLACE))
    assert sorted(map(str, found.collect())) == sorted(map(str, many.distinct().collect()))
    text = final_plan(found).split("== Initial Plan ==")[0]
    assert text.count("Exchange ") == 1 and text.count("Sort [") == 1 and "Aggregate" not in text


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    kept = spark.conf.get(runtime.SHUFFLE_CLEANUP)
    df = spark.range(200_000).groupBy(F.md5(F.col("id").cast("string")).alias("k")).count()
    before = _shuffle_files(spark)
    assert runtime.stored(df).count() == 200_000
    deadline = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < deadline:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and spark.conf.get(runtime.SHUFFLE_CLEANUP) == kept


def test_passing_tables_go_with_their_block(spark):
    with runtime.passing(spark) as keep:
        df = keep(spark.range(10))
        place = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert df.count() == 10 and os.path.exists(place)
    assert not os.path.exists(place)
