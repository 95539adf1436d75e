"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Joins meet keys that hold a large share of all rows (one body, session or item). Adaptive
# execution splits such partitions, also where that needs one more shuffle behind the join, and
# turns a join into a broadcast only after the size of the side is measured.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Shuffles are dealt widely and merged by adaptive execution up to the given size, so that what one task holds does not grow with
# the data. Quads and link tables are text that repeats itself: 8 MB as shuffled are about 160 MB as rows. A side of a join whose
# parts are all below that is hashed, not sorted: keys share their first bytes, by which Spark's sort tells rows apart cheaply.
WIDTH, PART = 1000, 8 << 20
BOUNDED_PARTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(WIDTH),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PART),
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(PART),
    "spark.sql.execution.rangeExchange.sampleSizePerPartition": "20",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session. Bounds of parts that a session sets itself stay as they are."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    named = spark.conf.getAll
    for key, value in BOUNDED_PARTS.items():
        if key not in named:
            spark.conf.set(key, value)
    return spark


def file_system(spark: SparkSession, path: str):
    """A path of any of the cluster's file systems, and that file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fallback_folder(master: str, warehouse: str) -> str:
    """Where intermediate tables go if ``spark.checkpoint.dir`` is unset: the warehouse, if driver and executors share it."""
    if not re.match(r"local(\[|$)", master) and re.match("file:|/", warehouse):
        raise ValueError(f"set spark.checkpoint.dir: {warehouse} is a folder of one machine, and {master} has several")
    return f"{warehouse.rstrip('/')}/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one: that ``spark.checkpoint.dir`` names or, where it
    is unset, one in the warehouse, if that is shared too. It goes with the application."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or fallback_folder(sc.master, spark.conf.get("spark.sql.warehouse.dir")))
    place, fs = file_system(spark, sc.getCheckpointDir())
    fs.deleteOnExit(place)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the application's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    place, fs = file_system(spark, path)
    fs.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files: Spark removes them as soon as the action has ended. Without it they stay until the driver's garbage
    collector finds that nothing names them, and a job of many steps holds the shuffles of all of them at once. For frames that are run
    once, as those that are written down are."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, in columns and compressed. A checkpoint holds rows as they lie in memory: of quads, whose text repeats itself, dozens
    of times as much. Rows come back in another order and other partitions."""
    return _set_down(df, new_folder(df.sparkSession, "stored"))


def _set_down(df: DataFrame, path: str) -> DataFrame:
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like :func:`stored`, whose tables are removed when the block ends: for what nothing reads after a step."""
    places: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        places.append(new_folder(spark, "passing"))
        return _set_down(df, places[-1])

    try:
        yield kept
    finally:
        for place in places:
            remove_folder(spark, place)
