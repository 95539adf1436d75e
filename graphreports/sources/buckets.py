"""Tables laid out for joins on one key, so that the joins need no shuffle.

Tables of one key are written in the same number of buckets; Spark joins and groups them bucket by bucket. A bucket can't be split as a
shuffled partition can, so keys that hold a large share of a table's rows are kept apart: they are written plainly and joined with a shuffle, whose partitions
adaptive execution splits. ``Split`` holds both parts of a table; a join of two is the join of either part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphreports.runtime import freeing

SHARE = 4  # a key is hot if it alone has more rows than this part of an average bucket
CELLS = 16  # cells for each hot key that a table can have
FULL = 500_000  # rows of the largest table in an average bucket, at most


@dataclass(frozen=True)
class Split:
    """A table in two parts with no key in common: ``cold`` in buckets by ``key``, ``hot`` not."""

    key: tuple[str, ...]
    cold: DataFrame
    hot: DataFrame

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Split:
        """``change`` of either part; it must keep the rows of a key together and the key as it is."""
        return Split(self.key, change(self.cold), change(self.hot))

    def join(self, other: Split, how: str = "inner") -> Split:
        key = list(self.key)
        return Split(self.key, self.cold.join(other.cold, key, how), self.hot.join(other.hot, key, how))

    def whole(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


def enough(counts: Sequence[int], buckets: int) -> int:
    """``buckets``, or a multiple of it where tables of so many rows would fill them: a task reads one bucket of each table."""
    return buckets * max(1, -(-max(counts) // (buckets * FULL)))


def hot_keys(tables: Sequence[DataFrame], key: Sequence[str], buckets: int, counts: Sequence[int] | None = None) -> DataFrame:
    """Keys with more rows in one of the tables than a quarter of its average bucket. Each table has ``4 * buckets`` of them at
    most, so they can be sent to every task. ``counts`` are the tables' rows, if known."""
    found = []
    cell = F.pmod(F.xxhash64(*key), F.lit(CELLS * SHARE * buckets)).alias("cell")
    for df, n in zip(tables, counts or [df.count() for df in tables], strict=True):
        most = max(1000, n // (buckets * SHARE))
        # Rows are counted by cells of keys, which costs no shuffle of keys; a hot key is in a cell with as many rows, and such cells are few.
        full = F.broadcast(df.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("cell"))
        few = df.select(*key, cell).join(full, "cell", "left_semi")
        found.append(few.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*key))
    return reduce(DataFrame.unionByName, found).distinct()


def save_split(tables: Mapping[str, DataFrame], key: Sequence[str], path: str, buckets: int) -> dict[str, Split]:
    """Write tables that are joined on ``key`` and read them back; rows without a whole key are left out, since no join has them. The
    tables have to be cheap to read, or stored: they are read three times. Large tables get a multiple of ``buckets``, see :func:`enough`."""
    keyed = {name: df.dropna(subset=list(key)) for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    counts = [df.count() for df in keyed.values()]
    buckets = enough(counts, buckets)
    with freeing(spark):
        hot_keys(list(keyed.values()), key, buckets, counts).write.parquet(f"{path}/hot_keys")
    hot = F.broadcast(spark.read.parquet(f"{path}/hot_keys"))  # 4 * buckets keys a table at most
    out = {}
    for name, df in keyed.items():
        table = f"bucketed_{uuid.uuid4().hex}"  # a name in the session's catalog; the files are those under ``path``
        with freeing(spark):
            (
                df.join(hot, list(key), "left_anti")
                .repartition(buckets, *key)
                .write.bucketBy(buckets, *key)
                .sortBy(*key)
                .format("parquet")
                .option("compression", "zstd")
                .option("path", f"{path}/{name}/cold")
                .saveAsTable(table)
            )
            df.join(hot, list(key), "left_semi").write.parquet(f"{path}/{name}/hot")
        out[name] = Split(tuple(key), spark.table(table), spark.read.schema(df.schema).parquet(f"{path}/{name}/hot"))
    return out


def load_split(spark: SparkSession, path: str, name: str, schema: str, key: Sequence[str], buckets: int) -> Split:
    """A table that another application wrote with :func:`save_split`; ``schema`` as DDL, ``buckets`` as written."""
    table = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({', '.join(key)}) SORTED BY ({', '.join(key)}) INTO {buckets} BUCKETS"
        f" LOCATION '{path}/{name}/cold'"
    )
    return Split(tuple(key), spark.table(table), spark.read.schema(schema).parquet(f"{path}/{name}/hot"))
