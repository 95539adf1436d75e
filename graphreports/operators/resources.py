"""Generic operators: resource assembly, single-row results, limits and zero suppression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assemble(df: DataFrame, key: str | list[str], properties: list[str]) -> DataFrame:
    """One row per resource with the distinct values of each property as a sorted array.

    A star of properties repeats every value once per combination; repeats are dropped in each
    task before rows are shuffled, so only a resource's distinct values come together."""
    keys = [key] if isinstance(key, str) else list(key)
    values = [F.array_sort(F.collect_set(name)).alias(name) for name in properties]
    return df.groupBy(*keys).agg(*values)


def assemble_parts(df: DataFrame, key: str | list[str], properties: list[str], limit: int = 100_000) -> DataFrame:
    """:func:`assemble` for resources with any number of values: ``key``, ``part``, ``parts`` and the properties.

    A resource with at most ``limit`` distinct values in all has one part, as nearly all have. Another has as many parts as keep the expected
    size of each at half of that; a value's part follows from its hash, so the parts of a resource are independent of how the table
    lies. Values are distinct over all parts and sorted within each. First every task drops repeats and distinct values are spread by
    value; then values are counted per resource, with a partial step; then they meet in parts. A null value counts as none."""
    keys = [key] if isinstance(key, str) else list(key)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = [F.struct(F.lit(i).alias("property"), F.col(c).cast("string").alias("value")) for i, c in enumerate(properties)]
    values = df.select(*keys, F.explode(F.array(*one)).alias("v")).select(*keys, "v.*")
    # A resource is kept though it has no value at all.
    distinct = values.withColumn("property", F.when(F.col("value").isNotNull(), F.col("property"))).distinct()
    sizes = distinct.groupBy(*keys).agg(F.count("value").alias("n")).filter(F.col("n") > limit)
    many = sizes.select(*[F.col(k).alias(f"large_{k}") for k in keys], F.ceil(F.col("n") * 2 / limit).cast("int").alias("parts"))
    same = [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys]
    dealt = distinct.join(many, same, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = dealt.withColumn("part", F.pmod(F.xxhash64("property", "value"), F.col("parts")).cast("int"))
    own = lambda i, c: F.array_sort(F.collect_list(F.when(F.col("property") == i, F.col("value").cast(kinds[c]))))
    return placed.groupBy(*keys, "part").agg(F.max("parts").alias("parts"), *[own(i, c).alias(c) for i, c in enumerate(properties)])


def ordered_digest(df: DataFrame, key: str, value: str, name: str = "digest") -> DataFrame:
    """``key`` and the MD5, in hex, of its values (text) in ascending order with a space between them. A null value counts as none.

    A digest is sequential, so the values of a key go through one task. They are sorted there, on disk where memory ends, and stream through
    it: a task holds one batch, whatever the number of values."""
    rows = df.select(F.col(key), F.col(value).alias("value")).filter(F.col("value").isNotNull())
    ordered = rows.repartition(key).sortWithinPartitions(key, "value")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of], keys), pa.array([state.hexdigest()])], names=[key, name])

        keys = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.schema.field(0).type
            ends = pc.run_end_encode(batch.column(0))
            start = 0
            for this, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                text = " ".join(batch.column(1).slice(start, end - start).to_pylist()).encode()
                if state is None or this != of:
                    if state is not None:
                        yield done()
                    state, of = hashlib.md5(text), this
                else:
                    state.update(b" " + text)
                start = end
        if state is not None:
            yield done()

    schema = T.StructType([df.select(key).schema.fields[0], T.StructField(name, T.StringType())])
    return ordered.mapInArrow(digests, schema)


def scalar_or_list(values: Column) -> Column:
    """The value itself when an assembled property has only one, NULL otherwise."""
    return F.when(F.size(values) == 1, values[0])


def single_row(df: DataFrame) -> DataFrame:
    """``df``'s row; running it fails unless there is exactly one."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct(*[F.col(c) for c in df.columns])).alias("row")
    )
    message = F.format_string("expected exactly one row, got %d", F.col("n"))
    checked = F.when(F.col("n") == 1, F.col("row")).otherwise(
        F.raise_error(message).cast(counted.schema["row"].dataType)
    )
    return counted.select(checked.alias("row")).select("row.*")


def limit_or_all(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows; 0 means all."""
    if n < 0:
        raise ValueError("a limit is zero or positive")
    return df.limit(n) if n else df


def non_zero(df: DataFrame, column: str = "n") -> DataFrame:
    return df.filter(F.col(column) > 0)
