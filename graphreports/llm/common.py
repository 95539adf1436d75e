"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphreports.runtime import new_folder, remove_folder

SPACE = r"[\x20\x09-\x0D]+"  # what parts words; every other character belongs to a word
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


_folders: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, so that a lost executor costs no earlier stage.

    The folder is removed by :func:`remove_stored` or when the application ends.
    """
    spark = df.sparkSession
    place = new_folder(spark, label)
    _folders.append(place)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def stored_so_far() -> int:
    """A mark in the series of folders that :func:`stored` has made."""
    return len(_folders)


def remove_stored(spark: SparkSession, since: int, until: int) -> None:
    """Remove the folders made between two marks; nothing may read them any more."""
    for k in range(since, until):
        if _folders[k]:
            remove_folder(spark, _folders[k])
            _folders[k] = ""


def once(value: Column, name: str) -> Column:
    """Compute ``value`` once, also where later expressions name it many times (a generator is not merged into them)."""
    return F.explode(F.array(value)).alias(name)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, so that a caller's columns are never replaced."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
