"""Parameterised SQL over the tables of a run."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **parameters: Any) -> DataFrame:
    """Run ``text`` with ``{table}`` names and ``:parameter`` values. Values are bound by Spark and
    never become part of the statement."""
    return spark.sql(text, args=parameters, **tables)
