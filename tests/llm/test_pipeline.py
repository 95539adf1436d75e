"""The corpus pipeline, and the registered queries, on the smallest supplied tables."""

import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from graphreports.llm import common
from graphreports.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_mixes import check_packing

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        assert docs.columns == columns, name
        seen[name] = before = docs
    kept = seen["quality_rules"].collect()
    assert kept and all(not brute.measures(r["text"])[5] for r in kept)
    lines = [x.strip().lower() for r in seen["line_dedup"].collect() for x in r["text"].split("\n")]
    long = [x for x in lines if len(x) >= 20]
    assert len(long) == len(set(long))
    near = [brute.fingerprint(r["text"]) for r in seen["simhash_near_dedup"].collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(near) for b in near[:i])
    mixed = seen["mixing"].collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen["mixing"], SF).collect()
    once = {r["doc_id"]: r["text"] for r in mixed}
    assert {r["doc_id"] for r in packed} == set(once)
    assert check_packing([r for r in packed if list(x["doc_id"] for x in mixed).count(r["doc_id"]) == 1], [(k, t) for k, t in once.items() if [x["doc_id"] for x in mixed].count(k) == 1], gapless=False)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


CLASHING = [
    "__quality", "__w", "__n", "__keys", "__at", "__lines", "__left", "__first", "__h1", "__root", "__copy", "lines", "left", "first", "row", "doc", "h1", "h2", "h1_",
    "chosen1", "root", "nth", "copy", "fp", "id", "of", "passes", "threshold", "stratum", "cutoff", "own_0", "place", "component_id",
]


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns called as columns that the stages use come through with their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.select("*", *[F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(name) for name in CLASHING])
    before = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING), name
        before = spark.createDataFrame(rows, odd.schema)


def test_stages_remove_what_the_stage_before_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    begun, ended = corpus_pipeline._left
    folders = common._folders[begun:ended]
    kept = spark.createDataFrame(first.collect(), docs.schema)
    assert folders and all(os.path.exists(f.removeprefix("file:")) for f in folders)
    corpus_pipeline.STAGES[1][1](spark, kept, SF).collect()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_queries_return_every_row(spark, name):
    table = "pages" if name in ("op3_warc", "op7_extraction") else "conversations" if name == "op12_conversations" else "documents"
    got = QUERIES[name](spark, SF)
    rows = got.filter("piece = 0").count() if name == "op2_packing" else got.count()
    whole = spark.read.parquet(os.path.join(SF, f"{table}.parquet"))
    assert rows == (whole.select("conv_id").distinct() if table == "conversations" else whole).count()
    assert set(ORACLES) <= set(QUERIES)
