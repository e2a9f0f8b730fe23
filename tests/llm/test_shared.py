"""Components, hot joins and what is left behind in the shared folder."""

import os

import pytest
from pyspark.sql import functions as F
from quillstone.llm import shared


def test_components(spark):
    edges = [(k + 1, k) for k in range(0, 200)] + [(1000 + k, 1000) for k in range(300)] + [(5, 5)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    with pytest.raises(RuntimeError):
        shared.components(spark.createDataFrame(edges, "a long, b long"), 2)


def test_joined(spark, monkeypatch):
    """Hot keys by a broadcast, the others by a shuffle; null keys and keys without a row have none; every row stays."""
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 700).cast("string")).alias("k"))
    one = rows.where("k is not null and k <> '1'").groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    got = {r.id: r.first for r in shared.joined(rows, one, ["k"], ["first"], 4000).collect()}
    firsts = {r.k: r.first for r in one.collect()}
    assert got == {r.id: firsts.get(r.k) for r in rows.collect()}


def test_scratch(spark):
    with shared.scratch(spark):
        path = shared.shared_folder(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))
