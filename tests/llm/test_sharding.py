"""op7: whole rows, equal counts, slots without a gap, the same on a second run."""

import zlib
from collections import Counter

import numpy as np
from quillstone.llm import sharding


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: r for r in sharding.digests(docs, bucket_bytes=30000).collect()}
    again = {r.doc_id: r for r in sharding.digests(docs.repartition(7), bucket_bytes=30000).collect()}
    assert first == again
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {d: (r.size, r.text_crc32) for d, r in first.items()} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    counts = Counter(r.shard for r in first.values())
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in first.values() if r.shard == s) == list(range(n))
    order = [d for d, r in sorted(first.items(), key=lambda x: (x[1].shard, x[1].slot))]
    assert order != sorted(order) and abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "b"), (3, "b"), (4, "c" * 100000)], "doc_id long, text string").selectExpr("*", "'s' as shard", "9 as bucket")
    out = sharding.write_shards(docs, shards=4)
    assert out.count() == 6 and "bucket" in out.columns
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [1, 1, 2, 2]
    assert sharding.digests(docs.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    """A row that is half of the table goes to many buckets; each copy has a slot, and the columns of the pass clash with nothing."""
    rows = [(7, "same", 0)] * 400 + [(100 + n, f"text {n}", n) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark_of_pass int")
    out = sharding.shuffled(docs, shards=4, bucket_bytes=300).collect()
    assert Counter((r.doc_id, r.text, r.mark_of_pass) for r in out) == Counter(rows)
    counts = Counter(r.shard for r in out)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(200)) for s in range(4)) and set(counts) == set(range(4))
    assert all(60 < n < 140 for n in Counter(r.shard for r in out if r.doc_id == 7).values())


def test_tasks_go_through_buckets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shuffled(docs, bucket_bytes=5000).collect())
    monkeypatch.setattr(sharding, "MOST_TASKS", 3)
    assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.shuffled(docs, bucket_bytes=5000).collect()) == one


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, (7, k))) for k in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
