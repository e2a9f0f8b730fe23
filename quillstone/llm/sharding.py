"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash of doc_id and text. Pass two puts
each bucket in a fixed order, shuffles it (Fisher-Yates, seeded by the bucket) and writes it. A bucket's place among all
rows is the sum of the counts before it, so that shard = place * shards div rows, and the slots of a shard have no gap and
its count differs from any other's by one at most. What the driver holds is one count for each bucket, 2**23 at most, which
are 200 TB; beyond that buckets grow. A task goes through the buckets dealt to it one after the other, sorted by Spark, so
that one bucket at a time is in memory. A run over the same rows gives the same shards, however its tasks are retried.

Nulls: a null doc_id hashes like any value, a null text counts no bytes. Equal rows are numbered, are spread over the
buckets by their numbers, and each gets a slot of its own. All columns are written; columns named shard or slot are
replaced, and those named as the pass's own come back as they were.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_folder, stored

SHARDS, SEED, BUCKET_BYTES = 16, 20240501, 24 << 20
#: Buckets, whose counts the driver holds (64 MB), and tasks that they are dealt to; a task goes through its buckets one by one.
MOST_BUCKETS, MOST_TASKS = 1 << 23, 1 << 15
OWN = ["bucket_of_pass", "mark_of_pass", "copy_of_pass"]


def size_of() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    order = list(range(n))
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with copy_of_pass, the number of a row among equal rows, so that these don't share one bucket.

    Only rows of a doc_id and text that repeat are grouped. Equal rows are one and the same, so that it doesn't matter which gets which number.
    """
    key = [F.xxhash64("doc_id", "text").alias("k")]
    again = docs.select(*key).groupBy("k").count().where("count > 1").select("k")
    if not again.limit(1).count():
        return docs.withColumn("copy_of_pass", F.lit(0).cast("long"))
    again = stored(again, "again")
    own = docs.withColumn("k", *key)
    several = own.join(again, "k").drop("k").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("n__")).withColumn("copy_of_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n__") - 1))).drop("n__")
    return stored(own.join(again, "k", "left_anti").drop("k").withColumn("copy_of_pass", F.lit(0).cast("long")).unionByName(several), "apart")


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs with shard (int) and slot (long), each partition some buckets, each in its final order."""
    clash = [c for c in docs.columns if c in OWN]
    if clash:
        plain = shuffled(docs.withColumnsRenamed({c: f"{c}__own" for c in clash}), shards, seed, bucket_bytes)
        return plain.withColumnsRenamed({f"{c}__own": c for c in clash})
    docs = docs.select([c for c in docs.columns if c not in ("shard", "slot")])
    kinds = docs.schema.fields
    whole = docs.agg(F.sum(size_of()).alias("n")).first()["n"] or 0
    buckets = max(1, min(MOST_BUCKETS, math.ceil(whole / bucket_bytes)))
    docs = told_apart(docs)
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), F.col("copy_of_pass"))
    bucket = F.pmod(mark, F.lit(buckets)).cast("int")
    told = docs.select(bucket.alias("b")).groupBy("b").count().toArrow()
    counts = np.zeros(buckets + 1, np.int64)
    counts[told.column("b").to_numpy() + 1] = told.column("count").to_numpy()
    starts = np.cumsum(counts)
    rows = int(starts[-1])
    schema = T.StructType([*kinds, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    firsts = np.array([-(-rows * s // shards) for s in range(shards + 1)], np.int64)

    def dealt_out(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        at = table.column("bucket_of_pass")[0].as_py()
        table = table.drop_columns(OWN).take(pa.array(fisher_yates(table.num_rows, (seed, at))))
        place = np.arange(starts[at], starts[at + 1])
        shard = np.searchsorted(firsts, place, "right") - 1
        table = table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - firsts[shard]))
        yield from table.to_batches(max_chunksize=2000)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("bucket_of_pass")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and held[-1].column("bucket_of_pass")[0].as_py() != of[a]:
                    yield from dealt_out(held)
                    held = []
                held.append(part)
        if held:
            yield from dealt_out(held)

    tasks = min(buckets, MOST_TASKS)
    dealt = docs.withColumns({"bucket_of_pass": bucket, "mark_of_pass": mark}).repartitionById(tasks, F.col("bucket_of_pass") % tasks)
    return dealt.sortWithinPartitions("bucket_of_pass", "mark_of_pass", "doc_id", "text", "copy_of_pass").mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the shards as Parquet, a folder each, rows in the order of their slots; gives the table as read again."""
    path = path or shared_folder(docs.sparkSession, "shards")
    rows = shuffled(docs, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    fields = [f for f in rows.schema.fields if f.name != "shard"]
    return docs.sparkSession.read.schema(T.StructType([*fields, T.StructField("shard", T.IntegerType())])).parquet(path)


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) from the shards as written."""
    out = write_shards(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", size_of().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
