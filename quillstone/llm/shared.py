"""What the operators of this subpackage share: the cluster's shared folder, Arrow batches, components."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that `joined` broadcasts at most.
HOT_KEYS = 100_000
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, a URI."""
    root = checkpoint_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Inside, what goes to the shared folder is noted; afterwards it is deleted. For a step whose result is written elsewhere."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            removed(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    return stored(df, "cut")


def joined(rows: DataFrame, one: DataFrame, keys: list[str], values: list[str], total: int) -> DataFrame:
    """rows with the values of `one` (keys, values, n: how many of the `total` rows have the key), null where it has no row.

    Keys of over total / HOT_KEYS rows, of which there can be at most HOT_KEYS, are joined by a broadcast, so that no task
    gets all rows of a hot key; in the shuffled join of the others the rows that have their values are spread by chance keys.
    """
    least = max(1000, total // HOT_KEYS)
    hot = one.where(F.col("n") > least).select(*(F.col(k).alias(f"{k}__hot") for k in keys), F.lit(True).alias("is__hot"), *(F.col(v).alias(f"{v}__hot") for v in values))
    cold = one.where(F.col("n") <= least).select(*(F.col(k).alias(f"{k}__cold") for k in keys), *(F.col(v).alias(f"{v}__cold") for v in values))
    near = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"{k}__hot") for k in keys], "left")
    # A hot row meets nothing in the second join; its number keeps such rows in different tasks. The numbers are hashes, as a
    # constant would be folded away and the rows dealt by their keys again.
    near = near.withColumn("deal__", F.when(F.col("is__hot"), F.xxhash64(*(c for c in rows.columns if c not in keys))).otherwise(F.xxhash64(*keys)))
    cold = cold.withColumn("deal__cold", F.xxhash64(*(F.col(f"{k}__cold") for k in keys)))
    both = near.join(cold, [*(F.col(k) == F.col(f"{k}__cold") for k in keys), F.col("deal__") == F.col("deal__cold")], "left")
    return both.select(*rows.columns, *(F.when(F.col("is__hot"), F.col(f"{v}__hot")).otherwise(F.col(f"{v}__cold")).alias(v) for v in values))


def batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes at most, one row at least."""
    for batch in rows:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 8 << 20) -> DataFrame:
    """mapInArrow of `work` over slices of bounded size."""

    def run(rows):
        for batch in batches(rows, most):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; a null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds on joins: no node's neighbours are ever gathered in one row, and each
    round is written to the shared folder, and the one before it deleted. A round that changes nothing ends it. Rounds
    grow with the logarithm of the longest path; RuntimeError if `most_rounds` don't suffice.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "round")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    state, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = state.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(b % 1000003)").alias("s")).first()
        if now["n"] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before = path
        state, path = written(small.where("a <> b").distinct())
        removed(spark, before)
    else:
        raise RuntimeError(f"components don't settle in {most_rounds} rounds")
    roots = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
