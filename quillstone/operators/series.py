"""Time series of frames: fingerprints, distinct frames, even samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """F47."""
    return F.bit_count(a.bitwiseXOR(b))


def gradient_bits(values: Column, n: int = 64) -> Column:
    """Bit k of a fingerprint is set if value k + 1 is larger than value k."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda k: F.when(F.get(values, (k + 1).cast("int")) > F.get(values, k.cast("int")), F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def look(pixels: Column, width: int, height: int) -> Column:
    """(shape, tone) of a picture of gray levels, row by row: a bit for each pixel that is darker than the one on its right, and their mean."""
    at = F.sequence(F.lit(0), F.lit(height * (width - 1) - 1))
    here = lambda k: F.floor(k / (width - 1)).cast("int") * width + k % (width - 1)
    bits = F.transform(at, lambda k: F.when(F.get(pixels, here(k) + 1) > F.get(pixels, here(k)), F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))).otherwise(F.lit(0).cast("bigint")))
    tone = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return F.struct(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)).alias("shape"), tone.alias("tone"))


def first_equal(frames: DataFrame, group: list[str], order: str, pixels: str) -> DataFrame:
    """Each frame with the first one of its group that has the same pixels, all of them. A hash of the pixels is the key, the pixels decide."""
    own = frames.withColumn("key", F.xxhash64(pixels))
    first = own.groupBy(*group, "key", pixels).agg(F.min(order).alias("first"))
    return own.join(first, [*group, "key", pixels]).select(*group, order, "first")


def distinct_frames(frames: DataFrame, group: str, order: str, shape: str, tone: str, distance: int = 4, gap: float = 8.0) -> DataFrame:
    """(group, order, repeats): each frame with the last kept one that it repeats, or null if it is kept.

    Rows stream in order, the state is the last kept frame.
    """

    def run(batches):
        now = last = None
        for batch in batches:
            out = []
            for k, o, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, last = k, None
                if last is not None and ((s ^ last[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance and abs(t - last[2]) < gap:
                    out.append(last[0])
                else:
                    out.append(None)
                    last = (o, s, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.schema.field(1).type)], [group, order, "repeats"])

    own = frames.select(group, order, F.col(shape).cast("long"), F.col(tone).cast("double"))
    kinds = dict(own.dtypes)
    return own.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, repeats {kinds[order]}")


def spread(rows: DataFrame, group: list[str], order: list[str], n: Column) -> DataFrame:
    """N rows of each group, evenly spaced from the first to the last (places rounded half to even)."""
    w = Window.partitionBy(*group)
    own = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)) - 1, "all": F.count(F.lit(1)).over(w), "want": n})
    step = (F.col("all") - 1) / (F.col("want") - 1)
    picks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("want") - 1, F.lit(0))), lambda i: F.rint(i * step).cast("int"))
    keep = F.when(F.col("want") <= 0, False).when(F.col("all") <= F.col("want"), True).when(F.col("want") == 1, F.col("place") == 0).otherwise(F.array_contains(picks, F.col("place")))
    return own.where(keep).drop("all", "want")


def capped(rows: DataFrame, group: str, order: list[str], repeat: str, n: int) -> DataFrame:
    """At most n rows a group: distinct ones first, repeats fill what is left, both evenly spread."""
    fresh = F.sum(F.when(F.col(repeat), 0).otherwise(1)).over(Window.partitionBy(group))
    own = rows.withColumn("fresh", fresh)
    total = F.count(F.lit(1)).over(Window.partitionBy(group))
    own = own.withColumn("total", total)
    few = own.where(F.col("total") <= n)
    many = own.where(F.col("total") > n)
    share = F.when(F.col(repeat), F.greatest(F.lit(0), n - F.least(F.col("fresh"), F.lit(n)))).otherwise(F.lit(n)).cast("int")
    return few.unionByName(spread(many, [group, repeat], order, share).drop("place")).drop("fresh", "total")


def instants(start: Column, end: Column, step: float) -> Column:
    """S129: an array of the instants from start, a step apart, up to end."""
    return F.transform(F.sequence(F.lit(0), F.floor((end - start) / step).cast("int")), lambda k: start + k * step)
