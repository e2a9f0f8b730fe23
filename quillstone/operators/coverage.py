"""What was read, what wasn't and why; claims, budgets, leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unclaimed(items: DataFrame, claims: DataFrame, key: str, claimed: str, named: str) -> DataFrame:
    """Items without those claimed, but with those that the user named. One pass: named items join on null."""
    probe = items.withColumn("probe", F.when(~F.col(named), F.col(key)))
    return probe.join(claims, F.col("probe") == F.col(claimed), "left_anti").drop("probe")


def stale(outputs: DataFrame, written: DataFrame, failed: DataFrame) -> DataFrame:
    """(cite, doc_id) of outputs not written now whose citation is neither failed nor below a failed one.

    A prefix up to a # is an equality after cutting the citation at each #: the theta join becomes a hash join.
    """
    left = outputs.join(written, "doc_id", "left_anti")
    parts = F.split("cite", "#")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "#"))
    kept = left.select("doc_id", F.explode(heads).alias("head")).join(failed, F.col("head") == F.col("failed"), "left_semi").select("doc_id").distinct()
    return left.join(kept, "doc_id", "left_anti").select("cite", "doc_id")


def covered(rows: DataFrame) -> DataFrame:
    """Rows (error, needs) with unread and status; `no text found` is not something unread."""
    unread = F.array_compact(F.concat(F.filter("needs", lambda n: n != "no text found"), F.array("error")))
    out = rows.withColumn("unread", unread)
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.size("unread") > 0, "partial").otherwise("complete"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows (source, code, needs) counted by source; the code to exit with is the gravest."""
    clean = F.col("code").isNull() & (F.col("needs") == 0)
    has = lambda code: F.coalesce(F.bool_or(F.col("code") == code), F.lit(False))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.count("code").alias("errors"), F.count_if(F.col("code").isNull() & (F.col("needs") > 0)).alias("partial"), F.every(clean).alias("complete"),
        F.when(has("missing"), 3).when(has("usage"), 2).when(has("failed"), 1).otherwise(0).alias("exit_code"),
    )


def skipped(rows: DataFrame, keys: list[str], name: str, shown: int = 5) -> DataFrame:
    """(keys, n, names): the first names in order and how many more; only `shown` names of a group are ever kept."""
    from pyspark.sql import Window

    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(name))).where(F.col("k") <= shown)
    named = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("first"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(named, keys).select(*keys, "n", F.concat("first", F.when(F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")).alias("names"))


def greedy(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """(group, order, cost, taken): in order, each row that still fits is taken. State is one number a group, so
    that rows stream through in order and a group of any size takes no memory."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        left, now = budget, None
        for batch in batches:
            keys, costs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            taken = np.zeros(len(keys), bool)
            for n, (k, c) in enumerate(zip(keys, costs, strict=True)):
                if n == 0 and now is None or k != now:
                    left, now = budget, k
                if c is not None and c <= left:
                    taken[n], left = True, left - c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken)], [group, order, cost, "taken"])

    own = rows.select(group, order, cost)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, f"{kinds}, taken boolean")
