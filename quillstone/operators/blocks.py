"""Ordered blocks of text. A text's lines stay in one row as an array: no shuffle, and the order is the array's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render as R

BLOCK_LINES = 200


def block_lines(docs: DataFrame, size: int = BLOCK_LINES, prefix: str = "doc/") -> DataFrame:
    """(doc_id, block, cite, text): blocks of `size` lines, cited by their first line."""
    lines = docs.select("doc_id", R.split_lines("text").alias("lines")).where("size(lines) > 0")
    blocks = lines.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int"))).alias("block"))
    first = F.col("block") * size + 1
    return blocks.select("doc_id", F.col("block").cast("long").alias("block"), F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit(":"), first.cast("string")).alias("cite"), F.array_join(F.slice("lines", first, F.lit(size)), "\n").alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): each line behind its number, as wide as the text's largest."""
    lines = docs.select("doc_id", R.split_lines("text").alias("lines")).select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    number = (F.col("at") + 1).cast("string")
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.concat(F.lpad(number, F.length(F.col("n").cast("string")), F.lit(" ")), F.lit("| "), F.col("line")).alias("text"))


def unfolded(docs: DataFrame, continued: str = "^[ \t]") -> DataFrame:
    """(doc_id, item, line, text): lines that match `continued` joined to the line before.

    A fold over the text's own lines, so that nothing is shuffled.
    """
    start = F.lit([]).cast("array<struct<line:bigint,text:string>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["line"].alias("line"), F.concat(last["text"], x["text"]).alias("text"))))
        return F.when((F.size(acc) > 0) & x["text"].rlike(continued), joined).otherwise(F.concat(acc, F.array(x)))

    lines = F.transform(R.split_lines("text"), lambda t, n: F.struct((n + 1).cast("bigint").alias("line"), t.alias("text")))
    items = docs.select("doc_id", F.aggregate(lines, start, step).alias("items"))
    return items.select("doc_id", F.posexplode("items").alias("at", "i")).select("doc_id", (F.col("at") + 1).cast("long").alias("item"), F.col("i.line").alias("line"), F.col("i.text").alias("text"))
