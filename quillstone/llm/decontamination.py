"""Benchmark decontamination by template windows, in DataFrame operations alone.

A text is canonicalised: numbers, names (capitalised words inside a sentence) and units after a number become typed
placeholders, other words lower case. Windows of WINDOW template tokens of all documents are joined by hash, and compared
in full, with those of the benchmark; a benchmark item shorter than that is one window of its own length. What the
placeholders stood for must be consistent: along one alignment of an item with a document, every value of the item has
one value in the document, that of the most windows; windows that hold another don't count, unless they are verbatim. A
document holds an item if consistent windows cover SHARE of the item's windows, or if it has RUN of the item's words in a
row, value by value, whatever their share; `changed` tells if values differ, that is if the question was given other parameters.

Windows with fewer than half of their tokens in plain words are not used, as "0 0 0 0" says nothing; an item that has
none, or under MOST_SHORT tokens, can't be found. The benchmark's windows are broadcast only if their counted number is
at most BROADCAST, and their bytes at most BROADCAST_BYTES; beyond that the join is shuffled.

Nulls: null texts and null items hold nothing; a null doc_id is a document of its own per text, shown as null. Rows
repeated with the same doc_id and text count once. Repeated item_ids are one item for each text. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SHARE, MOST_SHORT = 8, 0.3, 4
BROADCAST, BROADCAST_BYTES = 200_000, 32 << 20
#: Words in a row, the same word for word, that are enough by themselves.
RUN = 20
UNITS = "km|cm|mm|kg|mg|ml|mph|kmh|kwh|kw|gb|mb|tb|lbs?|oz|ft|miles?|met(?:er|re)s?|centimet(?:er|re)s?|kilomet(?:er|re)s?|grams?|kilograms?|lit(?:er|re)s?|inch(?:es)?|feet|yards?|acres?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|percent|degrees?|pages?|points?|[mgls]|h"
NUMBER = r"\d+(?:[.,:/]\d+)*"
TOKEN = "\u0002?[\\p{L}\\p{M}]+|\u0003|" + NUMBER


def marked(text: Column) -> Column:
    """The text with a mark before each name."""
    return F.regexp_replace(text, r"(?<=[\p{Ll}\d,;] )(?=\p{Lu}\p{Ll})", "\u0002")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(marked(text)), F.lit(TOKEN), F.lit(0))


def template_tokens(text: Column) -> Column:
    """As many tokens as raw_tokens gives, with placeholders: 0 a number, \\u0002 a name, \\u0003 a unit."""
    out = F.lower(F.regexp_replace(F.regexp_replace(marked(text), "\u0002[\\p{L}\\p{M}]+", "\u0002x"), NUMBER, "0"))
    out = F.regexp_replace(out, rf"(?<=0 |0)(?:{UNITS})(?![\p{{L}}\p{{M}}])", "\u0003")
    return F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0))


def is_slot(token: Column) -> Column:
    return token.isin("0", "\u0002x", "\u0003")


def windows(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., tokens, at, w): each window of `width` of the column tokens, at its place from 0."""
    n = F.size("tokens") - (width - 1)
    parts = F.arrays_zip(*(F.slice("tokens", k + 1, n).alias(f"t{k}") for k in range(width)))
    return rows.where(F.size("tokens") >= width).select(*keep, "tokens", F.posexplode(parts).alias("at", "w"))


def plain_words(width: int) -> Column:
    return sum((~is_slot(F.col(f"w.t{k}"))).cast("int") for k in range(width))


def hashed(width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.col(f"w.t{k}") for k in range(width)))


def items_of(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """The benchmark's windows (width, h, words, item_id, item_key, item_at, of, values) and the widths among them."""
    items = benchmark.select(F.col("item_id"), "text").where("text is not null").distinct()
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), template_tokens(F.col("text")).alias("tokens"), raw_tokens(F.col("text")).alias("raw"))
    items = items.withColumn("width", F.least(F.size("tokens"), F.lit(window))).where(F.col("width") >= MOST_SHORT)
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    every = None
    for width in widths:
        own = windows(items.where(F.col("width") == width), width, "item_id", "item_key", "raw").where(2 * plain_words(width) >= width)
        own = own.select(
            F.lit(width).alias("width"), hashed(width).alias("h"), F.array(*(F.col(f"w.t{k}") for k in range(width))).alias("words"), "item_id", "item_key", F.col("at").alias("item_at"),
            F.slice("raw", F.col("at") + 1, F.lit(width)).alias("values"),
        )
        every = own if every is None else every.unionByName(own)
    return every, widths


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """Each window of a document that equals one of an item: doc_id, doc_key, item_id, item_key, item_at, line, pairs."""
    items, widths = items_of(benchmark, window)
    if not widths:
        return None
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("values", " "))).alias("b")).first()
    small = size["n"] <= BROADCAST and (size["b"] or 0) <= BROADCAST_BYTES
    texts = docs.select("doc_id", "text").where("text is not null")
    rows = texts.select("doc_id", F.xxhash64("text").alias("doc_key"), template_tokens(F.col("text")).alias("tokens"), *(["text"] if small else []))
    every = None
    for width in widths:
        own = items.where(F.col("width") == width).select("h", "words", "item_id", "item_key", "item_at", "values", F.exists("words", is_slot).alias("slots"))
        equal = (F.col("dh") == F.col("h")) & (F.array(*(F.col(f"w.t{k}") for k in range(width))) == F.col("words"))
        if small:
            found = windows(rows, width, "doc_id", "doc_key", "text").select("doc_id", "doc_key", "text", "at", hashed(width).alias("dh"), "w").join(F.broadcast(own), equal)
        else:
            # A shuffled window carries its tokens only; the texts of those that match are fetched afterwards, so that what
            # is shuffled grows with the text and not with its square.
            found = windows(rows, width, "doc_id", "doc_key").select("doc_id", "doc_key", "at", hashed(width).alias("dh"), "w").join(own, equal).drop("w", "dh", "h")
            whole = texts.withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"]).withColumnRenamed("doc_id", "id")
            found = found.join(whole, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")))
        mine = F.slice(raw_tokens(F.col("text")), F.col("at") + 1, F.lit(width))
        slots = F.filter(F.arrays_zip(F.col("words").alias("word"), F.col("values").alias("item"), mine.alias("doc")), lambda x: is_slot(x["word"]))
        pairs = F.when(F.col("slots"), F.transform(slots, lambda x: F.struct(F.concat(x["word"], F.lit("="), x["item"]).alias("item"), x["doc"].alias("doc")))).otherwise(F.array().cast("array<struct<item:string,doc:string>>"))
        found = found.select("doc_id", "doc_key", "item_id", "item_key", "item_at", (F.col("at") - F.col("item_at")).alias("line"), pairs.alias("pairs"))
        every = found if every is None else every.unionByName(found)
    return every


def longest_run(places: Column, width: int) -> Column:
    """Tokens in the longest stretch that windows at these sorted places cover without a gap."""
    step = lambda a, x: F.struct(F.when(x - a["last"] <= width, a["first"]).otherwise(x).alias("first"), x.alias("last"), F.greatest(a["best"], F.when(x - a["last"] <= width, x - a["first"]).otherwise(0) + width).alias("best"))
    start = F.struct(F.lit(-1 - width).alias("first"), F.lit(-1 - width).alias("last"), F.lit(0).alias("best"))
    return F.aggregate(places, start, step, lambda a: a["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, doc_key, item_id, n_windows, item_windows, share, changed) of the documents that hold an item."""
    found = matches(docs, benchmark, window)
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_key long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_windows long, item_windows long, share double, changed boolean"
    if found is None:
        return spark.createDataFrame([], kinds)
    items, _ = items_of(benchmark, window)
    sizes = items.groupBy("item_key").agg(F.count_distinct("item_at").alias("item_windows"))
    other = lambda p: ~F.endswith(p["item"], F.concat(F.lit("="), p["doc"]))
    along = found.groupBy("doc_id", "doc_key", "item_id", "item_key", "line").agg(F.collect_set(F.struct("item_at", "pairs")).alias("own"), F.sort_array(F.collect_set(F.when(~F.exists("pairs", other), F.col("item_at")))).alias("verbatim"))
    along = along.withColumns({"pairs": F.flatten("own.pairs"), "run": longest_run(F.col("verbatim"), window)})
    # Of a value that stands for several, the one of the most windows counts (of equals its own); windows that hold another, and aren't verbatim, go.
    several = F.size(F.array_distinct("pairs")) > F.size(F.array_distinct(F.col("pairs.item")))
    most = F.transform(F.array_distinct(F.col("pairs.item")), lambda i: F.array_max(F.transform(F.filter("pairs", lambda p: p["item"] == i), lambda q: F.struct(F.size(F.filter("pairs", lambda p: p == q)).alias("n"), (~other(q)).alias("own"), q.alias("pair"))))["pair"])
    along = along.withColumn("chosen", F.when(several, most))
    fits = lambda w: F.forall(w["pairs"], lambda p: F.array_contains("chosen", p)) | ~F.exists(w["pairs"], other)
    along = along.withColumn("own", F.when(several, F.filter("own", fits)).otherwise(F.col("own")))
    along = along.select("doc_id", "doc_key", "item_id", "item_key", F.array_distinct(F.col("own.item_at")).alias("places"), "run", F.exists(F.flatten("own.pairs"), other).alias("changed"))
    whole = along.groupBy("doc_id", "doc_key", "item_id", "item_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.max("changed").alias("changed"), F.max("run").alias("run"))
    out = whole.join(sizes, "item_key").withColumn("share", F.col("n_windows") / F.col("item_windows")).where((F.col("share") >= share) | (F.col("run") >= RUN))
    return out.select("doc_id", "doc_key", "item_id", "n_windows", "item_windows", "share", "changed")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""
    bad = contaminated(docs, benchmark, **options).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("bad_id"), F.col("doc_key").alias("bad_key")).distinct()
    return docs.join(bad, (F.coalesce(docs["doc_id"].cast("string"), F.lit("null")) == bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")
