"""What several readers agree on, and what they dispute."""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

NUMBERS = r"\d+(?:[.,]\d+)*"
TOKENS = r"(?U)\w+(?:[.,]\w+)*"


@lru_cache(1)
def folds() -> tuple[str, str]:
    """The characters of the basic plane whose NFKC form is one other character, and these forms."""
    every = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    some = [(a, b) for a, b in every if a != b and len(b) == 1]
    return "".join(a for a, _ in some), "".join(b for _, b in some)


def folded(text: Column) -> Column:
    """characters as their NFKC forms where these are one character (full-width, superscript, circled and so on), in the JVM; plain texts stay as they are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *folds()))


def values(text: Column, pattern: str = NUMBERS) -> Column:
    """The values of a text, in an array."""
    return F.regexp_extract_all(folded(text), F.lit(pattern), F.lit(0))


def verdicts(readings: DataFrame, keys: list[str], readers: DataFrame, pattern: str = NUMBERS, boxes: bool = True) -> DataFrame:
    """(keys, value, counts, agreed, bbox) of readings (keys, engine, box_no, text, bbox).

    readers (keys, engine, kind, ord) names every reader of an item, also those that read nothing. A value is agreed if
    two readers or more read it, all equally often, and one of an item's readers is local. Readings that have a column
    `values` (array) aren't searched again. Readings and readers of an item meet in one shuffle, before values are rows of
    their own, and stream in order; what is kept is the values of the item at hand. Without `boxes` bbox is null.
    """
    kinds = dict(readings.dtypes)
    found = readings if "values" in readings.columns else readings.withColumn("values", values(F.col("text"), pattern))
    order, box = (F.col("box_no"), F.col("bbox")) if boxes else (F.lit(None).cast(kinds["box_no"]), F.lit(None).cast(kinds["bbox"]))
    found = found.where(F.col("engine").isNotNull() & (F.size("values") > 0)).select(*keys, F.lit(1).alias("part"), order.alias("box_no"), box.alias("bbox"), "engine", "values", F.lit(None).cast("array<struct<place:int,engine:string,local:boolean>>").alias("readers"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("ord"))
    own = readers.select(*keys, "engine", "kind", rank.alias("place")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "engine", F.coalesce(F.col("kind") == "local", F.lit(False)).alias("local")))).alias("readers"))
    own = own.select(*keys, F.lit(0).alias("part"), F.lit(None).cast(kinds["box_no"]).alias("box_no"), F.lit(None).cast(kinds["bbox"]).alias("bbox"), F.lit(None).cast("string").alias("engine"), F.lit(None).cast("array<string>").alias("values"), "readers")
    both = own.unionByName(found).dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, "part", *(["box_no", "bbox"] if boxes else []))
    width = len(keys)

    def run(batches):
        now, told, counts, first = None, [], {}, {}
        out = Verdicts()
        for batch in batches:
            # A row may hold a long text's values; a few rows at a time keep what is held small.
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts, sizes = rows.column("values").flatten().to_numpy(zero_copy_only=False).tolist(), pc.fill_null(pc.list_value_length(rows.column("values")), 0).to_pylist()
                ends = list(itertools.accumulate(sizes))
                for n, row in enumerate(zip(*(c.to_pylist() for c in rows.drop_columns(["values"]).columns), strict=True)):
                    if row[:width] != now:
                        out.add(now, told, counts, first)
                        now, told, counts, first = row[:width], [], {}, {}
                    part, place, bbox, engine, named = row[width:]
                    got = texts[ends[n] - sizes[n] : ends[n]]
                    if part == 0:
                        told = [tuple(r.values()) for r in named]
                        counts, first = {e: Counter() for _, e, _ in told}, {e: {} for _, e, _ in told}
                    elif engine in counts:
                        counts[engine].update(got)
                        if bbox is not None:
                            own = first[engine]
                            for v in got:
                                own.setdefault(v, (place, bbox))
                if len(out.values) >= 20_000:
                    yield out.batch(both_schema, keys)
        out.add(now, told, counts, first)
        yield out.batch(both_schema, keys)

    both_schema = pa.schema([pa.field(n, t) for n, t in zip([*keys, "bbox"], (to_arrow_type(both.schema[c].dataType) for c in [*keys, "bbox"]), strict=True)])
    return both.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", value string, counts array<struct<engine:string,n:bigint>>, agreed boolean, bbox {kinds['bbox']}")


class Verdicts:
    """Rows of verdicts, column by column."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.engines, self.counts, self.ends, self.agreed, self.boxes = [], [], [], [], [0], [], []

    def add(self, key: tuple | None, told: list[tuple], counts: dict[str, Counter], first: dict[str, dict]) -> None:
        """The values of one item; told are its readers (place, engine, local), in order."""
        if not any(counts.values()):
            return
        names, local = [e for _, e, _ in told], len(told) >= 2 and any(r[2] for r in told)
        every = dict.fromkeys(v for c in counts.values() for v in c)
        tallies = list(zip(*([get(v, 0) for v in every] for get in (counts[e].get for e in names)), strict=True))
        self.keys += [key] * len(every)
        self.values += every
        self.engines += names * len(every)
        for t in tallies:
            self.counts += t
            self.ends.append(len(self.counts))
        self.agreed += [local and t.count(t[0]) == len(t) for t in tallies]
        if any(first.values()):
            # Of readers with the same place the smaller box counts; a box without a number comes before others.
            found = lambda v: min(((p, n is not None, n or 0, b) for p, e, _ in told for n, b in (first[e].get(v),) * (v in first[e])), default=(None,))[-1]
            self.boxes += map(found, every)
        else:
            self.boxes += [None] * len(every)

    def batch(self, schema: pa.Schema, keys: list[str]) -> pa.RecordBatch:
        counts = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays([pa.array(self.engines, pa.string()), pa.array(self.counts, pa.int64())], ["engine", "n"]))
        columns = [pa.array([k[n] for k in self.keys], schema.field(name).type) for n, name in enumerate(keys)]
        rows = pa.RecordBatch.from_arrays([*columns, pa.array(self.values, pa.string()), counts, pa.array(self.agreed, pa.bool_()), pa.array(self.boxes, schema.field("bbox").type)], [*keys, "value", "counts", "agreed", "bbox"])
        self.clear()
        return rows


def tally(counts: Column) -> Column:
    """Name n, name n."""
    return F.array_join(F.transform(counts, lambda c: F.concat(c["engine"], F.lit(" "), c["n"].cast("string"))), ", ")
