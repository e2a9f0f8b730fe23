"""Queries on texts: lines, blocks, citations, islands of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators.blocks import block_lines, numbered, unfolded
from .tables import table

QUERIES = {}
ORACLES = {}

LINES = """l as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
m as (select doc_id, case when a[-1] = '' then a[1:len(a)-1] else a end as a from l)"""


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's blocks of 20 lines, cited by their first line."""
    return block_lines(table(spark, sf, "documents"), 20)


QUERIES["text_blocks"] = text_blocks
ORACLES["text_blocks"] = f"""with {LINES},
b as (select doc_id, a, unnest(range(0, ((len(a) - 1) // 20) + 1)) as block from m where len(a) > 0)
select doc_id, block::bigint as block, 'doc/' || doc_id || ':' || (block * 20 + 1) as cite, array_to_string(a[block*20+1 : block*20+20], chr(10)) as text from b"""


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with its number, padded to the width of the text's last."""
    return numbered(table(spark, sf, "documents"))


QUERIES["numbered_lines"] = numbered_lines
ORACLES["numbered_lines"] = f"""with {LINES}
select doc_id, n::bigint as line, lpad(n::varchar, length(len(a)::varchar)::int, ' ') || '| ' || a[n] as text from (select doc_id, a, unnest(range(1, len(a) + 1)) as n from m)"""


def item_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each item, with the stated count beside them."""
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), (F.length("text") == F.col("n_chars")).alias("as_stated"))


QUERIES["item_chars"] = item_chars
ORACLES["item_chars"] = "select doc_id, length(text)::bigint as chars, length(text) = n_chars as as_stated from documents"


def cite_render(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with every kind of part, over events."""
    e = table(spark, sf, "events")
    src = F.struct(
        F.concat(F.lit("log/"), F.col("event_type"), F.lit(".zip")).alias("path"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a/b.zip"), F.concat(F.lit("e"), F.col("user_id").cast("string")))).alias("parts"),
        F.when(F.col("event_id") % 7 == 0, F.lit("top")).alias("anchor"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 11).alias("section"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 13).alias("page"),
        F.lit(None).cast("int").alias("slide"), F.when(F.col("event_id") % 17 == 0, F.lit(2)).alias("frame"), F.when(F.col("event_id") % 4 == 0, F.lit("Sheet1")).alias("sheet"), F.when(F.col("event_id") % 8 < 2, F.lit("B7")).alias("cell"),
        F.lit(None).cast("int").alias("para"), F.when(F.col("event_id") % 19 == 0, F.lit("17.5")).alias("ts"), F.when(F.col("event_id") % 23 == 0, F.lit(3)).alias("img"),
        F.when(F.col("event_id") % 6 == 0, F.array(F.lit(0.0), F.lit(1.25), F.floor("value").cast("double"), F.lit(103.25))).alias("bbox"), F.when(F.col("event_id") % 12 == 0, F.lit("pt")).alias("unit"),
        F.when(F.col("event_id") % 9 == 0, F.array(F.floor("value") * 1.0, F.floor("value") + 59.96)).alias("t"), F.when(F.col("event_id") % 10 == 0, F.col("event_id") + 1).alias("line"),
    )
    return e.select("event_id", R.cite(src).alias("cite"))


QUERIES["cite_render"] = cite_render
ORACLES["cite_render"] = r"""
with e as (select *, event_id as i, floor(value)::bigint as v from events),
c as (select *, (v*10)::bigint as t0, (v*10 + 600)::bigint as t1 from e)
select event_id, 'log/' || event_type || '.zip' || case when i % 3 = 0 then '#att=a/b.zip#att=e' || user_id else '' end || case when i % 7 = 0 then '#top' else '' end
 || case when i % 5 = 0 then '#s' || (i % 11) else '' end || case when i % 2 = 0 then '#p' || (i % 13) else '' end || case when i % 17 = 0 then '#frame2' else '' end
 || case when i % 4 = 0 then '#Sheet1' || case when i % 8 < 2 then '!B7' else '' end when i % 8 < 2 then '#cell=B7' else '' end || case when i % 19 = 0 then '#ts=17.5' else '' end || case when i % 23 = 0 then '#img3' else '' end
 || case when i % 6 = 0 then '@' || case when i % 12 = 0 then 'pt' else 'px' end || '(0,1.2,' || v || ',103.2)' else '' end
 || case when i % 9 = 0 then '@' || printf('%02d:%02d:%02d.%d', t0 // 36000, t0 % 36000 // 600, t0 % 600 // 10, t0 % 10) || '-' || printf('%02d:%02d:%02d.%d', t1 // 36000, t1 % 36000 // 600, t1 % 600 // 10, t1 % 10) else '' end
 || case when i % 10 = 0 then ':' || (i + 1) else '' end as cite from c"""


def unfold_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with a blank join the one before; here, lines that begin with a vowel."""
    return unfolded(table(spark, sf, "documents"), "^[AEIOU]")


QUERIES["unfold_lines"] = unfold_lines
ORACLES["unfold_lines"] = f"""with {LINES},
r as (select doc_id, n, a[n] as line from (select doc_id, a, unnest(range(1, len(a) + 1)) as n from m)),
g as (select *, sum(case when regexp_matches(line, '^[AEIOU]') and n > 1 then 0 else 1 end) over (partition by doc_id order by n) as k from r)
select doc_id, k::bigint as item, min(n)::bigint as line, string_agg(line, '' order by n) as text from g group by doc_id, k"""


def notice_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that state a licence or a copyright, with their numbers."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(R.split_lines("text")).alias("n", "line"))
    return d.where(F.col("line").rlike(r"(?i)\b(licen[cs]ed? under|released under|copyright|all rights reserved)\b") & (F.length("line") < 300)).select("doc_id", (F.col("n") + 1).cast("long").alias("line"), F.trim("line").alias("notice"))


QUERIES["notice_lines"] = notice_lines
ORACLES["notice_lines"] = rf"""with {LINES}
select doc_id, n::bigint as line, trim(a[n], ' ') as notice from (select doc_id, a, unnest(range(1, len(a) + 1)) as n from m)
where regexp_matches(a[n], '(?i)\b(licen[cs]ed? under|released under|copyright|all rights reserved)\b') and length(a[n]) < 300"""


def docs_by_cite(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks under one citation as one document for a connector, identified by the citation's digest."""
    blocks = block_lines(table(spark, sf, "documents"), 20).withColumn("cite", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    own = blocks.groupBy("cite").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n\n").alias("content"))
    return own.select(F.sha2(F.col("cite").cast("binary"), 256).alias("doc_key"), "cite", F.sha2(F.col("content").cast("binary"), 256).alias("content_digest"), F.length("content").cast("long").alias("chars"))


QUERIES["docs_by_cite"] = docs_by_cite
ORACLES["docs_by_cite"] = f"""with {LINES},
b as (select doc_id, a, unnest(range(0, ((len(a) - 1) // 20) + 1)) as block from m where len(a) > 0),
t as (select 'doc/' || doc_id as cite, string_agg(array_to_string(a[block*20+1 : block*20+20], chr(10)), chr(10) || chr(10) order by block) as content from b group by doc_id)
select sha256(cite) as doc_key, cite, sha256(content) as content_digest, length(content)::bigint as chars from t"""


def paragraph_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A line without a number of its own takes the last one before it."""
    e = table(spark, sf, "conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return e.select("conv_id", "turn", F.last("own", True).over(w).alias("para"))


QUERIES["paragraph_numbers"] = paragraph_numbers
ORACLES["paragraph_numbers"] = "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as para from conversations"


def text_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of lines of one kind (here speakers) as blocks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("change", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1))
    c = c.withColumn("island", F.sum("change").over(w))
    return c.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


QUERIES["text_islands"] = text_islands
ORACLES["text_islands"] = """with c as (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role and lag(turn) over (partition by conv_id order by turn) is not null then 0 else 1 end as change from conversations),
i as (select *, sum(change) over (partition by conv_id order by turn) as island from c)
select conv_id, island::bigint as island, role, min(turn) as first, count(*) as lines, sum(length(text))::bigint as chars from i group by conv_id, island, role"""


def seven_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and names, over texts."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", R.sample_cell("text").alias("cell"), R.value_cell(F.when(F.col("doc_id") % 5 == 0, "NULL").when(F.col("doc_id") % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("source"))).alias("value"), R.safe_name(F.concat(F.lit("a b/"), F.col("source"), F.lit("?*.txt"))).alias("safe"), R.flat_name(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit(".md"))).alias("flat"), R.clip(F.col("text"), 100).alias("clipped"))


QUERIES["cells_and_names"] = seven_escapes
ORACLES["cells_and_names"] = r"""with e as (select *, replace(replace(text, '|', '\|'), chr(10), ' ') as c from documents)
select doc_id, case when text is null then 'NULL' when length(c) > 200 then substr(c, 1, 200) || '...' else c end as cell, case doc_id % 5 when 0 then '"NULL"' when 1 then 'NULL' else source end as value,
 'a_b_' || source || '_.txt' as safe, lang || '__' || source || '.md' as flat, substr(text, 1, 100) as clipped from e"""
