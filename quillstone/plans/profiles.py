"""Queries that profile, sample and clean tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import profile as P
from .tables import table

QUERIES = {}
ORACLES = {}


def profile_events(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls, least, most and distinct values of each column of events."""
    e = table(spark, sf, "events")
    out = P.profile(e.select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "props"))
    return out.select("column_name", "nulls", "distinct", F.when(F.col("column_name") != "value", F.col("low")).alias("low"), F.when(F.col("column_name") != "value", F.col("high")).alias("high"))


QUERIES["profile_events"] = profile_events
ORACLES["profile_events"] = "\nunion all ".join(
    f"select '{c}' as column_name, count(*) filter (where {x} is null) as nulls, count(distinct {x}) as distinct, {f'min({x})::varchar' if c != 'value' else 'null'} as low, {f'max({x})::varchar' if c != 'value' else 'null'} as high from events"
    for c, x in (("event_id", "event_id"), ("user_id", "user_id"), ("event_type", "event_type"), ("value", "value"), ("ts", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ("props", "props"))
)


def profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """A01 over lineitem, least and most as numbers."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return P.profile(li).select("column_name", "nulls", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "distinct")


QUERIES["profile_lineitem"] = profile_lineitem
ORACLES["profile_lineitem"] = "\nunion all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls, min({c})::double as low, max({c})::double as high, count(distinct {c}) as distinct from lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def distinct_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables an exact distinct count fits, at 8 MiB."""
    names = ["region", "nation", "customer", "supplier", "part"]
    every = None
    for n in names:
        t = table(spark, sf, n)
        own = P.distinct_guard(t.select(*[c for c, k in t.dtypes if k != "double"]), 8 << 20).select(F.lit(n).alias("table_name"), "rows", "bytes", "computed")
        every = own if every is None else every.unionByName(own)
    return every


QUERIES["distinct_guard"] = distinct_guard
ORACLES["distinct_guard"] = "with g as (" + "\nunion all ".join(
    f"select '{t}' as table_name, count(*) as rows, coalesce(sum({' + '.join(f'coalesce(strlen({c}::varchar), 0)' for c in cols)}), 0)::bigint as bytes from {t}"
    for t, cols in {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]}.items()
) + ") select *, rows * 512 + bytes * 4 <= 8388608 as computed from g"


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of orders as a text, with the count of all."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return P.sample_text(o, "orders", ["o_orderkey"])


QUERIES["sample_rows"] = sample_rows
ORACLES["sample_rows"] = """with f as (select * from orders order by o_orderkey limit 20), n as (select count(*) as rows from orders),
r as (select *, row_number() over (order by o_orderkey) as k from f)
select 'orders' as name, rows, 'orders: first 20 of ' || format('{:,}', rows) || ' rows' || chr(10) || 'columns| o_orderkey | o_custkey | o_orderstatus | o_orderpriority' || chr(10) ||
 (select string_agg('row=' || k || '| ' || o_orderkey || ' | ' || o_custkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) order by k) from r) as text from n"""


def rows_not_read(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a read of 200 leaves out, by table."""
    every = None
    for name in ("orders", "events", "region"):
        own = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.greatest(F.col("n") - 200, F.lit(0)).alias("left"))
        every = own if every is None else every.unionByName(own)
    return every.select("name", F.when(F.col("left") > 0, R.not_read("left", "row", "limit 200")).alias("need"))


QUERIES["rows_not_read"] = rows_not_read
ORACLES["rows_not_read"] = "\nunion all ".join(f"select '{t}' as name, case when count(*) > 200 then format('{{:,}}', count(*) - 200) || case when count(*) - 200 > 1 then ' rows' else ' row' end || ' not read (limit 200)' end as need from {t}" for t in ("orders", "events", "region"))


def value_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of JSON values, with NULL apart from the string."""
    e = table(spark, sf, "events")
    v = F.when(F.col("event_id") % 6 == 0, "NULL").when(F.col("event_id") % 6 == 1, F.lit(None).cast("string")).otherwise(F.col("props"))
    return e.select("event_id", R.value_cell(v).alias("cell"), R.blob_cell(F.encode(F.repeat(F.lit("x"), (F.col("event_id") % 1500).cast("int")), "utf-8")).alias("blob"), R.counted(F.col("event_id") % 3000, "row").alias("counted"))


QUERIES["value_cells"] = value_cells
ORACLES["value_cells"] = r"""select event_id, case event_id % 6 when 0 then '"NULL"' when 1 then 'NULL' else case when length(c) > 200 then substr(c, 1, 200) || '...' else coalesce(c, 'NULL') end end as cell,
 '<blob ' || format('{:,}', event_id % 1500) || ' bytes>' as blob, format('{:,}', event_id % 3000) || ' row' || case when event_id % 3000 = 1 then '' else 's' end as counted
from (select *, replace(replace(props, '|', '\|'), chr(10), ' ') as c from events)"""


def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    """Strings that stand for a missing value become null."""
    return table(spark, sf, "orders").select("o_orderkey", F.when(~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"), F.col("o_orderpriority")).alias("priority"), F.when(~F.col("o_orderstatus").isin("F"), F.col("o_orderstatus")).alias("status"))


QUERIES["missing_values"] = missing_values
ORACLES["missing_values"] = "select o_orderkey, case when o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED') then o_orderpriority end as priority, case when o_orderstatus <> 'F' then o_orderstatus end as status from orders"


def jsonl_keys_union(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of all objects in the order in which they are first seen."""
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"z": 1, "k": 2, "a'), (F.col("event_id") % 50).cast("string"), F.lit('": null}'))).otherwise(F.col("props"))
    return P.keys_in_order(e.select("event_id", text.alias("line")), "line", "event_id")


QUERIES["jsonl_keys_union"] = jsonl_keys_union
ORACLES["jsonl_keys_union"] = """with e as (select event_id, case when event_id % 10 = 3 then '{"z": 1, "k": 2, "a' || (event_id % 50) || '": null}' else props end as line from events),
k as (select event_id, json_keys(line) as ks from e), x as (select event_id, unnest(ks) as key, unnest(range(0, len(ks))) as pos from k),
f as (select key, min((event_id, pos)) as first from x group by key)
select key, row_number() over (order by first) as place from f"""


def jsonl_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no object: how many, and where the first is; blank lines don't count."""
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 97 == 5, "not json").when(F.col("event_id") % 101 == 7, "[1, 2]").when(F.col("event_id") % 103 == 9, "  ").otherwise(F.col("props"))
    own = e.select("event_type", "event_id", line.alias("line")).where("trim(line) <> ''")
    bad = F.json_object_keys("line").isNull()
    return own.groupBy("event_type").agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("event_id"))).alias("first_bad"))


QUERIES["jsonl_bad_lines"] = jsonl_bad_lines
ORACLES["jsonl_bad_lines"] = """with e as (select event_type, event_id, case when event_id % 97 = 5 then 'not json' when event_id % 101 = 7 then '[1, 2]' when event_id % 103 = 9 then '  ' else props end as line from events),
b as (select *, case when json_valid(line) then json_type(line) <> 'OBJECT' else true end as bad from e where trim(line) <> '')
select event_type, count(*) filter (where not bad) as rows, count(*) filter (where bad) as bad, min(event_id) filter (where bad) as first_bad from b group by event_type"""


def json_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 items of a JSON list a user, each cut to 60 characters."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 20")
    return e.select("user_id", F.col("n").cast("long").alias("item"), F.when(F.length("props") > 60, F.concat(F.substring("props", 1, 60), F.lit("..."))).otherwise(F.col("props")).alias("text"))


QUERIES["json_items"] = json_items
ORACLES["json_items"] = "with e as (select *, row_number() over (partition by user_id order by event_id) as n from events) select user_id, n as item, case when length(props) > 60 then substr(props, 1, 60) || '...' else props end as text from e where n <= 20"


def record_columns(spark: SparkSession, sf: str) -> DataFrame:
    """An array of objects as a table."""
    w = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))).alias("doc"))
    return w.select("n_regionkey", F.inline(F.from_json("doc", "array<struct<key:int,name:string>>")))


QUERIES["record_columns"] = record_columns
ORACLES["record_columns"] = "select n_regionkey, n_nationkey as key, n_name as name from nation"


def multipart_union(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one resource one after the other, repeated header rows left out."""
    region = table(spark, sf, "region").select(F.lit(1).alias("part"), F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").select(F.lit(2).alias("part"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    header = spark.range(1).select(F.lit(2).alias("part"), F.lit("key").alias("key"), F.lit("name").alias("name"))
    return region.unionByName(header).unionByName(nation).where("not (part > 1 and key = 'key' and name = 'name')")


QUERIES["multipart_union"] = multipart_union
ORACLES["multipart_union"] = "select 1 as part, r_regionkey::varchar as key, r_name as name from region union all select 2, n_nationkey::varchar, n_name from nation"


def grid_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse grid, rows numbered and columns lettered."""
    cells = table(spark, sf, "nation").select((F.col("n_regionkey") + 1).alias("r"), (F.col("n_nationkey") * 31 + 1).alias("c"), F.col("n_name").alias("v"))
    return cells.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: F.concat(R.letters(x["c"]), x["v"])), " | ").alias("cells")).select(F.col("r").cast("long").alias("row"), "cells")


QUERIES["grid_letters"] = grid_letters
ORACLES["grid_letters"] = """with c as (select n_regionkey + 1 as r, n_nationkey * 31 as v, n_name from nation),
l as (select *, case when v < 26 then chr((65 + v)::int) when v < 702 then chr((65 + (v - 26) // 26)::int) || chr((65 + (v - 26) % 26)::int) else chr((65 + (v - 702) // 676)::int) || chr((65 + (v - 702) // 26 % 26)::int) || chr((65 + (v - 702) % 26)::int) end as s from c)
select r::bigint as row, string_agg(s || n_name, ' | ' order by v) as cells from l group by r"""


def row_group_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The leading orders of a customer until 300,000 are spent (costs are never negative, so that a running sum is exact)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, sf, "orders").withColumn("spent", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w))
    return o.where("spent <= 30000000").select("o_custkey", "o_orderkey", "spent")


QUERIES["budget_prefix_rows"] = row_group_prefix
ORACLES["budget_prefix_rows"] = "with o as (select *, sum(round(o_totalprice * 100)::bigint) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint as spent from orders) select o_custkey, o_orderkey, spent from o where spent <= 30000000"
