"""Queries on pages, placement, naming and trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import footers as P
from ..operators import ordered as O
from .tables import table

QUERIES = {}
ORACLES = {}


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """The words of a page; entities stay as they are."""
    return table(spark, sf, "pages").select("page_id", R.plain_html("html").alias("text"))


QUERIES["html_text"] = html_text
ORACLES["html_text"] = r"""with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') as t from pages),
b as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') as t from a)
select page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ') as text from b"""


def heading_anchor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Headings paired with ids of the same words, the nth with the nth; here list links with later headings."""
    p = table(spark, sf, "pages")
    words = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
    heads = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:h1|h2|b)>([^<]+)<"), F.lit(1))).alias("pos", "head")).withColumn("norm", words(F.col("head")))
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:h1|h2|b|title)>([^<]+)<"), F.lit(1))).alias("at", "anchor")).withColumn("norm", words(F.col("anchor")))
    nth = lambda d, o: d.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "norm").orderBy(o)))
    return nth(heads, "pos").join(nth(links, "at"), ["page_id", "norm", "nth"]).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"))


QUERIES["heading_anchor_pairs"] = heading_anchor_pairs
ORACLES["heading_anchor_pairs"] = r"""with h0 as (select page_id, regexp_extract_all(html, '<(?:h1|h2|b)>([^<]+)<', 1) as a from pages), h1 as (select page_id, unnest(a) as x, unnest(range(0, len(a))) as pos from h0),
l0 as (select page_id, regexp_extract_all(html, '<(?:h1|h2|b|title)>([^<]+)<', 1) as a from pages), l1 as (select page_id, unnest(a) as x, unnest(range(0, len(a))) as at_ from l0),
h as (select *, lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) as norm, row_number() over (partition by page_id, lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) order by pos) as nth from h1),
l as (select *, lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) as norm, row_number() over (partition by page_id, lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) order by at_) as nth from l1)
select h.page_id, pos, at_ as "at" from h join l using (page_id, norm, nth)"""


def page_sections(batches: Iterable[pa.RecordBatch], pages: int = 64) -> Iterator[pa.RecordBatch]:
    """(page_id, section, anchor, text) of batches (page_id, html): a few pages at a time, whatever the batch, so that neither its texts nor its sections are held at once."""
    from ..sources.parsers import Page

    for batch in batches:
        for at in range(0, batch.num_rows, pages):
            part, out = batch.slice(at, pages), []
            for i, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = Page()
                page.feed(html or "")
                page.close()
                out += [(i, n, a, t) for n, (a, t) in enumerate(page.sections())]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "section", "anchor", "text"])


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A page's text by headings with their anchors."""
    return table(spark, sf, "pages").select("page_id", "html").mapInArrow(page_sections, "page_id long, section long, anchor string, text string")


QUERIES["heading_sections"] = heading_sections


def block_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures placed among the blocks of their documents."""
    li = table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.select("l_orderkey", (F.col("l_quantity") > 35).alias("extra"), n.cast("long").alias("n"), (F.col("l_linenumber") % 4).alias("page"), F.lit(None).cast("int").alias("slide"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string"))).alias("sheet"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 9).alias("para"), F.lit(None).cast("int").alias("line"))
    return O.placement(rows, "l_orderkey")


QUERIES["block_placement"] = block_placement


def fresh_names(spark: SparkSession, sf: str) -> DataFrame:
    """W13 S109: members named anew until the name is free."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.concat("lang", F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".txt")).alias("name"))
    return O.fresh_names(d, "source", "doc_id", "name")


QUERIES["fresh_names"] = fresh_names


def host_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """S124: requests to a host at least a second apart."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.floor(F.unix_timestamp("ts") / 86400) * 4).cast("double").alias("t"))
    return O.spaced(e, "user_id", "event_id", F.col("t"), 1.0).select("event_id", "start")


QUERIES["host_spacing"] = host_spacing
ORACLES["host_spacing"] = """with e as (select user_id, event_id, floor(floor(epoch(ts)) / 86400) * 4 as t, row_number() over (partition by user_id order by event_id) as n from events)
select event_id, (max(t - n) over (partition by user_id order by event_id rows unbounded preceding) + n)::double as start from e"""


def series_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Series of a chart side by side, by point."""
    e = table(spark, sf, "events")
    p = e.select(F.col("user_id").alias("chart"), F.col("event_type").alias("series"), (F.col("event_id") % 12).alias("idx"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), (F.col("event_id") % 12).cast("string"))).otherwise("").alias("category"), "value")
    return O.aligned_series(p, "chart", ["click", "error", "purchase"])


QUERIES["series_alignment"] = series_alignment
ORACLES["series_alignment"] = """with p as (select user_id as chart, event_type as series, event_id % 12 as idx, case when event_id % 3 = 0 then 'c' || (event_id % 12) else '' end as category, value from events)
select chart, idx, coalesce(max(case when category <> '' and series in ('click', 'error', 'purchase') then category end), max(case when category <> '' then category end), (idx + 1)::varchar) as label,
 max(case when series = 'click' then value end) as click, max(case when series = 'error' then value end) as error, max(case when series = 'purchase' then value end) as purchase from p group by chart, idx"""


def range_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that a range reference takes in."""
    cells = table(spark, sf, "orders").select((F.col("o_custkey") % 997).alias("sheet"), (F.col("o_orderkey") % 500).cast("int").alias("r"), (F.col("o_orderkey") % 7).cast("int").alias("c"), F.col("o_orderkey").alias("v"))
    ranges = table(spark, sf, "customer").select((F.col("c_custkey") % 997).alias("sheet"), F.col("c_custkey").alias("ref"), (F.col("c_custkey") * 5 % 400).cast("int").alias("r0"), (F.col("c_custkey") * 5 % 400 + 90).cast("int").alias("r1"), F.lit(1).alias("c0"), F.lit(3).alias("c1"))
    return O.cells_in(ranges, cells, "sheet").select("ref", "r", "c", "v")


QUERIES["range_cells"] = range_cells
ORACLES["range_cells"] = """with c as (select o_custkey % 997 as sheet, o_orderkey % 500 as r, o_orderkey % 7 as c, o_orderkey as v from orders), g as (select c_custkey % 997 as sheet, c_custkey as ref, c_custkey * 5 % 400 as r0 from customer)
select ref, r::int as r, c::int as c, v from g join c using (sheet) where r between r0 and r0 + 90 and c between 1 and 3"""


def uncached_charts(spark: SparkSession, sf: str) -> DataFrame:
    """Charts without values, each with the nth of those that a saved copy has at the same sheet and anchor cell (here line items and orders)."""
    charts = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4000).alias("sheet"), (F.col("l_linenumber") % 2).cast("long").alias("cell"), F.col("l_orderkey").alias("chart"), F.col("l_linenumber").alias("place"), "l_partkey", "l_suppkey")
    saved = table(spark, sf, "orders").select((F.col("o_orderkey") % 4000).alias("sheet"), (F.col("o_custkey") % 2).alias("cell"), F.col("o_orderkey").alias("copy"))
    return O.nth_to_nth(charts, saved, ["sheet", "cell"], ["chart", "place", "l_partkey", "l_suppkey"], ["copy"]).select("sheet", "cell", "chart", "place", "copy")


QUERIES["uncached_charts"] = uncached_charts
ORACLES["uncached_charts"] = """with c as (select l_orderkey % 4000 as sheet, l_linenumber::bigint % 2 as cell, l_orderkey as chart, l_linenumber as place, row_number() over (partition by l_orderkey % 4000, l_linenumber % 2 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as nth from lineitem),
s as (select o_orderkey % 4000 as sheet, o_custkey % 2 as cell, o_orderkey as copy, row_number() over (partition by o_orderkey % 4000, o_custkey % 2 order by o_orderkey) as nth from orders)
select sheet, cell, chart, place, copy from c join s using (sheet, cell, nth)"""


def cell_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """numbers of table cells by their kind."""
    o = table(spark, sf, "orders").withColumn("kind", F.element_at(F.array(F.lit(2), F.lit(5), F.lit(6)), (F.col("o_orderkey") % 3 + 1).cast("int")))
    value = F.when(F.col("kind") == 5, F.col("o_orderkey") * F.when(F.col("o_orderkey") % 2 == 0, 86400).otherwise(3607)).when(F.col("kind") == 6, F.col("o_orderkey") % 2).otherwise(F.when(F.col("o_orderkey") % 4 == 0, F.floor("o_totalprice")).otherwise(F.col("o_totalprice")))
    return o.select("o_orderkey", R.cell_number(value.cast("double"), F.col("kind")).alias("shown"))


QUERIES["cell_numbers"] = cell_numbers
ORACLES["cell_numbers"] = r"""with o as (select o_orderkey as k, o_totalprice as p, timestamp '2001-01-01' + to_seconds(o_orderkey * case when o_orderkey % 2 = 0 then 86400 else 3607 end) as t from orders)
select k as o_orderkey, case k % 3 when 1 then case when t = date_trunc('day', t) then strftime(t, '%Y-%m-%d') else strftime(t, '%Y-%m-%dT%H:%M:%S') end when 2 then case when k % 2 = 1 then 'TRUE' else 'FALSE' end
 else regexp_replace(regexp_replace((case when k % 4 = 0 then floor(p) else p end)::decimal(38, 9)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') end as shown from o"""


def tree_outline(spark: SparkSession, sf: str) -> DataFrame:
    """A tree as an indented list, in preorder."""
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 3 + 0.5)).alias("parent"), F.col("p_name").alias("label"))
    return O.tree_order(n.where("parent is null or parent < id")).select("id", "depth", "line", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


QUERIES["tree_outline"] = tree_outline
ORACLES["tree_outline"] = """with recursive n as (select p_partkey as id, case when p_partkey > 1 then floor(p_partkey / 3.0 + 0.5)::bigint end as parent, p_name as label from part),
w as (select id, label, 0 as depth, id::varchar as path from n where parent is null union all select n.id, n.label, w.depth + 1, w.path || '/' || n.id from n join w on n.parent = w.id where n.parent < n.id)
select id, depth, repeat('  ', depth) || '- ' || label as line, path from w"""


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles over pictures."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_size") * 70).alias("h"))
    return p.select("p_partkey", F.explode(O.tiles(F.col("w"), F.col("h"), 1000, 100)).alias("t")).select("p_partkey", F.col("t.x").alias("x"), F.col("t.y").alias("y"))


QUERIES["tile_grid"] = tile_grid
ORACLES["tile_grid"] = """with p as (select p_partkey, greatest(0, ceil((p_size * 100 - 100) / 900.0)::int - 1) as nx, greatest(0, ceil((p_size * 70 - 100) / 900.0)::int - 1) as ny from part),
x as (select p_partkey, ny, unnest(range(0, nx + 1)) as i from p), y as (select p_partkey, i, unnest(range(0, ny + 1)) as j from x) select p_partkey, (i * 900)::int as x, (j * 900)::int as y from y"""


def tile_seams(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of tiles without those that the tile above had: here turns of conversations as tiles of three words a side."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    before = F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    tail = F.slice(before, F.greatest(F.size(before) - F.col("turn").cast("int") % 4, F.lit(1)), F.when(F.size(before) > 0, 5).otherwise(0))
    tiles = c.select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, F.array(F.lit("cut"))).otherwise(F.array().cast("array<string>")), tail, "w").alias("lines"))
    return O.seamless(tiles, ["conv_id"], "turn", "lines").select("conv_id", "turn", F.array_join("lines", " ").alias("text"), F.col("dropped").cast("long").alias("dropped"))


QUERIES["tile_seams"] = tile_seams
ORACLES["tile_seams"] = """with c as (select conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') as w from conversations),
b as (select *, coalesce(lag(w) over (partition by conv_id order by turn), []) as before from c),
t as (select conv_id, turn, list_concat(case when turn % 3 = 0 then ['cut'] else [] end, before[greatest(len(before) - turn % 4, 1) : greatest(len(before) - turn % 4, 1) + 4], w) as l from b),
p as (select *, coalesce(lag(l) over (partition by conv_id order by turn), []) as a from t),
k as (select unnest([0, 0, 1, 1]) as cut, unnest([0, 1, 0, 1]) as skip),
f as (select conv_id, turn, l, cut, skip, coalesce(list_max(list_filter(range(1, least(len(a) - cut, len(l) - skip) + 1), lambda n: a[len(a) - cut - n + 1 : len(a) - cut] = l[skip + 1 : skip + n])), 0) as n from p, k),
g as (select conv_id, turn, any_value(l) as l, arg_max(skip, n * 4 - 2 * cut - skip) as skip, max(n) as n from f group by conv_id, turn)
select conv_id, turn, array_to_string(case when n = 0 then l else list_concat(l[1 : skip], l[skip + n + 1 :]) end, ' ') as text, n::bigint as dropped from g"""


def public_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """S122: which addresses a fetch may reach."""
    k = F.col("event_id") * 7919 + F.col("user_id") * 104729
    part = [(k % 257).cast("string"), (F.floor(k / 257) % 256).cast("string"), (F.floor(k / 65792) % 256).cast("string"), (F.col("event_id") % 256).cast("string")]
    ip = F.concat(F.when(F.col("event_id") % 5 == 0, "::FFFF:").otherwise(""), F.concat_ws(".", *part), F.when(F.col("event_id") % 11 == 0, "x").otherwise(""))
    return table(spark, sf, "events").select("event_id", ip.alias("ip")).select("event_id", "ip", O.public_address(F.col("ip")).alias("public"))


QUERIES["public_addresses"] = public_addresses
ORACLES["public_addresses"] = """with k as (select event_id, event_id * 7919 + user_id * 104729 as k from events),
p as (select event_id, k % 257 as a, k // 257 % 256 as b, k // 65792 % 256 as c, event_id % 256 as d from k)
select event_id, case when event_id % 5 = 0 then '::FFFF:' else '' end || a || '.' || b || '.' || c || '.' || d || case when event_id % 11 = 0 then 'x' else '' end as ip,
 event_id % 11 <> 0 and a <= 255 and not (a in (0, 10, 127) or a >= 224 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 100 and b between 64 and 127) or (a = 192 and b = 0 and c in (0, 2)) or (a = 198 and (b in (18, 19) or (b = 51 and c = 100))) or (a = 203 and b = 0 and c = 113)) as public from p"""


def profile_footer(spark: SparkSession, sf: str) -> DataFrame:
    """A profile from Parquet footers, no row read."""
    return P.footer_profile(P.row_groups(spark, f"{sf}/lineitem.parquet"))


QUERIES["profile_footer"] = profile_footer
ORACLES["profile_footer"] = "\nunion all ".join(
    f"select '{c}' as column_name, {low} as low, {high} as high, count(*) filter (where {c} is null)::bigint as nulls from lineitem"
    for c, low, high in [(c, f"min({c})::double::varchar", f"max({c})::double::varchar") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [(c, f"min({c})::varchar", f"max({c})::varchar") for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
)


def row_group_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups that a read of the first 200 rows takes."""
    return P.leading_groups(P.row_groups(spark, f"{sf}/lineitem.parquet"))


QUERIES["row_group_prefix"] = row_group_prefix


def glyph_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of glyphs joined to lines."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.select(F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("seq"), (F.col("l_linenumber") * 10.0).alias("x0"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity") % 12).alias("x1"), (F.col("l_partkey") % 3 * 4.0).alias("y"), F.lit(10.0).alias("h"), F.col("l_returnflag").alias("text"))
    return O.glyph_lines(rows, "page").groupBy("page", "line").agg(F.count(F.lit(1)).alias("runs"))


QUERIES["glyph_lines"] = glyph_lines
ORACLES["glyph_lines"] = """with recursive g as (select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq, l_linenumber * 10.0::double as x0, l_linenumber * 10.0::double + l_quantity % 12 as x1, (l_partkey % 3 * 4.0::double) as y from lineitem),
r as (select page, seq, x1 as past, y as base, 0 as line from g where seq = 1
 union all select g.page, g.seq, g.x1, case when abs(g.y - r.base) <= 5 and g.x0 - r.past between -10 and 3 then r.base else g.y end, case when abs(g.y - r.base) <= 5 and g.x0 - r.past between -10 and 3 then r.line else r.line + 1 end
 from r join g on g.page = r.page and g.seq = r.seq + 1)
select page, line::bigint as line, count(*) as runs from r group by page, line"""
