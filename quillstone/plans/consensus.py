"""Queries on readings and on what pages hide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import consensus as C
from ..operators import spatial as S
from .tables import table

QUERIES = {}
ORACLES = {}


def readings(spark: SparkSession, sf: str, values: Callable[[Column], Column] = C.values) -> tuple[DataFrame, DataFrame]:
    """Three readers of each document; reader m leaves out the lines whose number leaves m, divided by 3. A line's values are found once for all of them."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("values", values(F.col("text"))).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("n % 3 <> m or n % 2 = 0")
    box = F.when(F.col("n") % 4 > 0, F.array(F.col("n") * 1.0, F.lit(0.0), F.col("n") + 1.0, F.lit(1.0)))
    boxes = lines.select("doc_id", F.concat(F.lit("r"), F.col("m").cast("string")).alias("engine"), F.col("n").alias("box_no"), "values", box.alias("bbox"))
    readers = d.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f"r{m}").alias("engine"), F.lit("local" if m == 0 else "llm").alias("kind"), F.lit(m).alias("ord")) for m in range(3)))))
    return boxes, readers


READ = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10))))) as n from documents where text is not null),
r as (select doc_id, n, text, m from l, (select unnest([0, 1, 2]) as m) where n % 3 <> m or n % 2 = 0),
v as (select doc_id, m, n, unnest(regexp_extract_all(text, '{pattern}')) as value from r),
g as (select doc_id, value, count(*) filter (where m = 0) as n0, count(*) filter (where m = 1) as n1, count(*) filter (where m = 2) as n2, min((m, n)) filter (where n % 4 > 0) as first from v group by doc_id, value)
"""
NUMBERS = READ.format(pattern=r"\d+(?:[.,]\d+)*")


def consensus_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that the readers agree on, with the counts of each and the first box."""
    boxes, readers = readings(spark, sf)
    v = C.verdicts(boxes, ["doc_id"], readers)
    return v.select("doc_id", "value", C.tally(F.col("counts")).alias("tally"), "agreed", F.get("bbox", F.lit(0)).alias("left"))


QUERIES["consensus_numbers"] = consensus_numbers
ORACLES["consensus_numbers"] = NUMBERS + "select doc_id, value, 'r0 ' || n0 || ', r1 ' || n1 || ', r2 ' || n2 as tally, n0 = n1 and n1 = n2 as agreed, first[2]::double as \"left\" from g"


def consensus_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """the same over tokens; plain letters only, where both engines' classes are the same."""
    boxes, readers = readings(spark, sf, lambda text: C.values(F.regexp_replace(text, r"[^\x00-\x7F]+", " "), C.TOKENS))
    v = C.verdicts(boxes, ["doc_id"], readers, boxes=False)
    return v.groupBy("doc_id").agg(F.count_if("agreed").alias("agreed"), F.count_if(~F.col("agreed")).alias("disputed"))


QUERIES["consensus_tokens"] = consensus_tokens
ORACLES["consensus_tokens"] = READ.format(pattern=r"\w+(?:[.,]\w+)*").replace("unnest(regexp_extract_all(text,", "unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g'),") + "select doc_id, count(*) filter (where n0 = n1 and n1 = n2) as agreed, count(*) filter (where n0 <> n1 or n1 <> n2) as disputed from g group by doc_id"


def disputed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Values in dispute, cited."""
    boxes, readers = readings(spark, sf)
    v = C.verdicts(boxes, ["doc_id"], readers).where("not agreed")
    return v.select(F.lit("disputed").alias("kind"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("cite"), F.concat("value", F.lit("  ("), C.tally(F.col("counts")), F.lit(")")).alias("text"), F.concat(F.lit("> disputed "), "value", F.lit(": "), C.tally(F.col("counts"))).alias("line"))


QUERIES["disputed_rows"] = disputed_rows
ORACLES["disputed_rows"] = NUMBERS + "select 'disputed' as kind, 'doc/' || doc_id as cite, value || '  (r0 ' || n0 || ', r1 ' || n1 || ', r2 ' || n2 || ')' as text, '> disputed ' || value || ': r0 ' || n0 || ', r1 ' || n1 || ', r2 ' || n2 as line from g where not (n0 = n1 and n1 = n2)"


def agreement_table(spark: SparkSession, sf: str) -> DataFrame:
    """Who has to agree: one reader is no check, two models are none, a local one and a model are."""
    cases = [(1, "a", "local", "5"), (2, "a", "llm", "5"), (2, "b", "llm", "5"), (3, "a", "local", "5"), (3, "b", "llm", "5"), (4, "a", "local", "5 5"), (4, "b", "llm", "5"), (5, "a", "local", "５"), (5, "b", "llm", "5"), (6, "a", "local", ""), (6, "b", "llm", "7")]
    rows = spark.createDataFrame(cases, "item int, engine string, kind string, text string")
    boxes = rows.select("item", "engine", F.lit(0).alias("box_no"), "text", F.lit(None).cast("array<double>").alias("bbox"))
    readers = rows.select("item", "engine", "kind", F.when(F.col("engine") == "a", 0).otherwise(1).alias("ord"))
    return C.verdicts(boxes, ["item"], readers).select("item", "value", "agreed", C.tally(F.col("counts")).alias("tally"))


QUERIES["agreement_table"] = agreement_table
ORACLES["agreement_table"] = "select * from (values (1, '5', false, 'a 1'), (2, '5', false, 'a 1, b 1'), (3, '5', true, 'a 1, b 1'), (4, '5', false, 'a 2, b 1'), (5, '5', true, 'a 1, b 1'), (6, '7', false, 'a 0, b 1')) t(item, value, agreed, tally)"


def drawn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, fills and images of pages, made of lineitem: a supplier is a document of 16 pages."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("item", "page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    own = li.withColumns({"item": F.col("l_suppkey"), "page": F.col("l_orderkey") % 16})
    own = own.withColumn("seq", F.row_number().over(w))
    x, y, q = F.col("l_partkey") % 40, F.floor(F.col("l_partkey") / 40) % 30, F.col("l_quantity").cast("int")
    spans = own.where("l_linenumber <= 3").select("item", "page", "seq", x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 5).cast("double").alias("x1"), (y + 2).cast("double").alias("y1"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), F.array((F.col("l_partkey") % 5) / 4).alias("color"), (q % 16).cast("double").alias("size"), ((q % 50) / 50).alias("opacity"), (F.col("l_partkey") % 7).cast("int").alias("type"))
    fills = own.where("l_linenumber = 4 or l_linenumber = 5").select("item", "page", "seq", (x - 20).cast("double").alias("x0"), (y - 20).cast("double").alias("y0"), (x + q).cast("double").alias("x1"), (y + q).cast("double").alias("y1"), F.array((F.col("l_partkey") % 3) / 2, (F.col("l_partkey") % 2) * 1.0, (F.col("l_suppkey") % 2) * 1.0).alias("color"))
    images = own.where("l_linenumber > 5").select("item", "page", "seq", (x - 3).cast("double").alias("x0"), (y - 3).cast("double").alias("y0"), (x + q % 9).cast("double").alias("x1"), (y + q % 9).cast("double").alias("y1"), F.col("l_partkey").alias("image"))
    return spans, fills, images


DRAWN = """with o as (select *, l_suppkey as item, l_orderkey % 16 as page, row_number() over (partition by l_suppkey, l_orderkey % 16 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as seq, l_partkey % 40 as x, l_partkey // 40 % 30 as y, l_quantity::int as q from lineitem),
s as (select item, page, seq, x as x0, y as y0, x + 5 as x1, y + 2 as y1, 't' || l_partkey as text, (l_partkey % 5) / 4.0::double as color, (q % 16)::double as size, (q % 50) / 50.0::double as opacity, l_partkey % 7 as type from o where l_linenumber <= 3),
f as (select item, page, seq, x - 20 as x0, y - 20 as y0, x + q as x1, y + q as y1, 0.299 * ((l_partkey % 3) / 2.0::double) + 0.587 * (l_partkey % 2)::double + 0.114 * (l_suppkey % 2)::double as l from o where l_linenumber in (4, 5)),
i as (select item, page, seq, x - 3 as x0, y - 3 as y0, x + q % 9 as x1, y + q % 9 as y1, l_partkey as image from o where l_linenumber > 5),
b as (select s.item, s.page, s.seq, arg_max(f.l, f.seq) as l, max(f.seq) as behind from s join f on s.item = f.item and s.page = f.page and f.seq < s.seq and f.x0 <= s.x0 and s.x1 <= f.x1 and f.y0 <= s.y0 and s.y1 <= f.y1 group by all),
u as (select s.item, s.page, s.seq, max(i.seq) as image from s join i on s.item = i.item and s.page = i.page and i.seq < s.seq and i.x0 < i.x1 and i.y0 < i.y1 and s.x0 < i.x1 and i.x0 < s.x1 and s.y0 < i.y1 and i.y0 < s.y1 group by all),
c as (select s.item, s.page, s.seq, exists (select 1 from f where s.item = f.item and s.page = f.page and f.seq > s.seq and f.x0 <= s.x0 and s.x1 <= f.x1 and f.y0 <= s.y0 and s.y1 <= f.y1) as over from s),
a as (select s.*, coalesce(b.l, 1.0) as background, behind, coalesce(u.image, -1) as image, over from s left join b using (item, page, seq) left join u using (item, page, seq) join c using (item, page, seq))
"""
KEYS = ["item", "page"]


def hidden_background(spark: SparkSession, sf: str) -> DataFrame:
    """The background of each span: the last fill before it that contains it."""
    spans, fills, _ = drawn(spark, sf)
    return S.backgrounds(spans, fills, KEYS).select(*KEYS, F.col("seq").cast("long").alias("seq"), "background")


QUERIES["hidden_background"] = hidden_background
ORACLES["hidden_background"] = DRAWN + "select item, page, seq, background from a"


def hidden_last_image(spark: SparkSession, sf: str) -> DataFrame:
    """The last image under each span."""
    spans, _, images = drawn(spark, sf)
    return S.last_under(spans, images, KEYS).select(*KEYS, F.col("seq").cast("long").alias("seq"), F.col("image").cast("long").alias("image"))


QUERIES["hidden_last_image"] = hidden_last_image
ORACLES["hidden_last_image"] = DRAWN + "select item, page, seq, image from a"


def hidden_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Spans that a later fill covers."""
    spans, fills, _ = drawn(spark, sf)
    return S.covered(spans, fills, KEYS).select(*KEYS, F.col("seq").cast("long").alias("seq"), "text")


QUERIES["hidden_covered"] = hidden_covered
ORACLES["hidden_covered"] = DRAWN + "select item, page, seq, text from a where over"


def hidden_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden spans with every reason in order."""
    spans, fills, images = drawn(spark, sf)
    h = S.hidden(spans, fills, images, KEYS, (0.0, 0.0, 36.0, 28.0))
    return h.select(*KEYS, F.col("seq").cast("long").alias("seq"), "text", F.array_join("reasons", "; ").alias("reasons"), "color_cents", "background_cents")


QUERIES["hidden_spans"] = hidden_spans
ORACLES["hidden_spans"] = DRAWN + """, r as (select *, abs(color - background) as gap, concat_ws('; ', case when type = 3 then 'render mode 3' end, case when opacity < 0.05 then 'opacity 0.' || lpad(round_even(opacity * 100, 0)::int::varchar, 2, '0') end, case when size < 4 then 'size ' || size::int || '.0pt' end,
 case when not (x0 < 36 and 0 < x1 and y0 < 28 and 0 < y1) then 'off page' end, case when not (image >= 0 and (behind is null or image > behind)) and abs(color - background) < 0.12 then 'color matches background by 0.' || lpad(round_even(abs(color - background) * 100, 0)::int::varchar, 2, '0') end, case when over then 'covered by a later fill' end) as reasons from a)
select item, page, seq, text, reasons, round_even(color * 100, 0) as color_cents, round_even(background * 100, 0) as background_cents from r where reasons <> ''"""


def repeated_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images on over half of the pages of an item with three pages or more."""
    _, _, images = drawn(spark, sf)
    own = images.select("item", "page", (F.col("image") % 4).alias("image"))
    pages = own.groupBy("item").agg(F.count_distinct("page").alias("pages"))
    each = own.groupBy("item", "image").agg(F.count_distinct("page").alias("on"))
    return each.join(pages, "item").select("item", "image", "on", "pages", ((F.col("pages") >= 3) & (F.col("on") / F.col("pages") > 0.5)).alias("repeated"))


QUERIES["repeated_images"] = repeated_images
ORACLES["repeated_images"] = DRAWN + ", e as (select item, image % 4 as image, count(distinct page) as \"on\" from i group by all), p as (select item, count(distinct page) as pages from i group by item) select item, image, \"on\", pages, pages >= 3 and \"on\" / pages > 0.5 as repeated from e join p using (item)"


def layer_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Images with at least 20 characters of unseen text over them."""
    spans, _, images = drawn(spark, sf)
    s, i = spans.where("type = 3 or opacity < 0.3").alias("s"), images.alias("i")
    own = i.join(s, (F.col("s.item") == F.col("i.item")) & (F.col("s.page") == F.col("i.page")) & S.touches("s", "i")).groupBy(F.col("i.item").alias("item"), F.col("i.page").alias("page"), F.col("i.seq").cast("long").alias("seq")).agg(F.sum(F.length("s.text")).alias("chars"))
    return own.where("chars >= 20")


QUERIES["layer_chars"] = layer_chars
ORACLES["layer_chars"] = DRAWN + "select i.item, i.page, i.seq, sum(length(s.text))::bigint as chars from i join s on s.item = i.item and s.page = i.page and i.x0 < i.x1 and i.y0 < i.y1 and s.x0 < i.x1 and i.x0 < s.x1 and s.y0 < i.y1 and i.y0 < s.y1 where s.type = 3 or s.opacity < 0.3 group by all having sum(length(s.text)) >= 20"


def luminance_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Luminance of gray, RGB, CMYK and no colour."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    v = (F.col("p_size") % 11) / 10
    color = F.when(F.col("p_partkey") % 4 == 0, F.array(v)).when(F.col("p_partkey") % 4 == 1, F.array(v, F.lit(0.5), F.lit(1.0))).when(F.col("p_partkey") % 4 == 2, F.array(v, F.lit(0.1), F.lit(0.2), F.lit(0.3)))
    return p.select("p_partkey", R.luminance(color).alias("luminance"))


QUERIES["luminance_cases"] = luminance_cases
ORACLES["luminance_cases"] = """with p as (select p_partkey, (p_size % 11) / 10.0::double as v from part)
select p_partkey, case p_partkey % 4 when 0 then v when 1 then 0.299::double * v + 0.587::double * 0.5 + 0.114::double when 2 then 0.299::double * (1 - v) * 0.7 + 0.587::double * 0.9 * 0.7 + 0.114::double * 0.8 * 0.7 else 0 end::double as luminance from p"""
