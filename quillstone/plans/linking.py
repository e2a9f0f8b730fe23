"""Queries that link rows: jobs and outcomes, parts and targets, details and items, recordings and subtitles; and small
projections beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import files as O
from ..operators import linking as L
from .tables import table

QUERIES = {}
ORACLES = {}


def job_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of an item and what came of each, matched by item and number; what has none is unread."""
    c = table(spark, sf, "conversations")
    done = c.where("turn % 3 <> 0").select("conv_id", "turn", (F.lit(1) + (F.col("role") == "user").cast("int")).alias("engines"))
    own = L.outcomes(c, done, "conv_id", "turn")
    return own.withColumn("needs", F.when(F.col("unread") > 0, R.not_read("unread", "picture", "shallow")))


QUERIES["job_outcomes"] = job_outcomes
ORACLES["job_outcomes"] = """with j as (select conv_id, case when turn % 3 <> 0 then case when role = 'user' then 2 else 1 end end as engines from conversations),
g as (select conv_id, count(*) as jobs, count(engines) as read, count_if(engines = 1)::bigint as unchecked, count_if(engines is null)::bigint as unread from j group by conv_id)
select *, case when unread > 0 then format('{:,}', unread) || ' picture' || case when unread > 1 then 's' else '' end || ' not read (shallow)' end as needs from g"""


def relationship_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A part's relationship to its target; external targets have none."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    relations = region.select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("part/"), F.lower("r_name")).alias("target"), (F.col("r_name") == "ASIA").alias("external"))
    return L.targets(nation, relations, "n_regionkey").select("n_nationkey", "n_name", "target")


QUERIES["relationship_targets"] = relationship_targets
ORACLES["relationship_targets"] = "select n_nationkey, n_name, case when r_name <> 'ASIA' then 'part/' || lower(r_name) end as target from nation left join region on n_regionkey = r_regionkey"


def item_details(spark: SparkSession, sf: str) -> DataFrame:
    """The detail rows of each item with the item, in their order; the details' side is gathered before it is joined."""
    d, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return L.details(d, o, "c_custkey", "o_orderkey").select("c_custkey", "n_details", F.array_join(F.transform("details", lambda k: k.cast("string")), ",").alias("keys"))


QUERIES["item_details"] = item_details
ORACLES["item_details"] = """with o as (select o_custkey, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as keys from orders group by o_custkey)
select c_custkey, coalesce(n, 0)::bigint as n_details, keys from customer left join o on c_custkey = o_custkey"""


def first_block_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each picture linked to the first block of the same source (here the first turn of its speaker)."""
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn")
    return L.first_blocks(c, c, ["conv_id", "role"], "turn").select("conv_id", "turn", "block")


QUERIES["first_block_links"] = first_block_links
ORACLES["first_block_links"] = "select conv_id, turn, min(turn) over (partition by conv_id, role) as block from conversations"


def reader_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Readers in the order in which they are asked: local ones first, then as named."""
    r = table(spark, sf, "region").withColumn("remote", (F.col("r_regionkey") % 2 == 0).cast("int"))
    return L.asked(r, "remote", "r_regionkey").select("r_name", "place")


QUERIES["reader_priority"] = reader_priority
ORACLES["reader_priority"] = "select r_name, row_number() over (order by (r_regionkey % 2 = 0)::int, r_regionkey) as place from region"


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of a page from top to bottom and left to right (here parts by size and price)."""
    return L.shape_order(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "p_partkey").select("p_partkey", "place")


QUERIES["reading_order"] = reading_order
ORACLES["reading_order"] = "select p_partkey, row_number() over (partition by p_brand order by p_size, p_retailprice, p_partkey) as place from part"


def comment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose first field begins with the comment mark are left out, and counted."""
    told = L.without_comments(F.filter(F.split("text", "\n"), lambda x: x != ""), "Un")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", told.alias("told"))
    return d.select("doc_id", F.size("told.kept").cast("long").alias("rows"), "told.comments")


QUERIES["comment_rows"] = comment_rows
ORACLES["comment_rows"] = """with l as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null)
select doc_id, len(list_filter(a, lambda x: not starts_with(x, 'Un') and x <> ''))::bigint as rows, len(list_filter(a, lambda x: starts_with(x, 'Un')))::bigint as comments from l"""


def readable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A text is readable if at most one character in a hundred is a control or a replacement."""
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", L.odd_characters(html).alias("odd"), L.readable(html).alias("readable"))


QUERIES["readable_texts"] = readable_texts
ORACLES["readable_texts"] = r"""with p as (select page_id, html, length(regexp_replace(html, '[^\x00-\x08\x0e-\x1f\x7f\x{fffd}]', '', 'g'))::bigint as odd from pages)
select page_id, odd, odd * 100 <= length(html) as readable from p"""


def values_of_readers(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct values that any reader saw, in order (here the long words of each conversation, a turn for a reader)."""
    own = L.values_seen(table(spark, sf, "conversations"), "conv_id", "text", "[A-Za-z]{6,}")
    return own.select("conv_id", F.array_join("found", " ").alias("found"), "n")


QUERIES["values_of_readers"] = values_of_readers
ORACLES["values_of_readers"] = """with v as (select distinct conv_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) as value from conversations)
select conv_id, string_agg(value, ' ' order by value) as found, count(*) as n from v group by conv_id"""


def physical_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The physical line on which a row begins, where fields before it hold line ends (here texts cut at full stops)."""
    c = table(spark, sf, "conversations")
    return L.row_lines(c, "conv_id", "turn", F.regexp_count("text", F.lit(r"[.]"))).select("conv_id", "turn", "line")


QUERIES["physical_lines"] = physical_lines
ORACLES["physical_lines"] = """with c as (select conv_id, turn, len(regexp_extract_all(text, '[.]')) as breaks from conversations)
select conv_id, turn, (2 + coalesce(sum(breaks + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as line from c"""


def data_uris(spark: SparkSession, sf: str) -> DataFrame:
    """data URIs decoded, base64 or percent-encoded; what isn't one is null."""
    d = table(spark, sf, "documents").where("text is not null")
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("\n"), F.lit("%0A"))
    uri = F.when(F.col("doc_id") % 4 == 0, F.lit("http://x")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("data:,"), escaped)).otherwise(F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.base64(F.col("text").cast("binary"))))
    body = O.data_uri(uri)
    return d.select("doc_id", F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"))


QUERIES["data_uris"] = data_uris
ORACLES["data_uris"] = """select doc_id, case when doc_id % 4 <> 0 then octet_length(encode(text))::bigint end as bytes,
 case when doc_id % 4 <> 0 then sha256(text) end as digest from documents where text is not null"""


def scaled_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes read on a scaled picture, back in its own units, one decimal, half to even."""
    p = table(spark, sf, "part")
    box = L.scaled_box(F.array(F.col("p_size"), F.col("p_size") + 7, F.col("p_size") * 3, F.col("p_size") * 5), 4)
    return p.select("p_partkey", box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"))


QUERIES["scaled_boxes"] = scaled_boxes
ORACLES["scaled_boxes"] = "select p_partkey, round_even(p_size / 4.0::double, 1) as x0, round_even((p_size + 7) / 4.0::double, 1) as y0, round_even(p_size * 3 / 4.0::double, 1) as x1, round_even(p_size * 5 / 4.0::double, 1) as y1 from part"


def reader_identity(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of all that decides a reading, by which it is looked up again."""
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", L.identity(F.col("s_name"), F.col("s_nationkey"), F.lit("v1")).alias("identity"))


QUERIES["reader_identity"] = reader_identity
ORACLES["reader_identity"] = "select s_suppkey, sha256(concat_ws(chr(10), s_name, s_nationkey::varchar, 'v1')) as identity from supplier"


def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    """the reader's code of each text's language; others keep their own."""
    return table(spark, sf, "documents").select("doc_id", L.reader_language(F.col("lang")).alias("code"))


QUERIES["language_codes"] = language_codes
ORACLES["language_codes"] = "select doc_id, case lang " + " ".join(f"when '{a}' then '{b}'" for a, b in L.LANGUAGES.items()) + " else lang end as code from documents"


def sticky_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes as blocks: their kind, author and text; empty ones are left out."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", L.sticky_note("Note", F.col("role"), F.col("text")).alias("text")).where("text is not null")


QUERIES["sticky_notes"] = sticky_notes
ORACLES["sticky_notes"] = "select conv_id, turn, '[Note by ' || coalesce(role, 'unknown') || '] ' || trim(text, ' ') as text from conversations where trim(text, ' ') <> ''"


def worthy_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures whose smaller side and drawn area are large enough to hold text (here parts as pictures)."""
    p = table(spark, sf, "part").withColumns({"w": F.col("p_size") * 4, "h": F.floor(F.col("p_retailprice") / 20).cast("int")})
    return p.where(L.worth_reading(F.col("w"), F.col("h"))).select("p_partkey", "w", "h")


QUERIES["worthy_pictures"] = worthy_pictures
ORACLES["worthy_pictures"] = "with p as (select p_partkey, p_size * 4 as w, floor(p_retailprice / 20)::int as h from part) select * from p where least(w, h) >= 48 and w * h >= 2500"


def sidecar_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    """S127 J10 Z35: a recording reads the first subtitle file of its folder and stem that has cues; others are listened to."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("folder"), F.concat(F.lit("clip"), F.col("doc_id").cast("string")).alias("stem"))
    files = d.select("folder", "stem", "doc_id", F.explode(F.array(F.lit("b.vtt"), F.lit("a.srt"))).alias("end")).where("doc_id % 3 <> 1 and not (end = 'a.srt' and doc_id % 3 = 2)")
    named = files.select("folder", "stem", F.concat("stem", F.lit("."), "end").alias("name"), (F.col("doc_id") % 5).alias("cues"))
    return L.recording_jobs(d, named, ["folder", "stem"], "name", "cues").select("doc_id", "file", "job")


QUERIES["sidecar_subtitles"] = sidecar_subtitles
ORACLES["sidecar_subtitles"] = """select doc_id, case when doc_id % 5 = 0 or doc_id % 3 = 1 then null when doc_id % 3 = 0 then 'clip' || doc_id || '.a.srt' else 'clip' || doc_id || '.b.vtt' end as file,
 case when doc_id % 5 = 0 or doc_id % 3 = 1 then 'listen' else 'subtitles' end as job from documents"""


def resource_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A resource's kind: its stated format, else the suffix of its first path."""
    p = table(spark, sf, "pages")
    stated = F.when(F.col("page_id") % 3 == 0, F.lit("CSV"))
    return p.select("page_id", L.resource_kind(stated, F.col("url")).alias("kind"))


QUERIES["resource_kinds"] = resource_kinds
ORACLES["resource_kinds"] = r"""select page_id, lower(coalesce(case when page_id % 3 = 0 then 'CSV' end, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1), ''), 'unknown')) as kind from pages"""


def column_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each column of a table as name (type)."""
    return spark.createDataFrame(list(enumerate(L.labels(table(spark, sf, "customer")))), "pos int, label string")


QUERIES["column_labels"] = column_labels
ORACLES["column_labels"] = "select (cid)::int as pos, name || ' (' || case type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(type) end || ')' as label from pragma_table_info('customer')"


def squeezed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """runs of blanks as one, none at the ends."""
    return table(spark, sf, "documents").select("doc_id", F.md5(L.squeezed(F.col("text")).cast("binary")).alias("digest"))


QUERIES["squeezed_texts"] = squeezed_texts
ORACLES["squeezed_texts"] = r"select doc_id, md5(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'), ' ')) as digest from documents"
