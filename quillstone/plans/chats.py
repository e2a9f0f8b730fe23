"""Queries on chats, captions and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import chat as C
from ..operators import series as S
from .tables import table

QUERIES = {}
ORACLES = {}


def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as lines of the dialects: a day line before turn 0, then messages."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("said"))
    d, h, m = F.col("conv_id") % 28 + 1, F.col("turn") % 12 + 1, F.col("conv_id") % 60
    mm = F.lpad(m.cast("string"), 2, "0")
    text = (
        F.when(F.col("conv_id") % 4 == 0, F.format_string("[%s] [%s %d:%s] %s", "role", F.when(F.col("turn") % 2 == 0, "오전").otherwise("오후"), h, mm, "said"))
        .when(F.col("conv_id") % 4 == 1, F.format_string("2021년 12월 %d일 오후 %d:%s, %s : %s", d, h, mm, "role", "said"))
        .when(F.col("conv_id") % 4 == 2, F.format_string("Dec %d, 2014 at %d:%s, %s : %s", d, h, mm, "role", "said"))
        .otherwise(F.format_string("2021. 12. %d. 오전 %d:%s, notice", d, h, mm))
    )
    day = c.where("turn = 0 and conv_id % 4 = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.format_string("--------------- 2022년 3월 %d일 화요일 ---------------", d).alias("line"))
    return c.select("conv_id", "turn", text.alias("line")).unionByName(day)


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps, senders and texts of chat lines."""
    return C.messages(chat_lines(spark, sf), "conv_id", "turn", "line")


QUERIES["chat_messages"] = chat_messages
ORACLES["chat_messages"] = r"""with c as (select conv_id, turn, role, rtrim(replace(text, chr(10), ' '), ' ') as said, conv_id % 28 + 1 as d, turn % 12 + 1 as h, conv_id % 60 as m from conversations)
select conv_id, turn,
 case conv_id % 4 when 0 then case when exists (select 1 from conversations z where z.conv_id = c.conv_id and z.turn = 0) then printf('2022-03-%02d %02d:%02d', d, h % 12 + case when turn % 2 = 0 then 0 else 12 end, m) end
  when 1 then printf('2021-12-%02d %02d:%02d', d, h % 12 + 12, m) when 2 then printf('2014-12-%02d %02d:%02d', d, h, m) else printf('2021-12-%02d %02d:%02d', d, h % 12, m) end as stamp,
 case conv_id % 4 when 3 then '' else role end as name, case conv_id % 4 when 3 then 'notice' else said end as text from c"""


def chat_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """Three messages or more in the first 60 lines make a chat."""
    lines = chat_lines(spark, sf).where("turn < 60")
    return lines.groupBy("conv_id").agg(F.count_if(C.is_message(F.col("line"))).alias("hits"), (F.count_if(C.is_message(F.col("line"))) >= 3).alias("chat"))


QUERIES["chat_sniff"] = chat_sniff
ORACLES["chat_sniff"] = "select conv_id, count(*) as hits, count(*) >= 3 as chat from conversations where turn < 60 group by conv_id"


def chat_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of three messages, cited by the first."""
    c = table(spark, sf, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    b = c.groupBy("conv_id", F.floor(F.col("n") / 3).alias("block")).agg(F.min("turn").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit("| ["), "role", F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return b.select("conv_id", "block", F.concat(F.lit("chat.zip#att="), F.col("conv_id").cast("string"), F.lit(".json#ts="), F.col("first").cast("string")).alias("cite"), "text")


QUERIES["chat_blocks"] = chat_blocks
ORACLES["chat_blocks"] = """with c as (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations)
select conv_id, n // 3 as block, 'chat.zip#att=' || conv_id || '.json#ts=' || min(turn) as cite, string_agg(turn || '| [' || role || '] ' || replace(text, chr(10), ' '), chr(10) order by turn) as text from c group by conv_id, n // 3"""


def roster_names(spark: SparkSession, sf: str) -> DataFrame:
    """The sender's name from a roster whose first entry counts, else the id."""
    roster = spark.createDataFrame([(1, "user", "Uma"), (2, "user", "Other"), (3, "assistant", ""), (4, "system", None)], "ord int, id string, name string")
    first = roster.where("name <> ''").groupBy("id").agg(F.min_by("name", "ord").alias("name"))
    c = table(spark, sf, "conversations")
    return c.join(first, c["role"] == first["id"], "left").select("conv_id", "turn", F.coalesce("name", "role").alias("who"))


QUERIES["roster_names"] = roster_names
ORACLES["roster_names"] = "select conv_id, turn, case role when 'user' then 'Uma' else role end as who from conversations"


def mention_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions inside texts become names."""
    names = F.create_map(F.lit("U1"), F.lit("Ann"), F.lit("C1"), F.lit("general"))
    kinds = ["<@U1>", "<@U2|Bob>", "<@U3>", "<#C1>", "<#C1|news>", "<!here>", "<!subteam^S1|@team>", "<http://x.org|site>", "&lt;b&gt; &amp;"]
    c = table(spark, sf, "conversations")
    text = F.concat(F.translate("text", "<>&", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, kinds)), (F.col("turn") % 9 + 1).cast("int")), F.lit(" <@U1>"))
    return c.select("conv_id", "turn", C.renamed(text, names).alias("text"))


QUERIES["mention_rewrite"] = mention_rewrite
ORACLES["mention_rewrite"] = "select conv_id, turn, translate(text, '<>&', '') || ' ' || ['@Ann', '@Bob', '@U3', '#general', '#news', '@here', '@@team', 'site', '<b> &'][turn % 9 + 1] || ' @Ann' as text from conversations"


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The day of the last signup carried to a user's later events."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd")), True).over(w).alias("day"))


QUERIES["carry_forward"] = carry_forward
ORACLES["carry_forward"] = "select event_id, last_value(case when event_type = 'signup' then strftime(ts, '%Y-%m-%d') end ignore nulls) over (partition by user_id order by ts, event_id) as day from events"


def cues(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = (F.unix_timestamp("ts") % 7200).cast("double")
    return e.select("user_id", "event_id", start.alias("start"), (start + F.floor("value")).alias("end"), "event_type")


def cues_window(spark: SparkSession, sf: str) -> DataFrame:
    """Cues that touch a window, as lines."""
    c = cues(spark, sf).where(C.in_window(F.col("start"), F.col("end"), 600, 1200))
    return c.select("event_id", F.concat(R.span("start", "end"), F.lit("| "), "event_type").alias("line"))


QUERIES["cues_window"] = cues_window
ORACLES["cues_window"] = """with c as (select event_id, event_type, (floor(epoch(ts))::bigint % 7200) as s, (floor(epoch(ts))::bigint % 7200) + floor(value)::bigint as e from events)
select event_id, printf('@%02d:%02d:%02d.0-%02d:%02d:%02d.0| ', s // 3600, s % 3600 // 60, s % 60, e // 3600, e % 3600 // 60, e % 60) || event_type as line from c where e >= 600 and s <= 1200"""


def cue_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of captions in both notations."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 3).alias("h"), (F.col("event_id") % 60).alias("m"), (F.col("user_id") % 60).alias("s"), (F.col("event_id") % 1000).alias("ms"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    srt = F.concat(F.when(F.col("h") > 0, F.concat(two("h"), F.lit(":"))).otherwise(""), two("m"), F.lit(":"), two("s"), F.lit(","), F.lpad(F.col("ms").cast("string"), 3, "0"))
    ass = F.concat(F.col("h").cast("string"), F.lit(":"), two("m"), F.lit(":"), two("s"), F.lit("."), F.lpad((F.col("ms") % 100).cast("string"), 2, "0"))
    return e.select("event_id", C.cue_seconds(srt).alias("srt"), C.ass_seconds(ass).alias("ass"))


QUERIES["cue_times"] = cue_times
ORACLES["cue_times"] = "select event_id, (event_id % 3) * 3600 + (event_id % 60) * 60 + user_id % 60 + (event_id % 1000) / 1000.0::double as srt, (event_id % 3) * 3600 + (event_id % 60) * 60 + user_id % 60 + (event_id % 1000 % 100) / 100.0::double as ass from events"


def rolling_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions that roll, merged."""
    c = table(spark, sf, "conversations").withColumn("first", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    said = F.when(F.col("turn") % 3 == 1, F.concat("first", F.lit(" "), "text")).otherwise(F.col("first"))
    own = c.select("conv_id", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), said.alias("text"))
    return C.rolling_captions(own, "conv_id", "start", "end", "text")


QUERIES["rolling_captions"] = rolling_captions
ORACLES["rolling_captions"] = """with recursive c as (select conv_id, turn, text, first_value(text) over (partition by conv_id order by turn) as first, row_number() over (partition by conv_id order by turn, turn + 1) as n from conversations),
s as (select conv_id, n, turn::double as start, (turn + 1)::double as "end", coalesce(case when turn % 3 = 1 then first || ' ' || text else first end, '') as said from c),
r as (select conv_id, n, start, "end", said, said as fresh, case when said <> '' then said end as last from s where n = 1
 union all select conv_id, n, start, "end", said, fresh, case when fresh <> '' and fresh is distinct from last then fresh else last end from
 (select s.conv_id, s.n, s.start, s."end", s.said, r.last, case when r.last is not null and starts_with(s.said, r.last) and s.said <> r.last then trim(substr(s.said, length(r.last) + 1), ' ') when s.said is not distinct from r.last then '' else s.said end as fresh from r join s on s.conv_id = r.conv_id and s.n = r.n + 1))
select conv_id, start, "end", fresh as text from (select *, lag(last) over (partition by conv_id order by n) as before from r) where fresh <> '' and fresh is distinct from before"""


def frame_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of vectors by rising neighbours, and how far each is from a fixed one."""
    e = table(spark, sf, "embeddings").select("vec_id", S.gradient_bits(F.col("embedding"), 63).alias("shape"))
    return e.select("vec_id", "shape", S.hamming(F.col("shape"), F.lit(0x5555555555555555)).cast("long").alias("distance"))


QUERIES["frame_fingerprint"] = frame_fingerprint
ORACLES["frame_fingerprint"] = """with e as (select vec_id, list_sum(list_transform(range(0, 62), lambda k: case when embedding[k + 2] > embedding[k + 1] then 1::hugeint << k else 0::hugeint end))::bigint as shape from embeddings)
select vec_id, shape, bit_count(xor(shape, 6148914691236517205))::bigint as distance from e"""


def picture_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and mean tone of pictures of 8 by 8 gray levels."""
    e = table(spark, sf, "embeddings").select("vec_id", S.look(F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("double")), 8, 8).alias("look"))
    return e.select("vec_id", "look.shape", "look.tone")


QUERIES["picture_looks"] = picture_looks
ORACLES["picture_looks"] = """with e as (select vec_id, list_transform(embedding, lambda x: floor((x::double + 1) * 100)) as g from embeddings)
select vec_id, list_sum(list_transform(range(0, 56), lambda k: case when g[k // 7 * 8 + k % 7 + 2] > g[k // 7 * 8 + k % 7 + 1] then 1::hugeint << k else 0::hugeint end))::bigint as shape, list_sum(g) / 64 as tone from e"""


def equal_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """each picture with the first of its label that has the same pixels (here the signs of three values)."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: (x > 0).cast("int")).alias("pixels"))
    return S.first_equal(e, ["label"], "vec_id", "pixels")


QUERIES["equal_pictures"] = equal_pictures
ORACLES["equal_pictures"] = 'select label, vec_id, min(vec_id) over (partition by label, embedding[1] > 0, embedding[2] > 0, embedding[3] > 0) as "first" from embeddings'


def distinct_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that repeat the last kept one."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") / 3).cast("long").alias("shape"), F.lit(10.0).alias("tone"))
    return S.distinct_frames(e, "label", "vec_id", "shape", "tone", 2)


QUERIES["distinct_frames"] = distinct_frames
ORACLES["distinct_frames"] = """with recursive e as (select label, vec_id, vec_id // 3 as shape, row_number() over (partition by label order by vec_id) as n from embeddings),
r as (select label, vec_id, n, null::bigint as repeats, vec_id as kept, shape as last from e where n = 1
 union all select e.label, e.vec_id, e.n, case when bit_count(xor(e.shape, r.last)) <= 2 then r.kept end, case when bit_count(xor(e.shape, r.last)) <= 2 then r.kept else e.vec_id end, case when bit_count(xor(e.shape, r.last)) <= 2 then r.last else e.shape end
 from r join e on e.label = r.label and e.n = r.n + 1)
select label, vec_id, repeats from r"""


def spread_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Seven events of each user, evenly spaced."""
    e = table(spark, sf, "events").select("user_id", "event_id")
    return S.spread(e, ["user_id"], ["event_id"], F.lit(7)).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


QUERIES["spread_sample"] = spread_sample
ORACLES["spread_sample"] = """with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as place, count(*) over (partition by user_id) as n from events)
select user_id, event_id, place from e where n <= 7 or list_contains(list_transform(range(0, 7), lambda i: round_even(i * ((n - 1) / 6.0), 0)::bigint), place)"""


def cap_with_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """At most twelve a user, distinct ones first."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3 == 0).alias("repeat"))
    return S.capped(e, "user_id", ["event_id"], "repeat", 12)


QUERIES["cap_with_repeats"] = cap_with_repeats
ORACLES["cap_with_repeats"] = """with e as (select user_id, event_id, event_id % 3 = 0 as repeat, count(*) over (partition by user_id) as total, count(*) filter (where event_id % 3 <> 0) over (partition by user_id) as fresh from events),
p as (select *, row_number() over (partition by user_id, repeat order by event_id) - 1 as place, count(*) over (partition by user_id, repeat) as n, case when repeat then greatest(0, 12 - least(fresh, 12)) else 12 end as want from e)
select user_id, event_id, repeat from p where total <= 12 or (want > 0 and (n <= want or (want = 1 and place = 0) or (want > 1 and list_contains(list_transform(range(0, want), lambda i: round_even(i * ((n - 1) / (want - 1)), 0)::bigint), place))))"""


def interval_grid(spark: SparkSession, sf: str) -> DataFrame:
    """S129: an instant every 2.5 seconds of each user's recording, from its first event in an hour of its own to its last."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.unix_timestamp("ts") % 3600).cast("double").alias("start"), F.max(F.unix_timestamp("ts") % 3600).cast("double").alias("end"))
    return e.select("user_id", F.explode(S.instants(F.col("start"), F.col("end"), 2.5)).alias("t"))


QUERIES["interval_grid"] = interval_grid
ORACLES["interval_grid"] = """with e as (select user_id, min(floor(epoch(ts))::bigint % 3600)::double as s, max(floor(epoch(ts))::bigint % 3600)::double as f from events group by user_id)
select user_id, s + unnest(range(0, floor((f - s) / 2.5)::bigint + 1)) * 2.5::double as t from e"""


def events_terminal(spark: SparkSession, sf: str) -> DataFrame:
    """Streams with exactly one end, last, whose count is that of the records before it."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("end"), F.length("props").alias("size"))
    own = e.groupBy("user_id").agg(F.count_if(~F.col("end")).alias("records"), F.count_if("end").alias("ends"), F.max_by("end", "event_id").alias("last_is_end"), F.max("size").alias("longest"))
    return own.select("user_id", "records", "ends", F.when((F.col("ends") == 1) & F.col("last_is_end") & (F.col("longest") <= 4194304), "confirmed").when(F.col("ends") == 0, "unconfirmed").otherwise("invalid").alias("status"))


QUERIES["events_terminal"] = events_terminal
ORACLES["events_terminal"] = """with e as (select user_id, count(*) filter (where event_type <> 'purchase') as records, count(*) filter (where event_type = 'purchase') as ends, arg_max(event_type, event_id) = 'purchase' as last from events group by user_id)
select user_id, records, ends, case when ends = 1 and last then 'confirmed' when ends = 0 then 'unconfirmed' else 'invalid' end as status from e"""


def match_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Matches and misses; strict readiness takes no miss."""
    l = table(spark, sf, "labels").withColumn("part", F.col("doc_id") % 50)
    return l.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality") == 0).alias("misses"), F.every(F.col("quality") == 1).alias("strict_ready"))


QUERIES["match_ready"] = match_ready
ORACLES["match_ready"] = "select doc_id % 50 as part, count(*) as rows, count(*) filter (where quality = 0) as misses, bool_and(quality = 1) as strict_ready from labels group by 1"


def windows_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: hourly windows by type."""
    e = table(spark, sf, "events")
    own = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES["windows_tumbling"] = windows_tumbling
ORACLES["windows_tumbling"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all"


def windows_session(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions of a user, closed by half a day without events."""
    e = table(spark, sf, "events")
    own = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES["windows_session"] = windows_session
ORACLES["windows_session"] = """with e as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 12 hour then 1 else 0 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts) as k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k"""
