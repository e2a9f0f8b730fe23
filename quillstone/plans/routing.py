"""Queries that route, name, claim and account for inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import coverage as C
from ..operators import routing as S
from .tables import table

QUERIES = {}
ORACLES = {}


def sniff_kind(spark: SparkSession, sf: str) -> DataFrame:
    """What the first bytes say, over pages, documents and made-up heads."""
    p = table(spark, sf, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.encode("html", "utf-8").alias("content"))
    d = table(spark, sf, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"))
    heads = ["504B0304140000000000", "255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "1F8B0800", "00010203000A", "53514C69746520666F726D6174203300", "4152524F573100", "7F454C46", "CAFEBABE", "D0CF11E0A1B11AE1", "47494638", "", "5041523100"]
    m = p.sparkSession.range(len(heads)).select(F.lit("head").alias("origin"), "id", F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("id") + 1).cast("int"))).alias("content"))
    return p.unionByName(d).unionByName(m).select("origin", "id", S.sniffed("content").alias("kind"), S.is_binary("content").alias("is_binary"))


QUERIES["sniff_kind"] = sniff_kind
ORACLES["sniff_kind"] = r"""with h as (select unnest(['504B0304140000000000','255044462D312E37','89504E470D0A1A0A','FFD8FFE0','1F8B0800','00010203000A','53514C69746520666F726D6174203300','4152524F573100','7F454C46','CAFEBABE','D0CF11E0A1B11AE1','47494638','','5041523100']) as hex, unnest(range(0, 14)) as id),
m as (select 'head' as origin, id, upper(substr(hex, 1, 16)) as x, case when hex = '' then 'unknown' end as empty, id = 5 or id in (0, 4, 6, 7, 13) or id in (2, 8) or id = 10 as b from h)
select origin, id, case when x like '504B0304%' then 'zip' when x like '25504446%' then 'pdf' when x like '89504E47%' or x like 'FFD8FF%' or x like '47494638%' then 'image' when x like '1F8B%' then 'gzip'
 when x like '53514C69746520%' then 'sqlite' when x like '4152524F5731%' then 'arrow' when x like '7F454C46%' or x like 'CAFEBABE%' then 'program' when x like 'D0CF11E0%' then 'ole' when x like '50415231%' then 'parquet' when x = '' then 'text' else 'unknown' end as kind,
 case id when 0 then true when 1 then false when 2 then true when 3 then false when 4 then true when 5 then true when 6 then true when 7 then true when 8 then false when 9 then false when 10 then true when 13 then true else false end as is_binary from m
union all select 'page', page_id, case when regexp_matches(lower(substr(html, 1, 512)), '^\s*(<!doctype html|<html)') then 'html' else 'text' end, false from pages
union all select 'doc', doc_id, 'text', false from documents where text is not null"""


def suffix_route(spark: SparkSession, sf: str) -> DataFrame:
    """The longest registered suffix of a name decides its kind."""
    d = table(spark, sf, "documents")
    endings = [".tar.gz", ".PDF", ".csv", ".gz", ".unknown", "", ".ipynb", ".xlsx", ".JSONL", ".eml", ".srt"]
    name = F.concat(F.col("source"), F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings) + 1).cast("int")))
    return d.select("doc_id", name.alias("name")).withColumns({"suffix": S.suffix_of(F.col("name")), "kind": S.kind_of(F.col("name"))})


QUERIES["suffix_route"] = suffix_route
ORACLES["suffix_route"] = """with e as (select doc_id, source || ['.tar.gz','.PDF','.csv','.gz','.unknown','','.ipynb','.xlsx','.JSONL','.eml','.srt'][doc_id % 11 + 1] as name from documents)
select doc_id, name, case doc_id % 11 when 0 then '.tar.gz' when 5 then '' else lower('.' || split_part(name, '.', 2)) end as suffix,
 ['archive','pdf','table','archive','unknown','unknown','notebook','sheet','table','mail','subtitle'][doc_id % 11 + 1] as kind from e"""


def classify_url(spark: SparkSession, sf: str) -> DataFrame:
    """S121 F32 F10: host, path's suffix and kind of URLs."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), S.url_suffix(F.col("url")).alias("suffix"), S.url_kind(F.col("url"), F.encode(F.substring("html", 1, 64), "utf-8")).alias("kind"), R.work_name("url").alias("work"))


QUERIES["classify_url"] = classify_url
ORACLES["classify_url"] = r"""with p as (select *, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_replace(url, '[^\w.\-]+', '_', 'g') as safe from pages)
select page_id, host, lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) as suffix, case when regexp_matches(lower(substr(html, 1, 64)), '^\s*(<!doctype html|<html)') then 'html' else 'file' end as kind,
 right(safe, 71) || '_' || substr(sha256(url), 1, 8) as work from p"""


def claims_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs that a manifest claims go, unless they were named by the user."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50 == 0).alias("named"))
    claims = table(spark, sf, "labels").select(F.col("doc_id").alias("claimed"))
    return C.unclaimed(d, claims, "doc_id", "claimed", "named").select("doc_id")


QUERIES["claims_anti_join"] = claims_anti_join
ORACLES["claims_anti_join"] = "select doc_id from documents d where doc_id % 50 = 0 or not exists (select 1 from labels l where l.doc_id = d.doc_id)"


def stale_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of earlier runs that this run neither wrote nor failed, members of failed inputs included."""
    d = table(spark, sf, "documents")
    out = d.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#att=m"), F.col("doc_id").cast("string"))).otherwise("")).alias("cite"), "doc_id")
    written = d.where("doc_id % 7 = 0").select("doc_id")
    failed = d.where("lang = 'de' and source in ('src1', 'src2', 'src3')").select(F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("failed")).distinct()
    return C.stale(out, written, failed)


QUERIES["stale_prefix_join"] = stale_prefix_join
ORACLES["stale_prefix_join"] = """with o as (select source || '/' || lang || case when doc_id % 3 = 0 then '#att=m' || doc_id else '' end as cite, doc_id from documents),
f as (select distinct source || '/' || lang as failed from documents where lang = 'de' and source in ('src1', 'src2', 'src3'))
select cite, doc_id from o where doc_id % 7 <> 0 and not exists (select 1 from f where cite = failed or starts_with(cite, failed || '#'))"""


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Of names that are equal without case the first keeps its own, later ones get a digest of what they name."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("name"))
    w = Window.partitionBy(F.lower("name")).orderBy("doc_id")
    digest = F.substring(F.sha2(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    return d.withColumn("n", F.row_number().over(w)).select("doc_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), digest)).alias("own_name"))


QUERIES["unique_names"] = unique_names
ORACLES["unique_names"] = """with d as (select doc_id, case when doc_id % 2 = 0 then upper(source) else source end as name from documents), n as (select *, row_number() over (partition by lower(name) order by doc_id) as n from d)
select doc_id, case when n = 1 then name else name || '-' || substr(sha256('doc/' || doc_id), 1, 8) end as own_name from n"""


def member_name(spark: SparkSession, sf: str) -> DataFrame:
    """F11 F51 S107: names and sizes of archive members made safe."""
    e = table(spark, sf, "events")
    raws = ["../../etc/passwd", "C:\\dir\\file.txt", "/abs/path.txt", "a/./b/../c.txt", "  spaced / name ", "", "...", "ok.txt", "x//y"]
    raw = F.element_at(F.array(*map(F.lit, raws)), (F.col("event_id") % len(raws) + 1).cast("int"))
    size, packed = F.col("event_id") * 1000, F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 700)
    return e.select("event_id", R.member_name(raw, F.col("event_id")).alias("member"), R.inflates(size, packed).alias("inflates"))


QUERIES["member_name"] = member_name
ORACLES["member_name"] = """select event_id, case event_id % 9 when 0 then 'etc/passwd' when 1 then 'dir/file.txt' when 2 then 'abs/path.txt' when 3 then 'a/b/c.txt' when 4 then 'spaced/name' when 5 then 'attachment-' || event_id when 6 then 'attachment-' || event_id when 7 then 'ok.txt' else 'x/y' end as member,
 coalesce(event_id % 4 > 0 and event_id * 1000 > 1048576 and event_id * 1000 > (event_id % 700) * 100, false) as inflates from events"""


def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    """Failed with an error, partial with anything unread, else complete."""
    d = table(spark, sf, "documents")
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rows = d.join(l, "doc_id", "left").select("doc_id", "source", F.when(F.col("toxic") == 1, "ValueError: toxic").alias("error"), F.array_compact(F.array(F.when(F.col("quality") == 0, "text not read"), F.when(F.length(F.trim("text")) < 20, "no text found"), F.when(F.col("quality").isNull(), "label not read"))).alias("needs"))
    return C.covered(rows).select("doc_id", "status", F.size("unread").alias("unread"))


QUERIES["coverage_status"] = coverage_status
ORACLES["coverage_status"] = """with r as (select d.doc_id, toxic = 1 as err, case when quality = 0 then 1 else 0 end + case when quality is null then 1 else 0 end as needs from documents d left join labels l using (doc_id))
select doc_id, case when err then 'failed' when needs > 0 then 'partial' else 'complete' end as status, (needs + case when err then 1 else 0 end)::int as unread from r"""


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """By source: items, status counts, completeness and the code to exit with."""
    d = table(spark, sf, "documents")
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rows = d.join(l, "doc_id", "left").select("source", F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "missing").otherwise("failed")).when((F.col("doc_id") % 41 == 0), "usage").alias("code"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("needs"))
    return C.summary(rows)


QUERIES["run_summary"] = run_summary
ORACLES["run_summary"] = """with r as (select source, case when toxic = 1 then case when d.doc_id % 2 = 0 then 'missing' else 'failed' end when d.doc_id % 41 = 0 then 'usage' end as code, case when quality = 0 then 1 else 0 end as needs from documents d left join labels l using (doc_id))
select source, count(*) as items, count(code) as errors, count(*) filter (where code is null and needs > 0) as partial, bool_and(code is null and needs = 0) as complete,
 case when bool_or(code = 'missing') then 3 when bool_or(code = 'usage') then 2 when bool_or(code = 'failed') then 1 else 0 end::int as exit_code from r group by source"""


def needs_wording(spark: SparkSession, sf: str) -> DataFrame:
    """What is missing, by source: pages, pictures, recordings."""
    d = table(spark, sf, "documents")
    own = d.groupBy("source").agg(F.array_sort(F.collect_set(F.when(F.col("n_chars") < 1200, F.col("doc_id") % 100))).alias("pages"), F.count_if(F.col("lang") == "de").alias("images"), F.max((F.col("lang") == "es")).alias("media"))
    return own.select("source", F.concat_ws("; ", F.when(F.size("pages") > 0, F.concat(F.lit("pages "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))), F.when(F.col("images") > 0, R.not_read("images", "image")), F.when(F.col("media"), "recording not read")).alias("needs"))


QUERIES["needs_wording"] = needs_wording
ORACLES["needs_wording"] = """with d as (select * from documents),
o as (select source, list_sort(list(distinct doc_id % 100) filter (where n_chars < 1200)) as pages, count(*) filter (where lang = 'de') as images, bool_or(lang = 'es') as media from d group by source)
select source, concat_ws('; ', case when len(pages) > 0 then 'pages ' || array_to_string(pages, ',') end, case when images > 0 then format('{:,}', images) || case when images > 1 then ' images' else ' image' end || ' not read' end, case when media then 'recording not read' end) as needs from o"""


def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """A17 A18 A27 S107: members left out by reason, five names and the count of the others."""
    d = table(spark, sf, "documents").select("source", F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"), F.when(F.col("n_chars") > 6000, "too large").when(F.col("lang") == "fr", "special file").alias("skip"))
    return C.skipped(d.where("skip is not null"), ["source", "skip"], "name")


QUERIES["skip_reasons"] = skip_reasons
ORACLES["skip_reasons"] = """with d as (select source, 'm' || lpad(doc_id::varchar, 8, '0') as name, case when n_chars > 6000 then 'too large' when lang = 'fr' then 'special file' end as skip from documents),
g as (select source, skip, count(*) as n, list_sort(list(name))[1:5] as five from d where skip is not null group by source, skip)
select source, skip, n, array_to_string(five, ', ') || case when n > 5 then ' and ' || (n - 5) || ' more' else '' end as names from g"""


def result_union(spark: SparkSession, sf: str) -> DataFrame:
    """Item rows and details of two kinds as one relation."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    items = d.select(F.lit("text").alias("kind"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("cite"), F.col("n_chars").alias("chars"))
    hidden = d.where("n_chars < 600").select(F.lit("hidden").alias("kind"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("#p1")).alias("cite"), F.lit("short").alias("reason"))
    disputed = e.where("event_id % 100 = 1").select(F.lit("disputed").alias("kind"), F.concat(F.lit("log/"), F.col("event_id").cast("string")).alias("cite"), F.col("value").alias("value"))
    return items.unionByName(hidden, True).unionByName(disputed, True)


QUERIES["result_union"] = result_union
ORACLES["result_union"] = """select 'text' as kind, 'doc/' || doc_id as cite, n_chars as chars, null::varchar as reason, null::double as value from documents
union all select 'hidden', 'doc/' || doc_id || '#p1', null, 'short', null from documents where n_chars < 600 union all select 'disputed', 'log/' || event_id, null, null, value from events where event_id % 100 = 1"""


def dedupe_content(spark: SparkSession, sf: str) -> DataFrame:
    """Work done once for each content and dealt back to every row that has it."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "n_chars")
    once = d.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return d.join(once, "digest").select("doc_id", "digest", "first", "copies")


QUERIES["dedupe_content"] = dedupe_content
ORACLES["dedupe_content"] = "select doc_id, sha256(text) as digest, min(doc_id) over (partition by sha256(text)) as first, count(*) over (partition by sha256(text)) as copies from documents where text is not null"


def cache_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Work that a cache by content, engine and language has, and the rest of it."""
    d = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "lang", "n_chars").dropDuplicates(["digest", "lang"])
    known = table(spark, sf, "documents").where("doc_id % 3 = 0 and lang <> 'en'").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "lang", F.lit(True).alias("cached")).distinct()
    return d.join(known, ["digest", "lang"], "left").groupBy("lang").agg(F.count_if(F.col("cached").isNotNull()).alias("cached"), F.count_if(F.col("cached").isNull()).alias("pending"))


QUERIES["cache_anti_join"] = cache_anti_join
ORACLES["cache_anti_join"] = """with d as (select distinct sha256(text) as digest, lang from documents), k as (select distinct sha256(text) as digest, lang, true as cached from documents where doc_id % 3 = 0 and lang <> 'en')
select lang, count(cached) as cached, count(*) - count(cached) as pending from d left join k using (digest, lang) group by lang"""


def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Characters spent in order of the citations, by root; what is beyond is marked."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "documents").withColumn("spent", F.sum("n_chars").over(w)).select("doc_id", "spent", F.when(F.col("spent") > 40000, "budget").alias("left_out"))


QUERIES["budget_prefix"] = budget_prefix
ORACLES["budget_prefix"] = "with d as (select doc_id, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding)::bigint as spent from documents) select doc_id, spent, case when spent > 40000 then 'budget' end as left_out from d"


def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Take what fits and skip what doesn't, in order, by source."""
    return C.greedy(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 40000)


QUERIES["greedy_budget"] = greedy_budget
ORACLES["greedy_budget"] = """with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as n from documents),
r as (select source, doc_id, n_chars, n, n_chars <= 40000 as taken, 40000 - case when n_chars <= 40000 then n_chars else 0 end as room from d where n = 1
 union all select d.source, d.doc_id, d.n_chars, d.n, d.n_chars <= r.room, r.room - case when d.n_chars <= r.room then d.n_chars else 0 end from r join d on d.source = r.source and d.n = r.n + 1)
select source, doc_id, n_chars, coalesce(taken, false) as taken from r"""


def recognition_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures are read in the order of their citations, by code points, while the budget takes them."""
    d = table(spark, sf, "documents").select("source", F.concat(F.lit("f#img="), F.col("doc_id").cast("string")).alias("cite"), "n_chars")
    return C.greedy(d, "source", "cite", "n_chars", 60000)


QUERIES["recognition_order"] = recognition_order
ORACLES["recognition_order"] = """with recursive d as (select source, 'f#img=' || doc_id as cite, n_chars, row_number() over (partition by source order by 'f#img=' || doc_id) as n from documents),
r as (select source, cite, n_chars, n, n_chars <= 60000 as taken, 60000 - case when n_chars <= 60000 then n_chars else 0 end as room from d where n = 1
 union all select d.source, d.cite, d.n_chars, d.n, d.n_chars <= r.room, r.room - case when d.n_chars <= r.room then d.n_chars else 0 end from r join d on d.source = r.source and d.n = r.n + 1)
select source, cite, n_chars, coalesce(taken, false) as taken from r"""


def scope_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the expected type pass, others are hidden; and if names are unique."""
    e = table(spark, sf, "events").withColumn("v", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count_if(F.col("v").rlike(r"^-?\d+$")).alias("numbers"), F.count_if(F.col("v").isNotNull() & ~F.col("v").rlike(r"^-?\d+$")).alias("others"), (F.count("event_id") == F.count_distinct("event_id")).alias("unique_names"), F.every(F.col("event_type") != "").alias("named"))


QUERIES["scope_whitelist"] = scope_whitelist
ORACLES["scope_whitelist"] = r"""with e as (select *, props->>'$.k' as v from events)
select event_type, count(*) filter (where regexp_matches(v, '^-?\d+$')) as numbers, count(*) filter (where v is not null and not regexp_matches(v, '^-?\d+$')) as others, count(event_id) = count(distinct event_id) as unique_names, bool_and(event_type <> '') as named from e group by event_type"""


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the pages that a range names."""
    return table(spark, sf, "pages").where(S.in_ranges(F.col("page_id") + 1, "1,3-5,20-")).select("page_id")


QUERIES["page_ranges"] = page_ranges
ORACLES["page_ranges"] = "select page_id from pages where page_id + 1 = 1 or page_id + 1 between 3 and 5 or page_id + 1 >= 20"


def sidecar_files(spark: SparkSession, sf: str) -> DataFrame:
    """J10 S127: recordings with the first of their subtitle files, by folder and stem."""
    d = table(spark, sf, "documents")
    rec = d.where("lang = 'en'").select("source", (F.col("doc_id") % 40).alias("stem"), "doc_id")
    subs = d.where("lang <> 'en'").groupBy("source", (F.col("doc_id") % 40).alias("stem")).agg(F.min("doc_id").alias("subtitle"), F.min_by("lang", "doc_id").alias("lang"))
    return rec.join(subs, ["source", "stem"], "left").select("doc_id", "subtitle", "lang", F.when(F.col("subtitle").isNull(), "listen").otherwise("subtitles").alias("job"))


QUERIES["sidecar_files"] = sidecar_files
ORACLES["sidecar_files"] = """with s as (select source, doc_id % 40 as stem, min(doc_id) as subtitle, arg_min(lang, doc_id) as lang from documents where lang <> 'en' group by all)
select r.doc_id, subtitle, s.lang, case when subtitle is null then 'listen' else 'subtitles' end as job from documents r left join s on r.source = s.source and r.doc_id % 40 = s.stem where r.lang = 'en'"""
