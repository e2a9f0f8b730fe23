"""Links between relations: jobs and outcomes, parts and targets, items and details, pictures and blocks, recordings and
subtitles; and Column functions that the readers of files share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: a language and its three-letter code.
LANGUAGES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "ko": "kor", "ja": "jpn", "zh": "chi_sim"}


def outcomes(jobs: DataFrame, done: DataFrame, item: str, number: str, engines: str = "engines") -> DataFrame:
    """Of each item how many jobs there are, and how many were read, by one engine alone, or by none.

    `done` has the number of engines of a job; of several rows of one job the largest counts.
    """
    own = done.groupBy(item, number).agg(F.max(engines).alias("by"))
    return jobs.select(item, number).join(own, [item, number], "left").groupBy(item).agg(
        F.count(F.lit(1)).alias("jobs"), F.count("by").alias("read"), F.count_if(F.col("by") == 1).alias("unchecked"), F.count_if(F.col("by").isNull()).alias("unread"),
    )


def targets(parts: DataFrame, relations: DataFrame, key: str, target: str = "target", external: str = "external") -> DataFrame:
    """The parts with the target of their relationship; null if it is external or isn't there. A repeated id has its first target by name."""
    inside = relations.where(~F.col(external)).groupBy(key).agg(F.min(target).alias(target))
    return parts.join(inside, key, "left")


def details(items: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The items with n_details and the details' `order` values in their order, null where there are none. Rows are gathered before they are joined."""
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("details"))
    return items.join(own, key, "left").select(*items.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n_details"), "details")


def first_blocks(pictures: DataFrame, blocks: DataFrame, source: list[str], place: str) -> DataFrame:
    """The pictures with `block`, the first place of a block of the same source; nulls in a source are equal."""
    first = blocks.groupBy(*(F.col(s).alias(f"{s}__of") for s in source)).agg(F.min(place).alias("block"))
    same = [F.col(s).eqNullSafe(F.col(f"{s}__of")) for s in source]
    return pictures.join(first, same, "left").select(*pictures.columns, "block")


def asked(readers: DataFrame, remote: str, order: str) -> DataFrame:
    """The readers with `place`, in the order in which they are asked: local ones first, then as named. Readers are a handful."""
    return readers.withColumn("place", F.row_number().over(Window.orderBy(remote, order)).cast("long"))


def shape_order(shapes: DataFrame, page: str, top: str, left: str, tie: str) -> DataFrame:
    """The shapes with `place` on their page, from top to bottom and left to right."""
    return shapes.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(top, left, tie)).cast("long"))


def without_comments(lines: Column, mark: str) -> Column:
    """(kept, comments) of an array of lines: those that don't begin with the mark, and how many do."""
    return F.struct(F.filter(lines, lambda x: ~F.startswith(x, F.lit(mark))).alias("kept"), F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(mark)))).cast("long").alias("comments"))


def odd_characters(text: Column) -> Column:
    """Controls and replacements in a text."""
    return F.length(F.regexp_replace(text, "[^\\x00-\\x08\\x0e-\\x1f\\x7f�]", "")).cast("long")


def readable(text: Column) -> Column:
    """A text is readable if at most one character in a hundred is a control or a replacement."""
    return odd_characters(text) * 100 <= F.length(text)


def values_seen(readings: DataFrame, item: str, text: str, pattern: str) -> DataFrame:
    """(item, found, n): the distinct values that any reader saw of an item, in order."""
    every = readings.select(item, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("value")).distinct()
    return every.groupBy(item).agg(F.array_sort(F.collect_list("value")).alias("found"), F.count(F.lit(1)).alias("n"))


def row_lines(rows: DataFrame, file: str, order: str, breaks: Column, first: int = 2) -> DataFrame:
    """The rows with the physical `line` on which they begin, where fields of those before hold `breaks` line ends; `first` is the first row's."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line", (F.lit(first) + F.coalesce(F.sum(F.coalesce(breaks, F.lit(0)) + 1).over(before), F.lit(0))).cast("long"))


def scaled_box(box: Column, scale: float) -> Column:
    """A box read on a picture scaled by `scale`, in the picture's own units, one decimal, half to even."""
    return F.transform(box, lambda v: F.bround(v / F.lit(float(scale)), 1))


def identity(*parts: Column) -> Column:
    """A digest of all that decides a reading; a null is an empty part."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def reader_language(lang: Column) -> Column:
    """a reader's code of a language; others keep their own."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), lang), lang)


def sticky_note(kind: str, author: Column, text: Column) -> Column:
    """A note as a block; null if it is empty."""
    own = F.trim(text)
    return F.when(own != "", F.concat(F.lit(f"[{kind} by "), F.coalesce(author, F.lit("unknown")), F.lit("] "), own))


def worth_reading(width: Column, height: Column, side: float = 48, area: float = 2500) -> Column:
    """If a picture's smaller side and area are large enough to hold text."""
    return (F.least(width, height) >= side) & (width * height >= area)


def recording_jobs(recordings: DataFrame, files: DataFrame, where: list[str], name: str, cues: str) -> DataFrame:
    """S127 J10 Z35: the recordings with `file`, the first subtitle file of their folder and stem that has cues, and `job`.

    The subtitles' side is reduced to a row a stem before the join, so that no recording multiplies.
    """
    first = files.where(F.col(cues) > 0).groupBy(*where).agg(F.min(name).alias("file"))
    return recordings.join(first, where, "left").select(*recordings.columns, "file", F.when(F.col("file").isNull(), "listen").otherwise("subtitles").alias("job"))


def resource_kind(stated: Column, path: Column) -> Column:
    """A resource's kind: its stated format, else the suffix of its path, else unknown."""
    suffix = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)
    return F.lower(F.coalesce(stated, F.nullif(suffix, F.lit("")), F.lit("unknown")))


def labels(df: DataFrame) -> list[str]:
    """Each column as name (type)."""
    return [f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields]


def squeezed(text: Column) -> Column:
    """runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\u000b]+", " "))
