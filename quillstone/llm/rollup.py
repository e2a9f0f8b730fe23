"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive: a batch of signed changes (an insert counts +1 and its
tokens, a delete the same with -1, a revised count is a delete and an insert) is summed by these keys, first within each
task, and only the sums are kept. A batch is committed by one exclusive creation of a marker that names the folder of its
sums. A batch that is sent again finds its marker and changes nothing; one whose driver died before the marker was filled
leaves sums that no marker names, and can be sent again. Totals are the sum over the committed batches, so that no batch
rereads the corpus; `compact` folds the sums of all batches into one folder, which a marker of its own commits, so that
totals don't slow down with the number of batches. Markers of batches stay, so that what was folded is still known.

Nulls: a null source, language or doc_id is a value like any other; a null text has no tokens and counts as a document. A
text's copies are those with a doc_id over the smallest; one with a null doc_id is never a copy.
Rows repeated count as often as they come. Other columns are ignored. Keys whose documents and tokens are all taken back
leave the totals.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import joined, shared_folder, stored

KEYS = ["source", "lang", "tokenizer"]
KINDS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer version: the pattern of its tokens.
TOKENIZERS = {"words/1": r"[^\x20\x09-\x0D]+", "wordpieces/2": r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"}


def tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


class Rollup:
    """Totals in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "rollup")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self, kind: str) -> dict[str, str]:
        """Name and content of each marker that was filled."""
        path, disk = self._path(kind)
        out = {}
        for status in disk.listStatus(path) if disk.exists(path) else []:
            name = status.getPath().getName()
            if name.startswith((".", "_")) or not status.getLen():
                continue
            stream = disk.open(status.getPath())
            out[bytes.fromhex(name).decode()] = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return out

    def _mark(self, kind: str, name: str, content: str) -> bool:
        """Creates a marker; False if another was first."""
        marker, disk = self._path(kind, name.encode().hex())
        if disk.exists(marker) and not disk.getFileStatus(marker).getLen():
            disk.delete(marker, False)  # of a driver that was lost between making and filling it
        try:
            stream = disk.create(marker, False)
        except Exception as taken:
            if "exists" not in str(taken) and "AlreadyExists" not in str(taken):
                raise
            return False
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    def committed(self) -> dict[str, str]:
        """The folder of the sums of each committed batch."""
        return self._markers("commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (source, lang, tokenizer, sign, tokens); False if it was committed before."""
        if batch in self.committed():
            return False
        attempt = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        sums.write.parquet(f"{self.folder}/sums/{attempt}")
        return self._mark("commits", batch, attempt)

    def _parts(self) -> tuple[list[str], list[str]]:
        """The folders of sums that make the totals, and those of the batches that they cover."""
        every = sorted(self.committed().values())
        folded = [json.loads(x) for x in self._markers("compactions").values()]
        best = max(folded, key=lambda x: (len(x["covers"]), x["sums"]), default={"sums": None, "covers": []})
        known = set(best["covers"])
        return [x for x in [best["sums"], *(e for e in every if e not in known)] if x], every

    def compact(self) -> bool:
        """Folds the sums of all committed batches into one folder; False if there is nothing to fold."""
        parts, covers = self._parts()
        if len(parts) < 2:
            return False
        attempt = uuid.uuid4().hex
        self.totals(parts).write.parquet(f"{self.folder}/sums/{attempt}")
        return self._mark("compactions", attempt, json.dumps({"sums": attempt, "covers": covers}))

    def totals(self, parts: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches."""
        paths = [f"{self.folder}/sums/{a}" for a in (self._parts()[0] if parts is None else parts)]
        sums = self.spark.read.schema(KINDS).parquet(*paths) if paths else self.spark.createDataFrame([], KINDS)
        return sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def signed(rows: DataFrame, sign: int, count: str, tokenizer: str) -> DataFrame:
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"), F.col(count).alias("tokens"))


def counted(docs: DataFrame) -> DataFrame:
    """What the batches need of each document: its counts, its count without repeated lines, a digest of its text."""
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    one, two = TOKENIZERS
    return stored(
        docs.select("doc_id", "source", "lang", tokens(F.col("text"), one).alias("one"), tokens(F.col("text"), two).alias("two"), tokens(lines, one).alias("revised"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")),
        "counts",
    )


def maintained(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The totals after five batches over all documents: inserts under either tokenizer, counts revised to leave out
    repeated lines, deletes of later copies of a text, and a batch that is sent twice."""
    one, two = TOKENIZERS
    rows = counted(docs)
    rollup = Rollup(docs.sparkSession, folder)
    rollup.commit("insert words", signed(rows, 1, "one", one))
    rollup.commit("insert wordpieces", signed(rows, 1, "two", two))
    other = rows.where("revised <> one")
    revised = signed(other, -1, "one", one).union(signed(other, 1, "revised", one))
    rollup.commit("revise words", revised)
    rollup.commit("revise words", revised)
    first = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = joined(rows, first, ["digest"], ["first"], rows.count()).where("doc_id > first")
    rollup.commit("delete copies", signed(copies, -1, "revised", one).union(signed(copies, -1, "two", two)))
    rollup.compact()
    return rollup.totals()


ORACLE = r"""
with d as (select *, min(doc_id) over (partition by text) as first from documents),
k as (select * from d where text is null or doc_id is null or doc_id = first),
u as (select source, lang, text, string_split(text, chr(10)) as a from k),
c as (select source, lang,
  coalesce(len(regexp_extract_all(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: list_position(a, a[i]) = i), lambda i: a[i]), chr(10)), '[^\x20\x09-\x0D]+')), 0) as one,
  coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]')), 0) as two from u)
select source, lang, 'words/1' as tokenizer, count(*)::bigint as n_docs, sum(one)::bigint as n_tokens from c group by all
union all select source, lang, 'wordpieces/2', count(*)::bigint, sum(two)::bigint from c group by all
"""
