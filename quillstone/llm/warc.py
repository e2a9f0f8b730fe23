"""WARC archives with a two-level capture index.

Pages become WARC 1.1 records, each a gzip member of its own. Of records with equal payloads the one with the smallest
page_id is a response and the others are revisits, which carry no payload but its digest, its length and the record they
refer to. Tasks write archive files of bounded size to the shared folder, under names of their own; a file counts only if
the committed table of captures names it, so that a task that is run again, or an executor that is lost, leaves nothing
in the result. The captures are sorted by reversed-host URL keys and written as compressed blocks of BLOCK lines, with a
sparse directory of one entry a block, and fences of one entry for each file of the directory, so that a reader holds the
fences and the files of the directory that it is at, never the whole. A lookup finds its blocks by binary search in the
fences and the directory, reads their byte ranges, finds its lines by binary search in the block, and reads the byte ranges
of the records. `captures_of` does so for a table of URLs: keys sorted by range search the directory, then keys meet the
blocks that hold them, so that a key with very many captures is read by as many tasks as it has blocks.

Nulls: a null html is an empty payload, a null url has an empty target. Rows that repeat a page_id with an equal payload
tie: if that page_id is the smallest, each is a response. A null page_id counts as larger than any other. Further columns
are ignored; empty tables give an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_arrow, joined, shared_folder

DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive file; lines of an index block.
FILE_BYTES, BLOCK = 32 << 20, 2000
LEVEL = 5
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: str | None) -> str:
    """Reversed host and the rest: http://www.b.org:80/x?y gives org,b)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"){quote(url or '')}"
    host = re.sub(r"^www\d*\.", "", host.lower())
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else "")
    return f"{quote(name, safe=',:-._[]')}){quote(parts.path or '/', safe='/%:@!$&()*+,;=~-._')}" + (f"?{quote(parts.query, safe='/%:@!$&()*+,;=~-._?')}" if parts.query else "")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, owner: int | None) -> bytes:
    """One record. owner: the page that it revisits; -1, a response. An absent page_id is named null."""
    revisit = owner is not None and owner != -1
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": quote(url or "", safe="/%:@!$&'()*+,;=~-._?#[]"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{owner}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record: page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to, url."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    named = lambda x: None if (n := x.removeprefix("<urn:page:").removesuffix(">")) == "null" else int(n)
    out = {"page_id": named(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "refers_to": None, "payload": None}
    if fields["WARC-Type"] == "revisit":
        out["refers_to"] = named(fields["WARC-Refers-To"])
    else:
        out |= {"payload": payload, "payload_bytes": len(payload)}
        if base32_sha1(payload) != out["payload_digest"]:
            raise ValueError(f"payload of page {out['page_id']} doesn't match its digest")
    return out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return zlib.decompress(handle.read(length), 31)


def roles(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, url, payload, owner): owner is the page to refer to, -1 for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= smallest).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = joined(rows, first, ["digest", "size"], ["first"], pages.count())
    owner = F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), F.lit(-1)).otherwise(F.col("first"))
    return both.select("page_id", "url", "payload", owner.alias("owner"))


def write(pages: DataFrame, folder: str | None = None, smallest: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Writes the archive files, the table of captures, the index blocks and their directory; gives the folder, a URI."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")

    def archive(rows):
        disk, root = opened(folder)
        disk.create_dir(f"{root}/archive", recursive=True)
        handle = name = None
        at = 0
        for batch in rows:
            out = []
            for page_id, url, payload, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if handle is None or at >= file_bytes:
                    if handle is not None:
                        handle.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    handle = disk.open_output_stream(f"{root}/archive/{name}", compression=None)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, owner)) + pack.flush()
                handle.write(data)
                out.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "start", "length"])
        if handle is not None:
            handle.close()

    roles(pages, smallest).mapInArrow(archive, "key string, page_id long, file string, start long, length long").write.parquet(f"{folder}/captures")
    captures = spark.read.parquet(f"{folder}/captures")

    def blocks(rows):
        disk, root = opened(folder)
        disk.create_dir(f"{root}/index", recursive=True)
        name, at, held, entries = f"{uuid.uuid4().hex}.cdx.gz", 0, [], []
        handle = disk.open_output_stream(f"{root}/index/{name}", compression=None)

        def flush():
            nonlocal at, held
            data = zlib.compress("".join(f"{k} {json.dumps(rest)}\n" for k, *rest in held).encode(), 6, 31)
            handle.write(data)
            entries.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
            at, held = at + len(data), []

        for batch in rows:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                if len(held) >= BLOCK:
                    flush()
        if held:
            flush()
        handle.close()
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first_key", "last_key", "file", "start", "length", "lines"])

    directory = captures.repartitionByRange("key", "page_id", "file", "start").sortWithinPartitions("key", "page_id", "file", "start").mapInArrow(blocks, "first_key string, last_key string, file string, start long, length long, lines long")
    directory.write.parquet(f"{folder}/directory")
    told = spark.read.parquet(f"{folder}/directory").groupBy(F.input_file_name().alias("path")).agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    told.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "first_key", "last_key").orderBy("first_key", "last_key").coalesce(1).write.parquet(f"{folder}/fences")
    return folder


class Directory:
    """The sparse directory: the fences are held, its files as they are needed, KEPT at a time."""

    KEPT = 4

    def __init__(self, folder: str):
        self.disk, self.root = opened(folder)
        found = [f for f in self.disk.get_file_info(fs.FileSelector(f"{self.root}/fences")) if f.path.endswith(".parquet")]
        rows = sorted((r["first_key"], r["last_key"], r["file"]) for f in found for r in pq.read_table(self.disk.open_input_file(f.path)).to_pylist())
        self.first, self.last, self.files = ([r[k] for r in rows] for k in range(3))
        self.held: dict[str, tuple[list[str], list[str], list[tuple[str, int, int]]]] = {}

    def part(self, file: str) -> tuple[list[str], list[str], list[tuple[str, int, int]]]:
        if file not in self.held:
            if len(self.held) >= self.KEPT:
                del self.held[next(iter(self.held))]
            rows = sorted((r["first_key"], r["last_key"], r["file"], r["start"], r["length"]) for r in pq.read_table(self.disk.open_input_file(f"{self.root}/directory/{file}")).to_pylist())
            self.held[file] = [r[0] for r in rows], [r[1] for r in rows], [r[2:] for r in rows]
        return self.held[file]

    def blocks(self, key: str) -> list[tuple[str, int, int]]:
        """(file, start, length) of the index blocks that may hold the key: binary search in the fences, then in the directory."""
        found = []
        for file in self.files[bisect_left(self.last, key) : bisect_right(self.first, key)]:
            first, last, entries = self.part(file)
            found += entries[bisect_left(last, key) : bisect_right(first, key)]
        return found

    def lines(self, block: tuple[str, int, int]) -> list[str]:
        with self.disk.open_input_file(f"{self.root}/index/{block[0]}") as handle:
            return read_range(handle, block[1], block[2]).decode().split("\n")[:-1]


def lines_of(lines: list[str], key: str) -> list[tuple]:
    """(key, page_id, file, start, length) of the key's lines in a block, by binary search."""
    found = []
    for line in lines[bisect_left(lines, f"{key} ") :]:
        own, _, rest = line.partition(" ")
        if own != key:
            break
        found.append((key, *json.loads(rest)))
    return found


CAPTURE = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def captures_of(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(key, page_id, file, start, length) of every capture of the urls (url), each once."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    def search(rows):
        directory = Directory(folder)
        for batch in rows:
            out = [(key, *block) for key in batch.column(0).to_pylist() for block in directory.blocks(key)]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "start", "length"])

    def look(rows):
        directory, block, lines = Directory(folder), None, []
        for batch in rows:
            out = []
            for key, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    block, lines = own, directory.lines(tuple(own))
                out += lines_of(lines, key)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), CAPTURE, strict=True)], ["key", "page_id", "file", "start", "length"])

    asked = by_arrow(urls.select("url").distinct(), keys, "key string").distinct()
    found = asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, "key string, file string, start long, length long")
    return found.repartition("file", "start").sortWithinPartitions("file", "start", "key").mapInArrow(look, "key string, page_id long, file string, start long, length long")


def index_lines(folder: str, entries: DataFrame) -> DataFrame:
    """The capture lines of blocks: entries are rows of the directory."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        disk, root = opened(folder)
        out = []
        for name, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with disk.open_input_file(f"{root}/index/{name}") as handle:
                for line in read_range(handle, start, length).decode().split("\n")[:-1]:
                    key, _, rest = line.partition(" ")
                    out.append((key, *json.loads(rest)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "start", "length"])

    return by_arrow(entries.select("file", "start", "length"), work, "key string, page_id long, file string, start long, length long")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record, by way of the index: directory, blocks, byte ranges of the archive files."""
    return records(spark, folder, index_lines(folder, spark.read.parquet(f"{folder}/directory")), payloads)


def records(spark: SparkSession, folder: str, lines: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of capture lines (file, start, length), read by byte ranges."""
    # A file's captures go to one task in the order of their bytes; files have a bounded size. The number of tasks is given,
    # as the lines are so much smaller than the records that they would be gathered in a few otherwise.
    files = spark.read.parquet(f"{folder}/captures").select("file").distinct().count()
    spread = lines.repartition(max(1, files), "file").sortWithinPartitions("file", "start").select("file", "start", "length")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(rows):
        disk, root = opened(folder)
        handle = name = None
        for batch in rows:
            files, starts, lengths = (c.to_pylist() for c in batch.columns)
            for at in range(0, batch.num_rows, 500):
                out = []
                for file, start, length in zip(files[at : at + 500], starts[at : at + 500], lengths[at : at + 500], strict=True):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        handle, name = disk.open_input_file(f"{root}/archive/{file}"), file
                    out.append(parse(read_range(handle, start, length)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=False)], names)
        if handle is not None:
            handle.close()

    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


class Lookup:
    """Point reads from one process."""

    def __init__(self, spark: SparkSession, folder: str):
        self.directory = Directory(folder)
        self.blocks_read = 0

    def get(self, url: str) -> list[dict]:
        found, key = [], url_key(url)
        for block in self.directory.blocks(key):
            self.blocks_read += 1
            for _, _, file, start, length in lines_of(self.directory.lines(block), key):
                with self.directory.disk.open_input_file(f"{self.directory.root}/archive/{file}") as handle:
                    found.append(parse(read_range(handle, start, length)))
        return found


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page: archived, its URL looked up in the index, read back."""
    folder = write(pages)
    spark = pages.sparkSession
    return records(spark, folder, captures_of(spark, folder, pages.select(F.col("url").cast("string").alias("url"))), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
v as (select *, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(0, 5), lambda k: (instr('0123456789abcdef', substr(h, i*5+k+1, 1)) - 1) * (16 ** (4 - k))::bigint))::bigint) as g from p),
f as (select *, min(page_id) over (partition by h) as first from v)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from f
"""
