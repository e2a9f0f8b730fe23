"""read(): files to items, cited blocks, coverage; and the sinks of a run.

Local paths are listed on the driver; URIs in workers, a folder a row, level by level, so that no list of files is held. Bytes are parsed in Python workers, a file a row; members of containers are parsed in turn, three
levels deep at most. Citations, coverage and everything relational are Column expressions over what the parsers give.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render as R
from .plugins import Registry

DEPTH = 3
SRC = "path string, parts array<string>, anchor string, section int, page int, slide int, frame int, sheet string, cell string, para int, ts string, img int, bbox array<double>, unit string, t array<double>, line int"
BLOCK = f"pos int, src struct<{SRC.replace(' ', ':').replace(',:', ',')}>, text string, role string"
FIELDS = [p.split(":")[0] for p in SRC.replace(" ", ":").replace(",:", ",").split(",")]
_BLOCKS = f"array<struct<{BLOCK.replace('struct<', chr(1)).replace(' ', ':').replace(',:', ',').replace(chr(1), 'struct<')}>>"
PARSED = f"path string, parts array<string>, digest string, kind string, needs array<string>, error string, blocks {_BLOCKS}, children array<struct<name:string,content:binary>>"


@dataclass
class Options:
    """What a run is asked for. Layers are merged by `settings`."""

    suffixes: tuple[str, ...] = ()
    content: bool = True
    shallow: bool = False
    depth: int = DEPTH
    claims: tuple[str, ...] = field(default_factory=tuple)
    registry: Registry | None = None


def settings(*layers: dict) -> dict:
    """Nested maps merged, later layers over earlier; a value keeps the type of the first layer that has it."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = settings(out[k], v)
            elif k in out and isinstance(v, str) and not isinstance(out[k], str) and out[k] is not None:
                kind = type(out[k])
                out[k] = v.strip().lower() in ("1", "true", "yes", "on") if kind is bool else v.split(",") if kind is list else kind(v)
            else:
                out[k] = v
    return out


def list_files(paths: list[str], suffixes: tuple[str, ...] = ()) -> list[str]:
    """Files under the paths in the order of their parts; hidden names are left out, a missing path raises."""
    out: list[str] = []
    for raw in paths:
        root = Path(raw)
        if not root.exists():
            raise FileNotFoundError(raw)
        if root.is_file():
            out.append(str(root))
            continue
        found = []
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            found += [Path(folder, n) for n in names if not n.startswith(".") and (not suffixes or n.lower().endswith(suffixes))]
        out += [str(p) for p in sorted(found, key=lambda p: p.parts)]
    return list(dict.fromkeys(out))


def common_root(paths: list[str]) -> str:
    """A25."""
    folders = [p if os.path.isdir(p) else os.path.dirname(p) for p in map(os.path.abspath, paths)]
    return os.path.commonpath(folders) if folders else ""


def claims_of(folder: str, data: bytes) -> set[str]:
    """Files inside the folder of a descriptor that it names; none where it isn't one."""
    out: set[str] = set()
    with contextlib.suppress(ValueError, AttributeError, TypeError):
        for r in json.loads(data.decode("utf-8-sig")).get("resources", []):
            for q in [r["path"]] if isinstance(r.get("path"), str) else r.get("path") or []:
                inner = os.path.normpath(q)
                if not os.path.isabs(inner) and inner.split(os.sep)[0] not in ("", ".", ".."):
                    out.add(f"{folder}/{inner}")
    return out


def claimed(paths: list[str], named: set[str]) -> list[str]:
    """Files that a data package claims are left to it, unless they were named."""
    gone: set[str] = set()
    for p in paths:
        if os.path.basename(p) == "datapackage.json":
            with contextlib.suppress(OSError):
                gone |= claims_of(os.path.dirname(p), Path(p).read_bytes())
    return [p for p in paths if p not in gone or p in named]


def parsed(items: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Rows of PARSED from items (path, parts, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from .sources.parsers import parse

        for pdf in frames:
            for path, parts, content in zip(pdf["path"], pdf["parts"], pdf["content"], strict=True):
                parts, content = [str(p) for p in parts] if parts is not None else [], bytes(content or b"")
                got = parse(parts[-1] if parts else os.path.basename(path), content, registry)
                blocks = []
                for n, (where, text, role) in enumerate(got.blocks):
                    src = dict.fromkeys(FIELDS) | {"path": path} | where
                    src["parts"] = [*parts, *where.get("parts", [])]
                    blocks.append({"pos": n, "src": src, "text": text, "role": role})
                row = {"path": path, "parts": parts, "digest": hashlib.sha256(content).hexdigest(), "kind": got.kind, "needs": got.needs, "error": got.error, "blocks": blocks, "children": [{"name": n, "content": c} for n, c in got.children]}
                yield pd.DataFrame([row])

    return items.select("path", "parts", "content").mapInPandas(run, PARSED)


def located(uri: str):
    """A file system, the name in it, and what goes before such names in a URI."""
    from pyarrow import fs

    uri = uri.rstrip("/")
    disk, name = fs.FileSystem.from_uri(uri)
    return disk, name, urllib.parse.unquote(uri).removesuffix(name)


def listed(spark: SparkSession, uris: list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path) of the files under URIs, as URIs. Hidden names and, unless they were named, what a data package claims are left out; a missing URI raises."""
    from pyarrow import fs

    for uri in uris:
        disk, name, _ = located(uri)
        if disk.get_file_info(name).type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            for uri in pdf["path"]:
                disk, name, before = located(uri)
                own = disk.get_file_info(name)
                if own.type == fs.FileType.File:
                    yield pd.DataFrame([{"path": uri, "folder": False}])
                    continue
                found = [f for f in disk.get_file_info(fs.FileSelector(name)) if not f.base_name.startswith(".")]
                rows = [{"path": before + urllib.parse.quote(f.path), "folder": f.type == fs.FileType.Directory} for f in found if f.type == fs.FileType.Directory or not suffixes or f.base_name.lower().endswith(suffixes)]
                yield pd.DataFrame(rows, columns=["path", "folder"])

    def claims(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                own = claims_of(urllib.parse.unquote(path).rpartition("/")[0], bytes(content or b""))
                yield pd.DataFrame({"plain": sorted(own)}, columns=["plain"])

    named = spark.createDataFrame([(u.rstrip("/"),) for u in dict.fromkeys(uris)], "path string")
    folders, files = named, None
    while True:
        level = folders.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInPandas(look, "path string, folder boolean").persist()
        files = level.where("not folder") if files is None else files.unionByName(level.where("not folder"))
        folders = level.where("folder").select("path")
        if not folders.limit(1).count():
            break
    files = files.select("path").distinct()
    gone = contents(files.where("path like '%/datapackage.json'")).select("path", "content").mapInPandas(claims, "plain string").distinct()
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    left = files.withColumn("plain", plain).join(gone, "plain", "left_anti").select("path")
    return left.unionByName(files.join(named, "path", "left_semi")).distinct()


def opened(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, parts, content) of local files."""
    rows = spark.createDataFrame([(os.path.abspath(f),) for f in files], "path string")
    return contents(rows.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))))


def contents(files: DataFrame) -> DataFrame:
    """(path, parts, content) of files (path), opened in the workers: Spark's own file source leaves out empty files and names
    that begin with an underscore, which are inputs here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            for path in pdf["path"]:
                disk, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with disk.open_input_stream(name, compression=None) as f:
                    yield pd.DataFrame([{"path": path, "parts": [], "content": f.read()}])

    return files.select("path").mapInPandas(run, "path string, parts array<string>, content binary")


@dataclass
class Run:
    """What a run found. items: a row each input and member; blocks: ordered, cited text."""

    items: DataFrame
    blocks: DataFrame
    held: list[DataFrame]

    def coverage(self) -> DataFrame:
        """(cite, kind, chars, status, unread)."""
        unread = F.array_compact(F.concat(F.filter("needs", lambda n: n != "no text found"), F.array("error")))
        out = self.items.withColumn("unread", unread)
        return out.select("cite", "kind", "chars", F.when(F.col("error").isNotNull(), "failed").when(F.size("unread") > 0, "partial").otherwise("complete").alias("status"), "unread", "needs", "digest")

    def summary(self) -> dict:
        """A10 A14 A15."""
        rows = self.coverage().groupBy("status").count().collect()
        by = {r["status"]: r["count"] for r in rows}
        return {"items": sum(by.values()), "errors": by.get("failed", 0), "partial": by.get("partial", 0), "complete": set(by) <= {"complete"}, "exit_code": 1 if by.get("failed") else 0}

    def write_markdown(self, folder: str) -> None:
        """One file an item: its citation, and each block under its own."""
        rows = self.blocks.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cite", "text"))), lambda b: F.concat(F.lit("## "), b["cite"], F.lit("\n\n"), b["text"], F.lit("\n"))), "\n").alias("body"))
        own = self.items.join(rows, self.items["cite"] == rows["item"], "left").select("cite", "body", "needs")
        os.makedirs(folder, exist_ok=True)

        def write(rows) -> None:
            import hashlib
            import re

            for r in rows:
                name = re.sub(r"[^\w.\-]+", "_", r["cite"])[-120:] + "-" + hashlib.sha256(r["cite"].encode()).hexdigest()[:8] + ".md"
                tail = "".join(f"<!-- needs: {n} -->\n" for n in r["needs"] or [])
                temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                Path(temporary).write_text(f"<!-- source: {r['cite']} -->\n\n{r['body'] or ''}\n{tail}", "utf-8")
                os.replace(temporary, os.path.join(folder, name))

        own.foreachPartition(write)

    def write_index(self, path: str) -> None:
        """The rows of the run as JSON lines in the order of their citations, put in place at once."""
        lines = self.coverage().orderBy("cite").select(F.to_json(F.struct("cite", "kind", "chars", "status", "unread", "needs", "digest")).alias("l"))
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            for r in lines.toLocalIterator():
                f.write(r["l"] + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)

    def write_tables(self, folder: str) -> None:
        """Items, blocks and coverage as Parquet under a path or URI, each written by the workers; for runs whose rows don't fit on one machine."""
        for name, rows in (("items", self.items), ("blocks", self.blocks), ("coverage", self.coverage())):
            rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    def documents(self) -> DataFrame:
        """A document for each citation, for connectors; metadata blocks are left out."""
        body = self.blocks.where("role <> 'metadata'").groupBy("cite").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "pos", "text"))), lambda b: b["text"]), "\n\n").alias("content"))
        return body.select(F.sha2(F.col("cite").cast("binary"), 256).alias("doc_key"), "content", F.struct(F.col("cite").alias("evidence")).alias("metadata"), F.sha2(F.col("content").cast("binary"), 256).alias("content_digest"))

    def close(self) -> None:
        for h in self.held:
            h.unpersist()


def read(spark: SparkSession, *paths: str, options: Options | None = None) -> Run:
    """Files and folders, local ones or URIs, to a Run."""
    o = options or Options()
    far = [p for p in paths if "://" in p]
    near = [p for p in paths if "://" not in p]
    named = {str(Path(p)) for p in near if os.path.isfile(p)}
    level = opened(spark, claimed(list_files(near, o.suffixes), named))
    if far:
        level = level.unionByName(contents(listed(spark, far, o.suffixes)))
    every, held = None, []
    for depth in range(o.depth + 1):
        own = parsed(level, o.registry).persist()
        held.append(own)
        every = own.drop("children") if every is None else every.unionByName(own.drop("children"))
        if depth == o.depth or o.shallow:
            break
        inner = own.select("path", "parts", F.explode("children").alias("c"))
        if not inner.limit(1).count():
            break
        level = inner.select("path", F.concat("parts", F.array("c.name")).alias("parts"), F.col("c.content").alias("content"))
    root = F.concat("path", F.array_join(F.transform("parts", lambda p: F.concat(F.lit("#att="), p)), ""))
    items = every.withColumns({"cite": root, "chars": F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))})
    blocks = items.select(F.col("cite").alias("item"), F.explode("blocks").alias("b")).select("item", F.col("b.pos").alias("pos"), F.col("b.src").alias("src"), R.cite(F.col("b.src")).alias("cite"), F.col("b.text").alias("text"), F.col("b.role").alias("role"))
    return Run(items.drop("blocks"), blocks, held)


@contextlib.contextmanager
def exclusive(folder: str):
    """One run at a time writes to a folder."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, ".lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise RuntimeError(f"another run writes to {folder}") from None
        yield
