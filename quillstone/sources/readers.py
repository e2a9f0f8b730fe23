"""Python data sources: Arrow IPC, SQLite, mbox and archives as tables, a partition a file (or a part of one)."""

from __future__ import annotations

import sqlite3
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from .parsers import mbox, parse


def _paths(options: dict) -> list[str]:
    raw = options.get("path") or ""
    found = []
    for p in raw.split(","):
        path = Path(p.removeprefix("file://"))
        found += sorted(str(x) for x in path.rglob("*") if x.is_file() and not x.name.startswith(".")) if path.is_dir() else [str(path)]
    return found


class ArrowIpc(DataSource):
    """IPC files and streams; a partition for each record batch of a file, one for a stream."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        return from_arrow_schema(_schema(_paths(self.options)[0]))

    def reader(self, schema):
        return ArrowReader(self.options)


def _schema(path: str) -> pa.Schema:
    with pa.memory_map(path) as f:
        try:
            return pa.ipc.open_file(f).schema
        except pa.ArrowInvalid:
            f.seek(0)
            return pa.ipc.open_stream(f).schema


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _paths(options)

    def partitions(self):
        out = []
        for p in self.paths:
            with pa.memory_map(p) as f:
                try:
                    out += [InputPartition((p, n)) for n in range(pa.ipc.open_file(f).num_record_batches)]
                except pa.ArrowInvalid:
                    out.append(InputPartition((p, None)))
        return out or [InputPartition((None, None))]

    def read(self, partition):
        path, n = partition.value
        if path is None:
            return
        with pa.memory_map(path) as f:
            if n is not None:
                batch = pa.ipc.open_file(f).get_batch(n)
                batch.validate(full=True)
                yield batch
                return
            reader = pa.ipc.open_stream(f)
            while True:
                try:
                    batch = reader.read_next_batch()
                except (StopIteration, pa.ArrowInvalid, OSError):
                    return  # R03: what came whole stays
                batch.validate(full=True)
                yield batch


class Sqlite(DataSource):
    """A table of an SQLite file by ranges of its rowid; option table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self):
        con = sqlite3.connect(f"file:{_paths(self.options)[0]}?mode=ro&immutable=1", uri=True)
        kinds = {"INT": "long", "REA": "double", "FLO": "double", "DOU": "double", "BLO": "binary"}
        columns = con.execute(f"pragma table_info({self.options['table']})").fetchall()
        con.close()
        return ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper()[:3], 'string')}" for c in columns)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.step = _paths(options)[0], options["table"], int(options.get("rows", 100_000))
        self.kinds = [f.dataType.simpleString() for f in schema.fields]

    def partitions(self):
        con = sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)
        try:
            low, high = con.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
        except sqlite3.OperationalError:
            return [InputPartition(None)]
        finally:
            con.close()
        return [InputPartition((a, min(a + self.step - 1, high))) for a in range(low, high + 1, self.step)] if low is not None else [InputPartition(None)]

    def read(self, partition):
        con = sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        where = f" where rowid between {partition.value[0]} and {partition.value[1]}" if partition.value else ""
        fit = {"bigint": lambda v: v if isinstance(v, int) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None, "binary": lambda v: v if isinstance(v, bytes) else None, "string": lambda v: v if isinstance(v, str) else str(v)}
        for row in con.execute(f"select * from {self.table}{where}"):
            yield tuple(None if v is None else fit[k](v) for v, k in zip(row, self.kinds, strict=True))
        con.close()


class Members(DataSource):
    """S100: members of archives: (archive, member, content); a partition an archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self):
        return "archive string, member string, content binary"

    def reader(self, schema):
        return MembersReader(self.options)


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _paths(options)

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for name, body in parse(Path(partition.value).name, Path(partition.value).read_bytes()).children:
                yield partition.value, name, body


class Mbox(DataSource):
    """Messages of mbox files: (file, n, message)."""

    @classmethod
    def name(cls) -> str:
        return "mbox_messages"

    def schema(self):
        return "file string, n int, message binary"

    def reader(self, schema):
        return MboxReader(self.options)


class MboxReader(MembersReader):
    def read(self, partition):
        if partition.value is not None:
            for n, (_, body) in enumerate(mbox(partition.value, Path(partition.value).read_bytes()).children, 1):
                yield partition.value, n, body


def register(spark: SparkSession) -> None:
    for source in (ArrowIpc, Sqlite, Members, Mbox):
        spark.dataSource.register(source)
