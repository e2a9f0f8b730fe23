"""Files in a table: (key, name, content binary) to blocks, to what was left out, and to members."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<place:int,role:string,where:string,text:string>"


def parsed(files: DataFrame, key: str, name: str = "name", content: str = "content") -> DataFrame:
    """(key, kind, blocks, needs, members, error) of each file, by its suffix and its first bytes; no file fails the job.

    A file is parsed where its bytes are; a task holds a batch of files. `members` has the name and bytes of what is inside.
    """

    def run(batches):
        from ..sources.parsers import parse

        for batch in batches:
            # Batches have a number of files at most, whatever their sizes; a few at a time keep what is held near one file.
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                got = [parse(n or "", bytes(c or b"")) for n, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                blocks = [[{"place": k, "role": role, "where": json.dumps(where, ensure_ascii=False), "text": text} for k, (where, text, role) in enumerate(p.blocks)] for p in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([p.kind for p in got], pa.string()), pa.array(blocks, pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string()), ("where", pa.string()), ("text", pa.string())]))), pa.array([p.needs for p in got], pa.list_(pa.string())),
                     pa.array([[{"name": n, "content": c} for n, c in p.children] for p in got], pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())]))), pa.array([p.error for p in got], pa.string())],
                    [key, "kind", "blocks", "needs", "members", "error"],
                )

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, name, F.col(content).cast("binary").alias(content)).mapInArrow(run, f"{key} {kind}, kind string, blocks array<{BLOCK}>, needs array<string>, members array<struct<name:string,content:binary>>, error string")


def shown(rows: DataFrame, key: str) -> DataFrame:
    """One row for each file of `parsed`: its kind, its blocks as one text, what was left out, and the names of its members."""
    text = F.array_join(F.transform("blocks", lambda b: F.concat(b["role"], F.lit(" "), b["where"], F.lit("\n"), b["text"])), "\n~\n")
    return rows.select(key, "kind", text.alias("text"), F.array_join("needs", "; ").alias("needs"), F.array_join(F.transform("members", lambda m: F.concat(m["name"], F.lit(" "), F.octet_length(m["content"]).cast("string"))), "; ").alias("members"), F.coalesce("error", F.lit("")).alias("error"))


def data_uri(uri: Column) -> Column:
    """the bytes of a data URI, base64 or percent-encoded; null for anything else."""
    kind, body = (F.regexp_extract(uri, r"(?s)^data:([^,]*),(.*)$", k) for k in (1, 2))
    is_one = F.startswith(uri, F.lit("data:")) & F.contains(uri, F.lit(","))
    coded = F.rlike(F.lower(kind), F.lit(r";\s*base64\s*$"))
    # A plus sign stays one in a URI, where the function takes it for a blank; a percent sign without two digits stands for itself.
    plain = F.replace(F.regexp_replace(body, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(is_one & coded, F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))).when(is_one, F.encode(F.url_decode(plain), "utf-8"))
