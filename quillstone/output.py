"""What a run prints and hands on: terminal tables, envelopes, JSON lines, members as files."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reader import Run

CELL = 80
#: Exit codes: all well; something failed; the command was wrong; an input is missing.
OK, FAILED, USAGE, MISSING = 0, 1, 2, 3


def width(text: str) -> int:
    """columns that a text takes on a terminal."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def fitted(value, most: int = CELL) -> str:
    """one line, cut to `most` columns."""
    text = "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)
    text = re.sub(r"\s+", " ", text).strip()
    if width(text) <= most:
        return text
    out, left = [], most - 3
    for c in text:
        left -= width(c)
        if left < 0:
            break
        out.append(c)
    return "".join(out) + "..."


def table(rows: list[dict], most: int | None = None) -> str:
    """Rows under their names; past `most` a line says how many more there are."""
    if not rows:
        return "(no rows)"
    names = list(dict.fromkeys(k for r in rows for k in r))
    shown = [[fitted(r.get(n)) for n in names] for r in rows[:most]]
    wide = [max(width(n), *(width(r[k]) for r in shown)) for k, n in enumerate(names)]
    line = lambda r: "  ".join(c + " " * (w - width(c)) for c, w in zip(r, wide, strict=True)).rstrip()
    out = [line(names), line(["-" * w for w in wide]), *map(line, shown)]
    if most is not None and len(rows) > most:
        out.append(f"... {len(rows) - most:,} more rows")
    return "\n".join(out)


def compact(value):
    """Without what is None or empty, on every level."""
    if isinstance(value, dict):
        return {k: c for k, v in value.items() if (c := compact(v)) is not None and c != [] and c != {}}
    return [compact(v) for v in value] if isinstance(value, (list, tuple)) else value


def exit_code(run: Run, missing: list[str] = (), usage: str | None = None) -> int:
    """What is missing comes before what was asked wrongly, and that before what failed."""
    return MISSING if missing else USAGE if usage else run.summary()["exit_code"]


def rows_of(run: Run, content: bool = False, most: int | None = None) -> list[dict]:
    """The rows of a run in the order of their citations (O01); content adds blocks. `most` bounds what the driver takes."""
    out = run.coverage()
    if content:
        blocks = run.blocks.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cite", "text", "role"))), lambda b: F.struct(b["cite"].alias("cite"), b["text"].alias("text"), F.when(b["role"] != "body", b["role"]).alias("role"))).alias("content"))
        out = out.join(blocks, out["cite"] == blocks["item"], "left").drop("item")
    ordered = out.orderBy("cite")
    return [compact(r.asDict(recursive=True)) for r in (ordered.limit(most) if most is not None else ordered).toLocalIterator()]


def envelope(run: Run, content: bool = False) -> dict:
    """The summary and the rows as one value."""
    return {"schema": "quillstone/1", "summary": run.summary(), "rows": rows_of(run, content)}


def emitted(run: Run, as_json: bool = False, content: bool = False, most: int = 50) -> str:
    """JSON, or a table of at most `most` rows and how to see more."""
    if as_json:
        return json.dumps(envelope(run, content), ensure_ascii=False, indent=2)
    summary = run.summary()
    rows = [{k: r.get(k) for k in ("cite", "kind", "chars", "status", "unread")} for r in rows_of(run, most=most)]
    tail = [f"... {summary['items'] - most:,} more rows (--json shows all)"] if summary["items"] > most else []
    return "\n".join([table(rows), *tail, f"{summary['items']:,} items, {summary['errors']:,} failed, {summary['partial']:,} partial"])


def append_lines(df: DataFrame, folder: str) -> None:
    """Rows as more JSON lines of a folder."""
    df.write.mode("append").json(folder)


def write_members(members: DataFrame, folder: str) -> DataFrame:
    """Members (path, name, content) as files, named by the workers; (path, name, file, bytes).

    A name is safe for a file, and unique by the digest of the member's path and content, so that tasks need not agree.
    """

    def run(frames):
        import hashlib

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for pdf in frames:
            rows = []
            for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                body = bytes(content or b"")
                stem, dot, suffix = re.sub(r"[^\w.\-]+", "_", name.rpartition("/")[2])[-80:].rpartition(".")
                mark = hashlib.sha256(f"{path}\0{name}\0".encode() + body).hexdigest()[:8]
                file = f"{stem or suffix}-{mark}" + (f".{suffix}" if dot and stem else "")
                temporary = os.path.join(folder, f".{file}.{uuid.uuid4().hex}")
                Path(temporary).write_bytes(body)
                os.replace(temporary, os.path.join(folder, file))
                rows.append((path, name, os.path.join(folder, file), len(body)))
            yield pd.DataFrame(rows, columns=["path", "name", "file", "bytes"])

    return members.select("path", "name", "content").mapInPandas(run, "path string, name string, file string, bytes long")


def password(given: str | None = None, file: str | None = None, variable: str = "QUILLSTONE_PASSWORD") -> str | None:
    """A file's first line, else what was given, else the environment's."""
    if file:
        return Path(file).read_text("utf-8-sig").split("\n", 1)[0].rstrip("\r")
    return given if given is not None else os.environ.get(variable)
