"""Parsers, content rules, seals and readers that a user adds.

A plug-in is named as "module:function", so that workers import it themselves and nothing is pickled. What is registered
travels to the workers with the options of a run.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def resolved(target: str | Callable) -> Callable:
    """X01: "module:function" to the function."""
    if callable(target):
        return target
    module, _, name = target.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Registry:
    """Suffix: parser; ordered rules (predicate, parser, over); seals. over: suffixes that the rule may take;
    None, only names without a known one."""

    suffixes: dict[str, str] = field(default_factory=dict)
    rules: list[tuple[str, str, tuple[str, ...] | None]] = field(default_factory=list)
    seals: list[str] = field(default_factory=list)

    def suffix(self, target: str, *suffixes: str) -> None:
        self.suffixes |= {s.casefold(): target for s in suffixes}

    def rule(self, predicate: str, target: str, over: tuple[str, ...] | None = None) -> None:
        self.rules.append((predicate, target, over))

    def seal(self, predicate: str) -> None:
        self.seals.append(predicate)

    def pick(self, name: str, data: bytes, known: bool) -> Callable | None:
        """The parser that a registered rule or suffix gives; `known` tells if the engine has one for the suffix."""
        low = name.casefold()
        for predicate, target, over in self.rules:
            if (not known if over is None else low.endswith(over)) and resolved(predicate)(name, data[:8192]):
                return resolved(target)
        best = max((s for s in self.suffixes if low.endswith(s)), key=len, default=None)
        return resolved(self.suffixes[best]) if best else None

    def locked(self, name: str, data: bytes) -> bool:
        return any(resolved(s)(name, data) for s in self.seals)


@dataclass(frozen=True)
class Reader:
    """A picture or speech reader. kind: local, served (by the user's own machine) or paid; call: bytes to rows."""

    name: str
    kind: str
    target: str
    version: str = "1"

    def identity(self, **settings) -> str:
        """a digest of what decides a reading."""
        return hashlib.sha256("\n".join([self.name, self.kind, self.version, json.dumps(settings, sort_keys=True)]).encode()).hexdigest()


def chosen(readers: list[Reader], asked: list[str] | None = None) -> list[Reader]:
    """All that cost nothing, local ones first; those that are paid only when named, and in the order named."""
    if asked:
        by = {r.name: r for r in readers}
        if missing := [a for a in asked if a not in by]:
            raise ValueError(f"no reader named {', '.join(missing)}")
        return [by[a] for a in asked]
    return sorted((r for r in readers if r.kind != "paid"), key=lambda r: r.kind != "local")


def external_readings(spark: SparkSession, *named: str) -> DataFrame:
    """NAME=FILE: the lines of a file as one more reader's boxes (engine, box_no, text, bbox)."""
    rows = []
    for n in named:
        name, eq, path = n.partition("=")
        if not eq or not name or not path:
            raise ValueError(f"{n}: NAME=FILE is wanted")
        rows += [(name, k, t, None) for k, t in enumerate(Path(path).read_text("utf-8-sig").splitlines()) if t.strip()]
    return spark.createDataFrame(rows, "engine string, box_no bigint, text string, bbox array<double>")


def read_pictures(items: DataFrame, readers: list[Reader]) -> DataFrame:
    """(item, engine, box_no, text, bbox, error): every reader over every item (item, content).

    A reader's target takes bytes and gives (text, bbox) rows; one that fails leaves an error row and the others go on.
    """

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for item, content in zip(pdf["item"], pdf["content"], strict=True):
                rows = []
                for r in readers:
                    try:
                        rows += [(item, r.name, n, t, box, None) for n, (t, box) in enumerate(resolved(r.target)(bytes(content)))]
                    except Exception as e:
                        rows.append((item, r.name, 0, None, None, f"{type(e).__name__}: {e}"[:300]))
                yield pd.DataFrame(rows, columns=["item", "engine", "box_no", "text", "bbox", "error"])

    return items.select("item", "content").mapInPandas(run, f"item {items.schema['item'].dataType.simpleString()}, engine string, box_no long, text string, bbox array<double>, error string")
