"""Python -m quillstone read PATH... | doctor. Exit codes: 0 well, 1 something failed, 2 usage, 3 an input is missing."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import shutil
import sys

from . import output
from .reader import Options, exclusive, read


def capabilities() -> list[dict]:
    """What this machine has, and what it is for."""
    libraries = {"pyspark": "the engine", "pyarrow": "Arrow and Parquet", "pandas": "workers", "numpy": "operators on arrays", "duckdb": "tests", "tiktoken": "tests", "sentencepiece": "fertility rules", "xxhash": "fingerprints"}
    tools = {"java": "the engine", "ffmpeg": "recordings (optional)", "7z": "7z archives (optional)"}
    rows = [{"name": n, "kind": "library", "found": importlib.util.find_spec(n) is not None, "for": why} for n, why in libraries.items()]
    return rows + [{"name": n, "kind": "tool", "found": shutil.which(n) is not None, "for": why} for n, why in tools.items()]


def arguments() -> argparse.ArgumentParser:
    """The flags of a run."""
    p = argparse.ArgumentParser(prog="quillstone")
    commands = p.add_subparsers(dest="command", required=True)
    r = commands.add_parser("read", help="files and folders to cited rows")
    r.add_argument("paths", nargs="+")
    r.add_argument("--json", action="store_true")
    r.add_argument("--content", action="store_true", help="blocks in the rows")
    r.add_argument("--shallow", action="store_true", help="no members of containers")
    r.add_argument("--depth", type=int, default=Options.depth)
    r.add_argument("--suffix", action="append", default=[])
    r.add_argument("--limit", type=int, default=50)
    r.add_argument("--out", help="a folder for Markdown and an index")
    d = commands.add_parser("doctor", help="what this machine has")
    d.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return output.USAGE if e.code else output.OK
    if args.command == "doctor":
        rows = capabilities()
        print(json.dumps(rows, indent=2) if args.json else output.table(rows))
        return output.OK if all(r["found"] for r in rows if r["for"] == "the engine") else output.FAILED
    missing = [p for p in args.paths if "://" not in p and not os.path.exists(p)]
    if missing:
        print(f"not found: {', '.join(missing)}", file=sys.stderr)
        return output.MISSING
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillstone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        run = read(spark, *args.paths, options=Options(suffixes=tuple(s.lower() for s in args.suffix), content=args.content, shallow=args.shallow, depth=args.depth))
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return output.MISSING
    try:
        if args.out:
            with exclusive(args.out):
                run.write_markdown(args.out)
                run.write_index(os.path.join(args.out, "index.jsonl"))
        print(output.emitted(run, args.json, args.content, args.limit))
        return output.exit_code(run)
    finally:
        run.close()


if __name__ == "__main__":
    sys.exit(main())
