"""Links between relations with nulls, repeats and empty sides."""

import hashlib

from quillstone.operators import linking as L
from pyspark.sql import functions as F


def test_outcomes(spark):
    jobs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "item string, number int")
    done = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 3, None), ("c", 1, 2)], "item string, number int, engines int")
    got = {r["item"]: tuple(r)[1:] for r in L.outcomes(jobs, done, "item", "number").collect()}
    assert got == {"a": (3, 2, 1, 1), "b": (1, 0, 0, 1)}
    assert {tuple(r) for r in L.outcomes(jobs, done.limit(0), "item", "number").collect()} == {("a", 3, 0, 0, 3), ("b", 1, 0, 0, 1)}


def test_targets_and_details(spark):
    parts = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None), (4, "r9")], "part int, id string")
    relations = spark.createDataFrame([("r1", "b.xml", False), ("r1", "a.xml", False), ("r2", "http://x", True), (None, "n.xml", False)], "id string, target string, external boolean")
    assert {r.part: r.target for r in L.targets(parts, relations, "id").collect()} == {1: "a.xml", 2: None, 3: None, 4: None}
    items = spark.createDataFrame([("x",), ("y",), (None,)], "out string")
    rows = spark.createDataFrame([("x", 3), ("x", 1), (None, 5)], "out string, n int")
    assert {(r.out, r.n_details, tuple(r.details or ())) for r in L.details(items, rows, "out", "n").collect()} == {("x", 2, (1, 3)), ("y", 0, ()), (None, 0, ())}


def test_first_blocks(spark):
    pictures = spark.createDataFrame([("f", 1, "p"), ("f", None, "q"), ("g", 1, "r")], "file string, page int, name string")
    blocks = spark.createDataFrame([("f", 1, 7), ("f", 1, 4), ("f", None, 9)], "file string, page int, place int")
    out = L.first_blocks(pictures, blocks, ["file", "page"], "place")
    assert out.columns == ["file", "page", "name", "block"] and {r.name: r.block for r in out.collect()} == {"p": 4, "q": 9, "r": None}


def test_orders(spark):
    readers = spark.createDataFrame([("cloud", True, 0), ("own", False, 2), ("other", False, 1)], "name string, remote boolean, ord int")
    assert [r.name for r in L.asked(readers, "remote", "ord").orderBy("place").collect()] == ["other", "own", "cloud"]
    shapes = spark.createDataFrame([(1, 9.0, 0.0, "c"), (1, 2.0, 5.0, "b"), (1, 2.0, 5.0, "a"), (2, 1.0, 1.0, "d")], "page int, y double, x double, id string")
    assert {r.id: r.place for r in L.shape_order(shapes, "page", "y", "x", "id").collect()} == {"a": 1, "b": 2, "c": 3, "d": 1}
    rows = spark.createDataFrame([("f", 1, "a\nb"), ("f", 2, None), ("f", 3, "c"), ("g", 1, "d")], "file string, n int, text string")
    got = L.row_lines(rows, "file", "n", F.regexp_count("text", F.lit("\n")))
    assert {(r.file, r.n): r.line for r in got.collect()} == {("f", 1): 2, ("f", 2): 4, ("f", 3): 5, ("g", 1): 2}


def test_recordings(spark):
    recordings = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "e", "a")], "id int, dir string, stem string")
    files = spark.createDataFrame([("d", "a", "a.vtt", 4), ("d", "a", "a.ass", 0), ("d", "a", "a.srt", 2), ("d", "b", "b.srt", None)], "dir string, stem string, name string, cues int")
    got = {r.id: (r.file, r.job) for r in L.recording_jobs(recordings, files, ["dir", "stem"], "name", "cues").collect()}
    assert got == {1: ("a.srt", "subtitles"), 2: (None, "listen"), 3: (None, "listen")}


def test_columns(spark):
    one = spark.createDataFrame([(" hi ", None, ["# a", "b", "", "#c"], [1.0, 2.0, None])], "t string, n string, lines array<string>, box array<double>")
    r = one.select(
        L.sticky_note("Note", F.col("n"), F.col("t")).alias("note"), L.sticky_note("Note", F.col("t"), F.lit("  ")).alias("empty"), L.without_comments(F.col("lines"), "#").alias("told"), L.scaled_box(F.col("box"), 8).alias("box"),
        L.identity(F.col("n"), F.col("t")).alias("a"), L.identity(F.col("t"), F.col("n")).alias("b"), L.readable(F.lit("a" * 99 + "\x01")).alias("fair"), L.readable(F.lit("a" * 98 + "\x01")).alias("odd"), L.readable(F.col("n")).alias("none"),
        L.resource_kind(F.col("n"), F.lit("x/y.tar.GZ?v=1.csv")).alias("gz"), L.resource_kind(F.lit("CSV"), F.lit("x.json")).alias("csv"), L.resource_kind(F.col("n"), F.col("n")).alias("unknown"),
        L.reader_language(F.lit("de")).alias("deu"), L.reader_language(F.lit("xx")).alias("xx"), L.worth_reading(F.lit(48), F.lit(53)).alias("worth"), L.worth_reading(F.lit(48), F.lit(50)).alias("small"), L.squeezed(F.lit(" a \n\t b ")).alias("squeezed"),
    ).first()
    assert (r.note, r.empty, r.told.kept, r.told.comments, r.box) == ("[Note by unknown] hi", None, ["b", ""], 2, [0.1, 0.2, None])
    assert (r.a, r.b) == (hashlib.sha256(b"\n hi ").hexdigest(), hashlib.sha256(b" hi \n").hexdigest())
    assert (r.fair, r.odd, r.none) == (True, False, None) and (r.gz, r.csv, r.unknown) == ("gz", "csv", "unknown")
    assert (r.deu, r.xx, r.worth, r.small, r.squeezed) == ("deu", "xx", True, False, "a b")
    assert L.labels(one.select("t", "box")) == ["t (string)", "box (array<double>)"]


def test_values_seen(spark):
    readings = spark.createDataFrame([(1, "12 and 7"), (1, "7, 30"), (2, None), (3, "none")], "item int, text string")
    assert [tuple(r) for r in L.values_seen(readings, "item", "text", "[0-9]+").collect()] == [(1, ["12", "30", "7"], 3)]
