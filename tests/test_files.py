"""Files in a table, lines in chunks, data URIs and folded characters."""

import random
import unicodedata

from pyspark.sql import functions as F
from quillstone.operators import consensus, files
from quillstone.sources import parsers


def test_lines_in_chunks():
    rnd = random.Random(1)
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", ""]
    for _ in range(200):
        text = "".join(rnd.choice(["a", "bc", "", "漢"]) + rnd.choice(ends) for _ in range(rnd.randint(0, 12)))
        for size in (1, 2, 3, 7, 64):
            assert list(parsers.lines_in(text[k : k + size] for k in range(0, len(text), size))) == text.splitlines(), (text, size)


def test_files_of_a_table(spark):
    rows = [(1, "a.txt", b"x\ny"), (2, "b.zip", b"PK\3\4nonsense"), (3, None, None), (4, "c.csv", b"h\n1\n"), (4, "c.csv", b"h\n1\n")]
    got = files.parsed(spark.createDataFrame(rows, "id int, name string, content binary"), "id").collect()
    assert len(got) == 5
    by = {r.id: r for r in got}
    assert by[1].blocks[0].text == "1| x\n2| y" and by[2].error and by[3].error is None and by[4].blocks[0].role == "sample"
    assert files.parsed(spark.createDataFrame([], "id int, name string, content binary"), "id").count() == 0


def test_data_uris(spark):
    cases = {"data:,a%20b+c": b"a b+c", "data:text/plain;charset=utf-8,%C3%A9": "é".encode(), "data:;base64,YQ==": b"a", "data:image/png;BASE64, Y Q = =": b"a", "data:,": b"", "data:,50%": b"50%", "http://x": None, "data:text": None, "data:;base64,?": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: None if r.b is None else bytes(r.b) for r in df.select("u", files.data_uri(F.col("u")).alias("b")).collect()}
    assert got == cases


def test_folded_characters(spark):
    text = "".join(chr(c) for c in range(32, 0x10000) if not 0xD800 <= c < 0xE000)
    want = "".join(n if len(n := unicodedata.normalize("NFKC", c)) == 1 else c for c in text)
    assert spark.createDataFrame([(text,)], "t string").select(consensus.folded(F.col("t"))).first()[0] == want


def test_a_database_with_a_write_ahead_log(tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "w.db")
    con.execute("pragma journal_mode = wal")
    con.execute("create table t(a text)")
    con.execute("insert into t values ('x')")
    con.commit()
    con.execute("pragma wal_checkpoint(truncate)")
    con.close()
    data = (tmp_path / "w.db").read_bytes()
    assert "rowid=1| x" in parsers.parse("w.db", data).blocks[1][1]
    assert parsers.parse("w.db", data[:30] + bytes(200)).error and parsers.parse("w.db", data[:16]).error


def test_files_are_made_in_every_task(spark):
    """A table of few bytes is read by one task; making files of its rows isn't left to that one."""
    from quillstone.plans.files import FORMATS, made

    rows = made(spark, "/root/testdata/sf0.001", "f.zip", FORMATS["file_csv"][2]).withColumn("task", F.spark_partition_id())
    counts = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(counts) >= 4 and max(counts) <= 2 * sum(counts) / len(counts)


def test_sections_of_many_pages():
    """Pages of a batch are parsed a few at a time; pages without text give no rows."""
    import pyarrow as pa
    from quillstone.plans.pages import page_sections

    html = [None if n % 7 == 0 else "<p>" if n % 7 == 1 else f"lead {n}<h2 id=a{n}>Head</h2>body" for n in range(1000)]
    out = list(page_sections([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(html)], ["page_id", "html"])]))
    assert max(b.num_rows for b in out) <= 128 and len(out) == 16
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [x for n in range(1000) if n % 7 > 1 for x in ((n, 0, None, f"lead {n}"), (n, 1, f"a{n}", "Head\nbody"))]
