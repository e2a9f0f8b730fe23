"""op2: the archive as read back, lookups through the index, odd rows."""

import base64
import gzip
import hashlib

import duckdb
from quillstone.llm import warc


def plain(rows):
    rows = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for p, h in rows:
        first[h] = min(p, first.get(h, p))
    return sorted((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == p else "revisit", None if first[h] == p else first[h]) for p, h in rows)


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(1000, None, None), (1001, "x", ""), (1002, "http://a b.org/ \r\n", rows[3][2]), (999, "http://[bad", rows[3][2]), (1003, "y", "WARC/1.1\r\n\r\n"), (1004, "http://www.a.org:8080/q?x=é", "é" * 200000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'o' as owner")
    got = sorted((tuple(r) for r in warc.round_trip(docs).collect()), key=lambda r: r[0])
    assert got == plain([(p, h) for p, _, h in rows])
    assert warc.round_trip(docs.limit(0)).count() == 0


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet' union all select 5000, 'u', (select html from '/root/testdata/sf0.001/pages.parquet' limit 1) union all select 5001, null, null")
    got = sorted(con.sql(warc.ORACLE).fetchall(), key=lambda r: r[0])
    assert got == plain(con.sql("select page_id, html from pages").fetchall())


def test_lookup_reads_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i // 2}", f"page {i // 3}") for i in range(60)], "page_id long, url string, html string")
    folder = warc.write(pages, file_bytes=3000)
    find = warc.Lookup(spark, folder)
    for i in (0, 13, 59):
        before = find.blocks_read
        found = find.get(f"http://h{i % 7}.org/p{i // 2}")
        assert i in [r["page_id"] for r in found] and find.blocks_read - before <= 2
        assert all(r["payload"] == f"page {r['page_id'] // 3}".encode() for r in found if r["record_type"] == "response")
    assert find.get("http://absent.org/") == []
    disk, root = warc.opened(folder)
    files = [f.path for f in disk.get_file_info(warc.fs.FileSelector(f"{root}/archive"))]
    assert len(files) > 1
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 60


def test_distributed_lookup(spark, monkeypatch):
    """A key of many blocks, keys of one, repeated, absent and null URLs; each capture once; few directory files are held."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(i, "http://hot.org/" if i % 3 == 0 else None if i % 50 == 1 else f"http://h{i % 7}.org/p{i // 2}", f"page {i}") for i in range(200)]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8), file_bytes=3000)
    urls = spark.createDataFrame([(r[1],) for r in rows] + [("http://absent.org/",), (rows[0][1],)], "url string")
    lines = warc.captures_of(spark, folder, urls)
    assert sorted(r.page_id for r in lines.collect()) == list(range(200))
    some = warc.captures_of(spark, folder, urls.where("url = 'http://hot.org/' or url like 'http://absent%'"))
    assert sorted(r.page_id for r in warc.records(spark, folder, some).collect()) == list(range(0, 200, 3))
    directory = warc.Directory(folder)
    assert directory.blocks("zz") == [] and len(directory.blocks(warc.url_key("http://hot.org/"))) >= 67 // 4
    monkeypatch.setattr(warc.Directory, "KEPT", 1)
    assert len(warc.Directory(folder).blocks(warc.url_key("http://hot.org/"))) >= 67 // 4 and len(directory.held) <= 4


def test_hot_payload(spark, monkeypatch):
    """A payload of half of the pages is found by the broadcast, the others by the shuffle."""
    from quillstone.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", 1)
    rows = [(i, f"http://a/{i}", "same" if i % 2 else f"p{i // 4}") for i in range(3000)]
    got = sorted(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == plain([(p, h) for p, _, h in rows])


def test_keys():
    assert warc.url_key("http://www.b.org:80/x?y") == "org,b)/x?y"
    assert warc.url_key("https://a.b.org:8443") == "org,b,a:8443)/"


def test_null_ids(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (4, "u", "x"), (None, "u", "z"), (4, "u", "x")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [("4", "response", None), ("4", "response", None), ("None", "response", None), ("None", "revisit", 4)]
