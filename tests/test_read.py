"""Parsers, the read API, data sources and sinks on generated files."""

import gzip
import io
import json
import mailbox
import os
import plistlib
import sqlite3
import tarfile
import zipfile
from email.message import EmailMessage

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from quillstone import reader
from quillstone.sources import parsers, readers


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, body in parts.items():
            z.writestr(n, body)
    return out.getvalue()


def test_text_and_encodings():
    assert parsers.parse("a.txt", "가나".encode("cp949")).blocks == [({"line": 1}, "1| 가나", "body")]
    assert parsers.parse("a.txt", "x\r\ny".encode("utf-16")).blocks[0][1] == "1| x\n2| y"
    many = parsers.parse("a.md", "\n".join("abc").encode() + b"\n" + b"z\n" * 400)
    assert [b[0]["line"] for b in many.blocks] == [1, 201, 401]
    assert parsers.parse("x.bin", b"\0\1\2").needs == ["unsupported format"]
    assert parsers.parse("x", b"A" * 9).kind == "text" and parsers.parse("x.7z", b"7z\xbc\xaf").needs == ["not read (needs 7-Zip)"]
    assert parsers.parse("c.vcf", b"BEGIN:VCARD\nNOTE:a\n b\nPHOTO;ENCODING=b:" + b"A" * 100).blocks[0][1].splitlines()[1:] == ["2| NOTE:ab", "4| PHOTO;ENCODING=b:<base64 100 chars>"]


def test_tables():
    got = parsers.parse("t.csv", b"id,name\n" + b"".join(b"%d,n|%d\n" % (n, n) for n in range(25)))
    assert got.blocks[0][1].startswith("t.csv: first 20 of 25 rows\ncolumns| id | name\nrow=1| 0 | n\\|0") and got.needs == ["5 rows not read (sample)"]
    got = parsers.parse("t.jsonl", b'{"a": 1}\nnot json\n[1, 2]\n\n{"b": null, "a": "NULL"}\n')
    assert got.blocks[0][1] == 't.jsonl: 2 rows\ncolumns| a | b\nrow=1| 1 | NULL\nrow=2| "NULL" | NULL' and got.needs == ["2 lines not read (not an object, first at line 2)"]
    assert "row=1| 1 | true" in parsers.parse("t.json", b'[["x", "y"], [1, true]]').blocks[0][1]
    spec = {"name": "p", "resources": [{"name": "r", "format": "csv", "data": "a\n1\n"}, {"name": "s", "path": "../x.csv"}, {"name": "t", "path": "t.csv"}]}
    got = parsers.parse("datapackage.json", json.dumps(spec).encode())
    assert got.needs == ["s: ../x.csv not read (outside the package)", "t: t.csv not read (a file of its own)"] and got.blocks[1][0] == {"sheet": "r"}


def test_columnar(tmp_path):
    t = pa.table({"id": list(range(30)), "name": ["NULL", None] + [f"item|{n}" for n in range(28)], "tags": [[1, 2]] * 30}).replace_schema_metadata({"producer": "me"})
    f = io.BytesIO()
    with pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, 10)
    got = parsers.parse("t.arrow", f.getvalue())
    assert got.blocks[0][1] == "producer: me" and "id | int64 | 0 | 0 | 29 | 30" in got.blocks[1][1] and "row=2| 1 | NULL | [1, 2]" in got.blocks[2][1]
    s = io.BytesIO()
    with pa.ipc.new_stream(s, t.schema) as w:
        w.write_table(t, 10)
    cut = parsers.parse("t.arrows", s.getvalue()[: len(s.getvalue()) // 2])
    assert cut.needs == ["the stream is cut, its whole batches were read"]
    q = io.BytesIO()
    pq.write_table(t, q, row_group_size=10)
    got = parsers.parquet("t.parquet", q.getvalue(), 15)
    assert "id | 0 | 29 | 0" in got.blocks[1][1] and got.needs == ["15 rows not read"]
    db = tmp_path / "a.db"
    con = sqlite3.connect(db)
    con.execute("create table users(id integer primary key, name text, avatar blob)")
    con.execute("create table tags(k text primary key, v text) without rowid")
    con.executemany("insert into users values (?, ?, ?)", [(n, f"u{n}", b"xy") for n in range(1, 51)])
    con.execute("insert into tags values ('a', 'b')")
    con.commit()
    con.close()
    got = parsers.parse("a.db", db.read_bytes())
    assert [b[0].get("sheet") for b in got.blocks] == [None, "tags", "users"] and "rowid=1| 1 | u1 | <blob 2 bytes>" in got.blocks[2][1] and got.needs == ["users: 30 rows not read (sample)"]


def test_messages():
    m = EmailMessage()
    m["Subject"], m["From"] = "Hällo", "a@b.c"
    m.set_content("body\n")
    m.add_attachment(b"x,y\n1,2\n", maintype="text", subtype="csv", filename="../t.csv")
    got = parsers.parse("m.eml", m.as_bytes())
    assert "Subject: Hällo" in got.blocks[0][1] and got.blocks[1][1] == "body" and got.children == [("t.csv", b"x,y\n1,2\n")]
    box = b"From x\n" + m.as_bytes() + b"\nFrom y\n" + m.as_bytes()
    assert [n for n, _ in parsers.parse("b.mbox", box).children] == ["1.eml", "2.eml"]
    book = {"cells": [{"cell_type": "code", "source": ["a = 1\n", "a"], "outputs": [{"data": {"text/plain": "1", "image/png": "eA=="}}]}, {"source": "\x1b[31mred"}]}
    got = parsers.parse("n.ipynb", json.dumps(book).encode())
    assert [b[1] for b in got.blocks] == ["a = 1\na\n[output] 1", "red"] and got.children == [("cell1-1.png", b"x")]
    export = zipped(**{"users.json": '[{"id": "U1", "name": "ann", "profile": {"display_name": "Ann"}}]', "channels.json": "[]", "general/2024-01-01.json": '[{"ts": "1704067200.5", "user": "U1", "text": "hi <@U1> &amp; <!here>"}]'})
    got = parsers.parse("s.zip", export)
    assert got.blocks == [({"ts": "1704067200.5", "parts": ["general/2024-01-01.json"]}, "1704067200.5| [2024-01-01 00:00 UTC Ann] hi @Ann & @here", "body")]
    chat = "--------------- 2022년 3월 1일 화요일 ---------------\n[a] [오후 8:36] hello\nmore\n2021년 12월 29일 오후 12:36, b : x\nDec 31, 2014 at 19:12, c : y\n"
    assert parsers.parse("k.txt", chat.encode()).blocks[0][1].splitlines() == ["2| [2022-03-01 20:36 a] hello", "3| more", "4| [2021-12-29 12:36 b] x", "5| [2014-12-31 19:12 c] y"]
    assert parsers.parse("k.csv", b'Date,User,Message\n2024-01-02 03:04:05,a,"x\ny"\n2024-01-02 03:05:05,b,z\n').blocks[0][1].splitlines() == ["2| [2024-01-02 03:04 a] x y", "4| [2024-01-02 03:05 b] z"]


def test_pages_and_captions():
    page = b"<!doctype html><title>T</title><script>x</script><p>lead</p><section id=s1><h2>One</h2><p>a &amp; b</p></section><h3 id=two>Two</h3>c"
    assert parsers.parse("p", page).blocks == [({}, "T", "metadata"), ({}, "lead", "body"), ({"anchor": "s1"}, "One\na & b", "body"), ({"anchor": "two"}, "Two\nc", "body")]
    frame = {"WebMainResource": {"WebResourceData": b"<p>in"}}
    got = parsers.parse("w.webarchive", plistlib.dumps({"WebMainResource": {"WebResourceData": page}, "WebSubframeArchives": [frame, frame]}))
    assert len(got.children) == 1
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>one</i>\n\n2\n00:00:02,500 --> 00:00:03,000\none two\n\n3\n00:00:03,000 --> 00:00:04,000\ntwo\n"
    assert parsers.parse("c.srt", srt.encode()).blocks == [({"t": [1.0, 2.5]}, "00:00:01.0-00:00:02.5| one\n00:00:02.5-00:00:03.0| two", "body")]
    ass = "Format: Start, End, Text\nDialogue: 0:00:05.00,0:00:06.00,b, {x}c\\Nd\nDialogue: 0:00:01.00,0:00:02.00,a\n"
    assert parsers.parse("c.ass", ass.encode()).blocks[0][1] == "00:00:01.0-00:00:02.0| a\n00:00:05.0-00:00:06.0| b, c d"
    assert parsers.clock(59.96) == "00:01:00.0"


def test_packages():
    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>third</w:t></w:r></w:p></w:body></w:document>'
    assert parsers.parse("d.docx", zipped(**{"[Content_Types].xml": "", "word/document.xml": word})).blocks[0][1] == "1| first\n3| third"
    slide = '<p xmlns:a="a"><a:p><a:t>{}</a:t></a:p></p>'
    assert [b[0]["slide"] for b in parsers.parse("d.pptx", zipped(**{f"ppt/slides/slide{n}.xml": slide.format(n) for n in (2, 10, 1)})).blocks] == [1, 2, 10]
    sheet = '<s xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row></sheetData></s>'
    book = '<w xmlns="x" xmlns:r="r"><sheets><sheet name="S" r:id="i1"/><sheet name="H" state="hidden" r:id="i2"/></sheets></w>'
    got = parsers.parse("b.xlsx", zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<r><x Id="i1" Target="worksheets/sheet1.xml"/><x Id="i2" Target="worksheets/sheet2.xml"/></r>', "xl/sharedStrings.xml": '<s xmlns="x"><si><t>head</t></si></s>', "xl/worksheets/sheet1.xml": sheet}))
    assert got.blocks == [({"sheet": "S"}, "| row | A | B | C |\n|---|---|---|---|\n| 1 | head |  | 2 |", "body")] and got.needs == ["hidden sheet H not read"]
    ods = '<d xmlns:t="t"><t:table t:name="N"><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>v</t:p></t:table-cell></t:table-row></t:table></d>'
    assert "| 1 | v | v |" in parsers.parse("b.ods", zipped(**{"content.xml": ods})).blocks[0][1]
    chart = '<d xmlns:c="c" xmlns:t="t"><c:chart><c:title><t:p>Sales</t:p></c:title><c:axis><c:title><t:p>Year</t:p></c:title></c:axis>{}</c:chart></d>'
    row = lambda *cells: "<t:table-row>" + "".join(f"<t:table-cell><t:p>{c}</t:p></t:table-cell>" for c in cells) + "</t:table-row>"
    held = chart.format("<t:table><t:table-header-rows>" + row("", "a", "b") + "</t:table-header-rows>" + row("2001", 1, 2) + row("2002", 3) + "</t:table>")
    slides = '<d xmlns:d="d" xmlns:x="x"><d:page/><d:page><d:object x:href="./Object%201"/><d:object x:href="./Object%201"/><d:object x:href="./Object%202"/><d:object x:href="../x"/></d:page></d>'
    got = parsers.parse("p.odp", zipped(**{"content.xml": slides, "Object 1/content.xml": held, "Object 2/content.xml": chart.format("<t:table>" + row("", "a") + "</t:table>")}))
    assert got.blocks == [({"slide": 2, "anchor": "chart1"}, "chart 1: Sales\naxes: Year\ncolumns| category | a | b\n2001 | 1 | 2\n2002 | 3 | ", "sample")]
    assert got.needs == ["embedded object Object 2 not read", "embedded object ../x not read"] and not got.error
    hw = '<h xmlns:p="p"><p:p><p:t>가</p:t></p:p></h>'
    assert parsers.parse("d.hwpx", zipped(**{"Contents/section0.xml": hw})).blocks == [({"section": 1}, "1| 가", "body")]
    book = zipped(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>', "O/c.opf": '<p><item id="a" href="a.x"/><item id="b" href="b.x"/><itemref idref="b"/><itemref idref="a"/></p>', "O/a.x": "<p>A", "O/b.x": "<p>B"})
    assert [b[1] for b in parsers.parse("e.epub", book).blocks] == ["B", "A"]
    assert parsers.parse("r.rtf", rb"{\rtf1{\fonttbl x}Caf\'e9\par {\*\g z}b\u233?}").blocks[0][1] == "1| Café\n2| bé"
    got = parsers.parse("i.svg", b'<svg><title>t</title><g display="none"><text>no</text></g><text>yes</text></svg>')
    assert [b[1] for b in got.blocks] == ["t", "[hidden] no", "yes"]
    assert parsers.parse("x.svg", b'<!DOCTYPE a [<!ENTITY b "c">]><svg/>').error.startswith("ValueError")


def test_drawings_of_sheets():
    book = '<w xmlns="x" xmlns:r="r"><sheets><sheet name="S" r:id="i1"/><sheet name="H" state="hidden" r:id="i2"/></sheets></w>'
    drawn = '<d xmlns:a="a" xmlns:r="r"><a:twoCellAnchor><a:from><a:col>27</a:col><a:row>4</a:row></a:from><a:g><a:chart r:id="c1"/></a:g></a:twoCellAnchor><a:absoluteAnchor><a:sp><a:p><a:t>no</a:t><a:t>te</a:t></a:p><a:p/></a:sp></a:absoluteAnchor></d>'
    chart = "<c><ser><tx><v>n</v></tx><cat><pt idx='0'><v>q</v></pt></cat><val><pt idx='0'><v>{}</v></pt></val></ser></c>"
    link = lambda *targets: "<r>" + "".join(f'<x Id="{k}" Target="{t}"/>' for k, t in targets) + "</r>"
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": link(("i1", "worksheets/sheet1.xml"), ("i2", "/xl/worksheets/sheet2.xml")), "xl/drawings/drawing1.xml": drawn, "xl/drawings/_rels/drawing1.xml.rels": link(("c1", "../charts/chart2.xml"))}
    parts |= {f"xl/worksheets/sheet{n}.xml": "<s/>" for n in (1, 2)} | {"xl/worksheets/_rels/sheet1.xml.rels": link(("d", "../drawings/drawing1.xml"), ("gone", "../drawings/drawing9.xml"))} | {f"xl/charts/chart{n}.xml": chart.format(n) for n in (1, 2)}
    got = parsers.parse("b.xlsx", zipped(**parts))
    assert not got.error and got.blocks == [({"anchor": "chart1"}, "chart 1\ncolumns| category | n\nq | 1", "sample"), ({"sheet": "S", "anchor": "AB5"}, "chart 2\ncolumns| category | n\nq | 2", "sample"), ({"sheet": "S"}, "note", "body")]


def test_described():
    spec = {"x": 1, "run": {"a": "é", "error": None, "complete": False}, "title": "t\nu", "resources": ["bad", {"name": "n", "data": [], "format": "csv"}, {"path": "p" * 3000}]}
    lines = parsers.described(spec).split("\n")
    assert lines[:4] == ["title: t u", "x: 1", 'run: {"complete": false, "error": null, "a": "é"}', "resources: 3"]
    assert lines[4:6] == ["- resource1: bad", "- n: inline data, format=csv"] and lines[6] == "- resource3: path=" + "p" * 2000 + "..."
    assert parsers.parse("datapackage.json", json.dumps(spec).encode()).needs[0] == "resource1 not read (not an object)"


def test_archives():
    got = parsers.parse("a.zip", zipped(**{"../x.txt": "hi", "b/c.txt": "yo", "bomb.txt": "0" * (4 << 20)}))
    assert [n for n, _ in got.children] == ["../x.txt".replace("../", ""), "b/c.txt"] and got.needs == ["1 member not read (expands too much: bomb.txt)"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("d/e.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
        link = tarfile.TarInfo("l")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    got = parsers.parse("a.tar.gz", out.getvalue())
    assert got.children == [("d/e.txt", b"ok")] and "special file" in got.needs[0]
    assert parsers.parse("n.txt.gz", gzip.compress(b"x")).children == [("n.txt", b"x")]
    assert parsers.parse("bad.zip", b"PK\3\4nonsense").error


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "sub" / "_b.csv").write_text("x\n1\n")
    inner = zipped(**{"deep.txt": "deep"})
    (tmp_path / "z.zip").write_bytes(zipped(**{"in.zip": inner, "m.txt": "mm"}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "empty.html").write_text("")
    return tmp_path


def test_read(spark, folder, tmp_path_factory):
    run = reader.read(spark, str(folder))
    rows = {r.cite.removeprefix(str(folder)): r for r in run.coverage().collect()}
    assert set(rows) == {"/a.txt", "/bad.json", "/empty.html", "/sub/_b.csv", "/z.zip", "/z.zip#att=in.zip", "/z.zip#att=in.zip#att=deep.txt", "/z.zip#att=m.txt"}
    assert rows["/bad.json"].status == "failed" and rows["/empty.html"].status == "complete" and rows["/a.txt"].chars == 13
    cites = {r.cite.removeprefix(str(folder)): r.text for r in run.blocks.collect()}
    assert cites["/z.zip#att=in.zip#att=deep.txt:1"] == "1| deep" and cites["/a.txt:1"] == "1| one\n2| two"
    assert run.summary() == {"items": 8, "errors": 1, "partial": 0, "complete": False, "exit_code": 1}
    out = tmp_path_factory.mktemp("out")
    with reader.exclusive(str(out)), pytest.raises(RuntimeError), reader.exclusive(str(out)):
        pass
    run.write_markdown(str(out))
    run.write_index(str(out / "index.jsonl"))
    assert len([f for f in os.listdir(out) if f.endswith(".md")]) == 8
    index = [json.loads(x) for x in (out / "index.jsonl").read_text().splitlines()]
    assert [r["cite"] for r in index] == sorted(r["cite"] for r in index)
    assert run.documents().count() == run.blocks.where("role <> 'metadata'").select("cite").distinct().count()
    run.close()
    flat = reader.read(spark, str(folder), options=reader.Options(shallow=True, suffixes=(".zip",)))
    assert flat.items.count() == 1
    flat.close()
    with pytest.raises(FileNotFoundError):
        reader.read(spark, str(folder / "absent"))
    empty = reader.read(spark, str(tmp_path_factory.mktemp("none")))
    assert empty.summary()["items"] == 0 and empty.blocks.count() == 0


def test_claims_and_settings(folder):
    (folder / "datapackage.json").write_text(json.dumps({"resources": [{"path": "a.txt"}, {"path": "../x"}]}))
    files = reader.list_files([str(folder)])
    assert str(folder / "a.txt") not in reader.claimed(files, set()) and str(folder / "a.txt") in reader.claimed(files, {str(folder / "a.txt")})
    assert reader.settings({"a": {"n": 1, "on": False}, "l": ["x"]}, {"a": {"n": "5", "on": "true"}, "l": "p,q"}) == {"a": {"n": 5, "on": True}, "l": ["p", "q"]}
    assert reader.common_root([str(folder / "a.txt"), str(folder / "sub")]) == str(folder)


def test_data_sources(spark, tmp_path):
    readers.register(spark)
    t = pa.table({"id": list(range(30)), "s": [None, *map(str, range(29))]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, 10)
    df = spark.read.format("arrow_ipc").load(str(tmp_path / "t.arrow"))
    assert df.rdd.getNumPartitions() == 3 and df.where("s is null").count() == 1 and df.agg({"id": "sum"}).first()[0] == 435
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("create table u(id integer primary key, name text, x real)")
    con.executemany("insert into u values (?, ?, ?)", [(n, f"u{n}", n / 2) for n in range(250)])
    con.commit()
    con.close()
    df = spark.read.format("sqlite_file").option("table", "u").option("rows", 100).load(str(tmp_path / "a.db"))
    assert df.count() == 250 and df.agg({"x": "sum"}).first()[0] == sum(range(250)) / 2
    (tmp_path / "z.zip").write_bytes(zipped(**{"a.txt": "x", "b/c.txt": "yy"}))
    assert sorted(r.member for r in spark.read.format("archive_members").load(str(tmp_path / "z.zip")).collect()) == ["a.txt", "b/c.txt"]
    box = mailbox.mbox(tmp_path / "m.mbox")
    for n in range(3):
        m = EmailMessage()
        m["Subject"] = str(n)
        m.set_content("hi")
        box.add(m)
    box.close()
    assert spark.read.format("mbox_messages").load(str(tmp_path / "m.mbox")).count() == 3


def test_streams(spark, tmp_path):
    from quillstone import streaming

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "e"))
    events = streaming.stream(spark, str(tmp_path / "e"), src.schema, 1)
    q = streaming.windowed(events, late="400 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == src.count()
    q = streaming.terminals(events).writeStream.outputMode("complete").format("memory").queryName("t").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(records + ends) from t").first()[0] == src.count()
    q = streaming.first_seen(streaming.stream(spark, str(tmp_path / "e"), src.schema).unionByName(events), late="400 days").writeStream.outputMode("append").format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from d").first()[0] == src.count()


def test_read_of_uris(spark, tmp_path):
    from quillstone.reader import listed, read

    folder = tmp_path / "a b+c"
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "x.txt").write_text("no")
    (folder / "one.txt").write_text("one")
    (folder / "_two.txt").write_text("")
    (folder / "deep" / "er" / "three 50%.csv").write_text("a\n1\n")
    (folder / "claimed x.txt").write_text("claimed")
    (folder / "datapackage.json").write_text(json.dumps({"resources": [{"path": "claimed x.txt"}, {"path": "../out.txt"}, {"path": ["deep/none.txt"]}]}))
    root = "file://" + str(folder).replace(" ", "%20")
    names = lambda rows: sorted(r.path.removeprefix("file://" + str(tmp_path)) for r in rows.collect())
    every = ["/a%20b%2Bc/_two.txt", "/a%20b%2Bc/datapackage.json", "/a%20b%2Bc/deep/er/three%2050%25.csv", "/a%20b%2Bc/one.txt"]
    assert names(listed(spark, [root + "/"])) == every
    assert names(listed(spark, [root], (".csv",))) == every[2:3]
    assert len(names(listed(spark, [root, root + "/claimed%20x.txt"]))) == 5
    with pytest.raises(FileNotFoundError):
        listed(spark, [root + "/gone"])
    run = read(spark, root, str(folder / "one.txt"))
    got = {r.cite.rpartition("/")[2]: (r.kind, r.status) for r in run.coverage().collect()}
    assert got["three%2050%25.csv"][0] == "table" and "_two.txt" in got and run.items.count() == 5
    run.write_tables(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/blocks").count() == run.blocks.count() and spark.read.parquet(f"{tmp_path}/out/coverage").count() == 5
    run.close()
