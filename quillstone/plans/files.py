"""Files as rows: each supplier has a file of every format, made of its columns; the queries parse them."""

from __future__ import annotations

import gzip
import io
import json
import plistlib
import sqlite3
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as O
from .tables import table

QUERIES = {}
ORACLES = {}


def zipped(**members: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def tarred(name: str, body: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("link")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    return out.getvalue()


def stored_table(k: int, n: str) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("create table users(id integer primary key, name text, avatar blob)")
    con.executemany("insert into users values (?, ?, ?)", [(i, n if i == 1 else None, b"xy") for i in range(1, 23)])
    con.commit()
    body = con.serialize()
    con.close()
    return body


def columnar(k: int, n: str, kind: str) -> bytes:
    import pyarrow.parquet as pq

    t = pa.table({"id": pa.array([k, k + 1, None], pa.int64()), "name": pa.array([n, None, "NULL"], pa.string())})
    out = io.BytesIO()
    if kind == "parquet":
        pq.write_table(t, out)
    else:
        with pa.ipc.new_file(out, t.schema) as w:
            w.write_table(t)
    return out.getvalue()


def paper(k: int, n: str) -> bytes:
    """Two pages, one with text in two fonts and a note, one without text; a file inside."""
    import zlib

    shown = f"BT /F1 12 Tf 72 700 Td (Report on ) Tj [({n})] TJ 0 -14 Td (number {k}) Tj /F2 12 Tf 60 0 Td <0001> Tj ET".encode()
    table = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00e9> endbfchar"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R/Names<</EmbeddedFiles<</Names[(a)<</F(a.txt)/EF<</F 9 0 R>>>>]>>>>>>", b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 7 0 R/F2 8 0 R>>>>>>",
        b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Annots[6 0 R]>>", b"<</Type/Page/Parent 2 0 R/Contents 11 0 R>>", packed(zlib.compress(shown), b"/Filter/FlateDecode"), f"<</Subtype/Text/T(Ann)/Contents(see {k})>>".encode(),
        b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", b"<</Type/Font/Subtype/Type0/ToUnicode 10 0 R>>", packed(n.encode()), packed(table), packed(b"q Q"), f"<</Title({n})>>".encode(),
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer <</Root 1 0 R/Info 12 0 R>>\n%%EOF"


def packed(body: bytes, head: bytes = b"") -> bytes:
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), head, body)


WORD = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{n}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>number {k}</w:t></w:r></w:p></w:body></w:document>'
SLIDE = '<sld xmlns:a="a"><a:p><a:t>{n} {i}</a:t></a:p></sld>'
BOOK = '<w xmlns="x" xmlns:r="r"><sheets><sheet name="S" r:id="i1"/><sheet name="H" state="hidden" r:id="i2"/></sheets></w>'
LINKS = '<r><x Id="i1" Target="worksheets/sheet1.xml"/><x Id="i2" Target="worksheets/sheet2.xml"/></r>'
SHEET = '<s xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{k}.0</v></c></row></sheetData></s>'
ODS = '<d xmlns:t="t"><t:table t:name="N"><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>{n}</t:p></t:table-cell></t:table-row></t:table></d>'
MAIL = "From: a@b.c\nSubject: {n}\n\nbody {k}\n"

#: Query: what it covers, the file's name, its bytes of (number, name), and in SQL its kind, text, needs and members.
FORMATS: dict[str, tuple[str, str, Callable[[int, str], bytes], str, str, str, str]] = {
    "file_csv": ("S28 S29", "f.csv", lambda k, n: f"id,name\n{k},{n}\n7,\n".encode(), "table", "'sample {{}}' || e || 'f.csv: 2 rows' || e || 'columns| id | name' || e || 'row=1| ' || k || ' | ' || n || e || 'row=2| 7 | NULL'", "''", "''"),
    "file_tsv": ("S28 O04", "f.tsv", lambda k, n: ("id\tname\n" + f"{k}\t{n}\n" * 25).encode(), "table", "'sample {{}}' || e || 'f.tsv: first 20 of 25 rows' || e || 'columns| id | name' || (select string_agg(e || 'row=' || i || '| ' || k || ' | ' || n, '' order by i) from range(1, 21) t(i))", "'5 rows not read (sample)'", "''"),
    "file_jsonl": ("S30 A19 A20 U02", "f.jsonl", lambda k, n: f'{{"id": {k}, "x": "{n}"}}\n[1]\n\n{{"y": true}}\n'.encode(), "table", "'sample {{}}' || e || 'f.jsonl: 2 rows' || e || 'columns| id | x | y' || e || 'row=1| ' || k || ' | ' || n || ' | NULL' || e || 'row=2| NULL | NULL | true'", "'1 line not read (not an object, first at line 2)'", "''"),
    "file_json": ("S31 S32", "f.json", lambda k, n: json.dumps([["x", "y"], [k, n], [None, "NULL"]]).encode(), "table", "'sample {{}}' || e || 'f.json: 2 rows' || e || 'columns| x | y' || e || 'row=1| ' || k || ' | ' || n || e || 'row=2| NULL | \"NULL\"'", "''", "''"),
    "file_package": ("S35 S36 S39 P14 F18", "datapackage.json", lambda k, n: json.dumps({"name": n, "resources": [{"name": "r", "data": [{"a": k}]}, {"name": "s", "path": "../x.csv"}, {"path": "t.csv"}]}).encode(), "package", "'metadata {{}}' || e || 'name: ' || n || e || 'resources: 3' || e || '- r: inline data' || e || '- s: path=../x.csv' || e || '- resource3: path=t.csv' || e || '~' || e || 'sample {{\"sheet\": \"r\"}}' || e || 'r: 1 row' || e || 'columns| a' || e || 'row=1| ' || k", "'s: ../x.csv not read (outside the package); resource3: t.csv not read (a file of its own)'", "''"),
    "file_vcard": ("S63 S64 F30", "f.vcf", lambda k, n: f"BEGIN:VCARD\nNOTE:{n}\n  more\nPHOTO;ENCODING=b:{'A' * 100}".encode(), "text", "'body {{\"line\": 1}}' || e || '1| BEGIN:VCARD' || e || '2| NOTE:' || n || ' more' || e || '4| PHOTO;ENCODING=b:<base64 100 chars>'", "''", "''"),
    "file_notebook": ("S51 F15", "f.ipynb", lambda k, n: json.dumps({"cells": [{"source": ["a = 1\n", n], "outputs": [{"data": {"text/plain": str(k), "image/png": "eA=="}}]}, {"source": "\x1b[31mred"}]}).encode(), "notebook", "'body {{\"cell\": \"1\"}}' || e || 'a = 1' || e || n || e || '[output] ' || k || e || '~' || e || 'body {{\"cell\": \"2\"}}' || e || 'red'", "''", "'cell1-1.png 1'"),
    "file_mail": ("S71", "f.eml", lambda k, n: MAIL.format(k=k, n=n).encode(), "mail", "'metadata {{}}' || e || 'From: a@b.c' || e || 'Subject: ' || n || e || '~' || e || 'body {{}}' || e || 'body ' || k", "''", "''"),
    "file_mbox": ("S72", "f.mbox", lambda k, n: f"From x\n{MAIL.format(k=k, n=n)}\nFrom y\n{MAIL.format(k=k, n='two')}".encode(), "mail", "'summary {{}}' || e || '2 messages' || e || '1| ' || n || e || '2| two'", "''", "'1.eml ' || 30 + length(n) + length(k::varchar) || '; 2.eml ' || 32 + length(k::varchar)"),
    "file_html": ("S74 S75 S121", "f", lambda k, n: f"<!doctype html><title>{n}</title><script>x</script><p>lead</p><section id=s1><h2>One</h2><p>a &amp; {k}</p></section><h3 id=two>Two</h3>c".encode(), "html", "'metadata {{}}' || e || n || e || '~' || e || 'body {{}}' || e || 'lead' || e || '~' || e || 'body {{\"anchor\": \"s1\"}}' || e || 'One' || e || 'a & ' || k || e || '~' || e || 'body {{\"anchor\": \"two\"}}' || e || 'Two' || e || 'c'", "''", "''"),
    "file_webarchive": ("S76 U07", "f.webarchive", lambda k, n: plistlib.dumps({"WebMainResource": {"WebResourceData": f"<p>{n}".encode()}, "WebSubframeArchives": [{"WebMainResource": {"WebResourceData": b"<p>in"}}] * 2}), "html", "'body {{}}' || e || n", "''", "'frame-1.html 5'"),
    "file_srt": ("S80 W05 F43", "f.srt", lambda k, n: f"1\n00:00:01,000 --> 00:00:02,500\n<i>{n}</i>\n\n2\n00:00:02,500 --> 00:00:03,000\n{n} two\n\n3\n00:00:03,000 --> 00:00:04,000\ntwo\n".encode(), "subtitle", "'body {{\"t\": [1.0, 2.5]}}' || e || '00:00:01.0-00:00:02.5| ' || n || e || '00:00:02.5-00:00:03.0| two'", "''", "''"),
    "file_ass": ("Z36 S80 F44", "f.ass", lambda k, n: f"[Events]\nFormat: Start, End, Text\nDialogue: 0:00:05.00,0:00:06.00,{k}, {{x}}c\\Nd\nDialogue: 0:00:01.00,0:00:02.00,{n}\nDialogue: bad,0:00:02.00,no\n".encode(), "subtitle", "'body {{\"t\": [1.0, 2.0]}}' || e || '00:00:01.0-00:00:02.0| ' || n || e || '00:00:05.0-00:00:06.0| ' || k || ', c d'", "''", "''"),
    "file_rtf": ("S78", "f.rtf", lambda k, n: (r"{\rtf1{\fonttbl x}" + n + r"\'e9\par {\*\g z}" + str(k) + r"\u233?}").encode(), "office", "'body {{\"line\": 1}}' || e || '1| ' || n || 'é' || e || '2| ' || k || 'é'", "''", "''"),
    "file_svg": ("S79", "f.svg", lambda k, n: f'<svg><title>{n}</title><g display="none"><text>no</text></g><text>{k}</text></svg>'.encode(), "image", "'metadata {{}}' || e || n || e || '~' || e || 'body {{}}' || e || '[hidden] no' || e || '~' || e || 'body {{}}' || e || k", "''", "''"),
    "file_text": ("S60 S61 F25 W01 W02", "f.txt", lambda k, n: f"{n}\r\n한글\x0b{k}".encode(("utf-8", "cp949", "utf-16")[k % 3]), "text", "'body {{\"line\": 1}}' || e || '1| ' || n || e || '2| 한글' || e || '3| ' || k", "''", "''"),
    "file_chat": ("S66 S67 S68 F40 F41", "f.txt", lambda k, n: f"--------------- 2022년 3월 1일 화요일 ---------------\n[{n}] [오후 8:36] hello\nmore\n2021년 12월 29일 오후 12:36, b : x\nDec 31, 2014 at 19:12, c : {k}\n".encode(), "chat", "'body {{\"line\": 2}}' || e || '2| [2022-03-01 20:36 ' || n || '] hello' || e || '3| more' || e || '4| [2021-12-29 12:36 b] x' || e || '5| [2014-12-31 19:12 c] ' || k", "''", "''"),
    "file_chat_csv": ("S67 W14", "f.csv", lambda k, n: f'Date,User,Message\n2024-01-02 03:04:05,{n},"x\ny"\n2024-01-02 03:05:05,b,{k}\n'.encode(), "chat", "'body {{\"line\": 2}}' || e || '2| [2024-01-02 03:04 ' || n || '] x y' || e || '4| [2024-01-02 03:05 b] ' || k", "''", "''"),
    "file_workspace": ("S69 S70 J01 J21 F42", "f.zip", lambda k, n: zipped(**{"users.json": json.dumps([{"id": "U1", "name": "a", "profile": {"display_name": n}}]), "channels.json": "[]", "general/2024-01-01.json": json.dumps([{"ts": "1704067200.5", "user": "U1", "text": f"{k} <@U1> &amp; <!here>"}])}), "chat", "'body {{\"ts\": \"1704067200.5\", \"parts\": [\"general/2024-01-01.json\"]}}' || e || '1704067200.5| [2024-01-01 00:00 UTC ' || n || '] ' || k || ' @' || n || ' & @here'", "''", "''"),
    "file_word": ("S82 S83 Z01 Z04 W15", "f.docx", lambda k, n: zipped(**{"[Content_Types].xml": "", "word/document.xml": WORD.format(k=k, n=n)}), "office", "'body {{\"line\": 1}}' || e || '1| ' || n || e || '3| number ' || k", "''", "''"),
    "file_slides": ("S82 S84", "f.pptx", lambda k, n: zipped(**{f"ppt/slides/slide{i}.xml": SLIDE.format(n=n, i=i) for i in (2, 10, 1)}), "office", "'body {{\"slide\": 1}}' || e || n || ' 1' || e || '~' || e || 'body {{\"slide\": 2}}' || e || n || ' 2' || e || '~' || e || 'body {{\"slide\": 10}}' || e || n || ' 10'", "''", "''"),
    "file_workbook": ("S42 S43 F07 F08", "f.xlsx", lambda k, n: zipped(**{"xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": LINKS, "xl/sharedStrings.xml": f'<s xmlns="x"><si><t>{n}</t></si></s>', "xl/worksheets/sheet1.xml": SHEET.format(k=k)}), "sheet", "'body {{\"sheet\": \"S\"}}' || e || '| row | A | B | C |' || e || '|---|---|---|---|' || e || '| 1 | ' || n || ' |  | ' || k || ' |'", "'hidden sheet H not read'", "''"),
    "file_ods": ("S45 S46", "f.ods", lambda k, n: zipped(**{"content.xml": ODS.format(n=n)}), "sheet", "'body {{\"sheet\": \"N\"}}' || e || '| row | A | B |' || e || '|---|---|---|' || e || '| 1 | ' || n || ' | ' || n || ' |'", "''", "''"),
    "file_hwpx": ("S85 Z17", "f.hwpx", lambda k, n: zipped(**{"Contents/section0.xml": f'<h xmlns:p="p"><p:p><p:t>가 {n}</p:t></p:p></h>'}), "office", "'body {{\"section\": 1}}' || e || '1| 가 ' || n", "''", "''"),
    "file_epub": ("S77 Z33", "f.epub", lambda k, n: zipped(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>', "O/c.opf": '<p><item id="a" href="a.x"/><item id="b" href="b.x"/><itemref idref="b"/><itemref idref="a"/></p>', "O/a.x": f"<p>A {k}", "O/b.x": f"<p>B {n}"}), "office", "'body {{\"section\": 1}}' || e || 'B ' || n || e || '~' || e || 'body {{\"section\": 2}}' || e || 'A ' || k", "''", "''"),
    "file_zip": ("S100 S101 S107 F11 A27", "f.zip", lambda k, n: zipped(**{"../x.txt": n, "b/c.txt": str(k), "bomb.txt": "0" * (2 << 20)}), "archive", "'summary {{}}' || e || '3 members, 2 read' || e || 'x.txt (' || length(n) || ' bytes)' || e || 'b/c.txt (' || length(k::varchar) || ' bytes)' || e || 'bomb.txt (2,097,152 bytes)'", "'1 member not read (expands too much: bomb.txt)'", "'x.txt ' || length(n) || '; b/c.txt ' || length(k::varchar)"),
    "file_tar": ("S102 A17", "f.tar.gz", lambda k, n: tarred("d/e.txt", n.encode()), "archive", "'summary {{}}' || e || '2 members, 1 read' || e || 'd/e.txt (' || length(n) || ' bytes)' || e || 'link (0 bytes)'", "'1 member not read (special file: link)'", "'d/e.txt ' || length(n)"),
    "file_gzip": ("S106", "f.txt.gz", lambda k, n: gzip.compress(n.encode(), 0, mtime=0), "archive", "'summary {{}}' || e || '1 member, 1 read' || e || 'f.txt (' || length(n) + 23 || ' bytes)'", "''", "'f.txt ' || length(n)"),
    "file_sqlite": ("S40 S41 A05", "f.db", stored_table, "database", "'metadata {{}}' || e || 'CREATE TABLE users(id integer primary key, name text, avatar blob)' || e || '~' || e || 'sample {{\"sheet\": \"users\"}}' || e || 'users: first 20 of 22 rows' || e || 'columns| id | name | avatar' || (select string_agg(e || 'rowid=' || i || '| ' || i || ' | ' || case when i = 1 then n else 'NULL' end || ' | <blob 2 bytes>', '' order by i) from range(1, 21) t(i))", "'users: 2 rows not read (sample)'", "''"),
    "file_parquet": ("S20 S21 S22", "f.parquet", lambda k, n: columnar(k, n, "parquet"), "table", "'metadata {{}}' || e || 'id: int64' || e || 'name: string' || e || '~' || e || 'summary {{}}' || e || 'column | min | max | nulls' || e || 'id | ' || k || ' | ' || k + 1 || ' | 1' || e || 'name | \"NULL\" | ' || n || ' | 1' || e || '~' || e || 'sample {{}}' || e || 'f.parquet: 3 rows' || e || 'columns| id | name' || e || 'row=1| ' || k || ' | ' || n || e || 'row=2| ' || k + 1 || ' | NULL' || e || 'row=3| NULL | \"NULL\"'", "''", "''"),
    "file_arrow": ("S23 S24 S25 S26", "f.arrow", lambda k, n: columnar(k, n, "arrow"), "table", "'summary {{}}' || e || 'column | type | nulls | min | max | distinct' || e || 'id | int64 | 1 | ' || k || ' | ' || k + 1 || ' | 2' || e || 'name | string | 1 | \"NULL\" | ' || n || ' | 2' || e || '~' || e || 'sample {{}}' || e || 'f.arrow: 3 rows' || e || 'columns| id | name' || e || 'row=1| ' || k || ' | ' || n || e || 'row=2| ' || k + 1 || ' | NULL' || e || 'row=3| NULL | \"NULL\"'", "''", "''"),
    "file_locked": ("P18 S112", "f.docx", lambda k, n: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "EncryptedPackage".encode("utf-16-le") + n.encode(), "locked", "''", "'not read (locked by a password)'", "''"),
    "file_pdf": ("S81 S110 P10 Z23", "f.pdf", lambda k, n: paper(k, n), "pdf", "'metadata {{}}' || e || 'Title: ' || n || e || '~' || e || 'body {{\"page\": 1}}' || e || 'Report on ' || n || e || 'number ' || k || ' é' || e || '~' || e || 'note {{\"page\": 1}}' || e || '[Text by Ann] see ' || k", "'1 page with hardly any text, pictures not read (pages 2)'", "'a.txt ' || length(n)"),
    "file_unread": ("S65 S132 G11", "f.7z", lambda k, n: b"7z\xbc\xaf" + n.encode(), "unknown", "''", "'not read (needs 7-Zip)'", "''"),
}


def made(spark: SparkSession, sf: str, name: str, build: Callable[[int, str], bytes]) -> DataFrame:
    """(s_suppkey, name, content): a file of each supplier.

    Suppliers are few bytes, so that a read of all of them is one task; rows are dealt out before files are made of them.
    """

    def run(batches):
        for batch in batches:
            content = [build(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(content)), pa.array(content, pa.binary())], ["s_suppkey", "name", "content"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").repartition(tasks).mapInArrow(run, "s_suppkey long, name string, content binary")


def query(title: str) -> Callable[[SparkSession, str], DataFrame]:
    covers, name, build, *_ = FORMATS[title]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return O.shown(O.parsed(made(spark, sf, name, build), "s_suppkey"), "s_suppkey")

    run.__name__, run.__doc__ = title, f"{covers}: {name} of each supplier, parsed."
    return run


def oracle(title: str) -> str:
    _, _, _, kind, text, needs, members = FORMATS[title]
    return f"select k as s_suppkey, '{kind}' as kind, {text.replace('{{', '{').replace('}}', '}')} as text, {needs} as needs, {members} as members, '' as error from (select s_suppkey as k, s_name as n, chr(10) as e from supplier)"


for _title in FORMATS:
    QUERIES[_title], ORACLES[_title] = query(_title), oracle(_title)
