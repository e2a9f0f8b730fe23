"""Binary formats, from files that the tests build."""

import io
import struct
import zipfile
import zlib

import pytest
from quillstone.sources import drawn, legacy, parsers

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(streams):
    """A compound file of 512-byte sectors; small streams are padded beyond the cutoff's reach by setting it to 0 bytes."""
    folders = sorted({p.rpartition("/")[0] for p in streams if "/" in p})
    names = [("Root Entry", 5, None), *((f, 1, None) for f in folders), *((p, 2, body) for p, body in streams.items())]
    index = {n: k for k, (n, _, _) in enumerate(names)}
    children = {k: [] for k in range(len(names))}
    for k, (n, _, _) in enumerate(names[1:], 1):
        children[index[n.rpartition("/")[0]] if "/" in n else 0].append(k)
    sectors, fat, entries = [], [], []

    def put(body):
        if not body:
            return END
        start, n = len(sectors), -(-len(body) // 512)
        for i in range(n):
            sectors.append(body[512 * i : 512 * i + 512].ljust(512, b"\0"))
            fat.append(start + i + 1 if i + 1 < n else END)
        return start

    right = {}
    for own in children.values():
        right |= dict(zip(own, own[1:], strict=False))
    for k, (n, kind, body) in enumerate(names):
        raw = n.rpartition("/")[2].encode("utf-16-le") + b"\0\0"
        start = put(body) if kind == 2 else 0
        entries.append(raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, FREE, right.get(k, FREE), children[k][0] if children[k] else FREE) + bytes(36) + struct.pack("<IQ", start if kind != 5 else END, len(body or b"")))
    first = put(b"".join(entries).ljust(-(-len(entries) * 128 // 512) * 512, b"\0"))
    n = len(sectors) // 128 + 1
    at = len(sectors)
    fat += [0xFFFFFFFD] * n
    table = struct.pack(f"<{n * 128}I", *(fat + [FREE] * (n * 128 - len(fat))))
    head = legacy.COMPOUND + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", n, first, 0, 0, END, 0, END, 0) + struct.pack("<109I", *([at + i for i in range(n)] + [FREE] * (109 - n)))
    return head + b"".join(sectors) + table


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_word_97():
    body = "First line\rA \x13HYPERLINK x\x14link\x15 here\rcell\x07"
    main = bytearray(0x400)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 0x4C, len(body) + 4)
    struct.pack_into("<II", main, 0x1A2, 0, 5 + 4 * 3 + 16)
    text = body.encode("cp1252") + "가나\r다".encode("utf-16-le")
    plc = struct.pack("<3I", 0, len(body), len(body) + 4) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, 0x400 + len(body), 0)
    got = parsers.parse("a.doc", compound({"WordDocument": bytes(main) + text, "1Table": b"\x02" + struct.pack("<I", len(plc)) + plc}))
    assert [b[1] for b in got.blocks] == ["1| First line\n2| A link here\n3| cell\t가나\n4| 다"]
    struct.pack_into("<H", main, 10, 0x300)
    assert parsers.parse("a.doc", compound({"WordDocument": bytes(main)})).needs == [legacy.LOCKED]


def test_excel_97():
    words = [b"\x03\0\0abc", b"\x02\0\x01" + "가나".encode("utf-16-le")]
    split = b"\x06\0\0long"
    sheet = record(0x809, bytes(16)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5))
    sheet += record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, (7 << 2) | 2) + struct.pack("<HI", 0, (250 << 2) | 3) + struct.pack("<H", 1)) + record(0x205, struct.pack("<HHHBB", 3, 1, 0, 1, 0))
    sheet += record(0x06, struct.pack("<HHHd", 4, 0, 0, 9.0) + bytes(6)) + record(0xFD, struct.pack("<HHHI", 5, 0, 0, 2)) + record(0x0A, b"")

    def book(place):
        bound = lambda at, state, title: record(0x85, struct.pack("<IH", at, state) + bytes([len(title), 0]) + title)
        return record(0x809, bytes(16)) + bound(place, 0, b"Plan") + bound(place, 1, b"Old") + record(0xFC, struct.pack("<II", 3, 3) + b"".join(words) + split) + record(0x3C, b"\x00er") + record(0x0A, b"")

    got = parsers.parse("a.xls", compound({"Workbook": book(len(book(0))) + sheet}))
    lines = got.blocks[0][1].splitlines()
    assert lines[2:] == ["| 1 | abc |  | 가나 |", "| 2 | 2.5 |  |  |", "| 3 | 7 | 2.5 |  |", "| 4 |  | TRUE |  |", "| 5 | 9 |  |  |", "| 6 | longer |  |  |"]
    assert got.blocks[0][0] == {"sheet": "Plan"} and got.needs == ["hidden sheet Old not read"]


def test_powerpoint_97():
    atom = lambda kind, body, head=0: struct.pack("<HHI", head, kind, len(body)) + body
    listed = atom(4080, atom(1011, bytes(20)) + atom(4008, b"Title one") + atom(1011, bytes(20)) + atom(4000, "두 번째".encode("utf-16-le")), 15)
    drawn_slide = atom(1006, atom(1036, atom(61442, atom(61453, atom(4008, b"in a box\rtwo"), 15), 15), 15), 15)
    got = parsers.parse("a.ppt", compound({"PowerPoint Document": atom(1000, listed, 15) + drawn_slide}))
    assert [(b[0], b[1]) for b in got.blocks] == [({"slide": 1}, "Title one\nin a box\ntwo"), ({"slide": 2}, "두 번째")]


def test_outlook():
    wide = lambda s: s.encode("utf-16-le")
    got = parsers.parse("a.msg", compound({"__substg1.0_0037001F": wide("Hello"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_1000001F": wide("The body"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"x,y\n1,2\n", "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("t.csv")}))
    assert got.blocks[0][1] == "From: Ann\nSubject: Hello" and got.blocks[1][1] == "The body" and got.children == [("t.csv", b"x,y\n1,2\n")]


def test_hwp_5():
    para = lambda s: struct.pack("<I", 66) + struct.pack("<I", 67 | len(s) << 20) + s
    section = para("첫 줄\r".encode("utf-16-le")) + para(struct.pack("<8H", 2, 0, 0, 0, 0, 0, 0, 2) + "뒤\r".encode("utf-16-le"))
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    got = parsers.parse("a.hwp", compound({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000000, 1), "BodyText/Section0": pack.compress(section) + pack.flush()}))
    assert got.blocks == [({"section": 1}, "1| 첫 줄\n2| 뒤", "body")]
    got = parsers.parse("a.hwp", compound({"FileHeader": bytes(36) + struct.pack("<I", 2), "BodyText/Section0": b"x"}))
    assert got.needs == [legacy.LOCKED]


def test_metafiles():
    def drawn_text(y, s):
        raw = s.encode("utf-16-le").ljust(-(-len(s) * 2 // 4) * 4, b"\0")
        return struct.pack("<II", 84, 52 + len(raw)) + bytes(28) + struct.pack("<iiII", 0, y, len(s), 52) + raw

    head = struct.pack("<II", 1, 88) + bytes(32) + b" EMF" + bytes(44)
    assert parsers.parse("a.emf", head + drawn_text(5, "one ") + drawn_text(5, "line") + drawn_text(9, "two")).blocks[0][1] == "1| one line\n2| two"
    out = struct.pack("<H", 3) + b"abc\0" + struct.pack("<hh", 7, 0)
    wmf = bytes(18) + struct.pack("<IH", 3 + len(out) // 2, 0x521) + out + struct.pack("<IH", 3, 0)
    assert parsers.parse("a.wmf", wmf).blocks[0][1] == "1| abc"
    assert parsers.parse("a.wmf", b"").needs == ["no text found"]


def test_wordperfect():
    head = b"\xffWPC" + struct.pack("<I", 16) + b"\x01\x0a\x02\x01" + struct.pack("<HH", 0, 0)
    body = b"Some\x80words\xccnext\xd4\x00\x08\x00abcd\xf2\x01\xf2line"
    assert parsers.parse("a.wpd", head + body).blocks[0][1] == "1| Some words\n2| nextline"
    assert parsers.parse("a.wpd", head[:12] + b"\x01\0" + body).needs == [legacy.LOCKED]


def message(*parts):
    out = b""
    for key, value in parts:
        out += bytes([key << 3 | (2 if isinstance(value, bytes) else 0)]) + (bytes([len(value)]) + value if isinstance(value, bytes) else bytes([value & 127 | 128, value >> 7]) if value > 127 else bytes([value]))
    return out


def test_iwork_and_snappy():
    assert legacy.snappy(b"\x0a\x08abc\x0d\x03") == b"abcabcabca"
    with pytest.raises(ValueError):
        legacy.snappy(b"\x04\x00a\x05\x09")
    text = message((3, "Hello\nPages".encode()))
    words = message((3, message((1, 1), (3, b"cell one"))))
    plain = b""
    for kind, body in ((2001, text), (6005, words)):
        info = message((1, 1), (2, message((1, kind), (3, len(body)))))
        plain += bytes([len(info)]) + info + body
    block = bytes([len(plain), (len(plain) - 1) << 2]) if len(plain) <= 60 else bytes([len(plain), 60 << 2, len(plain) - 1])
    block += plain
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Index/Document.iwa", b"\0" + len(block).to_bytes(3, "little") + block)
    got = parsers.parse("a.pages", out.getvalue())
    assert got.error is None and got.blocks[0][:2] == ({"para": 1}, "1| Hello\n2| Pages") and got.blocks[1][1] == "cell one"
    old = io.BytesIO()
    with zipfile.ZipFile(old, "w") as z:
        z.writestr("index.apxl", '<k:p xmlns:k="k" xmlns:s="s"><k:slide><s:p>One</s:p></k:slide><k:slide><s:p>Two</s:p></k:slide></k:p>')
    assert [b[0] for b in parsers.parse("b.key", old.getvalue()).blocks] == [{"slide": 1}, {"slide": 2}]
    assert str(legacy.decimal128((((6176 - 2) << 113) | 12345 | 1 << 127).to_bytes(16, "little"))) == "-123.45"


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x0dIHDR" + struct.pack(">II", 30, 20) + bytes(8)
    frame = b"\x2c" + struct.pack("<4HB", 0, 0, 4, 3, 0) + b"\x02\x01\x00\x00"
    gif = b"GIF89a" + struct.pack("<HH", 4, 3) + b"\0\0\0" + frame + b"\x21\xf9\x04\0\0\0\0\0" + frame + b";"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + bytes(10)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 6, 0) + struct.pack("<HHIHH", 257, 3, 1, 5, 0) + struct.pack("<I", 0)
    assert [drawn.picture_size(x) for x in (png, gif, jpeg, tiff)] == [(30, 20, 1), (4, 3, 2), (9, 7, 1), (6, 5, 1)]
    got = parsers.parse("a.gif", gif)
    assert got.blocks == [({}, "4 x 3 px, 2 frames", "metadata")] and got.needs == ["not read (needs a picture reader)"]
    assert parsers.parse("a.png", b"text").error == "not a picture"
    assert drawn.media_kind(b"\0\0\0\x20ftypM4A ") == "audio/mp4" and drawn.media_kind(b"") is None
    assert parsers.parse("a.pdf", b"%PDF-1.7 ... /Encrypt 5 0 R").kind == "locked"


def test_charts_and_diagrams():
    chart = """<c xmlns:c="c"><c:ser><c:tx><c:v>Sales</c:v></c:tx><c:cat><c:pt idx="0"><c:v>Q1</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>5</c:v></c:pt><c:pt idx="2"><c:v>7</c:v></c:pt></c:val></c:ser>
    <c:ser><c:val><c:pt idx="1"><c:v>6</c:v></c:pt></c:val></c:ser></c>"""
    points = """<d xmlns:a="a"><pt modelId="0" type="doc"/><pt modelId="1"><a:t>Root</a:t></pt><pt modelId="2"><a:t>B</a:t></pt><pt modelId="3"><a:t>A</a:t></pt>
    <cxn srcId="0" destId="1" srcOrd="0"/><cxn srcId="1" destId="2" srcOrd="1"/><cxn srcId="1" destId="3" srcOrd="0"/></d>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<t/>")
        z.writestr("word/document.xml", '<w xmlns:w="w"><w:p><w:t>Body</w:t></w:p></w>')
        z.writestr("word/charts/chart1.xml", chart)
        z.writestr("word/diagrams/data1.xml", points)
        z.writestr("word/media/a.png", b"same")
        z.writestr("word/media/b.png", b"same")
    got = parsers.parse("a.docx", out.getvalue())
    assert [b[1] for b in got.blocks] == ["1| Body", "chart 1\ncolumns| category | Sales | series 2\nQ1 | 5 | \n2 |  | 6\n3 | 7 | ", "- Root\n  - A\n  - B"]
    assert [n for n, _ in got.children] == ["a.png"]
