"""Binary document formats to cited blocks: compound files (Word, Excel and PowerPoint 97, Outlook, HWP 5), metafiles,
WordPerfect, iWork. They follow the formats as published, with the standard library alone; what is locked is said to be."""

from __future__ import annotations

import gzip
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

from .parsers import Parsed, cell, checked, decoded, lettered, local, member_name, number, numbered, tree

COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LOCKED = "not read (locked by a password)"


class Compound:
    """A compound file: streams by their path."""

    def __init__(self, data: bytes):
        if data[:8] != COMPOUND:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        self.sector, self.mini = 1 << shift, 1 << mini
        _, first, _, self.cutoff, mini_first, _, more, _ = struct.unpack_from("<8I", data, 44)
        wide = self.sector // 4
        tables = list(struct.unpack_from("<109I", data, 76))
        for _ in range(len(data) // self.sector):
            if more >= 0xFFFFFFFA:
                break
            block = struct.unpack(f"<{wide}I", self._sector(more))
            tables, more = tables + list(block[:-1]), block[-1]
        self.next = [x for s in tables if s < 0xFFFFFFFA for x in struct.unpack(f"<{wide}I", self._sector(s))]
        small = self._chain(mini_first)
        self.small = list(struct.unpack(f"<{len(small) // 4}I", small))
        folder = self._chain(first)
        self.entries = [folder[k : k + 128] for k in range(0, len(folder) - 127, 128)]
        self.streams: dict[str, tuple[int, int]] = {}
        root = self.entries[0]
        self.short = self._chain(struct.unpack_from("<I", root, 116)[0])
        todo, seen = [(struct.unpack_from("<I", root, 76)[0], "")], set()
        while todo:
            k, base = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<3I", e, 68)
            path = base + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", e, 116)
            if kind == 2:
                self.streams[path] = (start, size & 0xFFFFFFFF if shift == 9 else size)
            todo += [(left, base), (right, base), (child, f"{path}/")]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector].ljust(self.sector, b"\0")

    def _chain(self, n: int) -> bytes:
        out, left = [], len(self.data) // self.sector + 1
        while n < len(self.next) and left:
            out.append(self._sector(n))
            n, left = self.next[n], left - 1
        return b"".join(out)

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, left = [], size // self.mini + 1
        while start < len(self.small) and left:
            out.append(self.short[start * self.mini : (start + 1) * self.mini])
            start, left = self.small[start], left - 1
        return b"".join(out)[:size]


def compound(name: str, data: bytes) -> Parsed:
    """What is inside decides, not the name. S112: a locked package is told apart and never rendered."""
    file = Compound(data)
    has = file.streams.keys()
    if "EncryptedPackage" in has:
        return Parsed("office", needs=[LOCKED])
    if "WordDocument" in has:
        return word(file)
    if "PowerPoint Document" in has:
        return slides(file)
    if "Workbook" in has or "Book" in has:
        return workbook97(file)
    if "FileHeader" in has and any(p.startswith(("BodyText/", "ViewText/")) for p in has):
        return hangul(file)
    if any(p.startswith("__substg1.0_") for p in has):
        return outlook(file)
    return Parsed("unknown", needs=["a compound file of an unknown kind"])


def word(file: Compound) -> Parsed:
    """The text of a Word 97 file by its piece table; field codes go, their results stay."""
    main, out = file.read("WordDocument"), Parsed("office")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        out.needs.append(LOCKED)
        return out
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx = file.read("1Table" if flags & 0x200 else "0Table")[at : at + size]
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    size = struct.unpack_from("<I", clx, at + 1)[0]
    plc, n = clx[at + 5 : at + 5 + size], (size - 4) // 12
    places, parts = struct.unpack_from(f"<{n + 1}I", plc), []
    for k in range(n):
        start, many = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0], places[k + 1] - places[k]
        if start & 0x40000000:
            begin = (start & 0x3FFFFFFF) // 2
            parts.append(main[begin : begin + many].decode("cp1252", "replace"))
        else:
            parts.append(main[start : start + 2 * many].decode("utf-16-le", "replace"))
    body = "".join(parts)[: struct.unpack_from("<I", main, 0x4C)[0]]
    while (plain := re.sub("\x13[^\x13\x15]*\x14([^\x13\x15]*)\x15", r"\1", re.sub("\x13[^\x13\x14\x15]*\x15", "", body))) != body:
        body = plain
    lines = [re.sub("[\x00-\x08\x0e-\x1f]", "", p.replace("\x07", "\t").replace("\x0b", "\n")).rstrip() for p in re.split("[\r\x0c]", body)]
    shown = [(n, t) for n, t in enumerate(lines, 1) if t.strip()]
    return numbered(out, shown) if shown else out


def atoms(data: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(type, instance, start, end) of the records between two places."""
    while low + 8 <= high:
        head, kind, size = struct.unpack_from("<HHI", data, low)
        yield kind, head, low + 8, min(high, low + 8 + size)
        low += 8 + size


def slides(file: Compound) -> Parsed:
    """Texts of a PowerPoint 97 file, those of the outline and those in drawings, a block a slide."""
    data, out = file.read("PowerPoint Document"), Parsed("office")
    outline: list[list[str]] = []
    drawn: list[list[str]] = []

    def said(kind: int, a: int, b: int) -> str | None:
        raw = data[a:b].decode("utf-16-le" if kind == 4000 else "cp1252", "replace") if kind in (4000, 4008) else None
        return None if raw is None else re.sub("[\r\x0b]", "\n", raw).strip()

    def walk(low: int, high: int, place: list[str] | None, listed: bool) -> None:
        nonlocal outline
        for kind, head, a, b in atoms(data, low, high):
            if kind == 1011 and listed:
                outline.append([])
            elif (t := said(kind, a, b)) is not None:
                target = (outline[-1] if outline else None) if listed else place
                if t and target is not None:
                    target.append(t)
            elif kind == 1006:
                drawn.append([])
                walk(a, b, drawn[-1], False)
            elif head & 15 == 15 and (kind != 4080 or head >> 4 == 0):
                walk(a, b, place, listed or kind == 4080)

    walk(0, len(data), None, False)
    for n in range(max(len(outline), len(drawn))):
        parts = dict.fromkeys([*(outline[n] if n < len(outline) else []), *(drawn[n] if n < len(drawn) else [])])
        if parts:
            out.add("\n".join(parts), slide=n + 1)
    if "EncryptedSummary" in file.streams:
        out.needs.append(LOCKED)
    return out


def shared_strings(parts: list[bytes]) -> list[str]:
    """The strings of an SST record and what continues it; a string may go on in the next, under flags of its own."""
    seg, at, out = 0, 8, []
    total = struct.unpack_from("<I", parts[0], 4)[0]

    def take(n: int) -> bytes:
        nonlocal seg, at
        got = b""
        while n > len(got) and seg < len(parts):
            piece = parts[seg][at : at + n - len(got)]
            got, at = got + piece, at + len(piece)
            if at >= len(parts[seg]) and len(got) < n:
                seg, at = seg + 1, 0
        return got

    for _ in range(total):
        head = take(3)
        if len(head) < 3:
            break
        left, flags = struct.unpack("<HB", head)
        skip = (4 * struct.unpack("<H", take(2))[0] if flags & 8 else 0) + (struct.unpack("<I", take(4))[0] if flags & 4 else 0)
        text = ""
        while left:
            if seg < len(parts) and at >= len(parts[seg]):
                seg, at = seg + 1, 1
                if seg >= len(parts):
                    break
                flags = parts[seg][0]
            wide = 2 if flags & 1 else 1
            n = min(left, (len(parts[seg]) - at) // wide)
            if not n:
                break
            text += parts[seg][at : at + n * wide].decode("utf-16-le" if wide == 2 else "latin-1", "replace")
            left, at = left - n, at + n * wide
        take(skip)
        out.append(text)
    return out


def packed_number(rk: int) -> float:
    """An RK value: a short double or a whole number, by a hundred or not."""
    value = float((rk ^ 0x80000000) - 0x80000000 >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def short_text(data: bytes, at: int, wide_count: bool) -> str:
    count, flags = struct.unpack_from("<HB" if wide_count else "<BB", data, at)
    at += 3 if wide_count else 2
    return data[at : at + count * 2].decode("utf-16-le", "replace") if flags & 1 else data[at : at + count].decode("latin-1")


def workbook97(file: Compound) -> Parsed:
    """The visible sheets of an Excel 97 file as lettered grids."""
    data, out = file.read("Workbook" if "Workbook" in file.streams else "Book"), Parsed("sheet")

    def records(at: int) -> Iterator[tuple[int, bytes]]:
        while at + 4 <= len(data):
            kind, size = struct.unpack_from("<HH", data, at)
            yield kind, data[at + 4 : at + 4 + size]
            at += 4 + size

    sheets, strings, last = [], [], 0
    for kind, body in records(0):
        if kind == 0x2F:
            out.needs.append(LOCKED)
            return out
        if kind == 0x85:
            place, state = struct.unpack_from("<IH", body)
            sheets.append((short_text(body, 6, False), place, state & 3, state >> 8))
        elif kind == 0xFC or kind == 0x3C and last == 0xFC:
            strings.append(body)
            kind = 0xFC
        elif kind == 0x0A:
            break
        last = kind
    words = shared_strings(strings) if strings else []
    for title, place, hidden, sort in sheets:
        if sort:
            continue
        if hidden:
            out.needs.append(f"hidden sheet {title} not read")
            continue
        grid: dict[int, dict[int, str]] = {}
        asked = None
        for kind, body in records(place):
            if kind == 0x0A:
                break
            if kind == 0x207 and asked:
                grid.setdefault(asked[0], {})[asked[1]] = short_text(body, 0, True)
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x205):
                continue
            r, c = struct.unpack_from("<HH", body)
            put = lambda v, r=r, c=c: grid.setdefault(r, {}).__setitem__(c, v)
            if kind == 0xFD and (k := struct.unpack_from("<I", body, 6)[0]) < len(words):
                put(words[k])
            elif kind == 0x203:
                put(number(repr(struct.unpack_from("<d", body, 6)[0])))
            elif kind == 0x27E:
                put(number(repr(packed_number(struct.unpack_from("<I", body, 6)[0]))))
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    grid.setdefault(r, {})[c + k] = number(repr(packed_number(struct.unpack_from("<I", body, 6 + 6 * k)[0])))
            elif kind == 0x204:
                put(short_text(body, 6, True))
            elif kind == 0x205 and not body[7]:
                put("TRUE" if body[6] else "FALSE")
            elif kind == 0x06:
                asked = (r, c) if body[12:14] == b"\xff\xff" and body[6] == 0 else None
                if body[12:14] != b"\xff\xff":
                    put(number(repr(struct.unpack_from("<d", body, 6)[0])))
        rows = [(r + 1, [cell(v) if (v := got.get(k, "")) else "" for k in range(max(got) + 1)]) for r, got in sorted(grid.items())]
        if rows:
            out.add(lettered(rows), sheet=title)
    return out


def outlook(file: Compound) -> Parsed:
    """Headers, body and attachments of an Outlook message."""
    out = Parsed("mail")

    def text(tag: str, base: str = "") -> str:
        for kind, name in (("001F", "utf-16-le"), ("001E", None)):
            if (path := f"{base}__substg1.0_{tag}{kind}") in file.streams:
                raw = file.read(path)
                return (raw.decode(name, "replace") if name else decoded(raw)).rstrip("\0")
        return ""

    person, address = text("0C1A"), text("0C1F")
    sender = " ".join(x for x in (person, f"<{address}>" if address else "") if x)
    out.add("\n".join(f"{k}: {v}" for k, v in (("From", sender), ("To", text("0E04")), ("Cc", text("0E03")), ("Subject", text("0037"))) if v), "metadata")
    if body := text("1000").strip():
        out.add(body)
    elif "__substg1.0_10130102" in file.streams:
        from .parsers import web_text

        out.add(web_text(decoded(file.read("__substg1.0_10130102"))))
    bases = sorted({p.partition("/")[0] + "/" for p in file.streams if p.startswith("__attach_version1.0_")})
    for n, base in enumerate(bases, 1):
        name = text("3707", base) or text("3704", base)
        if f"{base}__substg1.0_37010102" in file.streams:
            out.children.append((member_name(name, n), file.read(f"{base}__substg1.0_37010102")))
        else:
            out.needs.append(f"attachment {n} not read (an embedded message)")
    return out


def hangul(file: Compound) -> Parsed:
    """The paragraphs of each section of an HWP 5."""
    out, head = Parsed("office"), file.read("FileHeader")
    flags = struct.unpack_from("<I", head, 36)[0]
    if flags & 6:
        out.needs.append(LOCKED if flags & 2 else "not read (a distribution copy)")
        return out
    order = sorted((p for p in file.streams if re.fullmatch(r"BodyText/Section\d+", p)), key=lambda p: int(re.search(r"\d+$", p)[0]))
    for n, path in enumerate(order, 1):
        data = file.read(path)
        data = zlib.decompress(data, -15) if flags & 1 else data
        at, lines = 0, []
        while at + 4 <= len(data):
            word = struct.unpack_from("<I", data, at)[0]
            tag, size, at = word & 0x3FF, word >> 20, at + 4
            if size == 0xFFF:
                size, at = struct.unpack_from("<I", data, at)[0], at + 4
            if tag == 66:
                lines.append("")
            elif tag == 67 and lines:
                lines[-1] = controlled(data[at : at + size])
            at += size
        if any(lines):
            out.add("\n".join(f"{k}| {t}" for k, t in enumerate(lines, 1) if t), section=n)
    return out


def controlled(raw: bytes) -> str:
    """Text units without control units; most controls take eight."""
    units, out, k = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2]), [], 0
    while k < len(units):
        u = units[k]
        if u >= 32:
            out.append(struct.pack("<H", u))
        elif u in (10, 9):
            out.append(struct.pack("<H", 32 if u == 10 else 9))
        k += 1 if u >= 32 or u in (0, 10, 13) or 24 <= u <= 31 else 8
    return b"".join(out).decode("utf-16-le", "replace").strip()


def metafile(name: str, data: bytes) -> Parsed:
    """Texts that an EMF or WMF draws; runs on one baseline are one line."""
    runs: list[tuple[int, str]] = []
    if data[40:44] == b" EMF":
        at = 0
        while at + 8 <= len(data):
            kind, size = struct.unpack_from("<II", data, at)
            if size < 8:
                break
            if kind in (83, 84) and at + 52 <= len(data):
                y, count, start = struct.unpack_from("<iII", data, at + 40)
                raw = data[at + start : at + start + count * (2 if kind == 84 else 1)]
                runs.append((y, raw.decode("utf-16-le" if kind == 84 else "cp1252", "replace")))
            at += size
    else:
        at = (22 if data[:4] == b"\xd7\xcd\xc6\x9a" else 0) + 18
        while at + 6 <= len(data):
            words, kind = struct.unpack_from("<IH", data, at)
            body = data[at + 6 : at + 2 * words]
            if kind == 0x0521 and len(body) >= 6:
                n = struct.unpack_from("<H", body)[0]
                runs.append((struct.unpack_from("<h", body, 2 + n + n % 2)[0], body[2 : 2 + n].decode("cp1252", "replace")))
            elif kind == 0x0A32 and len(body) >= 8:
                y, _, n, options = struct.unpack_from("<hhHH", body)
                start = 16 if options & 6 else 8
                runs.append((y, body[start : start + n].decode("cp1252", "replace")))
            if words < 3:
                break
            at += 2 * words
    lines: list[list] = []
    for y, t in runs:
        if lines and lines[-1][0] == y:
            lines[-1][1] += t
        elif t.strip():
            lines.append([y, t])
    out = Parsed("image")
    return numbered(out, list(enumerate((t for _, t in lines), 1))) if lines else Parsed("image", needs=["no text found"])


FIXED6 = dict(zip(range(0xF0, 0x100), (4, 5, 3, 3, 3, 3, 4, 4, 4, 5, 5, 6, 6, 8, 8, 1), strict=True))
FIXED5 = {0xC0: 4, 0xC1: 9, 0xC2: 11, 0xC3: 3, 0xC4: 3, 0xC5: 5, 0xC6: 6, 0xC7: 7}


def wordperfect(name: str, data: bytes) -> Parsed:
    """The text of a WordPerfect 5 or 6 document; functions are stepped over by their lengths."""
    at, locked = struct.unpack_from("<I", data, 4)[0], struct.unpack_from("<H", data, 12)[0]
    if locked:
        return Parsed("office", needs=[LOCKED])
    six, out = data[10] >= 2, []
    while at < len(data):
        b = data[at]
        step = 1
        if 0x21 <= b < 0x7F or b == 0x20 and not six:
            out.append(chr(b))
        elif six and b in (0x80, 0x81) or not six and b in (0x0D, 0xA0):
            out.append(" ")
        elif b in (0x84, 0xA9, 0xAA):
            out.append("-")
        elif six and b in (0xCC, 0xB9, 0xC7) or not six and b in (0x0A, 0x0C):
            out.append("\n")
        elif six and b == 0xCF:
            out.append(" ")
        elif (FIXED6 if six else FIXED5).get(b):
            step = (FIXED6 if six else FIXED5)[b]
        elif b >= 0xD0 and at + 4 <= len(data):
            size = struct.unpack_from("<H", data, at + 2)[0]
            if six and b == 0xD0:
                out.append("\n" if data[at + 1] in (4, 5, 6, 7, 8, 9, 10, 19, 20, 21, 22, 23, 24, 25) else " ")
            step = max(4, size) if six else 4 + size
        at += step
    lines = [(n, t.strip()) for n, t in enumerate("".join(out).split("\n"), 1) if t.strip()]
    return numbered(Parsed("office"), lines) if lines else Parsed("office", needs=["no text found"])


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def fields(data: bytes) -> dict[int, list]:
    """The fields of a message: whole numbers, bytes."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a message")
        out.setdefault(key >> 3, []).append(value)
    return out


def snappy(data: bytes, most: int = 64 << 20) -> bytes:
    """a raw block: literals and copies from what came before."""
    size, at = varint(data, 0)
    if size > most:
        raise ValueError("a block is too large")
    out = bytearray()
    while at < len(data):
        tag, at = data[at], at + 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                wide = n - 59
                n, at = int.from_bytes(data[at : at + wide], "little"), at + wide
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back, at = (tag >> 2 & 7) + 4, (tag & 0xE0) << 3 | data[at], at + 1
        else:
            wide = 2 if tag & 3 == 2 else 4
            n, back, at = (tag >> 2) + 1, int.from_bytes(data[at : at + wide], "little"), at + wide
        if not 0 < back <= len(out):
            raise ValueError("a copy from outside the block")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("a block of another size than it says")
    return bytes(out)


def decimal128(raw: bytes):
    """a decimal of 16 bytes: 113 bits of digits, a biased power of ten, a sign."""
    from decimal import Decimal

    value = int.from_bytes(raw, "little")
    power = (value >> 113 & 0x3FFF) - 6176
    digits = value & ((1 << 113) - 1)
    return Decimal((value >> 127, tuple(map(int, str(digits))), power))


def archives(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of the objects in an IWA file."""
    at, body = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        body.append(snappy(data[at + 4 : at + 4 + size]))
        at += 4 + size
    plain, at = b"".join(body), 0
    while at < len(plain):
        size, at = varint(plain, at)
        info, at = fields(plain[at : at + size]), at + size
        for m in info.get(2, []):
            own = fields(m)
            size = own.get(3, [0])[0]
            yield own.get(1, [0])[0], plain[at : at + size]
            at += size


def iwork(name: str, data: bytes) -> Parsed:
    """Texts of Pages, Keynote and Numbers, and the words of tables; the older packages by their XML."""
    out = Parsed("office")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if any(n.endswith(".iwph") for n in names):
            out.needs.append(LOCKED)
            return out
        old = next((n for n in names if re.fullmatch(r"index\.(xml|apxl)(\.gz)?", n)), None)
        if old:
            raw = checked(z, old)
            root = tree(gzip.decompress(raw) if old.endswith(".gz") else raw)
            return old_iwork(out, root)
        inner = next((n for n in names if n.endswith("Index.zip")), None)
        parts = zipfile.ZipFile(io.BytesIO(checked(z, inner))) if inner else z
        words: list[str] = []
        k = 0
        for part in sorted((n for n in parts.namelist() if n.endswith(".iwa")), key=lambda n: (not n.endswith("Document.iwa"), n)):
            for kind, body in archives(checked(parts, part)):
                if kind in (2001, 2005):
                    said = "".join(t.decode("utf-8", "replace") for t in fields(body).get(3, []) if isinstance(t, bytes))
                    if said := re.sub("[\u0004\u0005￼]", "", said.replace(" ", "\n")).strip():
                        k += 1
                        out.add("\n".join(f"{n}| {t}" for n, t in enumerate(said.split("\n"), 1) if t.strip()), para=k)
                elif kind == 6005:
                    words += [t.decode("utf-8", "replace") for e in fields(body).get(3, []) if isinstance(e, bytes) for t in fields(e).get(3, []) if isinstance(t, bytes)]
        if words:
            out.add("\n".join(cell(w) for w in words), "sample", sheet="tables")
            out.needs.append("numbers and the places of table cells not read")
    return out


def old_iwork(out: Parsed, root: ET.Element) -> Parsed:
    said = lambda e: re.sub(r"\s+", " ", "".join(e.itertext())).strip()
    pages = [e for e in root.iter() if local(e) == "slide"]
    if pages:
        for n, s in enumerate(pages, 1):
            if body := "\n".join(t for p in s.iter() if local(p) == "p" and (t := said(p))):
                out.add(body, slide=n)
        return out
    lines = [(n, t) for n, t in enumerate((said(p) for p in root.iter() if local(p) == "p"), 1) if t]
    return numbered(out, lines) if lines else out
