"""Charts and diagrams of office packages, and pictures by their headers."""

from __future__ import annotations

import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

from .parsers import Parsed, cell, checked, letter, local, tree

#: First bytes (at a place) of media containers: (place, bytes, kind).
MAGIC = [
    (0, b"\x89PNG\r\n\x1a\n", "image/png"), (0, b"GIF8", "image/gif"), (0, b"\xff\xd8\xff", "image/jpeg"), (8, b"WEBP", "image/webp"), (0, b"BM", "image/bmp"), (0, b"II*\0", "image/tiff"), (0, b"MM\0*", "image/tiff"),
    (4, b"ftyp", "video/mp4"), (0, b"\x1aE\xdf\xa3", "video/webm"), (8, b"WAVE", "audio/wav"), (8, b"AVI ", "video/avi"), (0, b"ID3", "audio/mpeg"), (0, b"fLaC", "audio/flac"), (0, b"OggS", "audio/ogg"),
]


def media_kind(head: bytes) -> str | None:
    """P20 S130: the kind of a picture or recording by its first bytes; an MP4 that is sound alone says so in its brand."""
    for place, mark, kind in MAGIC:
        if head[place : place + len(mark)] == mark:
            return "audio/mp4" if kind == "video/mp4" and head[8:11] in (b"M4A", b"M4B") else kind
    return None


def picture_size(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, frames) of a picture, from its headers."""
    kind = media_kind(data[:16])
    if kind == "image/png" and len(data) >= 24:
        animated = re.search(rb"acTL(.{4})", data[:4096], re.S)
        return (*struct.unpack_from(">II", data, 16), int.from_bytes(animated[1], "big") if animated else 1)
    if kind == "image/gif" and len(data) >= 13:
        return (*struct.unpack_from("<HH", data, 6), max(1, gif_frames(data)))
    if kind == "image/bmp" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h), 1
    if kind == "image/jpeg":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h, 1
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + struct.unpack_from(">H", data, at + 2)[0]
    if kind == "image/webp" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), max(1, data.count(b"ANMF"))
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
        w, h = struct.unpack_from("<HH", data, 26)
        return w & 0x3FFF, h & 0x3FFF, 1
    if kind == "image/tiff":
        return tiff_size(data)
    return None


def gif_frames(data: bytes) -> int:
    at, frames = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0), 0

    def skipped(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    while at < len(data):
        if data[at] == 0x21:
            at = skipped(at + 2)
        elif data[at] == 0x2C and at + 10 <= len(data):
            frames += 1
            flags = data[at + 9]
            at = skipped(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            break
    return frames


def tiff_size(data: bytes) -> tuple[int, int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    at, first, pages, seen = struct.unpack_from(f"{order}I", data, 4)[0], None, 0, set()
    while at and at + 2 <= len(data) and at not in seen:
        seen.add(at)
        pages += 1
        n, sides = struct.unpack_from(f"{order}H", data, at)[0], {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", data, at + 2 + 12 * k)
            if tag in (256, 257):
                sides[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, at + 10 + 12 * k)[0]
        first = first or (sides.get(256, 0), sides.get(257, 0))
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
    return (*first, pages) if first else None


def picture(name: str, data: bytes) -> Parsed:
    """What a picture is; its text needs a reader that isn't here, and its row says so."""
    out = Parsed("image", needs=["not read (needs a picture reader)"])
    if size := picture_size(data):
        w, h, frames = size
        out.add(f"{w} x {h} px" + (f", {frames:,} frames" if frames > 1 else ""), "metadata")
    elif media_kind(data[:16]) is None:
        out.error = "not a picture"
    return out


def sealed(data: bytes) -> bool:
    """S112 X03: a PDF or package that is locked; such files are never handed on to another reader."""
    if data.startswith(b"%PDF"):
        return b"/Encrypt" in data[-4096:] or b"/Encrypt" in data[:4096]
    return data.startswith(b"\xd0\xcf\x11\xe0") and "EncryptedPackage".encode("utf-16-le") in data


def points(series: ET.Element, tag: str) -> dict[int, str]:
    """The cached points of one part of a series, by their index."""
    part = next((e for e in series if local(e) == tag), None)
    return {} if part is None else {int(p.get("idx", 0)): "".join(v.text or "" for v in p if local(v) == "v") for p in part.iter() if local(p) == "pt"}


def chart_table(root: ET.Element) -> tuple[list[str], list[list[str | None]]]:
    """Columns and rows of a chart: a row for each index of any series; its label is the first category there."""
    every = [e for e in root.iter() if local(e) == "ser"]
    titles = []
    for n, s in enumerate(every, 1):
        title = next((e for e in s if local(e) == "tx"), None)
        titles.append(("".join(v.text or "" for v in title.iter() if local(v) == "v") if title is not None else "") or f"series {n}")
    names = [points(s, "cat") or points(s, "xVal") for s in every]
    values = [points(s, "val") or points(s, "yVal") for s in every]
    rows = []
    for k in sorted({k for p in [*names, *values] for k in p}):
        rows.append([next((p[k] for p in names if p.get(k)), str(k + 1)), *(v.get(k) for v in values)])
    return ["category", *titles], rows


def outline(root: ET.Element) -> list[str]:
    """The points of a diagram as an indented list, children in the order of their links."""
    texts, links, children = {}, {}, set()
    for e in root.iter():
        if local(e) == "pt" and e.get("type", "node") in ("node", "doc", "asst"):
            texts[e.get("modelId")] = re.sub(r"\s+", " ", " ".join(t.text or "" for t in e.iter() if local(t) == "t")).strip()
        elif local(e) == "cxn" and e.get("type", "parOf") == "parOf":
            links.setdefault(e.get("srcId"), []).append((int(e.get("srcOrd", 0)), e.get("destId")))
            children.add(e.get("destId"))
    out: list[str] = []
    todo = [(k, 0) for k in reversed([k for k in texts if k not in children])]
    seen = set()
    while todo:
        k, depth = todo.pop()
        if k in seen:
            continue
        seen.add(k)
        if texts.get(k):
            out.append("  " * depth + "- " + texts[k])
            depth += 1
        todo += [(d, depth) for _, d in sorted(links.get(k, []), reverse=True)]
    return out


def related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that the relationships of a part lead to, by id; external ones are left out, as are parts that aren't there."""
    folder, _, own = part.rpartition("/")
    names = set(z.namelist())
    if (listed := f"{folder}/_rels/{own}.rels") not in names:
        return {}
    every = {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target") or "")).lstrip("/") for r in tree(checked(z, listed)) if r.get("TargetMode") != "External"}
    return {k: v for k, v in every.items() if v in names}


def relation(e: ET.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), None)


def anchored(z: zipfile.ZipFile) -> tuple[dict[str, dict], list[tuple[dict, str]]]:
    """Of a workbook's visible sheets, the sheet and anchor cell of each chart part, and of each shape with its text."""
    charts: dict[str, dict] = {}
    shapes: list[tuple[dict, str]] = []
    if "xl/workbook.xml" not in z.namelist():
        return charts, shapes
    sheets = related(z, "xl/workbook.xml")
    for s in (e for e in tree(checked(z, "xl/workbook.xml")).iter() if local(e) == "sheet" and e.get("state", "visible") == "visible"):
        for drawing in (p for p in related(z, sheets.get(relation(s), "")).values() if re.search(r"drawings/[^/]+\.xml$", p)):
            links = related(z, drawing)
            for a in tree(checked(z, drawing)):
                at = {local(e): int(e.text or 0) for start in a if local(start) == "from" for e in start if local(e) in ("col", "row")}
                place = {"sheet": s.get("name")} | ({"anchor": f"{letter(at['col'] + 1)}{at['row'] + 1}"} if len(at) == 2 else {})
                for e in a.iter():
                    if local(e) == "chart" and (part := links.get(relation(e))):
                        charts.setdefault(part, place)
                    elif local(e) == "sp":
                        lines = ["".join(t.text or "" for t in p.iter() if local(t) == "t").strip() for p in e.iter() if local(p) == "p"]
                        if text := "\n".join(x for x in lines if x):
                            shapes.append((place, text))
    return charts, shapes


def drawings(z: zipfile.ZipFile, out: Parsed) -> Parsed:
    """Charts and diagrams of a package as blocks, its pictures as members."""
    names = z.namelist()
    places, shapes = anchored(z)
    number = lambda n: (re.sub(r"\d+", "", n), int((re.findall(r"\d+", n) or ["0"])[-1]))
    for n, part in enumerate(sorted((x for x in names if re.fullmatch(r"(word|ppt|xl)/charts/chart\d+\.xml", x)), key=number), 1):
        columns, rows = chart_table(tree(checked(z, part)))
        if rows:
            out.add("\n".join([f"chart {n}", "columns| " + " | ".join(map(cell, columns)), *(" | ".join("" if v is None else cell(v) for v in r) for r in rows)]), "sample", **(places.get(part) or {"anchor": f"chart{n}"}))
    for n, part in enumerate(sorted((x for x in names if re.fullmatch(r"(word|ppt|xl)/diagrams/data\d+\.xml", x)), key=number), 1):
        if lines := outline(tree(checked(z, part))):
            out.add("\n".join(lines), anchor=f"diagram{n}")
    for place, text in shapes:
        out.add(text, **place)
    left = 256 << 20
    seen = set()
    for part in sorted((x for x in names if re.fullmatch(r"(word|ppt|xl)/media/[^/]+|Pictures/[^/]+|BinData/[^/]+", x)), key=number):
        try:
            body = checked(z, part)
        except (ValueError, zipfile.BadZipFile) as e:
            out.needs.append(f"{part} not read ({e})")
            continue
        if body in seen:
            continue
        seen.add(body)
        if len(body) > left:  # W17: what doesn't fit is passed over, smaller ones still count
            out.needs.append(f"{part} not read (over the limit of pictures)")
            continue
        left -= len(body)
        out.children.append((part.rpartition("/")[2], body))
    return out
