"""Column functions that render: citations, times, counts, cells, names. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What universal line splitting cuts on.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def split_lines(text) -> Column:
    """the lines of a text; what follows the last line end is a line only if it isn't empty."""
    lines = F.split(_col(text), LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def clock(seconds) -> Column:
    """HH:MM:SS.d, rounded half to even once, so that 59.96 carries."""
    tenths = F.rint(_col(seconds) * 10).cast("long")
    part = lambda x, n: F.when(F.length(x.cast("string")) < n, F.lpad(x.cast("string"), n, "0")).otherwise(x.cast("string"))
    return F.concat(part(F.floor(tenths / 36000), 2), F.lit(":"), part(F.floor(tenths % 36000 / 600), 2), F.lit(":"), part(F.floor(tenths % 600 / 10), 2), F.lit("."), (tenths % 10).cast("string"))


def span(start, end) -> Column:
    """@start-end."""
    return F.concat(F.lit("@"), clock(start), F.lit("-"), clock(end))


def coordinate(value) -> Column:
    """a whole number without a point, others with one decimal, half to even."""
    v = _col(value)
    return F.when(v == F.rint(v), v.cast("long").cast("string")).otherwise(F.bround(v, 1).cast("string"))


def cite(src) -> Column:
    """one line for a provenance struct; each field adds its part if it is set."""
    s = _col(src)
    has = lambda name: s[name].isNotNull()
    filled = lambda name: has(name) & (s[name] != "")
    tag = lambda name, mark, ok: F.when(ok, F.concat(F.lit(mark), s[name].cast("string")))
    members = F.array_join(F.transform(F.coalesce(s["parts"], F.array().cast("array<string>")), lambda p: F.concat(F.lit("#att="), p)), "")
    sheet = F.when(filled("sheet"), F.concat(F.lit("#"), s["sheet"], F.when(filled("cell"), F.concat(F.lit("!"), s["cell"])).otherwise(""))).when(filled("cell"), F.concat(F.lit("#cell="), s["cell"]))
    box = F.when(has("bbox"), F.concat(F.lit("@"), F.coalesce(s["unit"], F.lit("px")), F.lit("("), F.array_join(F.transform(s["bbox"], coordinate), ","), F.lit(")")))
    time = F.when(has("t"), span(s["t"][0], s["t"][1]))
    return F.concat_ws(
        "", s["path"], members, tag("anchor", "#", filled("anchor")), tag("section", "#s", has("section")), tag("page", "#p", has("page")), tag("slide", "#slide", has("slide")), tag("frame", "#frame", has("frame")),
        sheet, tag("para", "#para", has("para")), tag("ts", "#ts=", filled("ts")), tag("img", "#img", has("img")), box, time, tag("line", ":", has("line")),
    )


def escape_cell(text) -> Column:
    """pipes escaped, line ends made blanks."""
    return F.replace(F.replace(_col(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def sample_cell(text, most: int = 200) -> Column:
    """NULL, or the escaped text cut to `most` characters."""
    t = escape_cell(text)
    return F.when(_col(text).isNull(), "NULL").when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def value_cell(text) -> Column:
    """like sample_cell, with the string NULL in quotes."""
    return F.when(_col(text) == "NULL", '"NULL"').otherwise(sample_cell(text))


def blob_cell(data) -> Column:
    """F03 for bytes."""
    return F.when(_col(data).isNull(), "NULL").otherwise(F.concat(F.lit("<blob "), F.format_number(F.octet_length(_col(data)), 0), F.lit(" bytes>")))


def counted(n, noun: str) -> Column:
    """1 row, 1,000 rows."""
    return F.concat(F.format_number(_col(n), 0), F.lit(f" {noun}"), F.when(_col(n) == 1, "").otherwise("s"))


def not_read(n, what: str, why: str = "") -> Column:
    """what was left unread, and why."""
    return F.concat(F.format_number(_col(n), 0), F.lit(f" {what}"), F.when(_col(n) > 1, "s").otherwise(""), F.lit(" not read" + (f" ({why})" if why else "")))


def human_bytes(n) -> Column:
    """GiB and MiB with up to six digits, or bytes."""
    v = _col(n)
    short = lambda x: F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return F.when(v >= 1 << 30, F.concat(short(v / (1 << 30)), F.lit(" GiB"))).when(v >= 1 << 20, F.concat(short(v / (1 << 20)), F.lit(" MiB"))).otherwise(F.concat(v.cast("string"), F.lit(" bytes")))


def inflates(size, packed, ratio: int = 100, floor: int = 1 << 20) -> Column:
    """a member that unpacks to over `ratio` times its packed size, once it is large enough to matter."""
    return F.coalesce((_col(size) > floor) & (_col(size) > _col(packed) * ratio), F.lit(False))


def safe_name(text) -> Column:
    """runs of characters that a file name shouldn't have become one underscore."""
    return F.regexp_replace(_col(text), r"(?U)[^\w.\-]+", "_")


def member_name(raw, index) -> Column:
    """a path from an archive without drive, root, dots or blanks around its parts."""
    parts = F.split(F.replace(F.coalesce(_col(raw), F.lit("")), F.lit("\\"), F.lit("/")), "/")
    parts = F.when(parts[0].rlike("^[A-Za-z]:$"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\.+$"))
    return F.when(F.size(kept) == 0, F.concat(F.lit("attachment-"), _col(index).cast("string"))).otherwise(F.array_join(kept, "/"))


def flat_name(path) -> Column:
    """a relative path as one safe name."""
    return safe_name(F.replace(_col(path), F.lit("/"), F.lit("__")))


def work_name(url, tail: int = 71) -> Column:
    """the end of a URL's safe name and eight digits of its digest."""
    name = safe_name(url)
    return F.concat(F.substring(name, F.greatest(F.length(name) - tail + 1, F.lit(1)), F.lit(tail)), F.lit("_"), F.substring(F.sha2(_col(url).cast("binary"), 256), 1, 8))


def letters(n) -> Column:
    """a column's letters, A for 1; up to three letters."""
    v = _col(n).cast("int") - 1
    one = lambda x: F.char(x + 65)
    div = lambda x, d: F.floor(x / d).cast("int")
    return F.when(v < 26, one(v)).when(v < 702, F.concat(one(div(v - 26, 26)), one((v - 26) % 26))).otherwise(F.concat(one(div(v - 702, 676)), one(div(v - 702, 26) % 26), one((v - 702) % 26)))


def luminance(color) -> Column:
    """of gray, RGB or CMYK; no colour is black."""
    c = F.when(_col(color).isNull() | (F.size(_col(color)) == 0), F.array(F.lit(0.0))).otherwise(_col(color))
    rgb = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).when(F.size(c) == 4, rgb((1 - F.get(c, F.lit(0))) * (1 - F.get(c, F.lit(3))), (1 - F.get(c, F.lit(1))) * (1 - F.get(c, F.lit(3))), (1 - F.get(c, F.lit(2))) * (1 - F.get(c, F.lit(3))))).otherwise(rgb(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2))))


def cell_number(value, kind) -> Column:
    """a number of a table cell by its kind: 5 a time in seconds since 2001, 6 a truth value, others in plain digits."""
    v, k = _col(value), _col(kind)
    when = F.timestamp_seconds(v + 978307200)
    digits = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,9)").cast("string"), r"(\\.\\d*?)0+$", "$1"), r"\\.$", "")
    # A year of five digits or more is written with a plus sign by date_format.
    shown = F.ltrim(F.when(v % 86400 == 0, F.date_format(when, "yyyy-MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")), F.lit("+"))
    return F.when(k == 5, shown).when(k == 6, F.when(v != 0, "TRUE").otherwise("FALSE")).otherwise(digits)


def half_day_hour(hour, half) -> Column:
    """an hour with its half of the day as one of 24; without a half as it is."""
    h = _col(hour).try_cast("int")
    return F.when(_col(half).isin("PM", "오후"), h % 12 + 12).when(_col(half).isin("AM", "오전"), h % 12).otherwise(h)


def stamp(year, month, day, hour, minute) -> Column:
    """YYYY-MM-DD HH:MM."""
    return F.format_string("%04d-%02d-%02d %02d:%02d", *(_col(x).try_cast("int") for x in (year, month, day, hour, minute)))


def plain_html(text) -> Column:
    """An HTML text without scripts, styles, comments and tags, blanks squeezed."""
    t = F.regexp_replace(F.regexp_replace(_col(text), r"(?is)<script\b.*?</script\s*>", " "), r"(?is)<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def norm_words(text) -> Column:
    """word characters in lower case."""
    return F.lower(F.regexp_replace(_col(text), r"(?U)\W+", ""))


def clip(text, most: int = 10000) -> Column:
    """without terminal colours and embedded data, cut to `most` characters."""
    t = F.regexp_replace(_col(text), "\u001b\\[[0-9;]*[A-Za-z]", "")
    return F.substring(F.regexp_replace(t, r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+", "(data)"), 1, most)
