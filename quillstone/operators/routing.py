"""Routing of inputs by name and first bytes, all as Column expressions over a head of the content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 8192
KINDS = {
    "text": [".txt", ".md", ".log", ".rst", ".py", ".c", ".h", ".java", ".sh", ".vcf", ".ics"], "table": [".csv", ".tsv", ".jsonl", ".parquet", ".arrow", ".feather"], "pdf": [".pdf"], "html": [".html", ".htm"], "sheet": [".xlsx", ".ods", ".xlsm"],
    "office": [".docx", ".pptx", ".odt", ".odp", ".hwpx", ".rtf", ".epub"], "notebook": [".ipynb"], "mail": [".eml", ".mbox", ".msg"], "subtitle": [".srt", ".vtt", ".ass", ".ssa"], "archive": [".zip", ".tar", ".tar.gz", ".tgz", ".gz", ".bz2", ".xz"],
    "database": [".sqlite", ".db"], "image": [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".tiff"], "audio": [".mp3", ".wav", ".flac", ".m4a"], "video": [".mp4", ".mkv", ".mov", ".webm"], "package": ["datapackage.json"],
}
ROUTES = {suffix: kind for kind, every in KINDS.items() for suffix in every}
#: Ordered: the first that fits decides.
MAGIC = [("zip", ["504B0304"]), ("pdf", ["25504446"]), ("image", ["89504E47", "FFD8FF", "47494638"]), ("gzip", ["1F8B"]), ("sqlite", ["53514C69746520"]), ("arrow", ["4152524F5731"]), ("parquet", ["50415231"]), ("program", ["7F454C46", "CAFEBABE", "4D5A9000", "CFFAEDFE"]), ("ole", ["D0CF11E0"])]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def is_binary(content) -> Column:
    """A zero byte, or over one control byte in twenty, in the first 4096."""
    head = F.decode(F.substring(_col(content), 1, 4096), "iso-8859-1")
    odd = F.length(head) - F.length(F.regexp_replace(head, "[\u0001-\u0008\u000e-\u001a\u001c-\u001f]", ""))
    return F.contains(head, F.lit("\u0000")) | F.coalesce(odd > F.length(head) * 0.05, F.lit(False))


def sniffed(content) -> Column:
    """S04 S08 S132: the kind that the first bytes tell."""
    c = F.substring(_col(content), 1, HEAD)
    out = None
    for kind, heads in MAGIC:
        hit = F.startswith(c, F.unhex(F.lit(heads[0])))
        for h in heads[1:]:
            hit = hit | F.startswith(c, F.unhex(F.lit(h)))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    page = F.lower(F.decode(F.substring(c, 1, 512), "iso-8859-1")).rlike(r"^\s*(<!doctype html|<html)")
    return out.when(page, "html").when(~is_binary(c), "text").otherwise("unknown")


def suffix_of(name) -> Column:
    """The longest registered suffix, else the last one, in lower case."""
    low = F.lower(_col(name))
    double = F.regexp_extract(low, r"(\.tar\.(?:gz|bz2|xz))$", 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(low, r"(\.[^./]+)$", 1))


def kind_of(name) -> Column:
    """The kind that a name's suffix is registered for; a map literal, no join."""
    routes = F.create_map(*(F.lit(x) for pair in (ROUTES | {".tar.bz2": "archive", ".tar.xz": "archive"}).items() for x in pair))
    return F.coalesce(F.try_element_at(routes, suffix_of(name)), F.lit("unknown"))


def url_suffix(url) -> Column:
    """F32: the suffix of a URL's path, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(F.parse_url(_col(url), F.lit("PATH")), F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))


def url_kind(url, head) -> Column:
    """S121: html, media or file, by the first bytes, then by the suffix."""
    sniff = sniffed(head)
    suffix = url_suffix(url)
    media = [s for k in ("audio", "video") for s in KINDS[k]]
    return F.when(sniff == "html", "html").when(suffix.isin(*media), "media").when(suffix.isin(".html", ".htm", ".php", ".asp"), "html").otherwise("file")


def in_ranges(page: Column, ranges: str) -> Column:
    """Pages like 1,3-5,20- as comparisons, which push down to the scan."""
    out = F.lit(False)
    for part in ranges.split(","):
        low, dash, high = part.strip().partition("-")
        if not dash:
            out = out | (page == int(low))
        elif high:
            if int(high) < int(low):
                raise ValueError(f"pages {part} run backwards")
            out = out | page.between(int(low or 1), int(high))
        else:
            out = out | (page >= int(low))
    return out
