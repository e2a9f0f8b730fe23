"""What a fetch needs to decide, without the network: robots rules, revalidation, redirects, folder confinement, encodings."""

from __future__ import annotations

import codecs
import os
import re
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

#: The largest body, the longest wait and the most redirects of a fetch.
MOST_BYTES, MOST_SECONDS, MOST_REDIRECTS = 20_000_000, 30, 5


def allowed(status: int | None, body: str, agent: str, url: str) -> bool:
    """S123: robots rules: a server's failure forbids all, a missing file allows all."""
    if status is None or status >= 500:
        return False
    if status >= 400:
        return True
    rules = RobotFileParser()
    rules.parse(body.splitlines())
    return rules.can_fetch(agent, url)


@dataclass
class Kept:
    """What a cache keeps of a page."""

    body: bytes = b""
    etag: str | None = None
    modified: str | None = None
    headers: dict[str, str] = field(default_factory=dict)

    def asked(self) -> dict[str, str]:
        """Headers that ask if the page has changed."""
        return {k: v for k, v in (("If-None-Match", self.etag), ("If-Modified-Since", self.modified)) if v}

    def after(self, status: int, headers: dict[str, str], body: bytes) -> tuple[Kept, bool]:
        """S120: what to keep after an answer, and whether the page changed; 304 keeps it, an error keeps nothing new."""
        low = {k.lower(): v for k, v in headers.items()}
        if status == 304:
            return Kept(self.body, low.get("etag", self.etag), low.get("last-modified", self.modified), self.headers), False
        if status >= 400:
            raise ValueError(f"HTTP {status}")
        if len(body) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES:,} bytes")
        return Kept(body, low.get("etag"), low.get("last-modified"), low), body != self.body


def followed(url: str, answers: dict[str, str], safe=lambda host: True) -> str:
    """S120 S122: the URL after its redirects (answers: URL to location); too many, loops and unsafe hosts raise."""
    seen = [url]
    while (target := answers.get(seen[-1])) is not None:
        after = urljoin(seen[-1], target)
        if urlsplit(after).scheme not in ("http", "https"):
            raise ValueError(f"redirect to {urlsplit(after).scheme or 'nothing'}")
        if not safe(urlsplit(after).hostname or ""):
            raise ValueError("redirect to an address that isn't public")
        if after in seen or len(seen) > MOST_REDIRECTS:
            raise ValueError("too many redirects")
        seen.append(after)
    return seen[-1]


def confined(folder: str, name: str) -> str | None:
    """A path inside the folder, or None: no scheme, root, parents, backslashes, hidden names or links that lead out."""
    if not name or re.match(r"[A-Za-z][\w+.-]*:|[/\\~]", name) or "\\" in name or any(p in ("", "..") or p.startswith(".") for p in name.split("/")):
        return None
    full = os.path.realpath(os.path.join(folder, name))
    return full if full.startswith(os.path.realpath(folder) + os.sep) else None


def text_codec(name: str | None) -> str:
    """The codec of a stated encoding: UTF-8 with an optional mark by default; codecs that aren't of text are refused."""
    if not name:
        return "utf-8-sig"
    try:
        info = codecs.lookup(name)
    except LookupError:
        raise ValueError(f"unknown encoding {name}") from None
    if not info._is_text_encoding:
        raise ValueError(f"{name} is no text encoding")
    return "utf-8-sig" if info.name == "utf-8" else info.name


def unescaped(text: str) -> str:
    r"""\uXXXX and \UXXXXXXXX as characters; pairs of surrogates join, halves alone stay as they are."""

    def one(m: re.Match) -> str:
        code = int(m[1] or m[2], 16)
        return m[0] if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)

    def pair(m: re.Match) -> str:
        return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)

    text = re.sub(r"\\u(d[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2})", pair, text, flags=re.I)
    return re.sub(r"\\u([0-9a-f]{4})|\\U([0-9a-f]{8})", one, text, flags=re.I if "\\U" not in text else 0)


def message_costs(data: bytes) -> list[int]:
    """The declared bytes of the bodies of an Arrow stream's messages, read from their headers alone."""
    import pyarrow as pa

    out, at = [], 0
    while at + 8 <= len(data):
        mark, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        if mark != 0xFFFFFFFF or not size:
            break
        try:
            message = pa.ipc.read_message(pa.BufferReader(data[at:]))
        except (pa.ArrowInvalid, OSError):
            break
        body = message.body.size if message.body is not None else 0
        out.append(body)
        at += 8 + size + body
    return out
