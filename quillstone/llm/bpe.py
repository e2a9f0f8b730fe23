"""Byte-level BPE: texts to ids by a public rank file, ids to bytes.

A text is cut by the pattern of the rank files; every distinct piece is encoded once in a worker and kept in a bounded
table, so that a piece that a third of all texts hold costs one merge. Merging takes the pair of the lowest rank, the
leftmost of equals, until no pair has a rank: a short piece by repeated search, a long one (a text may be one piece of a
million characters) by a heap over a linked list, so that time grows as n log n and memory as n. Decoding concatenates
the pieces of the ids.

`native_pieces` is the same fold in Spark's higher-order functions over a literal rank map, for tables of distinct
pieces. It takes some milliseconds a piece in the interpreted lambdas, which is beyond the limits for whole corpora, so
the query encodes in Python workers; README.md has the figures.

Nulls and empty texts have no ids. Rows repeated come out as often as they came in; null doc_ids are kept; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_arrow

#: Pieces that a worker keeps.
KEPT = 400_000
#: Bytes from which a piece is merged by the heap.
LONG = 48


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def _ranges(wanted) -> str:
    out, start, last = [], None, None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and wanted(c):
            start, last = (c if start is None else start), c
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def cutter() -> re.Pattern:
    """The pattern of the rank files with its Unicode classes written out, so that the standard library's engine runs it."""
    letters = _ranges(lambda c: unicodedata.category(chr(c))[0] == "L")
    digits = _ranges(lambda c: unicodedata.category(chr(c))[0] == "N")
    blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{blank}{letters}{digits}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) >= LONG:
        return _merge_long(piece, ranks)
    # Bounds of the parts, and the rank of each part with the next one.
    get, none, n = ranks.get, len(ranks) + 1, len(piece)
    bounds = list(range(n + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        del bounds[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], none)
        if i < len(pairs):
            pairs[i] = get(piece[bounds[i] : bounds[i + 2]], none)
    return tuple([ranks[piece[i:j]] for i, j in pairwise(bounds)])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    get = ranks.get

    def pair(i: int):
        j = after[i]
        return get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pair(i)) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := pair(h)) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Coder:
    """A worker's encoder, with its table of pieces."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.table: dict[str, tuple[int, ...]] = {}
        self.cut = cutter().findall

    def encode(self, text: str) -> list[int]:
        pieces, table = self.cut(text), self.table
        fresh = set(pieces).difference(table)
        if len(table) + len(fresh) > KEPT:
            table.clear()
            fresh = set(pieces)
        for piece in fresh:
            table[piece] = merge(piece.encode(), self.ranks)
        ids = list(chain.from_iterable(map(table.__getitem__, pieces)))
        for piece in fresh:
            if len(piece) >= LONG:  # not kept, as their sizes have no bound
                del table[piece]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text)."""
    path = ranks or default_ranks()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        ids = [np.array(c.encode(x or ""), np.int32) for x in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return by_arrow(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", 4 << 20)


def decode(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids); null ids give no bytes."""
    path = ranks or default_ranks()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return by_arrow(coded.select("doc_id", "ids"), work, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, content binary", 4 << 20)


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids of each whole text and the bytes they decode to."""
    path = ranks or default_ranks()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        count, of_ids, of_bytes = [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.encode(text or "")
            count.append(len(ids))
            of_ids.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_arrow(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", 4 << 20)


BUCKETS = 16384


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: an array of small maps by crc32, as a lookup in one map would search it from end to end."""
    import zlib

    parts: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


def native_pieces(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(piece, ids) of (piece binary) in higher-order functions: a fold of ranked merges over the piece's bytes."""
    table = literal_ranks(ranks)

    def rank(part: Column) -> Column:
        return F.try_element_at(F.get(table, (F.crc32(part) % BUCKETS).cast("int")), F.hex(part))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.coalesce(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.lit(1 << 30)))
        best = F.array_min(pairs)
        at = F.array_position(pairs, best).cast("int")
        joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, F.size(parts)))
        return F.when((F.size(parts) > 1) & (best < 1 << 30), joined).otherwise(parts)

    single = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda i: F.substring(F.col("piece"), i, F.lit(1)))
    folded = F.when(F.octet_length("piece") > 1, F.aggregate(F.sequence(F.lit(2), F.octet_length("piece")), single, step)).otherwise(F.array("piece"))
    return pieces.where("octet_length(piece) > 0").select("piece", F.transform(folded, rank).alias("ids"))


def coded(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """docs without text, with n_tokens and ids, in the place of columns of these names; each text is decoded from its ids and compared."""
    path = ranks or default_ranks()
    names = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        every = []
        for text in batch.column(0).to_pylist():
            ids = c.encode(text or "")
            if c.decode(ids) != (text or "").encode():
                raise ValueError("a text doesn't come back from its ids")
            every.append(np.array(ids, np.int32))
        sizes = np.array([len(x) for x in every], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        rest = [batch.column(k + 1) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*rest, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(every)))], [*names, "n_tokens", "ids"])

    kept = docs.select("text", *names)
    schema = T.StructType([*kept.schema.fields[1:], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return by_arrow(kept, work, schema, 4 << 20)
