"""Removal of repeated byte strings, by suffix buckets over a cover of the corpus.

A byte goes if a string of WINDOW bytes that covers it also starts somewhere else. A full suffix array of the corpus does
not fit the disk, nor does an arithmetic difference cover of it (one position in eight for this length), so the cover is
taken from the content: of the CORE-byte strings inside a window the one whose middle hashes least is the window's core,
the leftmost of equals. Equal windows have equal cores at equal places, so every repeat meets in a bucket of suffixes that
start with the same core, and one position in a hundred is enough.

1. Every run of windows with one core gives a row: a hash of the core and one of all that the run covers. Rows that are
   equal inside a batch are repeats at once; the others are dealt out by core and streamed in order. A core that occurs
   once ends here, equal runs are repeats, and of each distinct run of a shared core one goes on.
2. Their bytes beside the core are fetched, and the suffix buckets are sorted one after the other: suffixes by the bytes
   right of the core, prefixes by those left of it. Long ties never compare again: the core is skipped, and the ranks of
   either side at each depth, from the longest common prefixes of neighbours, tell if two windows are equal. A bucket of
   over BUCKET distinct runs gives its windows to a grouped count instead, which needs no bucket in memory.
3. The repeats of each document are merged and cut out.

Hashes of runs have 128 bits together; windows that differ in part are compared by their bytes, those of buckets over BUCKET
by two 64-bit hashes of what is beside the core. A core that very many texts share costs its task a row for each MB of
input at most, which streams through sorted; of its distinct runs over BUCKET no task holds more than their windows' counts.

Nulls: a null text is empty bytes. Texts under WINDOW bytes stay whole. Rows with a null doc_id count as documents. Rows
repeated are repeats of each other. Extra columns are ignored by `digests` and kept by `cleaned`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, stored, texts_of

WINDOW, CORE = 400, 200
BUCKET = 100_000
#: Window starts of a text that are looked at in one go.
PIECE = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def runs_of(data: bytes, spans: list[tuple[int, int]], window: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts at `spans` of data: core start, first and last window start of each run, and the text's number."""
    spare = window - core
    raw = np.frombuffer(data, np.uint8)
    counts = np.array([max(0, b - a - window + 1) for a, b in spans], np.int64)
    keep = np.flatnonzero(counts)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    first = np.array([a for a, _ in spans], np.int64)
    begin = np.cumsum(counts) - counts
    windows = np.arange(total) + np.repeat((first - begin)[keep], counts[keep])
    text = np.repeat(keep, counts[keep])
    middle = min(core // 2, core - 8)
    grams = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw[middle:], (len(raw) - middle - 7, 8), (1, 1))).view("<u8")[:, 0]
    mixed = grams * _A
    mixed ^= mixed >> np.uint64(32)
    mixed *= _B
    mixed &= np.uint64(0xFFFFFFFF00000000)
    mixed |= np.arange(len(mixed), dtype=np.uint64)
    width = spare + 1
    padded = np.full(-(-(len(mixed) + width) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(mixed)] = mixed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    cores = (np.minimum(behind[windows], ahead[windows + spare]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(total, bool)
    fresh[1:] = (cores[1:] != cores[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], total) - 1
    return cores[at], windows[at], windows[last], text[at]


def run_rows(docs: DataFrame, window: int, core: int) -> DataFrame:
    """(h, full, dk, tk, at, low, high, seen) of each run of docs (dk, tk, content): core start, first and last window.

    seen is 1; 2 for one of runs that are equal inside a batch, all of which also come out with seen = 0 as repeats.
    """

    def work(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        spans, data, at = [], [], 0
        for _, _, _, x in parts:
            spans.append((at, at + len(x)))
            data.append(x)
            at += len(x)
        whole = b"".join(data)
        cores, low, high, text = runs_of(whole, spans, window, core)
        if not len(cores):
            return None
        view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(view[c : c + core]) for c in cores.tolist()), np.uint64, len(cores)).view(np.int64)
        full = np.fromiter((digest(view[a : b + window], (c - a << 24) + (b - a)) for c, a, b in zip(cores.tolist(), low.tolist(), high.tolist(), strict=True)), np.uint64, len(cores)).view(np.int64)
        shift = np.array([s - p[2] for (s, _), p in zip(spans, parts, strict=True)], np.int64)[text]
        dk, tk = (np.array([p[k] for p in parts], np.int64)[text] for k in (0, 1))
        _, firsts, inverse, times = np.unique(np.stack([h, full]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        many = times[inverse.ravel()] > 1
        probe = np.zeros(len(h), bool)
        probe[firsts] = True
        known = np.flatnonzero(many)
        spread = (dk[known] * 31 + low[known] * 1000003) ^ h[known]
        rows = [np.concatenate(x) for x in ((h[probe], spread), (full[probe], full[known]), (dk[probe], dk[known]), (tk[probe], tk[known]))]
        rows += [np.concatenate([(x - shift)[probe], (x - shift)[known]]) for x in (cores, low, high)]
        seen = np.concatenate([np.where(many, 2, 1)[probe], np.zeros(len(known), np.int64)])
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(seen.astype(np.int32))], ["h", "full", "dk", "tk", "at", "low", "high", "seen"])

    def run(rows):
        parts, n = [], 0
        for batch in batches(rows, 8 << 20):
            for dk, tk, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                for a in range(0, max(0, len(x) - window + 1), PIECE):
                    part = x if len(x) <= PIECE else x[a : a + PIECE + window - 1]
                    parts.append((dk, tk, a, part))
                    n += len(part)
                    if n >= 1 << 20:
                        if (out := work(parts)) is not None:
                            yield out
                        parts, n = [], 0
        if parts and (out := work(parts)) is not None:
            yield out

    return docs.select("dk", "tk", "content").mapInArrow(run, "h long, full long, dk long, tk long, at long, low long, high long, seen int")


def judged(rows: DataFrame) -> DataFrame:
    """(kind, h, dk, tk, at, low, high): kind 0, a run that is a repeat; kind 1, one of each distinct run of a shared core."""

    def run(chunks):
        held: np.ndarray | None = None  # the last row of what came before, not judged yet
        lead: np.ndarray | None = None  # the first row of the core at hand
        before: np.ndarray | None = None  # the row before the one held
        told = False

        def judge(block: np.ndarray, n: int, ended: bool):
            """Rows 0..n-1 of block; the row after them, if any, is there to look at."""
            nonlocal lead, before, told
            h, full, seen = block[:, 0], block[:, 1], block[:, 7]
            same = np.zeros(len(block) + 1, bool)
            equal = np.zeros(len(block) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            equal[1:-1] = same[1:-1] & (full[1:] == full[:-1])
            if before is not None:
                same[0] = before[0] == h[0]
                equal[0] = same[0] and before[1] == full[0]
            known = seen[:n] == 0
            repeat = known | (seen[:n] == 2) | equal[:n] | equal[1 : n + 1]
            out = [np.column_stack([np.zeros(int((repeat & (seen[:n] != 2)).sum()), np.int64), block[:n][repeat & (seen[:n] != 2)][:, [0, 2, 3, 4, 5, 6]]])]
            variant = ~equal[:n] & ~known
            starts = np.flatnonzero(~same[:n])
            group = np.cumsum(~same[:n]) - 1
            later = variant & same[:n]
            picks = np.flatnonzero(later)
            leads = []
            if len(picks):
                groups = np.unique(group[picks])
                for g in groups.tolist():
                    if g >= 0:
                        leads.append(block[starts[g]])
                    elif not told and lead is not None:
                        leads.append(lead)
                    if g == (group[-1] if n else -2):
                        told_last = True
                        break
                else:
                    told_last = False
            else:
                told_last = False
            if len(starts):
                lead, told = block[starts[-1]], told_last
            else:
                told = told or told_last
            chosen = block[:n][later]
            if leads:
                chosen = np.concatenate([chosen, np.stack(leads)])
            chosen = chosen[chosen[:, 7] != 0]
            out.append(np.column_stack([np.ones(len(chosen), np.int64), chosen[:, [0, 2, 3, 4, 5, 6]]]))
            if n:
                before = block[n - 1]
            result = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(result[:, k])) for k in range(7)], ["kind", "h", "dk", "tk", "at", "low", "high"])

        for batch in chunks:
            if not batch.num_rows:
                continue
            block = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)])
            if held is not None:
                block = np.concatenate([held, block])
            if len(block) > 1:
                yield judge(block, len(block) - 1, False)
            held = block[-1:]
        if held is not None:
            yield judge(held, 1, True)

    return rows.repartition("h").sortWithinPartitions("h", "full", "dk", "tk", "low").mapInArrow(run, "kind long, h long, dk long, tk long, at long, low long, high long")


def ranked(sides: list[bytes], sizes: np.ndarray, buckets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the sides in their buckets, and the longest common prefix of each with the one before (-1: a new bucket)."""
    width = -(-depth // 8) * 8
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in sides), np.uint8).reshape(len(sides), width)
    words = grid.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), buckets))
    common = np.full(len(sides), -1, np.int64)
    if len(sides) > 1:
        differ = grid[order[1:]] != grid[order[:-1]]
        length = np.where(differ.any(1), differ.argmax(1), width)
        length = np.minimum(length, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
        common[1:] = np.where(buckets[order[1:]] == buckets[order[:-1]], length, -1)
    return order, common


def repeats_in(buckets: np.ndarray, left: list[bytes], right: list[bytes], spare: int) -> np.ndarray:
    """For each run (row) and each count o of bytes left of the core (column), if that window is found in another run."""
    n = len(buckets)
    most = np.array([len(x) for x in left], np.int64)
    least = spare - np.array([len(x) for x in right], np.int64)
    by_left, lcp_left = ranked([x[::-1] for x in left], most, buckets, max(spare, 8))
    by_right, lcp_right = ranked(right, spare - least, buckets, max(spare, 8))
    hits = np.zeros((n, spare + 1), bool)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(spare + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) < 2:
            continue
        one[by_left], two[by_right] = np.cumsum(lcp_left < o), np.cumsum(lcp_right < spare - o)
        keys = one[rows] * (n + 1) + two[rows]
        order = np.argsort(keys, kind="stable")
        equal = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(rows), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hits[rows[order[twice]], o] = True
    return hits


def stretches(hits: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that the windows hit cover."""
    edges = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    _, past = np.nonzero(edges == -1)
    return row, at[row] - (past - 1), at[row] - first + window


def sorted_buckets(sides: DataFrame, window: int, core: int) -> DataFrame:
    """(dk, tk, low, high): the bytes that repeats cover, of runs (h, dk, tk, at, before, after)."""

    def run(chunks):
        held: list[pa.RecordBatch] = []
        n = 0

        def solve(table: pa.Table) -> pa.RecordBatch:
            h, dk, tk, at = (table.column(k).to_numpy() for k in range(4))
            left, right = ([x or b"" for x in table.column(k).to_pylist()] for k in (4, 5))
            hits = repeats_in(np.cumsum(np.append(True, h[1:] != h[:-1])), left, right, window - core)
            row, low, high = stretches(hits, at, window)
            return pa.RecordBatch.from_arrays([pa.array(dk[row]), pa.array(tk[row]), pa.array(low), pa.array(high)], ["dk", "tk", "low", "high"])

        for batch in chunks:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 20_000:
                continue
            table = pa.Table.from_batches(held)
            h = table.column(0).to_numpy()
            cut = n - int((h[::-1] != h[-1]).argmax()) if h[0] != h[-1] else 0
            if cut:
                yield solve(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
        if n:
            yield solve(pa.Table.from_batches(held))

    return sides.repartition("h").sortWithinPartitions("h").mapInArrow(run, "dk long, tk long, low long, high long")


def counted_windows(sides: DataFrame, window: int, core: int) -> DataFrame:
    """The same for buckets of any size: windows as rows, counted by two hashes."""
    spare = window - core

    def explode(chunks):
        for batch in batches(chunks, 1 << 18):
            out = []
            for h, dk, tk, at, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, after = before or b"", after or b""
                for o in range(spare - len(after), len(before) + 1):
                    key = before[len(before) - o :] + b"|" + after[: spare - o]
                    out.append((h, o, xxhash.xxh3_64_intdigest(key) - (1 << 63), xxhash.xxh3_64_intdigest(key, 1) - (1 << 63), dk, tk, at - o))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["h", "o", "one", "two", "dk", "tk", "low"])

    rows = stored(sides.mapInArrow(explode, "h long, o long, one long, two long, dk long, tk long, low long"), "windows")
    keys = ["h", "o", "one", "two"]
    twice = rows.groupBy(*keys).count().where("count > 1").drop("count")
    return rows.join(twice, keys).select("dk", "tk", "low", (F.col("low") + window).alias("high"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with dk, tk and content: the key of a row and its bytes."""
    return docs.withColumns({"dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "tk": F.xxhash64("text"), "content": F.coalesce(F.col("text").cast("binary"), F.lit(b""))})


def with_repeats(docs: DataFrame, work: Callable, schema: T.StructType | str, columns: list[str], window: int = WINDOW, core: int = CORE) -> DataFrame:
    """mapInArrow of work over the columns, dealt out by key, and `spans`: what goes, as (low, high), not merged yet."""
    own = keyed(docs)
    key = own.select("dk", "tk", "content")
    told = stored(judged(run_rows(key, window, core)), "runs")
    distinct = told.where("kind = 1").drop("kind")
    large = distinct.groupBy("h").count().where(F.col("count") > BUCKET).select("h")
    # Texts are dealt out by key once; both joins below read that one exchange.
    dealt = own.select("dk", "tk", "content", *[c for c in columns if c not in ("dk", "tk", "content")]).repartition("dk", "tk")
    wanted = distinct.groupBy("dk", "tk").agg(F.collect_list(F.struct("h", "at", "low", "high")).alias("wanted"))

    def sides(chunks):
        for batch in batches(chunks, 8 << 20):
            out = []
            for dk, tk, content, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    out.append((w["h"], dk, tk, w["at"], content[w["low"] : w["at"]], content[w["at"] + core : w["high"] + window]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)], ["h", "dk", "tk", "at", "before", "after"])

    beside = dealt.join(wanted, ["dk", "tk"]).select("dk", "tk", "content", "wanted").mapInArrow(sides, "h long, dk long, tk long, at long, before binary, after binary")
    if large.limit(1).count():
        large = stored(large, "large")
        beside = stored(beside, "beside")
        found = sorted_buckets(beside.join(large, "h", "left_anti"), window, core).union(counted_windows(beside.join(large, "h", "left_semi"), window, core))
    else:
        found = sorted_buckets(beside, window, core)
    every = told.where("kind = 0").select("dk", "tk", "low", (F.col("high") + window).alias("high")).union(found)
    spans = every.groupBy("dk", "tk").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return dealt.join(spans, ["dk", "tk"], "left").select("content", "spans", *columns).mapInArrow(work, schema)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def kept_bytes(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, high in spans:
        out.append(content[at:low])
        at = high
    return b"".join([*out, content[at:]])


def digests(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text)."""

    def work(chunks):
        for batch in batches(chunks, 8 << 20):
            out = []
            for content, spans, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = merged(spans)
                out.append((doc_id, len(content), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(content, gone)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"], window, core)


def whole_characters(content: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cover in part."""
    out = []
    for low, high in spans:
        while low < high and content[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(content) and content[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return out


def cleaned(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """docs, all columns, with the repeated strings cut out of text; a character is cut only as a whole."""
    names, at = docs.columns, docs.columns.index("text")
    clash = [c for c in names if c in ("dk", "tk", "content", "spans", "wanted")]
    if clash:
        plain = cleaned(docs.withColumnsRenamed({c: f"{c}__own" for c in clash}), window, core)
        return plain.withColumnsRenamed({f"{c}__own": c for c in clash})

    def work(chunks):
        for batch in batches(chunks, 8 << 20):
            text = [None if t is None else kept_bytes(x, whole_characters(x, merged(s))).decode() for x, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(at + 2).to_pylist(), strict=True)]
            rest = [batch.column(k + 2) for k in range(len(names))]
            rest[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(rest, names)

    return with_repeats(docs, work, docs.schema, names, window, core)
