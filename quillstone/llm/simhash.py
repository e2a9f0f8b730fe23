"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has 64 bits; two link at `radius` or fewer differing bits. Equal fingerprints meet first, so that copies
count once. The rest go through the pigeonhole: the bits are cut into blocks, and two fingerprints within the radius
agree on some pair of four blocks (radius 2), that is on 32 bits. Inside a bucket the fingerprints are kept as vertical
bit planes, lane i of a plane being bit b of fingerprint i. A shift by d lanes sets each fingerprint against the one d
places on; carry-save counters, preset so that they overflow beyond the radius, add the differing bits of 64 lanes at
once, and a word of lanes is abandoned when all of them have overflowed. A bucket over BUCKET rows is not compared: its
fingerprints link by the keys at distance one, which two fingerprints share exactly if they differ in two bits or fewer.

Nulls: a null text counts as empty. A text without words has fingerprint zero. Rows with a null doc_id get a
fingerprint and no component (null), and no row links through them. Rows repeated with the same doc_id come out as often
as they came in, each with the same result when their texts are equal. Further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_arrow, components, cut, texts_of

BLOCKS = 4
#: Rows of a bucket that are compared; larger ones go the exact way of shared keys.
BUCKET = 1024
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of all the words where there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    return np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def sliced_shifts(prints: np.ndarray, ends: np.ndarray, radius: int):
    """For each distance d: places i whose print is within the radius of that at i + d, where i + d < ends[i].

    ends[i] is the end of i's bucket in the sorted array.
    """
    n = len(prints)
    words = (n + 63) // 64
    most = int((ends - np.arange(n)).max()) - 1 if n else 0
    bits = np.zeros((64, (words + most // 64 + 2) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    index = np.arange(n)
    for d in range(1, most + 1):
        lanes = np.zeros(words * 64, np.uint8)
        lanes[:n] = index + d < ends
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        over = ~valid[at]
        counters = [np.full(len(at), full if start >> k & 1 else 0, np.uint64) for k in range(width)]
        skip, shift = at + d // 64, np.uint64(d % 64)
        for b in range(64):
            other = planes[b, skip] if not shift else (planes[b, skip] >> shift) | (planes[b, skip + 1] << (np.uint64(64) - shift))
            carry = planes[b, at] ^ other
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                going = over != full
                if not going.all():
                    at, skip, over, counters = at[going], skip[going], over[going], [c[going] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(hit)
            yield d, at[word] * 64 + lane


def sliced_pairs(prints: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within the radius, where j < ends[i]."""
    found = [(i, i + d) for d, i in sliced_shifts(prints, ends, radius)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def linked(prints: np.ndarray, ends: np.ndarray, radius: int, accept=None) -> np.ndarray:
    """The smallest place that each print reaches over pairs within the radius that accept(i, j) lets pass.

    Pairs that are connected already are left out, and no more pairs are held than there are prints.
    """
    n = len(prints)
    root = np.arange(n)
    for d, i in sliced_shifts(prints, ends, radius):
        i = i[root[i] != root[i + d]]
        if accept is not None and len(i):
            i = i[accept(i, i + d)]
        if len(i):
            root = lowest(n, np.concatenate([i, np.arange(n)]), np.concatenate([i + d, root]))
    return root


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def bucket_links(radius: int):
    """mapInArrow worker over rows (bucket, print, node) sorted by bucket: stars (a, b) of each bucket's components."""

    def links(buckets: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(buckets)) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(buckets)]]))
        root = linked(prints.view(np.uint64), np.repeat(starts + sizes, sizes), radius)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])

    def run(rows):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            n += batch.num_rows
            if n < 1 << 15:
                continue
            b, p, v = (np.concatenate(x) for x in zip(*held, strict=True))
            at = len(b) - int((b[::-1] != b[-1]).argmax()) if b[0] != b[-1] else 0
            if at:
                yield links(b[:at], p[:at], v[:at])
            held, n = [(b[at:], p[at:], v[at:])], len(b) - at
        if n:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def prints_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, print) of each row; print is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(shingle_hashes(x, k)) for x in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, print long")


def print_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that join what links: nodes has (node, print), one row for each print."""
    if radius != 2:
        raise ValueError("the blocks and the shared keys below are those of radius 2")
    width = 64 // BLOCKS
    block = [F.expr(f"shiftrightunsigned(print, {width * i}) & {(1 << width) - 1}L") for i in range(BLOCKS)]
    keys = F.array(*(F.lit(n << (2 * width)).cast("long") + F.shiftleft(block[i], width) + block[j] for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))))
    rows = nodes.select(F.explode(keys).alias("bucket"), "print", "node")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rows.join(sizes, "bucket").select("bucket", "print", "node", "n")
    small = shared.where(f"n <= {BUCKET}").select("bucket", "print", "node").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(bucket_links(radius), "a long, b long")
    # The exact way for large buckets: x and y differ in two bits or fewer if and only if some key is one flip or less from both.
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("print")).otherwise(F.expr("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))))
    near = shared.where(f"n > {BUCKET}").select("print", "node").distinct().select(F.explode(flips).alias("key"), "node")
    star = near.groupBy("key").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return small.union(near.join(star, "key").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    prints = cut(prints_of(docs, k))
    nodes = prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"))
    nodes = cut(nodes)
    roots = components(print_links(nodes, radius))
    named = nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    out = prints.join(named, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
