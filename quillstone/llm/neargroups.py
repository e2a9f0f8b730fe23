"""Groups of near-duplicate texts: candidates by SimHash and smallest shingles, verified by the similarity of their word shingles.

Two texts link if the Jaccard similarity of their sets of k-word shingles is `similarity` or more; a group is what links
reach. Texts of equal shingle sets count once. The bit-sliced comparison of `simhash` gives as candidates all whose
fingerprints, here of the set of shingles, differ in two bits or fewer. At a similarity of 0.8 fingerprints differ in some ten
bits, where blocks of equal bits no longer find them; so there are buckets of the smallest shingles under KEYS hashes
besides, of which two such texts share one with probability 1 - 0.2**KEYS. Inside a bucket those pairs pass whose sizes and counts of shingles by BINS
bins allow the similarity: the smaller counts of each bin add up to at least what two sets have in common, so that no pair of
the similarity is left out, whatever their fingerprints. They give stars, not pairs. A
bucket over BUCKET is dealt into blocks, every two of which meet as a bucket of their own. What stars and fingerprints connect is a candidate component, a superset of the
groups in it: its members meet with their shingles, where pairs that pass and are not connected yet are verified. A component
over PART members or SHINGLES shingles never meets in one task. Its members are dealt into blocks, and each is set against
LEADERS of them, which most members of one large group are similar to: they are connected with one row each. Only what is
left meets all others, block by block, each two blocks in a task of their own, and what the tasks find is connected again.
So work grows with the component's size where it is one group, and with the product of it and what is left otherwise.

Nulls: a null text counts as empty; texts without words are one group. A null doc_id sorts before all others. Of rows that
repeat both doc_id and text one stays. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .shared import batches, by_arrow, components, cut, joined, stored, texts_of

KEYS, BINS, BUCKET = 6, 256, 2048
#: Members and shingles of a candidate component, from which it is dealt into blocks.
PART, SHINGLES = 4096, 4 << 20
LEADERS = 4
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, KEYS + 1, dtype=np.uint64) | np.uint64(1)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "tk": F.xxhash64("text")})


def smallest(own: np.ndarray) -> np.ndarray:
    """The smallest of the shingles under each of KEYS hashes."""
    out = np.full(KEYS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(own), 1 << 13):
        np.minimum(out, (own[at : at + (1 << 13), None] * _ODD[:KEYS]).min(0), out=out)
    return out


def binned(own: np.ndarray) -> np.ndarray:
    """How many of the shingles fall into each bin; 255 stands for any number from there."""
    return np.bincount((own * _ODD[-1] >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS).clip(0, 255).astype(np.uint8)


def possible(sizes: np.ndarray, bins: np.ndarray, similarity: float):
    """accept() for all pairs that may have the similarity; it never rejects one that has."""
    full = (bins == 255).any(1)

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-6
        left = np.flatnonzero(out & ~(full[i] & full[j]))
        for at in range(0, len(left), 1 << 14):
            n = left[at : at + (1 << 14)]
            most = np.minimum(bins[i[n]], bins[j[n]]).sum(1, dtype=np.uint32)
            out[n] = (1 + similarity) * most >= similarity * (sizes[i[n]] + sizes[j[n]]) - 1e-6
        return out

    return accept


def linked(ends: np.ndarray, accept, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that each place reaches over pairs i < j < ends[i] that accept(i, j) lets pass; pairs connected already, as by `root` from the start, are left out."""
    n = len(ends)
    root, going, d = np.arange(n) if root is None else root, np.arange(n), 0
    while len(going):
        d += 1
        going = going[going + d < ends[going]]
        i = going[root[going] != root[going + d]]
        if len(i):
            i = i[accept(i, i + d)]
        if len(i):
            root = simhash.lowest(n, np.concatenate([i, np.arange(n)]), np.concatenate([i + d, root]))
    return root


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(dk, tk, node, size, bins, keys, print): node is a hash of the set of shingles, size their number, print its fingerprint."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, keys, bins, prints = [], [], [], [], []
        for text in texts_of(batch.column(2)):
            own = np.unique(simhash.shingle_hashes(text, k))
            sizes.append(len(own))
            mixed = own ^ (own >> np.uint64(31))
            nodes.append(int((mixed * _ODD[0] ^ (mixed * _ODD[1] >> np.uint64(32))).sum(dtype=np.uint64)) if len(own) else 0)
            bins.append(binned(own).tobytes())
            prints.append(simhash.fingerprint(own))
            keys.append((smallest(own) >> np.uint64(1)).astype(np.int64).tolist())
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(nodes), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), pa.array(keys, pa.list_(pa.int64())), signed(prints)], ["dk", "tk", "node", "size", "bins", "keys", "print"])

    return by_arrow(docs.select("dk", "tk", "text"), work, "dk long, tk long, node long, size long, bins binary, keys array<long>, print long", 4 << 20)


def bucket_stars(similarity: float):
    """mapInArrow worker over rows (bucket, size, node, bins) sorted by bucket: stars (a, b) of what passes."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        buckets, size, nodes = (table.column(k).to_numpy() for k in range(3))
        bins = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(buckets)]]))
        root = linked(np.repeat(starts + sizes, sizes), possible(size, bins, similarity))
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])

    def run(rows):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 1 << 14:
                continue
            table = pa.Table.from_batches(held)
            b = table.column(0).to_numpy()
            at = n - int((b[::-1] != b[-1]).argmax()) if b[0] != b[-1] else 0
            if at:
                yield solve(table.slice(0, at))
            rest = table.slice(at).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
        if n:
            yield solve(pa.Table.from_batches(held))

    return run


def block_pairs(node: str, blocks: str) -> Column:
    """The pairs (i, j) of blocks that the block of a node is in; every two nodes are in one of them together."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))


def stars(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of the candidate components of (node, size, bins, keys)."""
    rows = nodes.select("node", F.posexplode("keys").alias("place", "key")).select("node", F.xxhash64("place", "key").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    shared = rows.join(sizes, "bucket").select("node", F.explode(F.when(F.col("blocks") == 1, F.array("bucket")).otherwise(F.transform(block_pairs("node", "blocks"), lambda p: F.xxhash64("bucket", p["i"], p["j"])))).alias("bucket"))
    every = shared.join(nodes.select("node", "size", "bins"), "node").select("bucket", "size", "node", "bins")
    return every.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(bucket_stars(similarity), "a long, b long")


def print_stars(nodes: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) that join nodes (node, print), at most `total`, of equal prints or of prints that link."""
    prints = cut(nodes.groupBy("print").agg(F.min("node").alias("near"), F.count(F.lit(1)).alias("n")))
    equal = joined(nodes, prints, ["print"], ["near"], total).where("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b"))
    return equal.union(simhash.print_links(prints.select(F.col("near").alias("node"), "print")))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """If two sets of shingles have the similarity."""
    common = F.size(F.array_intersect(a, b))
    return common >= similarity * (F.size(a) + F.size(b) - common)


def led(large: DataFrame, similarity: float) -> DataFrame:
    """large (part, blocks, node, shingles) with block, its own one, and lead: the first leader's node for members similar to it, or to a leader that is; else null."""
    order = Window.partitionBy("part").orderBy("node")
    few = large.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS)
    few = few.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("node", "shingles"))).alias("leads"), F.first("blocks").alias("b"))
    few = few.withColumn("leads", F.filter("leads", lambda x: alike(x["shingles"], F.col("leads")[0]["shingles"], similarity)))
    spread = few.select("part", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"), "leads")
    own = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lead = F.when(F.exists("leads", lambda x: alike(x["shingles"], F.col("shingles"), similarity)), F.col("leads")[0]["node"])
    return own.join(spread, ["part", "block"]).select("part", "blocks", "block", "node", "shingles", lead.alias("lead"))


def left_over(told: DataFrame, part: int, shingles: int) -> DataFrame:
    """(part, i, j, node, shingles, lead): block i of what has no lead with block j of all members, for every i and j of a component."""
    rest = told.where("lead is null").groupBy("part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / part, F.sum(F.size("shingles")) / shingles)).cast("int").alias("rest"), F.first("blocks").alias("b"))
    spread = rest.select("part", "rest", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))
    rows = told.join(spread, ["part", "block"])
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_all = F.transform(every("rest"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    own = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.col("rest")).cast("int")
    as_rest = F.when(F.col("lead").isNull(), F.transform(every("blocks"), lambda j: F.struct(own.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    return rows.select("part", F.explode(F.concat(as_all, as_rest)).alias("p"), "node", "shingles", "lead").select("part", "p.i", "p.j", "node", "shingles", "lead")


def verified(sets: list[np.ndarray], similarity: float, led: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that each member reaches over pairs of the similarity; members that are `led` are connected from the start."""
    passes = possible(np.array([len(s) for s in sets]), np.stack([binned(s) for s in sets]), similarity)

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = passes(i, j)
        for n in np.flatnonzero(out).tolist():
            p, q = sets[i[n]], sets[j[n]]
            common = len(np.intersect1d(p, q, assume_unique=True))
            out[n] = common >= similarity * (len(p) + len(q) - common)
        return out

    root = np.arange(len(sets))
    if led is not None and led.any():
        root[led] = np.flatnonzero(led)[0]
    return linked(np.full(len(sets), len(sets)), accept, root)


def groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, part: int = PART, shingles: int = SHINGLES) -> DataFrame:
    """(dk, tk, group) of each row of docs (dk, tk, text)."""
    marks = stored(signatures(docs, k), "signatures")
    nodes = marks.groupBy("node").agg(F.first("size").alias("size"), F.first("bins").alias("bins"), F.first("keys").alias("keys"))
    prints = marks.groupBy("node").agg(F.first("print").alias("print"))
    roots = cut(components(stars(nodes, similarity).union(print_stars(prints, marks.count()))))
    member = marks.groupBy("node").agg(F.min(F.struct("dk", "tk")).alias("who"), F.first("size").alias("size")).join(roots, "node").select("node", F.col("root").alias("part"), "size", "who.dk", "who.tk")
    blocks = cut(member.groupBy("part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / part, F.sum("size") / shingles)).cast("int").alias("blocks")))
    member = member.join(blocks, "part").select("node", "part", "blocks", "dk", "tk")
    # A row that repeats doc_id and text is read once.
    wanted = docs.select("dk", "tk", "text").join(member, ["dk", "tk"])

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [simhash.shingle_hashes(x, k) for x in texts_of(batch.column(3))]
        sets = [np.unique(h).view(np.int64) for h in hashes]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["part", "blocks", "node", "shingles"])

    members = by_arrow(wanted.select("part", "blocks", "node", "text"), shingled, "part long, blocks int, node long, shingles array<long>", 4 << 20)

    def run(rows):
        held: list[tuple[tuple, int, np.ndarray, bool]] = []

        def solve(part: list) -> pa.RecordBatch:
            own = {x[1]: x for x in part}
            part = [own[x] for x in sorted(own)]
            low = verified([x[2].view(np.uint64) for x in part], similarity, np.array([x[3] for x in part]))
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in part], pa.int64()), pa.array([part[r][1] for r in low], pa.int64()), pa.array([part[0][0][1] >= 0] * len(part))], ["a", "b", "dealt"])

        for batch in batches(rows, 8 << 20):
            lists = batch.column(4)
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for n, (key, node, lead) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if held and held[0][0] != key:
                    yield solve(held)
                    held = []
                held.append((key, node, flat[ends[n] : ends[n + 1]].copy(), lead is not None))
        if held:
            yield solve(held)

    kinds = "a long, b long, dealt boolean"
    solve = lambda met: met.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node").mapInArrow(run, kinds).where("a <> b")
    small = members.where("blocks = 1").select("part", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "node", "shingles", F.lit(None).cast("long").alias("lead"))
    found = solve(small)
    if blocks.where("blocks > 1").limit(1).count():
        told = stored(led(members.where("blocks > 1"), similarity), "led")
        found = found.union(told.where("lead is not null and lead <> node").select(F.col("node").alias("a"), F.col("lead").alias("b"), F.lit(True).alias("dealt"))).union(solve(left_over(told, part, shingles)))
    solved = stored(found, "groups")
    whole = solved.where("not dealt").select(F.col("a").alias("node"), F.col("b").alias("group"))
    solved = cut(whole.union(components(solved.where("dealt").select("a", "b")).select("node", F.col("root").alias("group"))))
    return marks.select("dk", "tk", "node").join(solved, "node", "left").select("dk", "tk", F.coalesce("group", "node").alias("group"))


def thinned(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one document of each group: the one of the smallest doc_id."""
    names = docs.columns
    clash = [c for c in names if c in ("dk", "tk")]
    if clash:
        return thinned(docs.withColumnsRenamed({c: f"{c}__own" for c in clash}), k, similarity).withColumnsRenamed({f"{c}__own": c for c in clash})
    own = keyed(docs)
    found = stored(groups(own, k, similarity), "members")
    kept = found.groupBy("group").agg(F.min(F.struct("dk", "tk")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = found.join(kept, "group").where((F.col("dk") != F.col("first.dk")) | (F.col("tk") != F.col("first.tk"))).select("dk", "tk").distinct()
    out = own.join(gone, ["dk", "tk"], "left_anti")
    if found.groupBy("dk", "tk").count().where("count > 1").limit(1).count():
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("dk", "tk").orderBy("dk"))).where("nth = 1")
    return out.select(*names)
