"""op1 against brute force over all pairs."""

import numpy as np
import xxhash
from quillstone.llm import simhash


def brute(rows):
    def mark(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: mark(t) for d, t in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, base), (7, base + " x"), (8, base.replace("w150", "y")), (9, "ünï ß"), (9, "ünï ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as print", "1 as bucket", "2 as node")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = brute(rows)
    assert got == sorted((d, *want[d]) for d, _ in rows)
    assert {c for d, _, c in got if d < 4} == {1}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(odd).collect()) == [(False, 1), (True, None)]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    prints = {base}
    while len(prints) < 400:
        prints.add(rng.choice(list(prints)) .item() ^ (1 << int(rng.integers(20))) ^ (1 << int(rng.integers(20))) if len(prints) > 1 else base ^ 3)
    prints |= {int(rng.integers(1 << 62)) for _ in range(200)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, print long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = simhash.lowest(len(prints), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for limit in (1024, 3):
        monkeypatch.setattr(simhash, "BUCKET", limit)
        found = {r.node: r.root for r in simhash.components(simhash.print_links(nodes)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == want.tolist()


def test_sliced_pairs_at_other_radii():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 12, 200, dtype=np.uint64)
    ends = np.repeat([120, 200], [120, 80])
    for radius in (0, 1, 3, 5):
        i, j = simhash.sliced_pairs(prints, ends, radius)
        want = {(a, b) for a in range(200) for b in range(a + 1, ends[a]) if bin(int(prints[a] ^ prints[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_very_long_and_repeated_texts(spark):
    """Texts of 400,000 words, equal and nearly so, ties of doc_ids, and a table of nothing but copies."""
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (9, None), (8, ""), (7, " \t")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    prints = {d: f for d, f, _ in got}
    assert len(got) == 6 and {c for d, _, c in got if d in (3, 5)} == ({3} if bin(int(prints[3], 16) ^ int(prints[5], 16)).count("1") <= 2 else {3, 5})
    assert all((f, c) == ("0" * 16, 7) for d, f, c in got if d in (7, 8, 9))
