"""The pipeline's stages, and near groups against brute force."""

import random

import corpus_pipeline
import numpy as np
import tiktoken
from quillstone.llm import bpe, neargroups, simhash, shared


def brute(texts, k=5, least=0.8):
    sets = [set(simhash.shingle_hashes((t or "").encode(), k).tolist()) for t in texts]
    return connected(len(sets), lambda i, j: not (either := len(sets[i] | sets[j])) or len(sets[i] & sets[j]) >= least * either)


def connected(n, link):
    """The smallest place that each reaches over pairs that link."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def near_corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " ", "one", "one", "one two"]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(30, 300))] + (passage.split() if rnd.random() < 0.4 else [])
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 40))):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


def test_groups(spark, monkeypatch):
    texts = near_corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'k' as tk")
    want = brute(texts)
    for limit in (neargroups.BUCKET, 3):
        monkeypatch.setattr(neargroups, "BUCKET", limit)
        assert sorted(r.doc_id for r in neargroups.thinned(docs).collect()) == sorted(set(want))
    assert neargroups.thinned(docs).columns == docs.columns
    assert neargroups.thinned(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (2, "x y")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neargroups.thinned(twice).collect()) == ["1", "None"]


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id for r in neargroups.thinned(docs).collect()}
    assert got == {rows[i].doc_id for i in set(want)}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = shared.stored(stage(spark, docs, sf), f"t{n}")
        counts.append(after.count())
        if n < 4:
            assert after.columns == docs.columns
            assert after.where("n_chars <> length(text)").count() == 0
            last = after
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[-1] > 100
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    texts = {r.doc_id: r.text for r in last.collect()}
    for r in docs.collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_groups_in_blocks(spark):
    """A candidate component of more members or shingles than a task takes gives the same groups."""
    texts = near_corpus(7)
    docs = neargroups.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = brute(texts)
    for options in ({"part": 2}, {"shingles": 300}):
        rows = neargroups.groups(docs, **options).collect()
        first = {}
        for r in sorted(rows, key=lambda r: r.dk):
            first.setdefault(r.group, r.dk)
        assert [first[r.group] for r in sorted(rows, key=lambda r: r.dk)] == want


def test_groups_of_repeated_lines(spark):
    """A line repeated differently often leaves the set of shingles as it is, but not the fingerprint."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = []
    for _ in range(20):
        body, line = " ".join(word() for _ in range(80)), " ".join(word() for _ in range(15))
        texts += [f"{body} {line}", f"{body} " + " ".join([line] * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert len(set(want)) == 20
    assert sorted(r.doc_id for r in neargroups.thinned(docs).collect()) == sorted(set(want))


def test_candidates_of_fingerprints(spark, monkeypatch):
    """Without the smallest shingles, what fingerprints connect is verified; with handmade ones, every link is there."""
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) for _ in range(12)]
    prints = [b ^ sum(1 << k for k in rnd.sample(range(64), n)) for b in base for n in (0, 0, 1, 2, 3, 5)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    edges = neargroups.print_stars(spark.createDataFrame(rows, "node long, print long"), len(rows))
    root = {r.node: r.root for r in shared.components(edges).collect()}
    assert [root.get(i, i) for i in range(len(prints))] == connected(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    texts = [None, "", "a b c", "a b d"]
    for n in (0, 700, 1400):
        texts += [" ".join([*words[n : n + 600], *(["changed"] * k), *words[n + 600 :]]) for k in range(4)]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    marks = [simhash.fingerprint(np.array(sorted(x), np.uint64)) for x in sets]
    part = connected(len(texts), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 2)
    want = connected(len(texts), lambda i, j: part[i] == part[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want)) < len(texts) - 4
    monkeypatch.setattr(neargroups, "stars", lambda nodes, similarity: nodes.sparkSession.createDataFrame([], "a long, b long"))
    got = neargroups.thinned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_crowded_bucket_of_one_key(spark, monkeypatch):
    """Texts that share only the key of a crowded bucket are compared; of handmade rows, so that no other way connects them."""
    monkeypatch.setattr(neargroups, "BUCKET", 3)
    bins = lambda at: bytes(100 * (k == at) for k in range(neargroups.BINS))
    rows = [(i, 100, bytearray(bins(i // 12)), [99, *(1000 * i + k for k in range(5))]) for i in range(24)]
    nodes = spark.createDataFrame([*rows, (24, 100, bytearray(bins(0)), list(range(6)))], "node long, size long, bins binary, keys array<long>")
    root = {r.node: r.root for r in shared.components(neargroups.stars(nodes, 0.8)).collect()}
    assert root == {i: 12 * (i // 12) for i in range(24)}
    monkeypatch.setattr(neargroups, "print_stars", lambda nodes, total: nodes.sparkSession.createDataFrame([], "a long, b long"))
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(12)], "doc_id long, text string")
    assert [r.doc_id for r in neargroups.thinned(docs).collect()] == [0]


def test_large_components_by_leaders(spark, monkeypatch):
    """A chain whose ends are unlike, and a hub whose members are all like its first one: the latter leaves nothing to meet in blocks."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    walk, chain = [word() for _ in range(200)], []
    for _ in range(40):
        chain.append(" ".join(walk))
        walk = walk[8:] + [word() for _ in range(8)]
    hub = [word() for _ in range(300)]
    star = [" ".join([*hub, f"end{i}"]) for i in range(40)]
    for texts in (chain, star, [t for pair in zip(chain, star, strict=True) for t in pair]):
        docs = neargroups.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        want = brute(texts)
        for leaders in (1, 4):
            monkeypatch.setattr(neargroups, "LEADERS", leaders)
            first = {}
            for r in sorted(neargroups.groups(docs, part=3).collect(), key=lambda r: r.dk):
                first.setdefault(r.group, r.dk)
                assert first[r.group] == want[r.dk]
    sets = [(1, 5, i, [int(x) for x in range(100)] + [1000 + i]) for i in range(20)]
    told = neargroups.led(spark.createDataFrame(sets, "part long, blocks int, node long, shingles array<long>"), 0.8)
    assert {r.lead for r in told.collect()} == {0} and neargroups.left_over(told, 3, 1000).count() == 0
