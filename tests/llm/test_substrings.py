"""op3 against a plain search over all windows."""

import hashlib
import random
from collections import Counter

import pytest
from quillstone.llm import substrings


def plain(rows, window):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, x in data:
        seen.update(x[i : i + window] for i in range(len(x) - window + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def cleaned_texts(rows, window):
    """(doc_id, text, text left) of each row: a character goes if all of its bytes do."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    out = []
    for (d, t), x in zip(rows, data, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        left, at = [], 0
        for c in t or "":
            size = len(c.encode())
            if not all(gone[at : at + size]):
                left.append(c)
            at += size
        out.append((str(d), t, None if t is None else "".join(left)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = []
    for d in range(90):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6))]
        rows.append((d, " ".join(parts)))
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, rows[3][1]), (103, rows[3][1][7:]), (104, None), (105, ""), (106, "\0" * 90 + "b"), (107, "b" + "\0" * 90), (102, rows[3][1]), (None, rows[5][1][:80])]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_small_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as dk", "'x' as content")
    got = sorted((tuple(r) for r in substrings.digests(docs, 40, 20).collect()), key=str)
    assert got == plain(rows, 40)


def test_large_buckets(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(substrings, "BUCKET", 1)
    got = sorted((tuple(r) for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20).collect()), key=str)
    assert got == plain(rows, 40)


def test_pieces_of_long_texts(spark, monkeypatch):
    rows = corpus(8)
    rows.append((500, " ".join(t or "" for _, t in rows[:40])))
    monkeypatch.setattr(substrings, "PIECE", 300)
    got = sorted((tuple(r) for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20).collect()), key=str)
    assert got == plain(rows, 40)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str)
    assert got == plain(rows, 400)
    assert substrings.digests(docs.limit(0)).count() == 0


def test_cleaned_texts_are_whole_characters(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as dk", "'x' as content", "text as other")
    out = substrings.cleaned(docs, 40, 20)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r.content == "x" and r.dk == 1 for r in got)
    assert sorted(((str(r.doc_id), r.other, r.text) for r in got), key=str) == cleaned_texts(rows, 40)
