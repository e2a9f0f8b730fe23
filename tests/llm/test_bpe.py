"""op8 against the tiktoken library, the round trip, and the fold in higher-order functions."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from quillstone.llm import bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})


def test_pieces_of_every_code_point(library):
    c = bpe.coder(bpe.default_ranks())
    odd = []
    for at in range(0, sys.maxunicode + 1, 64):
        text = " a".join(chr(x) for x in range(at, min(at + 64, sys.maxunicode + 1)) if not 0xD800 <= x < 0xE000)
        if c.encode(text) != library.encode_ordinary(text):
            odd.append(at)
    assert not odd, [hex(x) for x in odd]


def test_texts_as_the_library(spark, library):
    rnd = random.Random(3)
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    rows += [(-1, None), (-2, ""), (-3, "a" * 5000), (-4, " \n\t  x\r\n \x1c\x85　"), (-5, "".join(rnd.choice("ab' \n1é漢") for _ in range(4000))), (-6, "x" * 47 + "y" * 48), (-7, "I'll we've 12½Ⅷ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    texts = {d: t or "" for d, t in rows}
    for r in bpe.digests(docs).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), r.doc_id
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: bytes(r.content) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {d: t.encode() for d, t in texts.items()}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_higher_order_functions_agree(spark):
    pieces = [" thinonat", "é", "ßüng", "aaaaa", " ", "x", "ciónosasta"]
    small = {k: v for k, v in bpe.load_ranks(bpe.default_ranks()).items() if v < 3000}
    got = {bytes(r.piece).decode(): tuple(r.ids) for r in bpe.native_pieces(spark.createDataFrame([(p.encode(),) for p in pieces], "piece binary"), small).collect()}
    assert all(bytes([i]) in small for i in range(256))
    assert got == {p: bpe.merge(p.encode(), small) for p in pieces}


def test_higher_order_functions_as_the_library(spark, library):
    """The fold over all ranks against the library, piece by piece."""
    ranks = bpe.load_ranks(bpe.default_ranks())
    rnd = random.Random(8)
    pieces = [" thinonat", " Überraschung", "aaaaaaaa", " ", "x", "ciónosasta", "漢字", "!!??"] + ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 9))) for _ in range(12)]
    got = {bytes(r.piece).decode(): list(r.ids) for r in bpe.native_pieces(spark.createDataFrame([(p.encode(),) for p in pieces], "piece binary").coalesce(1), ranks).collect()}
    assert got == {p: library.encode_ordinary(p) for p in pieces}


def test_coded_stage(spark, library):
    """Nulls, empty and repeated rows, null ids, an empty table; columns named as the stage's own are replaced."""
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello there", "c"), (3, "Hello there", "c"), (None, "x" * 100_000, "d")], "doc_id long, text string, source string").selectExpr("*", "'own' as n_tokens", "7 as ids")
    out = bpe.coded(docs)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
    got = sorted((str(r.doc_id), r.source, r.n_tokens, list(r.ids)) for r in out.collect())
    hello = library.encode_ordinary("Hello there")
    assert [g[:2] for g in got] == [("1", "a"), ("2", "b"), ("3", "c"), ("3", "c"), ("None", "d")]
    assert got[0][2:] == (0, []) and got[1][2:] == (0, []) and got[2][2:] == got[3][2:] == (len(hello), hello) and got[4][3] == library.encode_ordinary("x" * 100_000)
    assert bpe.coded(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    got = [tuple(r) for r in bpe.digests(docs).collect()]
    assert sorted(str(r[0]) for r in got) == ["5", "5", "None"] and len({r[1:] for r in got}) == 1
