"""op10: totals against DuckDB, batches sent again, a driver lost before its marker."""

import duckdb
from quillstone.llm import rollup


def test_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = sorted(tuple(r) for r in rollup.maintained(docs).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect())
    assert got == sorted(con.sql(rollup.ORACLE).fetchall())


def test_batches(spark):
    kinds = "source string, lang string, tokenizer string, sign long, tokens long"
    r = rollup.Rollup(spark)
    assert r.totals().count() == 0
    assert r.commit("a/1", spark.createDataFrame([("s", None, "t", 1, 5), ("s", None, "t", 1, 5), ("s", "en", "t", 1, 2)], kinds))
    assert not r.commit("a/1", spark.createDataFrame([("s", None, "t", 1, 500)], kinds))
    assert r.commit("b", spark.createDataFrame([("s", "en", "t", -1, 2), ("s", None, "t", -1, 5), ("s", None, "t", 1, 7)], kinds))
    assert [tuple(x) for x in rollup.Rollup(spark, r.folder).totals().collect()] == [("s", None, "t", 2, 12)]
    spark.createDataFrame([("s", "xx", "t", 9, 9)], "source string, lang string, tokenizer string, n_docs long, n_tokens long").write.parquet(f"{r.folder}/sums/lost")
    assert r.totals().count() == 1
    path, disk = r._path("commits", b"late".hex())
    disk.create(path, False).close()
    assert r.commit("late", spark.createDataFrame([("z", "z", "t", 1, 1)], kinds)) and r.totals().count() == 2
    assert r.commit("undo", spark.createDataFrame([("z", "z", "t", -1, 1)], kinds)) and r.totals().count() == 1
    assert r.commit("empty", spark.createDataFrame([], kinds)) and r.totals().count() == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b", "s", "en"), (2, "a\na\nb", "s", "en"), (3, "a\na\nb", "s", "en"), (4, "", "s", "en")], "doc_id long, text string, source string, lang string").selectExpr("*", "'k' as tokenizer", "1 as sign")
    got = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.maintained(docs).collect()}
    assert got == {(None, "words/1"): (1, 0), (None, "wordpieces/2"): (1, 0), ("s", "words/1"): (3, 4), ("s", "wordpieces/2"): (3, 5)}
    assert rollup.maintained(docs.limit(0)).count() == 0


def test_very_long_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 400_000, "s", "en"), (2, "b", "s", "en"), (2, "b", "s", "en"), (None, "b", "s", "en")], "doc_id long, text string, source string, lang string")
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in rollup.maintained(docs).collect()}
    assert got == {"words/1": (4, 400_003), "wordpieces/2": (4, 400_003)}


def test_compaction(spark):
    """Totals are the same after it, later batches add to it, folded ones are still known, and it may be repeated."""
    kinds = "source string, lang string, tokenizer string, sign long, tokens long"
    r = rollup.Rollup(spark)
    assert not r.compact()
    for k in range(4):
        assert r.commit(f"b{k}", spark.createDataFrame([("s", "en", "t", 1, k)], kinds))
    assert r.compact() and not r.compact()
    assert len(r._parts()[0]) == 1 and [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 4, 6)]
    assert not r.commit("b2", spark.createDataFrame([("s", "en", "t", 1, 99)], kinds))
    assert r.commit("b4", spark.createDataFrame([("s", "en", "t", -1, -3)], kinds))
    assert len(r._parts()[0]) == 2 and [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 3, 9)]
    assert r.compact() and [tuple(x) for x in rollup.Rollup(spark, r.folder).totals().collect()] == [("s", "en", "t", 3, 9)]
