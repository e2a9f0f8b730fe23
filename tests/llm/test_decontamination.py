"""op9 against a plain search for windows; parameters changed; odd rows."""

import re
from collections import defaultdict

from quillstone.llm import decontamination as dec


def test_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in dec.contaminated(docs, items).collect()}
    cut = lambda s: re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", re.sub(r"(?<=[a-zà-ÿ\d,;] )[A-ZÀ-Þ](?=[a-zà-ÿ])[^\W\d_]+", "NAME", s))
    shape = lambda s: ["0" if w[0].isdigit() else w if w == "NAME" else w.lower() for w in cut(s)]
    where, sizes = defaultdict(set), {}
    for r in items.collect():
        w = shape(r.text)
        keys = [(k, tuple(w[k : k + 8])) for k in range(len(w) - 7) if sum(x in ("0", "NAME") for x in w[k : k + 8]) <= 4]
        sizes[r.item_id] = len(keys)
        for k, key in keys:
            where[key].add((r.item_id, k))
    want = defaultdict(set)
    for r in docs.collect():
        w = shape(r.text or "")
        for k in range(len(w) - 7):
            for item, at in where.get(tuple(w[k : k + 8]), ()):
                want[r.doc_id, item].add(at)
    want = {k: (len(v), sizes[k[1]]) for k, v in want.items() if len(v) >= 0.3 * sizes[k[1]]}
    assert want and got == want
    kept = dec.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {d for d, _ in got}


def test_changed_parameters(spark):
    item = "If a farmer named Anna sells 12 apples for 3 dollars each and then Anna gives away 12 more apples how many km did she walk"
    other = item.replace("Anna", "Bruno").replace("12", "40").replace("3 dollars", "7.5 euros")
    torn = item.replace("12 more", "99 more")
    docs = [(1, f"Some words first. {item} And more."), (2, f"Here: {other}"), (3, f"Here: {torn}"), (4, "If a farmer sells apples he walks home with no money at all"), (5, None), (6, ""), (None, item), (7, item), (7, item), (8, "word " * 30000 + item)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as item_id")
    bench = spark.createDataFrame([(0, item), (0, item), (1, None), (2, ""), (3, "12 13 14 15 16"), (4, "no money at all")], "item_id long, text string").selectExpr("*", "1 as h")
    found = {(r.doc_id, r.item_id): r for r in dec.contaminated(docs, bench).collect()}
    assert set(found) == {(d, 0) for d in (1, 2, 3, None, 7, 8)} | {(4, 4)}
    assert not found[1, 0].changed and found[2, 0].changed and found[1, 0].share == 1.0
    # One of two equal values differs: the windows of the more frequent one and the verbatim ones count.
    assert found[3, 0].share == 1.0 and found[3, 0].changed
    assert sorted(str(r.doc_id) for r in dec.clean(docs, bench).collect()) == ["5", "6"]
    assert dec.contaminated(docs, bench.limit(0)).count() == 0 and dec.clean(docs, bench.limit(0)).count() == docs.count()
    assert dec.contaminated(docs.limit(0), bench).count() == 0


def test_shuffled_join_is_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, dec.contaminated(docs, items).collect()))
    for limit in ("BROADCAST", "BROADCAST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(dec, limit, 0)
            assert sorted(map(tuple, dec.contaminated(docs, items).collect())) == one


def test_slots_without_agreement(spark):
    """A template whose equal values have a new value at each place isn't the item; one with a majority is, by its windows."""
    item = " ".join(f"put 7 of the {w} boxes on the shelf beside" for w in ("red", "green", "blue", "grey", "black", "white", "brown", "pink", "tan", "gold"))
    doc = item
    for n in range(10):
        doc = doc.replace("put 7 ", f"put {100 + n} ", 1)
    half = doc
    for n in range(6):
        half = half.replace(f"put {100 + n} ", "put 55 ", 1)
    docs = spark.createDataFrame([(1, item), (2, doc), (3, half)], "doc_id long, text string")
    found = {r.doc_id: r for r in dec.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string"), share=0.6).collect()}
    assert set(found) == {1, 3} and found[3].changed and found[3].n_windows < found[1].n_windows


def test_long_verbatim_run(spark):
    """Twenty words in a row are enough, in a small share of a long item or beside a value that differs."""
    words = [f"{a}{b}" for a in ("al", "bor", "cim", "dun", "ek", "fur", "gil", "hom") for b in ("a", "eth", "ion", "ost", "ume", "yr", "ax", "ib")]
    long = " ".join(words[:59])
    part = " ".join(words[10:32])
    twice = f"he had 12 {' '.join(words[:20])} and then 12 more of them than anybody here"
    docs = [(1, f"zz {part} zz"), (2, twice.replace("then 12", "then 99")), (3, " ".join(words[10:28])), (4, "nothing of it")]
    bench = spark.createDataFrame([(0, long), (1, twice)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert (1, 0) in found and (2, 1) in found and found[1, 0].n_windows == 15
    assert not {3, 4} & {d for d, _ in found}
