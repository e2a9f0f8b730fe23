"""Folds against plain loops, and operators without SQL."""

import random

import pyarrow.parquet as pq
from quillstone.operators import consensus, coverage, footers, ordered
from quillstone.operators.chat import rolled
from pyspark.sql import functions as F


def naive_place(blocks, extras):
    """The rule as it reads: scan for the first block past the extra, the running maximum of keys deciding."""
    import math

    sheets = list(dict.fromkeys(b[2] for b in blocks if b[2]))
    paged, slides = any(b[0] for b in blocks), any(b[1] for b in blocks)

    def key(b, extra):
        page, slide, sheet, para, line = b
        none = math.inf if extra else 0
        if para if extra else line or para:
            at = 0
        elif sheet:
            at = sheets.index(sheet) + 1 if sheet in sheets else len(sheets) + 1
        else:
            at = none if sheets else 0
        return page or (none if paged else 0), slide or (none if slides else 0), at, (math.inf if para is None else para) if extra else line or para or 0

    out = [((0, n), key(b, False)) for n, b in enumerate(blocks)]
    for n, e in enumerate(extras):
        want, at = key(e, True), len(out)
        for k, (_, own) in enumerate(out):
            if own > want:
                at = k
                break
        out.insert(at, ((1, n), key(e, False)))
    return [x for x, _ in out]


def test_placement():
    for seed in range(300):
        rnd = random.Random(seed)
        src = lambda: (rnd.choice([None, 1, 2, 3]), None, rnd.choice([None, None, "S1", "S2", "S3"]), rnd.choice([None, 1, 5, 9]), rnd.choice([None, None, 2, 6]))
        blocks, extras = [src() for _ in range(rnd.randint(0, 25))], [src() for _ in range(rnd.randint(0, 25))]
        assert ordered.placed(blocks, extras) == naive_place(blocks, extras), seed


def test_greedy(spark):
    rnd = random.Random(1)
    rows = [(f"g{n % 3}", n, rnd.randint(0, 60)) for n in range(300)]
    got = {r.n: r.taken for r in coverage.greedy(spark.createDataFrame(rows, "g string, n long, c long"), "g", "n", "c", 500).collect()}
    left = {}
    for g, n, c in rows:
        fits = c <= left.setdefault(g, 500)
        left[g] -= c if fits else 0
        assert got[n] == fits


def test_rolled_fresh_seam():
    assert rolled([(0, 1, "a b"), (1, 2, "a b c"), (2, 3, "c"), (3, 4, "c"), (4, 5, "a b")]) == [(0, 1, "a b"), (1, 2, "c"), (4, 5, "a b")]
    named = lambda *names: list(ordered.fresh(enumerate(names, 1), set()))
    assert named("a.txt", "A.txt", "a.txt", "b", "b") == ["a.txt", "A-2.txt", "a-3.txt", "b", "b-5"]
    assert named("a-3.txt", "a.txt", "A.txt", ".x", ".x", "a.", "a.") == ["a-3.txt", "a.txt", "A-3-4.txt", ".x", ".x-5", "a.", "a-7."]


def test_footers(spark, tmp_path):
    t = spark.range(250).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("item|"), F.col("id").cast("string"))).alias("name"))
    pq.write_table(t.toArrow(), tmp_path / "t.parquet", row_group_size=30)
    pq.write_table(t.toArrow(), tmp_path / "n.parquet", write_statistics=False)
    groups = footers.row_groups(spark, f"file://{tmp_path}/t.parquet")
    got = {r.column_name: r for r in footers.footer_profile(groups).collect()}
    assert (float(got["id"].low), float(got["id"].high), got["id"].nulls) == (0, 249, 0) and (got["name"].low, got["name"].nulls) == ("item|1", 50)
    assert sorted(r.row_group for r in footers.leading_groups(groups, 100).collect()) == [0, 1, 2, 3]
    assert {(r.low, r.high) for r in footers.footer_profile(footers.row_groups(spark, f"file://{tmp_path}/n.parquet")).collect()} == {(None, None)}


def test_consensus_of_a_reader_that_reads_nothing(spark):
    readers = spark.createDataFrame([(1, "a", "local", 0), (1, "b", "llm", 1)], "item int, engine string, kind string, ord int")
    boxes = spark.createDataFrame([(1, "b", 0, "7 apples", [1.0, 2.0, 3.0, 4.0])], "item int, engine string, box_no int, text string, bbox array<double>")
    row = consensus.verdicts(boxes, ["item"], readers).first()
    assert not row.agreed and [c.n for c in row.counts] == [0, 1] and row.bbox == [1.0, 2.0, 3.0, 4.0]


def test_placement_of_many_items(spark):
    """Items that share a task and a batch keep apart; the result is that of each item alone; an empty table gives no rows."""
    rnd = random.Random(5)
    rows = [(i, rnd.random() < 0.4, n, rnd.choice([None, 1, 2, 3]), None, rnd.choice([None, "S1", "S2"]), rnd.choice([None, 4, 9]), None) for i in range(40) for n in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(rows, "item long, extra boolean, n long, page int, slide int, sheet string, para int, line int")
    got = {}
    for r in ordered.placement(df, "item").orderBy("item", "pos").collect():
        got.setdefault(r["item"], []).append((r["extra"], r["n"]))
    for i in range(40):
        body, extra = ([r for r in rows if r[0] == i and r[1] is e] for e in (False, True))
        assert got[i] == [(bool(e), (extra if e else body)[n][2]) for e, n in ordered.placed([r[3:] for r in body], [r[3:] for r in extra])]
    assert ordered.placement(df.limit(0), "item").count() == 0


def longest_seam(above, lines):
    """The rule as it reads: every pair of runs, the longest first."""
    found = [(n, -cut, -skip) for n in range(1, min(len(above), len(lines)) + 1) for cut in (0, 1) for skip in (0, 1) if n <= len(above) - cut and n <= len(lines) - skip and above[len(above) - cut - n : len(above) - cut] == lines[skip : skip + n]]
    n, _, skip = max(found, default=(0, 0, 0))
    return -skip, n


def test_seams(spark):
    rnd = random.Random(3)
    rows = [(i, k, [rnd.choice("ab") for _ in range(rnd.randint(0, 6))]) for i in range(40) for k in range(4)]
    rows += [(99, 0, ["x", "y", "z"]), (99, 1, ["y", "z", "w"]), (99, 2, ["cut", "z", "w", "v"]), (99, 3, [])]
    got = {(r.column, r.k): (r.lines, r.dropped) for r in ordered.seamless(spark.createDataFrame(rows, "column int, k int, lines array<string>"), ["column"], "k", "lines").collect()}
    above = []
    for i, k, lines in rows:
        start, n = longest_seam(above if k else [], lines)
        assert got[i, k] == (lines[:start] + lines[start + n :], n), (i, k)
        above = lines
    assert got[99, 1] == (["w"], 2) and got[99, 2] == (["cut", "v"], 2)


def test_fresh_names_stream(spark):
    rnd = random.Random(4)
    rows = [(f"g{n % 3}", n, rnd.choice([None, "a.txt", "A.TXT", "b", "b-4", ".x"])) for n in range(300)]
    got = {r.n: r.fresh for r in ordered.fresh_names(spark.createDataFrame(rows, "g string, n long, name string"), "g", "n", "name").collect()}
    for g in ("g0", "g1", "g2"):
        taken = set()
        for place, (_, n, name) in enumerate((r for r in rows if r[0] == g), 1):
            want = name
            i = place
            while want is not None and want.lower() in taken:
                stem, suffix = (want[: want.rindex(".")], want[want.rindex(".") :]) if "." in want[1:] else (want, "")
                want, i = f"{stem}-{i}{suffix}", i + 1
            assert got[n] == want
            taken.add(want and want.lower())


def test_profile_beyond_its_guard(spark):
    from quillstone.operators import profile

    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    assert {r.column_name: r.distinct for r in profile.profile(df).collect()} == {"id": 100, "k": 3}
    assert {r.column_name: (r.high, r.distinct) for r in profile.profile(df, most=1000).collect()} == {"id": ("99", None), "k": ("2", None)}
    assert {r.column_name: r.distinct for r in profile.profile(df.limit(0)).collect()} == {"id": 0, "k": 0}


def test_tree_has_no_limit_of_rows(spark):
    """More nodes than a recursive query may have; parents are terms in id, as in tree_outline; what has no root is left out."""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        ids = spark.range(1, 121).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 3 + 0.5)).alias("parent"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("label"))
        lost = spark.createDataFrame([(500, 501, "x"), (501, 500, "y"), (502, 999, "z")], "id long, parent long, label string")
        got = {r.id: (r.depth, r.line, r.path) for r in ordered.tree_order(ids.unionAll(lost)).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    want = {1: [1]}
    for n in range(2, 121):
        want[n] = [*want[int(n / 3 + 0.5)], n]
    assert got == {n: (len(p) - 1, "  " * (len(p) - 1) + f"- n{n}", p) for n, p in want.items()}


def test_numbers_of_late_years(spark):
    from quillstone.functions import render

    days = {0: "2001-01-01", 2921573: "9999-12-31", 2921574: "10000-01-01", 9000000: "26642-03-02"}
    df = spark.createDataFrame([(d,) for d in days], "d long")
    assert {r.d: r.day for r in df.select("d", render.cell_number(F.col("d") * 86400.0, F.lit(5)).alias("day")).collect()} == days
    assert df.where("d = 2921574").select(render.cell_number(F.col("d") * 86400.0 + 3661, F.lit(5)).alias("t")).first().t == "10000-01-01T01:01:01"


def test_profile_of_any_size(spark):
    """Distinct counts don't depend on the size: 600,000 rows are beyond what the guard of A02 takes."""
    from quillstone.operators import profile

    df = spark.range(600_000).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.array(F.col("id") % 5)).alias("a"))
    assert {r.column_name: r.distinct for r in profile.profile(df).collect()} == {"id": 600_000, "k": 3, "a": 5}


def test_consensus_streams_by_item(spark):
    """Readings meet by item in one shuffle; against plain counts, with items in any order, readers that aren't named and values given."""
    rnd = random.Random(8)
    cases = [(i, e, n, " ".join(str(rnd.randint(1, 6)) for _ in range(rnd.randint(0, 5))), rnd.choice([None, [float(n)]])) for i in range(30) for e in "abz" for n in range(4)]
    readers = [(i, e, k, o) for i in range(29) for e, k, o in (("b", "llm", 2), ("a", "local", 1))]
    boxes = spark.createDataFrame(cases, "item int, engine string, box_no int, text string, bbox array<double>")
    named = spark.createDataFrame(readers, "item int, engine string, kind string, ord int")
    want = {}
    for i, e, _, text, _ in cases:
        for v in text.split() if i < 29 and e != "z" else ():
            want.setdefault((i, v), {"a": 0, "b": 0})[e] += 1
    first = lambda i, v: next((b for e in "ab" for j, d, _, t, b in cases if (j, d) == (i, e) and v in t.split() and b), None)
    want = {(i, v): ([("a", c["a"]), ("b", c["b"])], c["a"] == c["b"], first(i, v)) for (i, v), c in want.items()}
    for own in (boxes, boxes.withColumn("values", consensus.values(F.col("text"))).drop("text")):
        out = consensus.verdicts(own, ["item"], named)
        assert {(r["item"], r.value): ([tuple(c) for c in r.counts], r.agreed, r.bbox) for r in out.collect()} == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {r.bbox for r in consensus.verdicts(boxes, ["item"], named, boxes=False).collect()} == {None}
    assert consensus.verdicts(boxes.limit(0), ["item"], named).count() == 0


def test_cells_in_ranges_with_many_references(spark):
    """References to one range are compared as one, a few at a time; against plain loops."""
    rnd = random.Random(6)
    ranges = [(n % 3, n, a := rnd.choice([0, 50, 130]), a + rnd.choice([0, 90]), 1, rnd.choice([1, 3]), f"k{n % 4}") for n in range(120)]
    cells = [(n % 4, rnd.randint(0, 230), rnd.randint(0, 4), n) for n in range(400)]
    df = spark.createDataFrame(ranges, "sheet int, ref int, r0 int, r1 int, c0 int, c1 int, kind string"), spark.createDataFrame(cells, "sheet int, r int, c int, v int")
    want = sorted((*g, *c[1:]) for g in ranges for c in cells if g[0] == c[0] and g[2] <= c[1] <= g[3] and g[4] <= c[2] <= g[5])
    out = ordered.cells_in(*df, "sheet", most=3)
    assert out.columns == ["sheet", "ref", "r0", "r1", "c0", "c1", "kind", "r", "c", "v"]
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    assert ordered.cells_in(df[0].limit(0), df[1], "sheet").count() == 0
