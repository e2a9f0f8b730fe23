"""op5: held-out accuracy, the contract's columns, odd rows."""

import tracemalloc
import zlib

import pytest
from quillstone.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, r.predicted, marks[d]) for d, r in rows.items() if r.held_out and d in marks]
    right = sum(p == m for _, p, m in held) / len(held)
    kept = sum(p for _, p, m in held if m) / sum(m for _, _, m in held)
    caught = sum(1 - p for _, p, m in held if not m) / sum(1 - m for _, _, m in held)
    print("held-out", len(held), "accuracy", right, "kept", kept, "caught", caught)
    assert right > 0.95 and kept > 0.97 and caught > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", "z"), (3, "a" * 300000, "u"), (3, "a" * 300000, "u")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.classify(docs, labels.limit(0)).where("predicted = 1").count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.accept(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5


def test_risk_separates_what_positives_lack():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (600, 5)), rng.normal(-2, 1, (600, 5))
    w, b, mean, scale = quality.fit(good[:300], np.concatenate([good[300:], bad[:300]]), 0.5)
    score = lambda x: ((x - mean) / scale) @ w + b
    assert (score(good) > 0).mean() > 0.97 and (score(bad) < 0).mean() > 0.97


def test_risk_and_gradient_against_a_plain_version():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (9, 3))
    seen = set()
    for prior in (0.2, 0.5, 0.95):
        for _ in range(6):
            w, b = rng.normal(size=3) * 2, float(rng.normal())
            score = lambda x, w=w, b=b: [sum(a * c for a, c in zip(r, w, strict=True)) + b for r in x]
            mean = lambda zs, sign: sum(np.log(1 + np.exp(-sign * z)) for z in zs) / len(zs)
            part = mean(score(u), -1) - prior * mean(score(p), -1)
            value, got, step = quality.risk(p, u, prior, w, b)
            assert np.isclose(value, prior * mean(score(p), 1) + max(0, part)) and np.isclose(got, part)
            # The step goes against the whole risk, or, where the unlabelled part is negative, up that part.
            wanted = (lambda w, b: quality.risk(p, u, prior, w, b)[0]) if part >= 0 else (lambda w, b: -quality.risk(p, u, prior, w, b)[1])
            both = np.append(w, b)
            for k in range(4):
                d = np.eye(4)[k] * 1e-6
                slope = (wanted((both + d)[:3], (both + d)[3]) - wanted((both - d)[:3], (both - d)[3])) / 2e-6
                assert np.isclose(step[k], slope, atol=1e-5)
            seen.add(part >= 0)
    assert seen == {True, False}


def test_prior_is_estimated_without_negatives():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.9):
        n = int(3000 * prior)
        web = np.concatenate([rng.normal(1, 1, (n, 4)), rng.normal(-2, 1, (3000 - n, 4))])[rng.permutation(3000)]
        assert abs(quality.class_prior(rng.normal(1, 1, (3000, 4)), web) - prior) < 0.08


def test_threshold_against_every_cut():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(6)
    model = (np.array([1.0]), 0.0, np.array([0.0]), np.array([1.0]))
    for _ in range(30):
        good, bad = np.round(rng.normal(1, 1, (20, 1)), 1), np.round(rng.normal(-1, 1, (15, 1)), 1)
        w, b, _, _ = quality.shifted(model, good, bad, 0.8)
        cut = np.log(0.7 / 0.3)
        right = lambda c: 0.8 * (good >= c).mean() + 0.2 * (bad < c).mean()
        assert np.isclose(0.8 * (good + b >= cut).mean() + 0.2 * (bad + b < cut).mean(), max(right(c) for c in np.unique(np.concatenate([good, bad]))))


def test_ties_and_repeated_labels(spark):
    """Equal texts score equally; of several labels of a doc_id the largest counts; a table of one text works."""
    docs = spark.createDataFrame([(i, "the same text " * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(0, 40, 4)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 40 and len({r.score for r in got}) == 1


def test_training_widens_few_rows_at_once():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(2)
    positive, unlabelled = (rng.random((n, quality.STATS + quality.GRAMS), np.float32).astype(np.float16) for n in (1500, 3000))
    tracemalloc.start()
    try:
        prior = quality.class_prior(positive, unlabelled)
        quality.shifted(quality.fit(positive, unlabelled, prior, rounds=1), positive, unlabelled, prior)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # The rows take 19 MB here and would take 75 MB in double precision.
    assert peak < 50 << 20


def test_gathered_rows(spark):
    np = pytest.importorskip("numpy")
    width = quality.STATS + quality.GRAMS
    row = lambda n: np.full(width, n, np.float16).tobytes()
    rows = spark.createDataFrame([(3, "web", row(3)), (1, "good,web", row(1)), (2, "good", row(2))], "doc_id long, parts string, row binary").repartition(3)
    web, bad, good = quality.gathered(rows, ["web", "bad", "good"])
    assert web[:, 0].tolist() == [1, 3] and good[:, -1].tolist() == [1, 2] and bad.shape == (0, width)
    assert {x.dtype for x in (web, bad, good)} == {np.dtype(np.float16)}
