"""op6's counts against a plain count, and its verdicts."""

import re
from collections import Counter

import numpy as np
from quillstone.llm import fertility

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a b a b a b a"), (-4, "# x\n# x\n \n \n漢字 漢字\x0b漢字"), (-5, "q" * 200000 + " é"), (-6, " ".join(f"w{i}" for i in range(30000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept")
    got = {r.doc_id: r for r in fertility.rules(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert fertility.rules(docs.limit(0)).count() == 0
    model, _ = fertility.pieces(fertility.default_vocabulary())
    words = ["ein", "Haus", "ein", "漢", "ሴ"]
    ids = [i for w in words for i in model.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    others = fertility.ranked(fertility.default_ranks()).encode_ordinary(" ".join(words))
    per, per_rank, fallback, bits = fertility.fertility(" ".join(words), 12, fertility.default_vocabulary(), fertility.default_ranks())
    assert (per, per_rank) == (12 / len(ids), 12 / len(others)) and fallback == sum(map(model.is_byte, ids)) / len(ids) > 0
    assert abs(bits + (share * np.log2(share)).sum()) < 1e-9


def test_learned_bands_against_a_plain_version(spark):
    """Quartiles by sorting, group by group; a null language, repeated rows and null ids are rows like any other."""
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 9 else None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += rows[:30] + [(None, *rows[3][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = fertility.rules(docs, spread=2.0, least=25).collect()
    assert len(got) == len(rows)
    passing = [r for r in got if not r.base_failed]

    def band(group, figure):
        values = sorted(r[figure] for r in group)
        low, middle, high = (values[max(0, -(-int(q * 4) * len(values) // 4) - 1)] for q in (0.25, 0.5, 0.75))
        floor, lower, upper = fertility.FIGURES[figure]
        return low - 2.0 * max(middle - low, floor) if lower else -np.inf, high + 2.0 * max(high - middle, floor) if upper else np.inf

    rejected = 0
    for r in got:
        groups = ([x for x in passing if (x.script, x.lang) == (r.script, r.lang)], [x for x in passing if x.script == r.script], passing)
        group = next((g for g in groups if len(g) >= 25), None)
        want = [f for f in fertility.FIGURES if group and not band(group, f)[0] <= r[f] <= band(group, f)[1]]
        low, high, most, bits = fertility.LIMITS[r.script]
        limits = {"chars_per_token": low <= r.chars_per_token <= high, "fallback_share": r.fallback_share <= most, "token_entropy": r.token_entropy >= bits}
        want = [f for f in fertility.FIGURES if f in want or not limits.get(f, True)]
        assert r.outside == ",".join(want) and r.kept == (not r.base_failed and not want)
        rejected += bool(want) and not r.base_failed
    assert rejected
    assert sum(x.n for x in fertility.rejects(spark.createDataFrame(got, fertility.rules(docs.limit(0)).schema)).collect()) >= rejected


def test_verdicts(spark):
    good = (
        "When the old bridge was closed for repairs last spring, traders on both banks feared that customers would stay away until autumn. "
        "Instead a ferry service, run by two retired sailors with a borrowed barge, carried shoppers across every quarter of an hour, and several "
        "shops reported better sales than in any previous year. The council now plans to keep some boats even after masons finish their work."
    )
    noise = " ".join(chr(0x12000 + i) * 3 for i in range(80))
    one = " ".join("aaaa" + "a" * i for i in range(60))
    got = [r.kept for r in fertility.rules(spark.createDataFrame([(1, good), (2, noise), (3, one)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True, False, False]
