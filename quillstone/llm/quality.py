"""A quality classifier by positive-unlabelled learning.

Trusted positives are training rows that the labels mark 1; the web text at large is unlabelled. A linear model on
bounded features of the whole text minimises the non-negative unbiased risk: prior * R(positives, +) +
max(0, R(unlabelled, -) - prior * R(positives, -)). Where the unlabelled part turns negative, the step ascends it instead,
so that the model does not fit the positives among the unlabelled. The class prior is estimated from positives and
unlabelled rows alone: a first model tells them apart on one half of the rows, and on the other half the smallest ratio of
unlabelled to positive rows above a score, with a bound for chance, is the prior. Where scores meet the threshold is chosen
on VALIDATION labelled rows of either class that the model isn't fitted to (training rows, of which crc32(doc_id) mod 4 is
1): in the middle of the widest gap of the best accuracy at the estimated prior. Rounds and rate were chosen on such rows too.

Training uses at most POSITIVES and UNLABELLED rows, and VALIDATION of either label, taken by the smallest hashes of their
ids; features are computed in the workers, so that the driver holds rows of fixed width, however long the texts. It keeps
them once, in half precision as they were sent, and widens SLICE rows at a time. Scoring reads every row once, in slices of
bounded size.

Nulls and empty texts get the score of a text without features. Rows with a null doc_id are scored and never learned
from. Of a doc_id with several labels the largest counts. Rows repeated come out as often as they came in, equal texts
score equally; other columns are ignored; without positive labels every score is 1.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_arrow, texts_of

#: The most training rows, and validation rows of either label.
POSITIVES, UNLABELLED, VALIDATION = 3000, 6000, 1500
GRAMS = 1 << 11
#: Rows of features in full precision at once.
SLICE = 512
THRESHOLD = 0.7
_CLASS = np.zeros((256, 8))
for _b in range(256):
    _CLASS[_b] = [65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b in b" \t\r\x0b\x0c", _b == 10, _b in b".,;:'\"-()", _b >= 128, _b in b"!#$%&*+/<=>?@[\\]^_`{|}~"]
STATS = 8 + 8 + 9
_MARKS = re.compile(rb"(?<!\S)[^\w\s\x80-\xff]+(?!\S)")


def features(data: bytes) -> np.ndarray:
    """Figures of one text, its length in proportion: byte classes, words and lines, repeats, marks, hashed byte pairs."""
    out = np.zeros(STATS + GRAMS, np.float32)
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return out
    n = len(raw)
    share = np.bincount(raw, minlength=256) @ _CLASS / n
    out[:8], out[8:16] = share, np.log1p(200 * share)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    out[16:STATS] = [
        np.log1p(n) / 10, len(words) and min(3, n / len(words) / 10), distinct / max(len(words), 1), len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)) / 5, len(words) and len(set(zip(words, words[1:], strict=False))) / len(words), np.log1p(len(words) / max(len(lines), 1)) / 5,
        sum(map(operator.eq, words, words[1:])) / max(len(words), 1), len(_MARKS.findall(data)) / max(len(words), 1),
    ]
    if n > 1:
        grams = np.zeros(GRAMS)
        for at in range(0, n - 1, 1 << 20):
            part = raw[at : at + (1 << 20) + 1].astype(np.uint32)
            grams += np.bincount((part[:-1] * 0x9E37 + part[1:] * 0x85EB >> 4) & (GRAMS - 1), minlength=GRAMS)
        out[STATS:] = np.sqrt(grams / n)
    return out


def matrix(texts: list[bytes]) -> np.ndarray:
    out = np.empty((len(texts), STATS + GRAMS), np.float32)
    for n, x in enumerate(texts):
        out[n] = features(x)
    return out


def loss(x: np.ndarray, sign: int, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """The mean logistic loss of rows x taken as of class `sign`, and its gradient by weights and bias."""
    z = sign * (x @ w + b)
    slope = -sign / (1 + np.exp(np.clip(z, -30, 30))) / len(x)
    return float(np.logaddexp(0, -z).mean()), np.append(slope @ x, slope.sum())


def risk(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """The non-negative unbiased risk, its unlabelled part before it is cut at 0, and the direction of the step against it."""
    positive, up = loss(p, 1, w, b)
    inner, down = loss(p, -1, w, b)
    outer, away = loss(u, -1, w, b)
    part = outer - prior * inner
    return prior * positive + max(0.0, part), part, prior * up + away - prior * down if part >= 0 else prior * down - away


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 20, size: int = 512, rate: float = 0.03, decay: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, means and scales of the model of least non-negative risk (logistic loss)."""
    mean, scale = both_of(positive, unlabelled)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    total, count = np.zeros(len(w) + 1), 0
    steps = max(1, len(unlabelled) // size)
    for turn in range(rounds):
        order, chosen = rng.permutation(len(unlabelled)), rng.permutation(max(len(positive), 1))
        for k in range(steps):
            xp, xu = positive[chosen[np.arange(k * size, (k + 1) * size) % len(positive)]], unlabelled[order[k::steps]]
            _, _, gradient = risk((xp - mean) / scale, (xu - mean) / scale, prior, w, b)
            gradient[:-1] += decay * w * len(w)
            t += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            step = rate / (1 + turn / 10) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - float(step[-1])
            if turn >= rounds // 2:
                total, count = total + np.append(w, b), count + 1
    return (total / count)[:-1], float((total / count)[-1]), mean, scale


def slices(x: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(x), SLICE):
        yield x[at : at + SLICE]


def both_of(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales over the rows of all parts, which are neither put together nor widened as a whole."""
    n = sum(map(len, parts))
    mean = sum(p.sum(0, dtype=np.float64) for p in parts) / n
    square = sum(((x - mean) ** 2).sum(0, dtype=np.float64) for p in parts for x in slices(p)) / n
    return mean.astype(np.float32), (np.sqrt(square) + 1e-2).astype(np.float32)


def logits(model: tuple, x: np.ndarray) -> np.ndarray:
    w, b, mean, scale = model
    return np.concatenate([((part - mean) / scale) @ w + b for part in slices(x)]) if len(x) else np.zeros(0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from these two alone.

    Above any score there are prior * (share of positives above it) unlabelled rows at least, and no more where no negative
    is above it; so the smallest ratio of the two shares, over scores that enough rows are above, is the prior.
    """
    model = fit(positive[::2], unlabelled[::2], 0.5, rounds=15)
    p, u = np.sort(logits(model, positive[1::2])), np.sort(logits(model, unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    above_p, above_u = 1 - np.arange(len(p)) / len(p), 1 - np.searchsorted(u, p, "left") / len(u)
    chance = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    at = int(np.argmin((above_u + chance) / above_p))
    return float(np.clip(above_u[at] / above_p[at], 0.02, 0.98))


def shifted(model: tuple, good: np.ndarray, bad: np.ndarray, prior: float) -> tuple:
    """The model with its bias moved so that THRESHOLD falls where most rows are right at the prior, in the middle of the widest such gap."""
    w, b, mean, scale = model
    g, d = (np.sort(logits(model, x)) if len(x) else np.zeros(0) for x in (good, bad))
    if not len(g):
        return model
    cuts = np.unique(np.concatenate([g, d]))
    right = prior * (1 - np.searchsorted(g, cuts, "left") / len(g)) + (1 - prior) * (np.searchsorted(d, cuts, "left") / len(d) if len(d) else 0)
    # A cut at a score accepts it; the cut may lie anywhere down to the score before.
    gap = np.diff(np.concatenate([[cuts[0] - 1], cuts]))
    best = np.flatnonzero(right >= right.max() - 1e-12)
    at = best[gap[best].argmax()]
    return w, float(b + np.log(THRESHOLD / (1 - THRESHOLD)) - (cuts[at] - gap[at] / 2)), mean, scale


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def smallest(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most `most` ids, those of the smallest hashes."""
    return rows.select("doc_id").distinct().withColumn("mark", F.xxhash64(F.lit(salt), "doc_id")).orderBy("mark", "doc_id").limit(most).select("doc_id")


def gathered(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Features of each part of `rows` (doc_id, parts, row), by id; what Arrow held of them is given back."""
    found = rows.toArrow()
    order = pc.sort_indices(found, sort_keys=[("doc_id", "ascending"), ("row", "ascending")]).to_pylist()
    of, column, out = [set(p.split(",")) for p in found.column("parts").to_pylist()], found.column("row"), []
    for name in names:
        own = [n for n in order if name in of[n]]
        out.append(np.empty((len(own), STATS + GRAMS), np.float16))
        for at, n in enumerate(own):
            out[-1][at] = np.frombuffer(column[n].as_buffer(), np.float16)
    del found, column
    pa.default_memory_pool().release_unused()
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, validation: int = VALIDATION):
    """The model, or None where no row can be learned from. labels: (doc_id, quality)."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.max("q").alias("q"))
    held = remainder(4) == 1
    known = known.select(F.col("id").alias("doc_id"), "q").where(learn)
    body = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & learn)
    # The ids are drawn first, from one column; each set has a fixed bound, so that its join needs no shuffle of texts.
    sets = {
        "positive": smallest(known.where(F.col("q") == 1).where(~held), positives, 1), "web": smallest(body.where(~held), unlabelled, 2),
        "good": smallest(known.where(F.col("q") == 1).where(held), validation, 3), "bad": smallest(known.where(F.col("q") != 1).where(held), validation, 4),
    }
    ids = None
    for name, own in sets.items():
        own = own.select("doc_id", F.lit(name).alias("part"))
        ids = own if ids is None else ids.union(own)
    parts = ids.groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    chosen = body.join(F.broadcast(parts), "doc_id").select("doc_id", "text", F.array_join(F.sort_array("parts"), ",").alias("parts"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(x).astype(np.float16).tobytes() for x in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "parts", "row"])

    drawn = by_arrow(chosen, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, parts string, row binary", 4 << 20)
    xp, xu, good, bad = gathered(drawn, list(sets))
    if not len(xp) or not len(xu):
        xp = good if not len(xp) else xp  # a table so small that all its positives are held back
        if not len(xp) or not len(xu):
            return None
    prior = class_prior(xp, xu)
    model = fit(xp, xu, prior)
    return tuple(np.asarray(x, np.float32) if isinstance(x, np.ndarray) else x for x in shifted(model, good if len(good) else xp, bad, prior))


def scores(model, texts: list[bytes]) -> np.ndarray:
    return np.ones(len(texts)) if model is None else 1 / (1 + np.exp(-np.clip(logits(model, matrix(texts)), -30, 30)))


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, texts_of(batch.column(1))).astype(np.float64))], ["doc_id", "score"])

    return by_arrow(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", 4 << 20)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; rows whose crc32(doc_id) mod 4 is 2 are held out of learning."""
    held = remainder(4) == 2
    out = scored(docs, train(docs, labels, ~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose texts score the threshold or more."""
    model = train(docs, labels, remainder(4) != 2)
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(model, texts_of(batch.column(names.index("text")))) >= threshold))

    return by_arrow(docs, work, docs.schema, 4 << 20)
