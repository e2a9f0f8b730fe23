"""Language identification by a linear-chain conditional random field.

Words are runs of letters. Each has affix and n-gram features (hashed n-grams of the word with its ends marked) and a
lexicon feature (the word itself, where training saw it often enough). Emission weights and transitions are learned
together by the gradient of the sequence likelihood, on segments of labelled texts of LENGTH words or fewer, a part of them
spliced from two languages, so that the chain learns what a switch costs. A text is labelled word by word by
forward-backward; its language is the one of the largest summed marginal, its score that sum's share. Training uses at most
ROWS texts of each language, those of the smallest hashes of their ids, TOTAL texts in all, and SEGMENTS segments of each;
every language that has a labelled text with a letter is learned, however short its texts. Scoring reads whole texts.

Nulls and texts without a letter are `und` with score 0. Rows with a null doc_id are scored and not learned from. Of a
doc_id with several languages the smallest counts. Languages whose sums tie go to the smallest name. Rows
repeated come out as often as they came in; other columns are ignored; where nothing can be learned all is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_arrow

#: The most training texts of a language, segments of a text, and training texts in all.
ROWS, SEGMENTS, TOTAL = 200, 24, 20_000
LENGTH = 24
#: Cells of the table of n-gram weights, and of what a step of learning holds; the more languages, the fewer n-grams.
HASHES, MOST_CELLS = 1 << 16, 1 << 22
ORDERS = (1, 2, 3, 4)
OFTEN = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts and, for each text, where its words end."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}]+")
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()] if len(lists) else np.zeros(0, np.int64)
    return flat.filter(pa.array(full)), ends.astype(np.int64)


def hashes_for(languages: int) -> int:
    return min(HASHES, 1 << max(10, (MOST_CELLS // max(languages, 1)).bit_length() - 1))


def features(words: pa.Array, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of distinct words (flat), where each word's begin, and a hash of each word."""
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words, pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    buffers = marked.buffers()
    at = np.frombuffer(buffers[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
    at = at - at[0]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))
    grams, owners = [], []
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    rolled = np.zeros(len(raw), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        part = np.zeros(len(raw), np.uint64)
        part[: len(raw) - k + 1] = raw[k - 1 :]
        rolled = rolled * np.uint64(257) + part + np.uint64(1)
        if k in ORDERS:
            ok = left >= k
            grams.append((((rolled[ok] + np.uint64(k)) * _ODD) >> np.uint64(48)).astype(np.int64) & (hashes - 1))
            owners.append(owner[ok])
    power = (np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (raw + np.uint64(1)) * power * _ODD
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed * (power * power * _ODD + raw), at[:-1]) if len(words) else np.zeros(0, np.uint64)
    order = np.argsort(np.concatenate(owners), kind="stable")
    flat = np.concatenate(grams)[order]
    sizes = np.bincount(np.concatenate(owners), minlength=len(words))
    return flat, np.cumsum(sizes) - sizes, whole


class Field:
    """The learned field: weights of n-grams and of lexicon words, transitions, first-word weights."""

    def __init__(self, labels: list[str], grams: np.ndarray, lexicon: np.ndarray, entries: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.labels, self.grams, self.lexicon, self.entries, self.moves, self.first = labels, grams, lexicon, entries, moves, first

    def emissions(self, words: pa.Array) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 1 << 16):
            flat, begin, whole = features(words.slice(a, 1 << 16), len(self.grams))
            if not len(begin):
                continue
            part = np.add.reduceat(self.grams[flat], begin) / np.maximum(np.diff(np.append(begin, len(flat))), 1)[:, None]
            at = np.minimum(np.searchsorted(self.lexicon, whole), max(len(self.lexicon) - 1, 0))
            known = self.lexicon[at] == whole if len(self.lexicon) else np.zeros(len(whole), bool)
            part[known] += self.entries[at[known]]
            out[a : a + (1 << 16)] = part
        return out

    def sums(self, emission: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text the marginals of its words, summed; all texts step together, the longest first."""
        sizes = np.diff(np.concatenate([[0], ends]))
        order = np.argsort(-sizes, kind="stable")
        length = sizes[order]
        start = (ends - sizes)[order]
        total = np.zeros((len(sizes), len(self.labels)))
        most = int(length[0]) if len(length) else 0
        active = len(length) - np.searchsorted(length[::-1], np.arange(most), "right")
        moves = np.exp(self.moves).astype(np.float32)
        weight = np.exp(emission - emission.max(1, keepdims=True))
        forward = np.empty_like(weight)
        now = np.exp(self.first).astype(np.float32)[None, :] * weight[start[: active[0]]] if most else None
        for t in range(most):
            if t:
                now = (now[: active[t]] @ moves) * weight[start[: active[t]] + t]
            now = now / now.sum(1, keepdims=True)
            forward[start[: active[t]] + t] = now
        back = np.ones((0, len(self.labels)), np.float32)
        for t in range(most - 1, -1, -1):
            if len(back):
                back = (back * weight[start[: len(back)] + t + 1]) @ moves.T
                back = back / back.max(1, keepdims=True)
            if len(back) < active[t]:
                back = np.concatenate([back, np.ones((active[t] - len(back), back.shape[1]), np.float32)])
            both = forward[start[: active[t]] + t] * back
            total[: active[t]] += both / both.sum(1, keepdims=True)
        out = np.empty_like(total)
        out[order] = total
        return out


def fit(segments: list[str], marks: list[str], rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field | None:
    """Learns the field from texts, cut into rows of LENGTH words or fewer, and the language of each."""
    labels = sorted(set(marks))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    words, ends = words_of(pa.array(segments, pa.large_string()))
    coded = words.dictionary_encode()
    ids, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    n = len(labels)
    hashes = hashes_for(n)
    flat, begin, whole = features(distinct, hashes)
    sizes = np.diff(np.append(begin, len(flat)))
    often = np.bincount(ids, minlength=len(distinct)) >= OFTEN
    lexicon = np.unique(whole[often])
    entry = np.where(often, np.searchsorted(lexicon, whole), -1)
    # Words are laid out in rows, filled up to LENGTH; `lengths` tells how many of a row are words.
    code = {label: k for k, label in enumerate(labels)}
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rows_of = -(-(ends - begins) // LENGTH)
    owner = np.repeat(np.arange(len(ends)), rows_of)
    if not len(owner):
        return None
    place = np.arange(LENGTH)
    starts = begins[owner] + LENGTH * (np.arange(len(owner)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of))
    lengths = np.minimum(ends[owner] - starts, LENGTH)
    x = ids[np.minimum(starts[:, None] + place, len(ids) - 1)]
    y = np.repeat(np.array([code[marks[k]] for k in owner], np.int64)[:, None], LENGTH, 1)
    # A part is spliced from two rows, so that the chain learns what a switch costs.
    other = rng.permutation(len(x))
    for i in np.flatnonzero(rng.random(len(x)) < 0.3):
        at = int(rng.integers(4, LENGTH - 4))
        if lengths[i] > at and lengths[other[i]] > at:
            x[i, at:], y[i, at:], lengths[i] = x[other[i], at:], y[other[i], at:], lengths[other[i]]
    shapes = [(hashes, n), (max(len(lexicon), 1), n), (n, n), (n,)]
    values = [np.zeros(s) for s in shapes]
    squares = [np.full(s, 1e-8) for s in shapes]
    size = min(len(x), max(64, min(3000, MOST_CELLS // (LENGTH * n))))
    for turn in range(max(rounds, rounds * n * 200 // (size * 20)) if size < len(x) else rounds):
        grams, entries, moves, first = values
        chosen = rng.permutation(len(x))[:size]
        own, xs = np.unique(x[chosen], return_inverse=True)
        xs, ys, valid = xs.reshape(size, LENGTH), y[chosen], place < lengths[chosen, None]
        parts = np.repeat(begin[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
        at, first_of = flat[parts], np.cumsum(sizes[own]) - sizes[own]
        emit = np.stack([np.add.reduceat(grams[at, c], first_of) for c in range(n)], 1) / np.maximum(sizes[own], 1)[:, None]
        known = entry[own] >= 0
        emit[known] += entries[entry[own[known]]]
        slope, pair, begun = slopes(emit[xs], ys, valid, moves, first)
        per_word = np.stack([np.bincount(xs.ravel(), slope[:, :, c].ravel(), minlength=len(own)) for c in range(n)], 1)
        of_grams = np.stack([np.bincount(at, np.repeat(per_word[:, c] / np.maximum(sizes[own], 1), sizes[own]), minlength=hashes) for c in range(n)], 1)
        of_entries = np.stack([np.bincount(entry[own[known]], per_word[known, c], minlength=shapes[1][0]) for c in range(n)], 1)
        for v, q, g in zip(values, squares, (of_grams, of_entries, pair, begun), strict=True):
            g = g - decay * v
            q += g * g
            v += rate / (1 + turn / 20) * g / np.sqrt(q)
    grams, entries, moves, first = values
    return Field(labels, grams.astype(np.float32), lexicon, entries.astype(np.float32), moves - moves.max(), first - first.max())


def slopes(emission: np.ndarray, marks: np.ndarray, valid: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the mean log-likelihood of rows of words by emissions, transitions and first words.

    emission is (rows, words, labels); valid tells which are words, the first of a row always being one.
    """
    rows, length, n = emission.shape
    eye = np.eye(n)
    weight = np.exp(emission - emission.max(2, keepdims=True))
    step = np.exp(moves - moves.max())
    forward, back = np.empty_like(weight), np.ones_like(weight)
    now = np.exp(first - first.max()) * weight[:, 0]
    forward[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, length):
        now = (forward[:, t - 1] @ step) * weight[:, t]
        forward[:, t] = now / now.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (back[:, t + 1] * weight[:, t + 1]) @ step.T
        back[:, t] = np.where(valid[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    both = forward * back
    both /= both.sum(2, keepdims=True)
    slope = np.where(valid[:, :, None], eye[marks] - both, 0.0) / rows
    pair = np.zeros((n, n))
    for t in range(1, length):
        on = valid[:, t]
        ahead = (weight[:, t] * back[:, t])[on]
        before = forward[on, t - 1]
        scale = ((before @ step) * ahead).sum(1, keepdims=True)
        pair += eye[marks[on, t - 1]].T @ eye[marks[on, t]] - ((before / scale).T @ ahead) * step
    return slope, pair / rows, slope[:, 0].sum(0)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def drawn(docs: DataFrame, learn: Column, rows: int = ROWS, segments: int = SEGMENTS, total: int = TOTAL, languages: int | None = None) -> DataFrame:
    """(mark_lang, words): segments of LENGTH words or fewer of `rows` labelled texts of each language, cut before they leave the workers.

    Of a text of more than `segments` segments those of the smallest hashes are taken; beyond `total` texts each language
    has fewer, one at least.
    """
    marked = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn).select("doc_id", "lang")
    languages = marked.select("lang").distinct().count() if languages is None else languages
    order = Window.partitionBy("lang").orderBy("mark", "doc_id")
    few = marked.withColumn("mark", F.xxhash64(F.lit(4), "doc_id")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(1, min(rows, total // max(languages, 1))))
    few = few.groupBy("doc_id").agg(F.min("lang").alias("mark_lang"))
    own = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text is not null")
    # The text as of a drawn row: what reads it can't be moved before the join, where it would read all texts.
    text = F.when(F.col("mark_lang").isNotNull(), F.col("text"))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    own = own.select("doc_id", "mark_lang", words.alias("w")).where(F.size("w") > 0)
    places = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / LENGTH).cast("int"))
    taken = F.slice(F.array_sort(F.transform(places, lambda k: F.struct(F.xxhash64("doc_id", k).alias("h"), k.alias("k")))), 1, segments)
    return own.select("doc_id", "mark_lang", F.explode(F.transform(taken, lambda s: F.array_join(F.slice("w", s["k"] * LENGTH + 1, F.lit(LENGTH)), " "))).alias("words"))


def train(docs: DataFrame, learn: Column, rows: int = ROWS) -> Field | None:
    every = [r.lang for r in docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn).select("lang").distinct().collect()]
    found = drawn(docs, learn, rows, languages=len(every)).orderBy("doc_id", "words").select("words", "mark_lang").collect()
    # Texts are drawn without a look at them. A language of which none had a letter is drawn again from those that have one.
    if missing := sorted(set(every) - {r.mark_lang for r in found}):
        found += drawn(docs.where(F.col("lang").isin(missing) & F.col("text").rlike(r"\p{L}")), learn, rows, languages=len(every)).orderBy("doc_id", "words").select("words", "mark_lang").collect()
    return fit([r.words for r in found], [r.mark_lang for r in found])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; rows whose crc32(doc_id) mod 3 is 1 are held out of learning."""
    held = remainder(3) == 1
    field = train(docs, ~held)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        if field is None:
            found, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        else:
            words, ends = words_of(texts)
            coded = words.dictionary_encode()
            emission = field.emissions(coded.dictionary)[np.asarray(coded.indices)] if len(words) else np.zeros((0, len(field.labels)), np.float32)
            total = field.sums(emission, ends)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            whole = total.sum(1)
            best = total.argmax(1)
            found = [field.labels[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            score = np.where(letters & (whole > 0), total.max(1) / np.maximum(whole, 1e-9), 0).clip(0, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = by_arrow(docs.select("doc_id", "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", 8 << 20 if field is None else max(1 << 17, (8 << 20) * 4 // max(4, len(field.labels))))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


