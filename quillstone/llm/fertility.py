"""Quality rules by tokeniser fertility.

The words of a whole text, joined by single spaces, are encoded by two public vocabularies: pieces with byte fallback
(sentencepiece) and byte-level ranks (tiktoken). Characters per token under either, the share of byte-fallback tokens and
the entropy of the text's pieces must lie inside the bands of the text's script and language. The bands are learned from
all documents that pass the base rule: SPREAD times the distance from the median to a quartile, beyond that quartile, with
the quartiles of the text's (script, language), or of its script where that group has under LEAST_GROUP documents, or of
all documents where the script has. LIMITS hold for every text beside these. Base counts (symbols, duplicate lines, repeated three-word windows) come with the
verdict; `rejects` counts what each figure rejects. A text costs memory in proportion to its length.

The figures of each row are written to the shared folder, as bands and verdict both read them. Groups that hold many rows
are joined by a broadcast of bounded size.

Nulls and texts without words have zero counts and fail the base rule. A null language is a group like any other. Rows
repeated come out as often as they came in; null doc_ids are kept; other columns are ignored; a table without `lang` has
one language. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .shared import by_arrow, joined, stored, texts_of

#: Script: first and last code points; the first that holds a character names it. Others are "other".
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
LEAST_WORDS, MOST_REPEATED = 50, 50
#: How far beyond a quartile a band reaches, in distances from the median to it; documents that make a group.
SPREAD, LEAST_GROUP = 4.0, 200
#: Script: least and most characters per piece, most share of byte-fallback pieces, least bits of entropy; limits for any corpus.
LIMITS = {
    "latin": (1.3, 8.0, 0.05, 4.0), "cyrillic": (1.0, 8.0, 0.05, 4.0), "greek": (0.7, 6.0, 0.2, 3.5), "hebrew": (0.6, 6.0, 0.3, 3.5), "arabic": (0.6, 6.0, 0.3, 3.5), "indic": (0.4, 6.0, 0.6, 3.0), "thai": (0.4, 6.0, 0.6, 3.0),
    "kana": (0.4, 4.0, 0.5, 4.0), "han": (0.3, 3.0, 0.8, 4.0), "hangul": (0.3, 3.0, 0.8, 4.0), "other": (0.3, 8.0, 0.5, 3.0),
}
#: Figure: the least distance from the median to a quartile, and if its band has a lower and an upper end.
FIGURES = {"chars_per_token": (0.05, True, True), "chars_per_rank": (0.05, True, True), "fallback_share": (0.005, False, True), "token_entropy": (0.05, True, True)}
_STARTS = np.array([s for _, s, _ in SCRIPTS])
_ENDS = np.array([e for _, _, e in SCRIPTS])
_CODE = np.array([NAMES.index(n) for n, _, _ in SCRIPTS])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def pieces(path: str):
    """The encoder of a sentencepiece file, and which of its ids are bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


@lru_cache(2)
def ranked(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def fertility(plain: str, chars: int, vocabulary: str, ranks: str) -> tuple[float, float, float, float]:
    """Of words joined by single spaces: characters per piece, per rank, share of byte-fallback pieces, bits of entropy."""
    model, byte = pieces(vocabulary)
    ids = np.array(model.encode(plain), np.int64)
    kinds, times = np.unique(ids, return_counts=True)
    share = times / max(len(ids), 1)
    others = len(ranked(ranks).encode_ordinary(plain))
    return chars / max(len(ids), 1), chars / max(others, 1), float(times[byte[kinds]].sum() / max(len(ids), 1)), float(-(share * np.log2(share)).sum()) + 0.0


def repeated(at: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(at) < 4:
        return 0
    base = int(at.max()) + 1
    if base < 1 << 21:
        key = (at[:-2] * base + at[1:-1]) * base + at[2:]
    else:
        _, pair = np.unique(at[:-1] * base + at[1:], return_inverse=True)
        key = pair[:-1] * base + at[2:]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    covered = np.zeros(len(at), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def script_of(text: str, seen: np.ndarray) -> str:
    """The script of most characters; `seen` counts the text's bytes, so that only characters beyond ASCII are looked up."""
    counts = np.zeros(len(NAMES), np.int64)
    counts[NAMES.index("latin")] = seen[65:91].sum() + seen[97:123].sum()
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = points[points >= 0x80]
        at = np.searchsorted(_STARTS, points, "right") - 1
        counts += np.bincount(_CODE[at[(at >= 0) & (points <= _ENDS[np.maximum(at, 0)])]], minlength=len(NAMES))
    return NAMES[int(counts.argmax())]


def figures(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): base counts, base_failed, script, lang, the figures of FIGURES."""
    path, other = vocabulary or default_vocabulary(), ranks or default_ranks()
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", *FIGURES]

    def row(data: bytes) -> tuple:
        words = data.split()
        raw = np.frombuffer(data, np.uint8)
        seen = np.bincount(raw, minlength=256)
        symbols = int(seen[_SYMBOLS].sum())
        lines = [x for x in data.split(b"\n") if x.strip()]
        plain = b" ".join(words).decode("utf-8", "replace")
        chars = len(plain) - max(len(words) - 1, 0)
        last = dict(zip(words, range(len(words)), strict=True))
        again = repeated(np.fromiter(map(last.__getitem__, words), np.int64, len(words)))
        failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
        return len(words), chars, symbols, len(lines) - len(set(lines)), again, failed, script_of(plain, seen), *fertility(plain, chars, path, other)

    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()] + [pa.float64()] * 4

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(row(x) for x in texts_of(batch.column(2))), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, " + ", ".join(f"{f} double" for f in FIGURES)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return by_arrow(docs.select("doc_id", lang.alias("lang"), "text"), work, schema, 4 << 20)


def bands(rows: DataFrame, keys: list[str], spread: float = SPREAD, least: int = LEAST_GROUP) -> DataFrame:
    """(keys, low_* and high_* of each figure, n) of every group: n counts its documents; the ends are null where under `least` pass the base rule."""
    passing = ~F.col("base_failed")
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(passing).alias("passing"), *(F.percentile_approx(F.when(passing, F.col(f)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f) for f in FIGURES))
    ends = []
    for f, (floor, lower, upper) in FIGURES.items():
        low, middle, high = (F.get(f, F.lit(k)) for k in range(3))
        enough = F.col("passing") >= least
        ends.append(F.when(enough, low - spread * F.greatest(middle - low, F.lit(floor)) if lower else F.lit(float("-inf"))).alias(f"low_{f}"))
        ends.append(F.when(enough, high + spread * F.greatest(high - middle, F.lit(floor)) if upper else F.lit(float("inf"))).alias(f"high_{f}"))
    return own.select(*keys, *ends, "n")


def outside(figure: str) -> Column:
    return F.coalesce((F.col(figure) < F.col(f"low_{figure}")) | (F.col(figure) > F.col(f"high_{figure}")), F.lit(False))


def rules(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, spread: float = SPREAD, least: int = LEAST_GROUP) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): base counts, figures, base_failed, kept, outside (names of figures beyond their bands)."""
    rows = stored(figures(docs, vocabulary, ranks), "figures")
    ends = [f"{side}_{f}" for f in FIGURES for side in ("low", "high")]
    of_group, of_script, of_all = (bands(rows, keys, spread, least) for keys in (["script", "lang"], ["script"], []))
    # Scripts are a dozen and `of_all` is one row or none; a (script, language) may hold most rows or be one of many.
    found = joined(rows, of_group, ["script", "lang"], ends, rows.count())
    by_script = of_script.select(F.col("script").alias("s"), *(F.col(e).alias(f"s_{e}") for e in ends))
    found = found.join(F.broadcast(by_script), F.col("script") == F.col("s"), "left").join(F.broadcast(of_all.select(*(F.col(e).alias(f"a_{e}") for e in ends))), F.lit(True), "left")
    found = found.withColumns({e: F.coalesce(e, f"s_{e}", f"a_{e}") for e in ends})
    limit = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, ends in LIMITS.items() for x in (name, ends[k]))), F.col("script"))
    beyond = {"chars_per_token": ~F.col("chars_per_token").between(limit(0), limit(1)), "fallback_share": F.col("fallback_share") > limit(2), "token_entropy": F.col("token_entropy") < limit(3)}
    found = found.withColumn("outside", F.array_compact(F.array(*(F.when(outside(f) | beyond.get(f, F.lit(False)), F.lit(f)) for f in FIGURES))))
    kept = ~F.col("base_failed") & (F.size("outside") == 0)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "script", "lang", *FIGURES, F.array_join("outside", ",").alias("outside"))


def rejects(verdicts: DataFrame) -> DataFrame:
    """(script, lang, figure, n): how many documents that pass the base rule each figure rejects."""
    own = verdicts.where("not base_failed").select("script", "lang", F.explode(F.split("outside", ",")).alias("figure"))
    return own.where("figure <> ''").groupBy("script", "lang", "figure").agg(F.count(F.lit(1)).alias("n"))
