"""Quality rules from a public tokeniser: fertility, byte fallback and token entropy, with bands per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh, in_slices, row_key, written

SYMBOLS = b"#*$%&|<>"
#: Tokens over which entropy is taken, so that it doesn't depend on a text's length.
WINDOW = 128
#: First and last code point of scripts, after which a text without a language is judged.
SCRIPTS = {
    "latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF),
    "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}
NAMES = [*SCRIPTS, "other"]


def script_of(word: str) -> int:
    """Number of the script of the word's first letter, in the order of ``NAMES``."""
    if word.isascii():
        return 0 if any(c.isalpha() for c in word) else len(SCRIPTS)
    for c in word:
        if c.isalpha():
            for i, (first, last) in enumerate(SCRIPTS.values()):
                if first <= ord(c) <= last:
                    return i
            break
    return len(SCRIPTS)


class WordTokens:
    """Tokens of every word seen, as flat arrays; a worker forgets them beyond ``remembered`` words."""

    def __init__(self, model: str, remembered: int = 300_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens, self.starts = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.chars = self.bytes = self.scripts = np.empty(0, dtype=np.int64)

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.remembered:
            self.clear()
        new = list(words.difference(self.known))
        if not new:
            return
        texts = [w.decode("utf-8") for w in new]
        found = self.model.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((t for x in found for t in x), dtype=np.int32, count=int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        fallback = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.tokens = np.concatenate([self.tokens, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends[1:]])
        self.bytes = np.concatenate([self.bytes, fallback[ends[1:]] - fallback[ends[:-1]]])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))])
        self.scripts = np.concatenate([self.scripts, np.fromiter(map(script_of, texts), dtype=np.int64, count=len(texts))])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that end before ``ends``; an empty run is 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def repeated_words(ids: np.ndarray, rows: np.ndarray, n_rows: int, n_words: int) -> np.ndarray:
    """Per row, words inside three-word windows that its text has twice or more."""
    if len(ids) < 3:
        return np.zeros(n_rows, dtype=np.int64)
    inside = rows[:-2] == rows[2:]
    at = np.flatnonzero(inside)
    pairs, _ = pd.factorize(ids[at] * np.int64(n_words) + ids[at + 1])
    triples, found = pd.factorize(pairs.astype(np.int64) * n_words + ids[at + 2])
    keys, _ = pd.factorize(rows[at] * np.int64(max(1, len(found))) + triples)
    often = np.bincount(keys)[keys] > 1 if len(keys) else np.empty(0, dtype=bool)
    hit = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        hit[at[often] + shift] = True
    return np.bincount(rows[hit], minlength=n_rows)


def window_entropies(tokens: np.ndarray, sizes: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mean entropy, in bits, of each text's windows of ``WINDOW`` tokens; the last one reaches to the end.

    A shorter text is one window, its entropy scaled by the logarithms of the sizes. No token: 0.
    """
    begins = np.cumsum(sizes) - sizes
    full = sizes // WINDOW
    rest = (sizes % WINDOW != 0) & (full > 0)
    count = np.where(full == 0, (sizes > 0).astype(np.int64), full + rest)
    row = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(sizes[row], WINDOW)
    start = begins[row] + np.minimum(number * WINDOW, sizes[row] - length)
    window = np.repeat(np.arange(len(row)), length)
    place = np.arange(len(window)) - np.repeat(np.cumsum(length) - length, length)
    keys = window * np.int64(vocabulary) + tokens[start[window] + place]
    found, codes = np.unique(keys, return_counts=True)
    sums = np.bincount(found // vocabulary, weights=codes * np.log2(codes), minlength=len(row))
    bits = np.log2(np.maximum(length, 1)) - sums / np.maximum(length, 1)
    bits = np.where(length < WINDOW, bits * math.log2(WINDOW) / np.log2(np.maximum(length, 2)), bits)
    return np.bincount(row, weights=bits, minlength=len(sizes)) / np.maximum(count, 1)


#: Characters of texts measured at a time; arrays over their tokens are most of a task's memory.
SLICE = 1_000_000

_MEASURED = (
    "id string, kid long, kh long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, n_byte_tokens long, entropy double"
)


def _measure(model: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordTokens(model)
        for frame in in_slices(frames, "text", SLICE):
            words, counts, symbols, repeats = [], [], [], []
            for text in frame.text:
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                found = raw.split()
                words += found
                counts.append(len(found))
                symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
                lines = [line for line in raw.split(b"\n") if line.strip()]
                repeats.append(len(lines) - len(set(lines)))
            known.learn(set(words))
            ids = np.fromiter(map(known.known.__getitem__, words), dtype=np.int64, count=len(words))
            counts = np.array(counts, dtype=np.int64)
            ends, rows = np.cumsum(counts), np.repeat(np.arange(len(counts)), counts)
            sizes = known.starts[ids + 1] - known.starts[ids]
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tokens = known.tokens[np.repeat(known.starts[ids], sizes) + place]
            n_tokens = _sums(sizes, ends)
            grid = np.bincount(rows * len(NAMES) + known.scripts[ids], weights=known.chars[ids], minlength=len(counts) * len(NAMES))
            script = grid.reshape(-1, len(NAMES)).argmax(axis=1)
            yield pd.DataFrame(
                {
                    "id": frame.id.array, "kid": frame.kid.array, "kh": frame.kh.array, "lang": frame.lang.array,
                    "script": [NAMES[i] for i in script], "n_words": counts, "word_chars": _sums(known.chars[ids], ends),
                    "n_symbols": symbols, "n_dup_lines": repeats,
                    "n_repeat_words": repeated_words(ids, rows, len(counts), len(known.known)),
                    "n_tokens": n_tokens, "n_byte_tokens": _sums(known.bytes[ids], ends),
                    "entropy": window_entropies(tokens, n_tokens, len(known.is_byte)),
                }
            )

    return run


def judged(
    docs: DataFrame,
    model: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str | None = "lang",
    fertility_band: float = 8.0,
    entropy_band: float = 4.0,
    byte_share: float = 0.05,
    prior_documents: float = 30.0,
    across_scripts: float = 0.1,
) -> DataFrame:
    """Measures and verdict of every document; ``model`` is a piece model with byte fallback.

    Words are runs without ASCII white space, encoded one by one. Measures: characters per
    token, tokens per word (fertility), share of byte-fallback tokens, and token entropy in
    windows of ``WINDOW`` tokens. Base rule: fewer than 50 words, or more than half of them in
    repeated three-word windows, fails.

    Documents that pass the base rule give medians and spreads (half of the distance between
    the tenths) of each measure, per language, or per script where the language is null or
    blank. Rejected is: entropy below median - entropy_band spreads; fertility above, or
    characters per token outside, fertility_band spreads, widened for texts of few tokens; a
    byte share above the median by ``byte_share`` and fertility_band spreads. Medians and spreads
    of a script are drawn towards those of the whole table, and those of a language towards
    its script's: of n documents the own figure has the weight n² / (n² + prior_documents²), so a band moves
    smoothly with their number, and a handful, odd ones among them, decides next to nothing. A language's or script's spread is at least a hundredth of its median, the whole
    table's ``across_scripts`` of it, as sound texts of another script are further apart than those of one. So every
    document is judged where any passes the base rule. ``reason`` names what failed.

    Null and empty texts have no words and fail the base rule. Every row gets its own result.
    """
    kid, kh = row_key(F.col(id_column), F.col(text_column))
    lang = F.col(lang_column).cast("string") if lang_column else F.lit(None).cast("string")
    keyed = docs.select(
        F.col(id_column).cast("string").alias("id"), kid.alias("kid"), kh.alias("kh"), F.col(text_column).alias("text"), lang.alias("lang")
    )
    measured = written(keyed.mapInPandas(_measure(model), _MEASURED), "fertility")
    tokens, words = F.greatest("n_tokens", F.lit(1)), F.greatest("n_words", F.lit(1))
    measured = measured.withColumns(
        {
            "id": F.col("id").cast("long"),
            "band": F.when(F.trim("lang") != "", F.col("lang")).otherwise(F.concat(F.lit("script "), F.col("script"))),
            "chars_per_token": F.col("word_chars") / tokens,
            "fertility": F.col("n_tokens") / words,
            "byte_share": F.col("n_byte_tokens") / tokens,
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    measures = ["chars_per_token", "fertility", "byte_share", "entropy"]
    # Each document counts for its language, its script and the whole table: levels 0 to 2 of one aggregate.
    levels = [F.struct(F.lit(i).alias("level"), x.alias("band")) for i, x in enumerate([F.col("band"), F.concat(F.lit("script "), F.col("script")), F.lit("")])]
    passed = measured.where(~F.col("base_failed")).select("script", *measures, F.inline(F.array(*levels)))
    bands = (
        passed.groupBy("level", "band")
        .agg(F.count("*").alias("n"), *[F.percentile_approx(m, [0.1, 0.5, 0.9], 10_000).alias(f"{m}_q") for m in measures])
    )
    for m in measures:
        q = F.col(f"{m}_q")
        bands = bands.withColumns({f"{m}_mid": q[1], f"{m}_spread": F.greatest((q[2] - q[0]) / 2, F.abs(q[1]) * F.when(F.col("level") == 2, across_scripts).otherwise(0.01))}).drop(f"{m}_q")
    found = F.struct("n", *[c for m in measures for c in (f"{m}_mid", f"{m}_spread")])
    bands = written(bands.select("level", "band", found.alias("found")), "bands")

    def of_level(level: int, key: str) -> DataFrame:
        return bands.where(F.col("level") == level).select(F.col("band").alias(key), F.col("found").alias(f"found{level}"))

    joined = (
        measured.withColumns({"by_script": F.concat(F.lit("script "), F.col("script")), "by_all": F.lit("")})
        .join(of_level(0, "band"), "band", "left").join(of_level(1, "by_script"), "by_script", "left").join(F.broadcast(of_level(2, "by_all")), "by_all", "left")
    )

    def drawn(field: str) -> Column:
        """A language's figure drawn towards its script's, that one drawn towards the whole table's."""
        figure = F.col(f"found2.{field}")
        for level in ("found1", "found0"):
            squared = F.coalesce(F.col(f"{level}.n").cast("double") * F.col(f"{level}.n"), F.lit(0.0))
            weight = squared / (squared + prior_documents**2)
            figure = weight * F.coalesce(f"{level}.{field}", F.lit(0.0)) + (1 - weight) * figure
        return figure.alias(field)

    joined = joined.select(*measured.columns, *[drawn(f"{m}_{kind}") for m in measures for kind in ("mid", "spread")])
    wide = fertility_band * F.sqrt(1 + 256 / tokens)

    def off(measure: str) -> Column:
        return F.col(measure) - F.col(f"{measure}_mid")

    spread = {m: F.col(f"{m}_spread") for m in measures}
    reason = (
        F.when(F.col("base_failed"), F.lit("base"))
        .when(off("entropy") < -entropy_band * spread["entropy"], F.lit("entropy"))
        .when(off("fertility") > wide * spread["fertility"], F.lit("fertility"))
        .when(F.abs(off("chars_per_token")) > wide * spread["chars_per_token"], F.lit("chars per token"))
        .when(off("byte_share") > byte_share + wide * spread["byte_share"], F.lit("byte fallback"))
    )
    return joined.select(*measured.columns, reason.alias("reason")).withColumn("kept", F.col("reason").isNull())


def without_rejected(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that are kept, in all their columns."""
    kid, kh = fresh(docs, "kid", "kh")
    one, two = row_key(F.col(id_column), F.col(text_column))
    kept = judged(docs, model, id_column, text_column, **options).where("kept").select(F.col("kid").alias(kid), F.col("kh").alias(kh))
    return docs.withColumns({kid: one, kh: two}).join(kept.distinct().hint("merge"), [kid, kh], "left_semi").drop(kid, kh)
