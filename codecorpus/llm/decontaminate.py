"""Benchmark decontamination: a prefix-filtered set join, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh, row_key, written

#: What no word holds: ASCII other than digits and letters (upper-case ones are lowered first).
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to this many bytes of prefix tokens every executor gets a copy; beyond, they are shuffled.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """Words of the text as written, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")


def lowered(array: Column) -> Column:
    """The words with A-Z in lower case; letters beyond ASCII stay as they are."""
    return F.transform(array, lambda w: F.translate(w, UPPER, LOWER))


def windows(items: DataFrame, id_column: str, text_column: str, length: int) -> DataFrame:
    """``item string, window array<string>``: all runs of ``length`` words; a shorter item is one run.

    Items without a word or without an id give none. Equal windows of an item are one.
    """
    worded = items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("item"), lowered(words(F.col(text_column))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    return (
        worded.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), length).alias("window"))
        .distinct()
    )


def _sent(small: DataFrame, bytes_of: Column) -> DataFrame:
    """The frame, marked for broadcast if its measured size allows."""
    size = small.agg(F.sum(bytes_of)).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 13,
    share: int = 20,
) -> DataFrame:
    """One row per document: ``id, kid, kh, n_words, n_hit, n_items, items, contaminated``.

    A document contains a window if all its words stand there in a row. Needed overlap is the
    whole window, so its prefix is one token: the rarest of its words over all documents.
    1. Frequencies of the words that benchmark items have, combined before the shuffle.
    2. Each window is keyed by its rarest word (ties by the word), with its place in the window.
    3. Words of documents are joined with these tokens, as (row, place, word) without the text.
       Length and position bounds: the window must begin at or after the first word and end at
       or before the last.
    4. Candidate places meet the words of their document once and are verified word by word.
    Tokens are full lower case, which is cheap and never parts words that are equal in A-Z
    lower case; the verification lowers A-Z alone.

    n_hit: words inside any verified window. n_items, items: whose windows occur, ids as sorted
    strings. contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have
    no words. Rows equal in id and text get equal results. Items with a null id count for
    nothing. Tokens are broadcast only up to ``BROADCAST_BYTES``, measured.
    """
    kid, kh = row_key(F.col(id_column), F.col(text_column))
    source = docs.select(F.col(id_column).cast("long").alias("id"), kid.alias("kid"), kh.alias("kh"), F.col(text_column).alias("text"))
    unique = windows(items, item_id, item_text, length).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("owners"))
    unique = written(unique.withColumn("window_id", F.xxhash64("window")), "windows")
    tokens_of = unique.select("window_id", F.size("window").alias("length"), F.posexplode("window").alias("place", "raw")).select(
        "window_id", "length", "place", F.lower("raw").alias("word")
    )
    vocabulary = written(tokens_of.select("word").distinct(), "benchmark-words")
    byte_size = F.octet_length("word") + 48
    counts = (
        source.select(F.explode(words(F.col("text"))).alias("raw")).select(F.lower("raw").alias("word"))
        .join(_sent(vocabulary, byte_size), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    counts = written(counts, "benchmark-word-counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place", "length")).alias("rarest")
    prefixes = tokens_of.join(counts, "word", "left").groupBy("window_id").agg(rarest).select("window_id", "rarest.*")
    prefixes = written(prefixes.where("n > 0").drop("n"), "prefixes")
    worded = source.select("kid", "kh", words(F.col("text")).alias("w"))
    tokens = worded.select("kid", "kh", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "raw"))
    candidates = (
        tokens.withColumn("word", F.lower("raw"))
        .join(_sent(prefixes, byte_size + 32), "word")
        .select("kid", "kh", "n_words", (F.col("at") - F.col("place")).alias("start"), "window_id", "length")
        .where("start >= 0 and start + length <= n_words")
        .select("kid", "kh", "start", "window_id")
        .distinct()
    )
    candidates = candidates.join(_sent(unique, F.size("owners") * 16 + F.size("window") * 24 + 48), "window_id")
    of_rows = written(
        candidates.groupBy("kid", "kh").agg(F.collect_list(F.struct("start", "window", "owners")).alias("places")), "candidates"
    )
    joined = source.join(of_rows.hint("merge"), ["kid", "kh"], "left").withColumn("w", words(F.col("text")))
    true_places = F.filter("places", lambda p: lowered(F.slice("w", p.start + 1, F.size(p.window))) == p.window)
    verified = joined.select(
        "id", "kid", "kh", F.size("w").cast("long").alias("n_words"),
        F.when(F.col("places").isNotNull(), true_places).alias("places"),
    )
    spans = F.array_sort(F.transform("places", lambda p: F.struct(p.start.alias("start"), (p.start + F.size(p.window)).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))
    hit = F.aggregate(
        spans,
        zero,
        lambda done, s: F.struct(
            (done.hit + F.greatest(F.lit(0), s.end - F.greatest(s.start, done.upto))).alias("hit"), F.greatest(done.upto, s.end).alias("upto")
        ),
        lambda done: done.hit,
    )
    owners = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: p.owners))))
    none = F.array().cast("array<string>")
    counted = verified.select(
        "id", "kid", "kh", "n_words",
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce(owners, none).alias("items"),
    )
    return counted.select(
        "id", "kid", "kh", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, in all their columns; rows that repeat are kept as often."""
    kid, kh = fresh(docs, "kid", "kh")
    one, two = row_key(F.col(id_column), F.col(text_column))
    judged = contamination(docs, items, id_column, text_column, **options)
    # Past an aggregate, so that the filter doesn't move down, where Spark would split the text anew for every use of its words.
    judged = judged.groupBy(F.col("kid").alias(kid), F.col("kh").alias(kh)).agg(F.bool_or("contaminated").alias("bad"))
    bad = judged.where("bad").select(kid, kh)
    return docs.withColumns({kid: one, kh: two}).join(bad.hint("merge"), [kid, kh], "left_anti").drop(kid, kh)
