"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.attention_quality import fit as fit_quality
from codecorpus.llm.attention_quality import scored
from codecorpus.llm.common import table
from codecorpus.llm.decontaminate import contamination
from codecorpus.llm.fertility import judged
from codecorpus.llm.fill_in_middle import fill_in_middle, with_restored
from codecorpus.llm.language_id import fit, identify
from codecorpus.llm.line_dedup import without_duplicate_lines
from codecorpus.llm.ngram_join import ngram_join
from codecorpus.llm.packing import packed
from codecorpus.llm.periodic_runs import periodic_runs
from codecorpus.llm.shards import sharded
from codecorpus.llm.style_tree import main_text
from codecorpus.llm.token_counts import edited_counts, token_tree
from codecorpus.llm.warc import derivatives, responses

try:
    from public_tokenizers import path as vocabulary
except ModuleNotFoundError:

    def vocabulary(name: str) -> str:
        """Where vocabulary files lie, if they are not installed as a module."""
        return f"/opt/tokenizers/{name}"



def op1_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by text, html tag, suffix and host; documents by text and source, which stands for their host."""
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(documents)
    of_pages = identify(pages, model)
    sourced = documents.withColumn("url", F.concat(F.lit("//"), F.col("source")))
    of_documents = identify(sourced, model, "doc_id", "url", "text", declared=F.lit(""), markup=False)
    columns = ["host", "declared", "suffix", "language", F.round("probability", 6).alias("probability"), "text_language"]
    none = F.lit(None).cast("long")
    return of_documents.select(F.col("id").alias("doc_id"), none.alias("page_id"), *columns).unionAll(
        of_pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), *columns)
    )


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")), "page_id")
    return made.withColumn("block_bytes", F.octet_length("block").cast("long")).withColumn("block_md5", F.md5("block")).drop("block")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links", F.col("size").alias("n_shingles"))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_duplicate_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.length("text").alias("n_chars_left"), F.crc32("text").alias("text_crc32"), "n_kept", "n_dropped")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    placed = sharded(docs, 40, keep_text=False)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return pieces.withColumnRenamed("id", "doc_id")


def op9_tokeniser_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measures = ["n_tokens", "n_byte_tokens", "chars_per_token", "fertility", "entropy", "script", "reason"]
    return rows.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", *measures)


def op10_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document, derived from it: one in each half, one at the end."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    text = F.coalesce("text", F.lit(""))
    n, half = F.length(text), F.floor(F.length(text) / 2).cast("int")

    def place(salt: int, size) :
        return F.pmod(F.xxhash64(F.lit(salt), "doc_id", text), F.greatest(size, F.lit(1))).cast("int")

    def edit(at, removed, inserted):
        return F.struct(at.cast("int").alias("at"), removed.cast("int").alias("removed"), inserted.alias("inserted"))

    one, two = place(1, half), half + place(2, n - half)
    edits = F.array(
        edit(one, F.least(place(3, F.lit(40)), half - one), F.concat_ws(" ", F.lit(""), "source", "lang")),
        edit(two, F.least(place(4, F.lit(40)), n - two), F.lit("")),
        edit(n, F.lit(0), F.concat(F.lit(".\nEnd of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("text")))),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), edits.alias("edits"))
    with_tree = docs.withColumn("tree", token_tree(F.col("text"), path))
    counted = with_tree.select("doc_id", edited_counts(F.col("text"), F.col("tree"), F.col("edits"), path).alias("c"))
    return counted.select("doc_id", "c.tokens_before", "c.tokens_after", "c.leaves", "c.leaves_read", "c.chars_read")


def _with_period(texts: pd.Series, draws: pd.Series) -> pd.Series:
    """The words of texts that have a draw, from a place on with those of one period only; null where there is none."""
    made = []
    for text, draw in zip(texts, draws, strict=True):
        words = text.encode("utf-8").split() if isinstance(text, str) and not pd.isna(draw) else []
        if not words:
            made.append(None)
            continue
        n, g = len(words), int(draw)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        made.append(b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]).decode("utf-8"))
    return pd.Series(made, dtype=object)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by a checksum of the id, gets a period first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = h % 10 == 0
    with_period = F.pandas_udf(_with_period, "string")(F.when(chosen, F.col("text")), F.when(chosen, F.floor(h / 10)))
    found = periodic_runs(docs.withColumn("text", F.coalesce(with_period, F.col("text"))))
    # Longest run; ties: least start, then least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, model)
    return rows.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight"
    )


QUERIES = {
    "op1_bayesian_language_id": op1_bayesian_language_id,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_fuzzy_line_dedup": op4_fuzzy_line_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_byte_balanced_shards": op6_byte_balanced_shards,
    "op7_site_style_tree": op7_site_style_tree,
    "op8_first_fit_packing": op8_first_fit_packing,
    "op9_tokeniser_fertility_rules": op9_tokeniser_fertility_rules,
    "op10_edit_aware_token_counts": op10_edit_aware_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_attention_quality": op13_attention_quality,
}
