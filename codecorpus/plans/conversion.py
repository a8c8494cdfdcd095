"""The two halves of converting a corpus, split at the external rewriting step."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.operators.assembly import assemble_files, pair_converted, promote
from codecorpus.operators.classify import classify
from codecorpus.operators.filters import filter_convertible, scannable
from codecorpus.operators.limits import admit_within_budget, truncate_lines
from codecorpus.operators.lines import rechunked
from codecorpus.operators.reports import run_summary
from codecorpus.operators.requests import conversion_requests
from codecorpus.operators.validation import pair_languages, run_validators
from codecorpus.session import scratch_path


def scan_corpus(
    files: DataFrame,
    max_bytes: int | None = None,
    max_lines: int | None = None,
    max_total: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Scan rules over a ``files`` table.  Filters need no content, so they reach the scan.

    Limits are off unless they are given: the size of a file, its lines (``truncated`` tells
    which files had more), and per repository the bytes and files in all, which suit one
    interactive run.  ``left_out`` counts what they keep back.
    """
    kept = scannable(files, max_bytes)
    if max_total is not None or max_files is not None:
        most = (1 << 62) if max_total is None else max_total
        kept = admit_within_budget(kept, most, (1 << 31) - 1 if max_files is None else max_files)
    return kept if max_lines is None else truncate_lines(kept, max_lines)


def left_out(files: DataFrame, **limits: int) -> DataFrame:
    """Per repository: files by the scan rules, and how many of them limits leave out or truncate."""
    scanned = scan_corpus(files, **limits)
    cut_short = F.count_if("truncated") if "truncated" in scanned.columns else F.lit(0).cast("long")
    kept = scanned.groupBy("repo").agg(F.count("*").alias("kept"), cut_short.alias("truncated"))
    every = scannable(files, None).groupBy("repo").agg(F.count("*").alias("files"))
    none = F.lit(0).cast("long")
    return every.join(kept, "repo", "left").select(
        "repo", "files", (F.col("files") - F.coalesce("kept", none)).alias("left_out"), F.coalesce("truncated", none).alias("truncated")
    )


def corpus_to_requests(files: DataFrame, target: str, **limits: int) -> DataFrame:
    """Files to one request per function or class; ``limits`` are those of ``scan_corpus``.

    Without a budget this is a single map over the files: no shuffle at all.
    """
    convertible = rechunked(filter_convertible(classify(scan_corpus(files, **limits))))
    return conversion_requests(convertible, target)


class Converted(NamedTuple):
    files: DataFrame
    results: DataFrame
    reports: DataFrame
    promoted: DataFrame
    summary: DataFrame


def responses_to_reports(
    classified: DataFrame,
    responses: DataFrame,
    timings: DataFrame,
    review_responses: DataFrame,
    target: str,
    strict: bool = False,
) -> Converted:
    """Answers to converted files, their validation, the files to put out and the run summary.

    ``pair_id`` of timings and reviews is that of ``pair_id_of``.  Converted files
    and reports feed several outputs, so both are written once.
    """
    spark = classified.sparkSession
    converted = stored(assemble_files(classified, responses, target), scratch_path(spark, "converted"))
    pairs = pair_converted(classified, converted, target).withColumn("pair_id", pair_id_of("repo", "original_path"))
    results, reports = run_validators(pairs, timings, review_responses, strict=strict)
    reports = stored(reports, scratch_path(spark, "reports"))
    results = reports.select("pair_id", F.explode("matrix").alias("m")).select("pair_id", "m.*")
    named = pair_languages(
        converted.withColumnsRenamed({"source_path": "original_path", "output_path": "converted_path"})
    ).withColumn("pair_id", pair_id_of("repo", "original_path"))
    return Converted(converted, results, reports, promote(reports, named), run_summary(classified, converted))


def pair_id_of(repo: str, path: str):
    """Identifier of the pair an original file belongs to."""
    return F.sha2(F.concat_ws("\n", F.col(repo), F.col(path)), 256)


def stored(frame: DataFrame, folder: str) -> DataFrame:
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)
