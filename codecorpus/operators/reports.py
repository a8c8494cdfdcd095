"""Grouped reports over a corpus.

Groups are few and may be very uneven, so everything is an aggregate with
partial sums, and lists of paths come as rows, never as one array per group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.operators.common import FILE
from codecorpus.operators.validation import PERFORMANCE, REVIEW, SEMANTIC


def language_stats(classified: DataFrame) -> DataFrame:
    """Files and lines per language."""
    return classified.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("total_loc"))


def language_files(classified: DataFrame) -> DataFrame:
    """The paths behind ``language_stats``, one row each."""
    return classified.select("language", *FILE)


def file_details(
    classified: DataFrame, segments: DataFrame | None = None, errors: DataFrame | None = None
) -> DataFrame:
    """One row per file: path, language, size, loc, number of segments, error.

    Without a stored table of segments, ``classified`` carries them as an array
    column and nothing is shuffled.
    """
    if segments is None:
        counted = classified.withColumn("segments_count", F.size("segments"))
    else:
        counts = segments.groupBy(*FILE).agg(F.count("*").cast("int").alias("_n"))
        slim = classified.select(*FILE, "language", "size", "loc")
        counted = slim.join(counts, FILE, "left").withColumn("segments_count", F.coalesce("_n", F.lit(0)))
    columns = [*FILE, "language", "size", "loc", "segments_count"]
    if errors is None:
        return counted.select(*columns, F.lit(None).cast("string").alias("error"))
    return counted.select(*columns).join(errors.select(*FILE, "error"), FILE, "left")


def segment_stats(details: DataFrame) -> DataFrame:
    """Per language: files, segments, and files with at least one segment."""
    return details.groupBy("language").agg(
        F.count("*").alias("files"),
        F.sum("segments_count").alias("total_segments"),
        F.count_if(F.col("segments_count") > 0).alias("files_with_segments"),
    )


def node_type_distribution(segments: DataFrame) -> DataFrame:
    return segments.groupBy(F.coalesce("node_type", F.lit(fixed.UNKNOWN_NODE_TYPE)).alias("node_type")).agg(
        F.count("*").alias("segments")
    )


def with_share(counts: DataFrame, count: str) -> DataFrame:
    """Adds the percentage of the total to an aggregated table, one decimal."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn("share", F.round(100.0 * F.col(count) / total, 1))


def corpus_summary(details: DataFrame) -> DataFrame:
    """One row: files, lines, files with segments, segments, languages in order."""
    by_language = details.groupBy("language").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"),
        F.count_if(F.col("segments_count") > 0).alias("with_segments"),
        F.sum("segments_count").alias("segments"),
    )

    def total(column: str, name: str):
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    return by_language.agg(
        total("files", "total_files"),
        total("loc", "total_loc"),
        total("with_segments", "files_with_segments"),
        total("segments", "total_segments"),
        F.array_sort(F.collect_set("language")).alias("languages"),
    )


def run_summary(classified: DataFrame, converted: DataFrame) -> DataFrame:
    """One row: files processed, files with output, and the success rate in percent (NULL for no files)."""
    done = converted.select("repo", F.col("source_path").alias("path"), F.lit(1).alias("_done")).distinct()
    return (
        classified.select(*FILE)
        .join(done, FILE, "left")
        .agg(F.count("*").alias("files_processed"), F.count("_done").alias("files_converted"))
        .withColumn("success_rate", F.round(F.try_divide(100.0 * F.col("files_converted"), F.col("files_processed")), 1))
    )


def pass_fail_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("passed").agg(F.count("*").alias("results"))


def validation_matrix(
    results: DataFrame, validators: Iterable[str] = (REVIEW, SEMANTIC, PERFORMANCE)
) -> DataFrame:
    """One row per pair, one boolean column per validator; NULL where it did not run.

    The validators are named beforehand, so no job is spent on finding them.
    """
    return results.groupBy("pair_id").pivot("validator", list(validators)).agg(F.first("passed"))


def matrix_of_reports(
    reports: DataFrame, validators: Iterable[str] = (REVIEW, SEMANTIC, PERFORMANCE)
) -> DataFrame:
    """The same from reports, which hold a pair's outcomes in its row: no shuffle."""

    def outcome(name: str) -> Column:
        return F.get(F.filter("matrix", lambda m: m["validator"] == name), F.lit(0))["passed"].alias(name)

    return reports.select("pair_id", *[outcome(v) for v in validators])


