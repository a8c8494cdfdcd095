"""Putting answers together into files and matching them with their originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions.language import output_path, target_folder
from codecorpus.functions.prompts import fill
from codecorpus.operators.common import FILE, language_column


def assemble_files(
    classified: DataFrame, responses: DataFrame, target: str, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Per file a header line and its answers in segment order, a blank line between them.

    Files without an answer give no row.  Only path and language of the files take part.
    """
    answered = responses.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("segment_no", "text")))
    bodies = answered.groupBy(*FILE).agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("_body")
    )
    header = fill(fixed.CONVERTED_HEADER, source_language=F.col("language"), target_language=F.lit(target))
    return (
        classified.select(*FILE, language_column(classified).alias("language"))
        .join(bodies, FILE)
        .select(
            "repo",
            F.col("path").alias("source_path"),
            output_path(F.col("path"), F.lit(target), aliases).alias("output_path"),
            F.lit(target).alias("target_language"),
            target_folder(F.lit(target)).alias("target_folder"),
            F.concat(header, F.col("_body")).alias("content"),
        )
    )


def _of_target(converted: DataFrame, target: str) -> DataFrame:
    return converted.filter(F.col("target_folder") == target_folder(F.lit(target))).withColumnRenamed(
        "source_path", "path"
    )


def pair_converted(files: DataFrame, converted: DataFrame, target: str) -> DataFrame:
    """Each original with its converted file, both texts ready for validation."""
    right = _of_target(converted, target).select(
        *FILE, F.col("output_path").alias("converted_path"), F.col("content").alias("converted_code")
    )
    return files.join(right, FILE).select(
        "repo",
        F.col("path").alias("original_path"),
        F.col("content").alias("original_code"),
        "converted_path",
        "converted_code",
    )


def unconverted_files(files: DataFrame, converted: DataFrame, target: str) -> DataFrame:
    """Originals without a converted file."""
    return files.join(_of_target(converted, target).select(*FILE), FILE, "left_anti")


PASSED = "validated"
PASSED_WITH_WARNINGS = "with warnings"
NOT_VALIDATED = "despite validation error"


def promote(reports: DataFrame, converted: DataFrame) -> DataFrame:
    """Converted files that go to the output, with the ground for it.

    ``converted`` has pair_id and is_cross_language; ``reports`` may miss pairs
    whose validation broke off.  Failed or unreported pairs go through only if
    they are cross-language and, where there is a report, not strict.
    """
    verdicts = reports.select("pair_id", "overall_passed", "strict_mode", F.lit(True).alias("_reported"))
    cross = F.col("is_cross_language")
    status = (
        F.when(F.col("overall_passed"), F.lit(PASSED))
        .when(F.col("_reported") & cross & ~F.col("strict_mode"), F.lit(PASSED_WITH_WARNINGS))
        .when(F.col("_reported").isNull() & cross, F.lit(NOT_VALIDATED))
    )
    return (
        converted.join(verdicts, "pair_id", "left")
        .withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .drop("_reported", "overall_passed", "strict_mode")
    )
