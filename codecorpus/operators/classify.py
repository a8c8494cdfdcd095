"""Language, size and priority of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions.language import language_of
from codecorpus.functions.language import priority_band as band_of
from codecorpus.functions.text import line_count


def classify_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def file_metrics(files: DataFrame) -> DataFrame:
    """Number of lines and, in hundreds of lines, the complexity score."""
    return files.withColumn("loc", line_count(F.col("content"))).withColumn(
        "complexity_score", F.col("loc") / F.lit(float(fixed.LINES_PER_COMPLEXITY_POINT))
    )


def priority_band(files: DataFrame) -> DataFrame:
    band = band_of(F.col("loc"))
    return files.withColumns({"difficulty": band["difficulty"], "priority": band["priority"]})


def classify(files: DataFrame) -> DataFrame:
    """``files`` with language, loc, complexity_score, difficulty and priority."""
    return priority_band(file_metrics(classify_language(files)))
