"""Functions and classes of files, one row per segment.

A file is one row, and all its segments are found inside that row: no shuffle,
whatever the number of files.  Positions are 0-based character offsets (end
exclusive) and 0-based lines (end inclusive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import segments as rules
from codecorpus.functions.arrays import let
from codecorpus.functions.language import base_name
from codecorpus.functions.text import split_lines
from codecorpus.operators.common import FILE, definitions_column, language_column, segmented, tokenised

POSITIONS = ("start_char", "end_char", "start_line", "end_line")


def _rows(files: DataFrame, found: Column) -> DataFrame:
    """Explode an array of segments with their code."""

    def with_code(text: Column) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                s["node_type"].alias("node_type"),
                s["name"].alias("name"),
                rules.code_of(rules.piece_of(text, s["start_char"], s["end_char"]), s).alias("code"),
                *[s[p].alias(p) for p in POSITIONS],
            ),
        )

    return files.select(*FILE, F.posexplode(let(rules.units(F.col("content")), with_code)).alias("segment_no", "segment")).select(
        *FILE, "segment_no", "segment.*"
    )


def _of_language(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(F.lower(language_column(files)).isin(list(names)))


def segment_code(files: DataFrame) -> DataFrame:
    """Segments of every file by the rule of its language, with the fallback of that language."""
    return _rows(segmented(files), F.col("segments"))


def with_segments(files: DataFrame) -> DataFrame:
    """``files`` with an array column ``segments``, for flows that stay inside the row."""
    return segmented(files).drop("_hidden")


def _by_rule(files: DataFrame, *languages: str) -> DataFrame:
    return _rows(tokenised(_of_language(files, *languages)), definitions_column())


def segment_python(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files by indentation, nested ones included."""
    return _by_rule(files, "python")


def segment_braced(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of JavaScript, Java and C++ files by braces."""
    return _by_rule(files, "javascript", "java", "c++", "cpp")


def segment_javascript_regex(files: DataFrame) -> DataFrame:
    """Pattern matches of JavaScript files, each up to the next closing brace."""
    return _rows(_of_language(files, "javascript"), rules.script_matches(F.col("content")))


def segment_whole_file(files: DataFrame) -> DataFrame:
    """One segment per file, for the languages that have no rule."""
    chosen = files.filter(~F.lower(language_column(files)).isin("python", "javascript", "java", "c++", "cpp"))
    return _rows(chosen, rules.whole_file(F.col("content"), base_name(F.col("path"))))


def sliced(content: Column, start_char: Column, end_char: Column, first: Column, last: Column, code: Column) -> Column:
    """Text by offsets if present, else by lines, else the stored code."""
    by_lines = F.array_join(F.slice(split_lines(content), first + 1, last - first + 1), "\n")
    return (
        F.when(
            start_char.isNotNull() & end_char.isNotNull(),
            F.substring(content, start_char + 1, end_char - start_char),
        )
        .when(first.isNotNull() & last.isNotNull(), by_lines)
        .otherwise(code)
    )


def slice_code(files: DataFrame, segments: DataFrame) -> DataFrame:
    """``segments`` with ``code_chunk`` taken from the files they belong to."""
    columns = [F.col(c) for c in ("content", *POSITIONS, "code")]
    return (
        segments.join(files.select(*FILE, "content"), FILE)
        .withColumn("code_chunk", sliced(*columns))
        .drop("content")
    )
