"""Lines and chunks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions import lexical
from codecorpus.functions.arrays import let, running_sum
from codecorpus.functions.text import chunk_texts
from codecorpus.operators.common import FILE, language_column


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per ``\\n``-delimited line: number from 1, first character, indent and flags.

    ``is_code`` is false for blank lines, lines of comment and lines that begin
    inside a string.  Comments and strings are those of the file's language; a
    C++ directive is code.
    """
    key = F.lower(language_column(files))
    content = F.col("content")
    shown = (
        F.when(key == "python", lexical.mask(content, "python"))
        .when(key == "javascript", lexical.mask(content, "javascript"))
        .when(key == "java", lexical.mask(content, "java"))
        .when(key.isin("c++", "cpp"), lexical.mask(content, "c++"))
        .otherwise(F.translate(content, lexical.JOINED, " "))
    )
    flags = F.flatten(
        F.transform(
            F.split(shown, "\n", -1),
            lambda line: F.transform(
                F.split(line, lexical.JOINED, -1), lambda part, i: (i == 0) & part.rlike(r"\S")
            ),
        )
    )

    def rows(p):
        lengths = F.transform(p["lines"], lambda line: F.length(line) + 1)
        return let(
            running_sum(lengths),
            lambda ends: F.transform(
                p["lines"],
                lambda line, i: F.struct(
                    (i + 1).alias("line_no"),
                    (F.get(ends, i) - F.length(line) - 1).alias("start_char"),
                    F.length(F.regexp_extract(line, r"^[ \t]*", 0)).alias("indent"),
                    line.alias("text"),
                    (~line.rlike(r"\S")).alias("is_blank"),
                    (
                        F.coalesce(F.get(p["flags"], i), F.lit(False))
                        | (key.isin("c++", "cpp") & line.rlike(r"\A[ \t]*#"))
                    ).alias("is_code"),
                ),
            ),
        )

    lines = let(F.struct(F.split(content, "\n", -1).alias("lines"), flags.alias("flags")), rows)
    return files.select(*FILE, F.explode(lines).alias("line")).select(*FILE, "line.*")


def chunk_lines(files: DataFrame, size: int = fixed.CHUNK_LINES) -> DataFrame:
    """Consecutive pieces of ``size`` lines; an empty file has none."""
    return files.select(*FILE, F.posexplode(chunk_texts(F.col("content"), size)).alias("chunk_no", "text"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks put together again in order; the final line break is gone."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    return chunks.groupBy(*FILE).agg(
        F.array_join(F.transform(ordered, lambda c: c["text"]), "\n").alias("content")
    )


def rechunked(files: DataFrame, size: int = fixed.CHUNK_LINES) -> DataFrame:
    """What chunking and joining makes of each file, within the row; empty files stay empty."""
    return files.withColumn("content", F.array_join(chunk_texts(F.col("content"), size), "\n"))


