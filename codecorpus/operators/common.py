"""Conventions shared by the operators."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import segments as segment_rules
from codecorpus.functions.language import base_name, language_of
from codecorpus.functions.lexical import positions

# A file is identified by its repository and its path.
FILE = ["repo", "path"]
SEGMENT = [*FILE, "segment_no"]


def language_column(files: DataFrame) -> Column:
    return F.col("language") if "language" in files.columns else language_of(F.col("path"))


# Columns below depend on nothing but the names they read.  Building a large
# expression takes longer than planning it, so each is built once per process.


@cache
def _hidden() -> Column:
    return segment_rules.masked(F.col("content"), F.col("language"))


@cache
def _tokens() -> dict[str, Column]:
    parts, at = F.col("_parts"), F.col("_at")
    return {
        "_parts": segment_rules.definition_parts(F.col("_hidden"), F.col("language")),
        "_at": positions(parts, segment_rules.GROUPS),
        "_depths": F.when(F.lower("language") != "python", segment_rules.brace_depths(parts, at)),
    }


@cache
def definitions_column() -> Column:
    return segment_rules.definitions(*[F.col(c) for c in ("language", "_parts", "_at", "_depths")])


@cache
def _segments() -> Column:
    return segment_rules.or_fallback(F.col("_found"), F.col("content"), F.col("language"), base_name(F.col("path")))


def masked(files: DataFrame) -> DataFrame:
    """``files`` with ``language`` and the masked text as ``_hidden``.

    Costly columns that several others build on become columns of their own:
    Catalyst keeps such a projection and evaluates each of them once per row.
    """
    return files.withColumn("language", language_column(files)).withColumn("_hidden", _hidden())


def tokenised(files: DataFrame) -> DataFrame:
    """``masked`` with matches of definitions, their positions and brace depths."""
    rows = masked(files)
    for name, column in _tokens().items():
        rows = rows.withColumn(name, column)
    return rows


def segmented(files: DataFrame) -> DataFrame:
    """``masked`` with the array column ``segments``; a stored table that has both is taken as it is."""
    if {"_hidden", "segments"} <= set(files.columns):
        return files
    return (
        tokenised(files)
        .withColumn("_found", definitions_column())
        .withColumn("segments", _segments())
        .drop("_parts", "_at", "_depths", "_found")
    )
