"""Scoring pairs of original and converted files.

All rules on texts are columns over one row per pair, so however many run, the
pairs are read once and their texts are never shuffled: only the outcomes meet
the measured run times and the review answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions import rules
from codecorpus.functions.arrays import let
from codecorpus.functions.language import bare_suffix

REVIEW, SEMANTIC, PERFORMANCE = "review", "semantic", "performance"

TEXT_COLUMNS = ("original_path", "original_code", "converted_path", "converted_code")


def pair_languages(pairs: DataFrame) -> DataFrame:
    """Adds source_language, target_language (bare suffixes) and is_cross_language."""
    source, target, cross = rules.pair_languages(F.col("original_path"), F.col("converted_path"))
    return pairs.withColumns({"source_language": source, "target_language": target, "is_cross_language": cross})


def _texts() -> tuple[Column, Column, Column, Column]:
    """Original code, converted code, and the suffixes of both."""
    return (
        F.col("original_code"),
        F.col("converted_code"),
        bare_suffix(F.col("original_path")),
        bare_suffix(F.col("converted_path")),
    )


@cache
def _complexity() -> Column:
    original, converted, source, target = _texts()
    both = F.struct(
        rules.complexity(original, source).alias("original"),
        rules.complexity(converted, target).alias("converted"),
        source.alias("source"),
        target.alias("target"),
    )
    outcome = let(both, lambda b: rules.complexity_result(b["original"], b["converted"], b["source"], b["target"]))
    return rules.unless_unreadable(original, converted, outcome, fixed.COMPLEXITY_ERROR)


@cache
def _structure() -> Column:
    original, converted, source, target = _texts()
    both = F.struct(
        rules.has_structure(original, source).alias("original"),
        rules.has_structure(converted, target).alias("converted"),
        source.alias("source"),
        target.alias("target"),
    )
    outcome = let(both, lambda b: rules.structure_result(b["original"], b["converted"], b["source"], b["target"]))
    return rules.unless_unreadable(original, converted, outcome, fixed.STRUCTURE_ERROR)


@cache
def _normalised_source() -> Column:
    return rules.normalised_source_result(F.col("original_code"), F.col("converted_code"))


@cache
def _runtime() -> Column:
    return rules.runtime_result(*[F.col(c) for c in ("original_s", "converted_s", "original_rc", "converted_rc")])


def _results(rows: DataFrame, keys: list[str], validator: str, outcome: Column) -> DataFrame:
    return rows.select(*keys, F.lit(validator).alias("validator"), outcome.alias("_r")).select(
        *keys, "validator", F.col("_r.passed").alias("passed"), F.col("_r.details").alias("details")
    )


def complexity_metrics(files: DataFrame) -> DataFrame:
    """Metrics of single files as columns."""
    metrics = rules.complexity(F.col("content"), bare_suffix(F.col("path")))
    return files.select("repo", "path", metrics.alias("m")).select("repo", "path", "m.*")


def structural_elements(files: DataFrame) -> DataFrame:
    """Lists of functions, classes, imports, variables and control structures by suffix."""
    elements = rules.structural_elements(F.col("content"), bare_suffix(F.col("path")))
    return files.select("repo", "path", elements.alias("elements"))


def complexity_check(pairs: DataFrame) -> DataFrame:
    return _results(pairs, ["pair_id"], PERFORMANCE, _complexity())


def structural_check(pairs: DataFrame) -> DataFrame:
    return _results(pairs, ["pair_id"], SEMANTIC, _structure())


def normalised_source_check(pairs: DataFrame) -> DataFrame:
    """Python pairs only: whether the two texts are the same but for comments and spacing."""
    _, _, source, target = _texts()
    python = pairs.filter((source == "py") & (target == "py"))
    return _results(python, ["pair_id"], SEMANTIC, _normalised_source())


def runtime_check(timings: DataFrame, keys: Iterable[str] = ("pair_id",)) -> DataFrame:
    return _results(timings, list(keys), PERFORMANCE, _runtime())


def verdict_check(review_responses: DataFrame) -> DataFrame:
    return _results(review_responses, ["pair_id"], REVIEW, rules.review_result(F.col("text"), F.col("error")))


def apply_leniency(
    results: DataFrame, pairs: DataFrame, strict: bool = False, phrases: list[str] | None = None
) -> DataFrame:
    """Stored results with known cross-language failures turned into passes."""
    cross = pair_languages(pairs).select("pair_id", "is_cross_language")
    outcome = rules.lenient(
        F.struct("passed", "details"), F.coalesce(F.col("is_cross_language"), F.lit(False)), strict, phrases
    )
    return (
        results.join(cross, "pair_id", "left")
        .select("pair_id", "validator", outcome.alias("_r"))
        .select("pair_id", "validator", "_r.passed", "_r.details")
    )


def overall_verdict(results: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Verdict per pair from stored results; pairs without a result are judged on none."""
    counts = results.groupBy("pair_id").agg(F.count_if("passed").alias("_passed"), F.count("*").alias("_all"))
    passed, total = (F.coalesce(F.col(c), F.lit(0)) for c in ("_passed", "_all"))
    return (
        pair_languages(pairs)
        .select("pair_id", "is_cross_language")
        .join(counts, "pair_id", "left")
        .select(
            "pair_id",
            "is_cross_language",
            rules.overall(passed, total, F.col("is_cross_language"), strict).alias("overall_passed"),
        )
    )


# A text rule sees the four text columns of a pair and gives struct<passed, details>.
TextRule = Callable[[], Column]


def run_validators(
    pairs: DataFrame,
    timings: DataFrame,
    review_responses: DataFrame,
    skip: Iterable[str] = (),
    strict: bool = False,
    text_rules: dict[str, TextRule] | None = None,
    further: Iterable[DataFrame] = (),
) -> tuple[DataFrame, DataFrame]:
    """Run all validators on all pairs; returns (results, reports).

    Built in are *review*, *semantic* (normalised source for Python pairs,
    structure otherwise) and *performance* (run times for Python pairs,
    complexity otherwise).  ``text_rules`` adds validators as columns over the
    texts, ``further`` adds finished results (pair_id, validator, passed,
    details).  ``timings`` and ``review_responses`` have one row per pair.
    A report has the verdict, and the result of each validator as ``matrix``.
    """
    skipped = set(skip)
    text_rules = {n: r for n, r in (text_rules or {}).items() if n not in skipped}
    _, _, source, target = _texts()
    python = (source == "py") & (target == "py")
    outcomes = {}
    if SEMANTIC not in skipped:
        outcomes["_semantic"] = F.when(python, _normalised_source()).otherwise(_structure())
    if PERFORMANCE not in skipped:
        outcomes["_complexity"] = F.when(~python, _complexity())
    outcomes |= {f"_text_{name}": rule() for name, rule in text_rules.items()}
    judged = pairs.select(
        "pair_id",
        python.alias("_python"),
        (source != target).alias("is_cross_language"),
        *[c.alias(n) for n, c in outcomes.items()],
    )

    entries: list[tuple[str, Column]] = []
    if REVIEW not in skipped:
        judged = judged.join(review_responses.select("pair_id", "text", "error"), "pair_id", "left")
        entries.append((REVIEW, rules.review_result(F.col("text"), F.col("error"))))
    if SEMANTIC not in skipped:
        entries.append((SEMANTIC, F.col("_semantic")))
    if PERFORMANCE not in skipped:
        measured = timings.select("pair_id", "original_s", "converted_s", "original_rc", "converted_rc")
        judged = judged.join(measured, "pair_id", "left")
        entries.append((PERFORMANCE, F.when(F.col("_python"), _runtime()).otherwise(F.col("_complexity"))))
    entries += [(name, F.col(f"_text_{name}")) for name in text_rules]

    cross = F.col("is_cross_language")

    def entry(validator: Column, outcome: Column) -> Column:
        return let(
            rules.lenient(outcome, cross, strict),
            lambda r: F.struct(validator.alias("validator"), r["passed"].alias("passed"), r["details"].alias("details")),
        )

    matrix = F.array(*[entry(F.lit(n), o) for n, o in entries]) if entries else F.array().cast(
        "array<struct<validator:string,passed:boolean,details:string>>"
    )
    for i, results in enumerate(further):
        more = (
            results.filter(~F.col("validator").isin(list(skipped)) if skipped else F.lit(True))
            .groupBy("pair_id")
            .agg(F.array_sort(F.collect_list(F.struct("validator", "passed", "details"))).alias(f"_more{i}"))
        )
        judged = judged.join(more, "pair_id", "left")
        added = F.transform(
            F.coalesce(F.col(f"_more{i}"), F.array().cast("array<struct<validator:string,passed:boolean,details:string>>")),
            lambda m: entry(m["validator"], F.struct(m["passed"].alias("passed"), m["details"].alias("details"))),
        )
        matrix = F.concat(matrix, added)

    scored = judged.select("pair_id", "is_cross_language", matrix.alias("matrix"))
    passed = F.size(F.filter(F.col("matrix"), lambda m: m["passed"]))
    reports = scored.select(
        "pair_id",
        rules.overall(passed, F.size("matrix"), cross, strict).alias("overall_passed"),
        "is_cross_language",
        F.lit(strict).alias("strict_mode"),
        "matrix",
    )
    results = judged.select("pair_id", F.explode(matrix).alias("m")).select("pair_id", "m.*")
    return results, reports
