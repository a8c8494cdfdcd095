"""Paths, suffixes and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """Constant table lookup as one literal map."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dot and what follows it in the base name; '' for none, a dot file or a final dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def bare_suffix(path: Column) -> Column:
    """Suffix without dot in lower case, ``unknown`` if there is none."""
    found = F.lower(F.substring(suffix(path), 2, 1 << 30))
    return F.when(found == "", F.lit(fixed.UNKNOWN_LANGUAGE)).otherwise(found)


def language_of(path: Column) -> Column:
    return lookup(F.lower(suffix(path)), fixed.LANGUAGE_BY_SUFFIX, F.lit(fixed.UNKNOWN_LANGUAGE))


def extension_for_language(language: Column, aliases: dict[str, str] | None = None) -> Column:
    """Suffix of files written in a target language; ``aliases`` adds names such as ``cpp``."""
    table = {**fixed.SUFFIX_BY_TARGET_LANGUAGE, **(aliases or {})}
    return lookup(F.lower(language), table, F.lit(fixed.FALLBACK_TARGET_SUFFIX))


def target_folder(language: Column) -> Column:
    return F.replace(F.lower(language), F.lit("#"), F.lit("sharp"))


def output_path(path: Column, target: Column, aliases: dict[str, str] | None = None) -> Column:
    """Folder of the target language, then the path with its suffix exchanged."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+\z", "")
    return F.concat(target_folder(target), F.lit("/"), stem, extension_for_language(target, aliases))


def priority_band(loc: Column) -> Column:
    """``struct(priority, difficulty)`` from the number of lines."""

    def band(priority: int, difficulty: str) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(difficulty).alias("difficulty"))

    chain = None
    for above, priority, difficulty in fixed.PRIORITY_BANDS:
        step = (loc > above, band(priority, difficulty))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain.otherwise(band(*fixed.LOWEST_PRIORITY_BAND))
