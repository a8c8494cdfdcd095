"""Request texts for the external rewriting and reviewing steps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions.language import bare_suffix, lookup


def fill(template: str, **values: Column) -> Column:
    """A constant template with ``{name}`` places taken by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def conversion_request(code: Column, source: Column, target: Column, context: Column) -> Column:
    """Request to rewrite one piece of code; an empty or missing context leaves no trace."""
    block = F.when(F.coalesce(context, F.lit("")) == "", F.lit("")).otherwise(
        fill(fixed.CONVERSION_CONTEXT, context=context)
    )
    return fill(
        fixed.CONVERSION_REQUEST, source_language=source, target_language=target, code=code, context_block=block
    )


def review_language(path: Column) -> Column:
    """Display name of a file's language, or its suffix where it has none."""
    key = bare_suffix(path)
    return lookup(key, fixed.REVIEW_NAME_BY_SUFFIX, key)


def review_request(
    original_path: Column, original_code: Column, converted_path: Column, converted_code: Column
) -> Column:
    return fill(
        fixed.REVIEW_REQUEST,
        source_language=review_language(original_path),
        target_language=review_language(converted_path),
        original_code=original_code,
        converted_code=converted_code,
    )


def verdict(answer: Column) -> Column:
    """Whether a review answer means that the conversion passed; no answer does not."""
    text = F.lower(answer)
    return F.when(answer.isNull(), False).otherwise(~F.contains(text, F.lit("fail")))
