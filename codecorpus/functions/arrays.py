"""Helpers over array columns used by every in-row operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNNING_SUM_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain Python variable holding a Column is pasted into every place it is
    used; binding it to a lambda variable keeps a costly step single.
    """
    return F.transform(F.array(value), body)[0]


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def running_sum(values: Column, element_type: str = "int", least: int | None = None) -> Column:
    """Inclusive prefix sums of an integer array; ``least`` keeps each sum from falling below it.

    Appending to an array copies it, so sums are built in blocks: the cost is
    n * block + n^2 / block element copies instead of n^2.
    """
    none = empty_array(element_type)
    zero = F.lit(0).cast(element_type)

    def append(acc: Column, before: Column, v: Column) -> Column:
        total = F.coalesce(F.get(acc, F.size(acc) - 1), before) + v
        return F.array_append(acc, total if least is None else F.greatest(total, F.lit(least).cast(element_type)))

    def of(bound: Column) -> Column:
        def add_block(done: Column, start: Column) -> Column:
            before = F.coalesce(F.get(done, F.size(done) - 1), zero)
            block = F.aggregate(
                F.slice(bound, start, F.lit(RUNNING_SUM_BLOCK)), none, lambda acc, v: append(acc, before, v)
            )
            return F.concat(done, block)

        starts = F.sequence(F.lit(1), F.size(bound), F.lit(RUNNING_SUM_BLOCK))
        return (
            F.when(F.size(bound) == 0, none)
            .when(F.size(bound) <= RUNNING_SUM_BLOCK, F.aggregate(bound, none, lambda acc, v: append(acc, zero, v)))
            .otherwise(F.aggregate(starts, none, add_block))
        )

    return let(values, of)


def later_minimum(values: Column) -> Column:
    """For each element of an integer array the least of it and all that follow.

    The array is folded from its end in the blocks of ``running_sum``, for the same reason.
    """
    none = empty_array("int")

    def prepend(acc: Column, after: Column, v: Column) -> Column:
        return F.array_append(acc, F.least(v, F.coalesce(F.get(acc, F.size(acc) - 1), after)))

    def add_block(done: Column, start: Column, reversed_values: Column) -> Column:
        after = F.get(done, F.size(done) - 1)
        block = F.aggregate(
            F.slice(reversed_values, start, F.lit(RUNNING_SUM_BLOCK)), none, lambda acc, v: prepend(acc, after, v)
        )
        return F.concat(done, block)

    def fold(backward: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(backward), F.lit(RUNNING_SUM_BLOCK))
        return F.reverse(F.aggregate(starts, none, lambda done, start: add_block(done, start, backward)))

    return F.when(F.size(values) == 0, none).otherwise(let(F.reverse(values), fold))
