"""Fill-in-the-middle samples: units cut, ordered and joined again batch by batch in ``pyarrow.compute``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_MADE = [
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so memory follows the slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, stop - start)


def line_units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Units (lines with their line ends) of all texts, the text each is of, its number there, and units per text."""
    pieces = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(pieces.offsets.cast(pa.int64()), parent))
    size = pc.list_value_length(pieces).cast(pa.int64())
    last = pc.equal(ordinal, pc.subtract(pc.take(size, parent), 1))
    units = pc.if_else(last, flat, pc.binary_join_element_wise(flat, pa.scalar("\n", flat.type), pa.scalar("", flat.type)))
    # What follows the last line end is a unit only if it isn't empty.
    real = pc.or_(pc.invert(last), pc.greater(pc.binary_length(flat), 0))
    none_after = pc.invert(real.filter(last))
    count = pc.subtract(size, pc.if_else(none_after, 1, 0).cast(pa.int64()))
    return units.filter(real), parent.filter(real), ordinal.filter(real), count


def _remainder(value: pa.Array, divisor: pa.Array) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, divisor), divisor))


def _joined(units: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """The units of a role, as one string per text that has ``counts`` of them."""
    offsets = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(role)), pa.scalar("", units.type))


def transformed(texts: pa.Array, draws: list[pa.Array], fim_percent: int, spm_percent: int, marks: tuple[str, str, str]) -> list[pa.Array]:
    """The columns ``_MADE`` for an array of texts and four arrays of drawn whole numbers."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    units, parent, ordinal, n = line_units(texts)
    one, two = (_remainder(h, pc.add(n, 1)) for h in draws[:2])
    begin, end = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    first, last = pc.less(ordinal, pc.take(begin, parent)), pc.greater_equal(ordinal, pc.take(end, parent))
    prefix = _joined(units, first, begin)
    middle = _joined(units, pc.invert(pc.or_(first, last)), pc.subtract(end, begin))
    suffix = _joined(units, last, pc.subtract(n, end))

    plain = pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, "|".join(map(re.escape, marks))))
    hundred = pa.array(np.full(len(texts), 100, dtype=np.int64))
    plain = pc.or_(plain, pc.greater_equal(_remainder(draws[2], hundred), fim_percent))
    spm = pc.less(_remainder(draws[3], hundred), spm_percent)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    mixed = pc.binary_join_element_wise(
        pc.if_else(spm, s, p), pc.if_else(spm, suffix, prefix), pc.if_else(spm, p, s), pc.if_else(spm, prefix, suffix),
        m, middle, pa.scalar("", pa.large_string()),
    )
    none = pa.scalar(None, pa.int64())
    return [
        n,
        pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(plain, texts, mixed).cast(pa.string()),
    ]


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A text is cut into n units, its lines with their ends, and between units into prefix,
    middle and suffix, at two places drawn from ``seed`` and id. ``output`` is, by ``form``:
    ``psm``: mark of prefix, prefix, mark of suffix, suffix, mark of middle, middle; ``spm``:
    the same with suffix before prefix; ``plain``: the text. Draws and texts decide alike
    for any number of rows and partitions; there is no shuffle.

    Per batch the units of all texts are one flat array beside the index of their text;
    filters by role give the parts, which lists with new offsets join again. Batches are worked off in slices
    of some 8 MB, a longer text by itself. Null and empty texts, and texts that hold a mark,
    are plain, with ``n`` 0 where there is no text, and null ``prefix_chars`` and ``middle_chars``.
    A null id draws as an empty one; repeated rows and equal ids give one output each, equal
    draws for equal ids. Ids may be of any type that has a decimal or text form. Columns of
    ``docs`` other than these two play no part.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            drawn = [batch.column(f"h{k}") for k in range(4)]
            made = transformed(batch.column("text"), drawn, fim_percent, spm_percent, marks)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", *[name for name, _ in _MADE]])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def rebuilt(output: pa.Array, form: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The texts that outputs were made of. A mark stands once in an output that isn't plain, so splitting there is exact."""
    output = output.cast(pa.large_string())
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    # Of a plain output nothing is split, whatever it holds.
    cut = pc.split_pattern_regex(pc.if_else(plain, "".join(marks), output).cast(pa.large_string()), "|".join(map(re.escape, marks)))
    one, two, middle = (pc.list_element(cut, i) for i in (1, 2, 3))
    empty = pa.scalar("", pa.large_string())
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), empty)
    return pc.if_else(plain, output, text).cast(pa.string())


def with_restored(made: DataFrame, marks: tuple[str, str, str] = MARKS, column: str = "restored") -> DataFrame:
    """What ``fill_in_middle`` made, with the exact text again, from ``output`` and ``form`` alone. Null output: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            yield batch.append_column(column, rebuilt(batch.column("output"), batch.column("form"), marks))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields if f.name != column)
    return made.drop(column).mapInArrow(run, f"{fields}, `{column}` string")
