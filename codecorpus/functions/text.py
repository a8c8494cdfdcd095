"""Text functions: line splitting, truncation, previews, trimming, counting, JSON lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions.arrays import empty_array, let

# Every line boundary a Python text line split knows; CRLF is one boundary.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"
RARE_LINE_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
LINE_BREAK = r"(?:\n|\r\n?|[\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029])"
# White space as Python trims it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
# Stands in for genuine U+FFFD while broken bytes are removed (a noncharacter).
STAND_IN = "\U0010fffe"


def dialect(pattern: str, multiline: bool = False) -> str:
    """Make a pattern mean the same in Java as in Python.

    Unicode word and space classes, and ``\\n`` as the only line end for ``.`` and ``^``.
    """
    return ("(?dUm)" if multiline else "(?dU)") + pattern


def by_alphabet(text: Column, pattern: str, use: Callable[[str], Column]) -> Column:
    """``use`` of a pattern in the dialect; on ASCII text without Unicode classes, which mean the same there and cost several times as much."""
    return F.when(F.octet_length(text) == F.length(text), use("(?d)" + pattern)).otherwise(use(dialect(pattern)))


def code_pattern(pattern: str, multiline: bool = False) -> str:
    """A pattern over source text, ``\\n`` being the only line end.

    Without Unicode classes, which cost many times as much per character;
    names are matched by ``word_class``.
    """
    return ("(?dm)" if multiline else "(?d)") + pattern


def word_class(also: str = "") -> str:
    """Character class of what names are made of, plus ``also``; all non-ASCII text counts.

    Written as the ASCII characters it leaves out, which the matcher tests with one table look-up.
    """
    other = [chr(c) for c in range(128) if not (chr(c).isalnum() or chr(c) in "_" + also)]
    return "[^" + "".join(f"\\x{ord(c):02x}" for c in other) + "]"


WORD = word_class()


def decode_utf8(data: Column) -> Column:
    """Bytes to text; invalid bytes vanish, genuine U+FFFD stay."""
    text = data.cast("string")
    kept = F.replace(text, F.lit("\ufffd"), F.lit(STAND_IN))
    repaired = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(repaired, F.lit(STAND_IN), F.lit("\ufffd")))


def universal_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def _ends_line(text: Column) -> Column:
    return F.right(text, F.lit(1)).isin(list(LINE_ENDS))


def has_rare_line_ends(text: Column) -> Column:
    """Whether some line ends with anything else than ``\\n``."""
    return text.rlike(RARE_LINE_ENDS)


def split_lines(text: Column) -> Column:
    """Lines without terminators; a final terminator opens no further line."""
    last = F.when(F.endswith(text, F.lit("\r\n")), 2).otherwise(1)
    body = F.when(_ends_line(text), F.left(text, F.length(text) - last)).otherwise(text)
    lines = F.when(has_rare_line_ends(text), F.split(body, LINE_BREAK, -1)).otherwise(F.split(body, "\n", -1))
    return F.when(text == "", empty_array("string")).otherwise(lines)


def line_count(text: Column, rare: Column | None = None) -> Column:
    """``size(split_lines(text))`` without building the lines; ``rare``: whether it may have rare line ends, where that is known."""
    if rare is not None:
        return F.when(rare, line_count(text)).otherwise(newline_count(text) + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1))
    breaks = F.when(has_rare_line_ends(text), F.regexp_count(text, F.lit(LINE_BREAK))).otherwise(newline_count(text))
    return (breaks + F.when((text == "") | _ends_line(text), 0).otherwise(1)).cast("int")


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def exceeds_lines(text: Column, max_lines: int) -> Column:
    """More than ``max_lines`` lines, counting only ``\\n`` as a terminator."""
    breaks = newline_count(text)
    return (breaks > max_lines) | ((breaks == max_lines) & ~F.endswith(text, F.lit("\n")))


def first_lines(text: Column, max_lines: int) -> Column:
    """The first ``max_lines`` lines with their terminators."""
    return F.when(
        exceeds_lines(text, max_lines),
        F.concat(F.substring_index(text, "\n", max_lines), F.lit("\n")),
    ).otherwise(text)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, by bytes: their number is at hand, that of characters is a walk."""
    without = F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.octet_length(text) - without) / len(needle.encode())).cast("int")


def chunk_texts(text: Column, lines_per_chunk: int) -> Column:
    """Array of consecutive pieces of ``lines_per_chunk`` lines, re-joined by ``\\n``."""

    def pieces(lines: Column) -> Column:
        starts = F.when(
            F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(lines_per_chunk))
        ).otherwise(empty_array("int"))
        return F.transform(starts, lambda s: F.array_join(F.slice(lines, s, F.lit(lines_per_chunk)), "\n"))

    return let(split_lines(text), pieces)


def preview(text: Column, head: int, tail: int, limit: int | None = None) -> Column:
    """The text, or its first and last lines around a note on how many are left out.

    A text of at most ``limit`` lines (``head + tail`` unless given) is shown whole.
    """
    limit = head + tail if limit is None else limit

    def shown(lines: Column) -> Column:
        omitted = F.size(lines) - F.lit(head + tail)
        note = F.concat(F.lit("... ("), omitted.cast("string"), F.lit(" lines omitted) ..."))
        last = F.slice(lines, F.size(lines) - F.lit(tail - 1), F.lit(tail)) if tail else empty_array("string")
        return F.array_join(
            F.when(F.size(lines) <= limit, lines).otherwise(
                F.concat(F.slice(lines, 1, head), F.array(note), last)
            ),
            "\n",
        )

    return let(split_lines(text), shown)


def segment_preview(code: Column) -> Column:
    return preview(code, *fixed.SEGMENT_PREVIEW_LINES)


def context_preview(context: Column) -> Column:
    return preview(context, *fixed.CONTEXT_PREVIEW_LINES, limit=fixed.CONTEXT_PREVIEW_LIMIT)


def strip_code_fence(answer: Column) -> Column:
    """Trim an answer and drop a surrounding three-backtick fence of at least three lines."""

    def unfenced(text: Column) -> Column:
        fenced = F.startswith(text, F.lit("```")) & F.endswith(text, F.lit("```"))
        lines = F.split(text, "\n", -1)
        inner = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")
        return F.when(fenced & (newline_count(text) >= 2), inner).otherwise(text)

    return let(strip(answer), unfenced)


def json_path(document: Column, dotted: str, default: str | None = None) -> Column:
    """Nested value at ``a.b.c`` as text; ``default`` where a step is missing.

    A JSON ``null`` at the path is a value, hence NULL and not the default.
    """
    path = "$" + "".join(f"['{step}']" for step in dotted.split("."))
    found = F.get_json_object(document, path)
    explicit_null = F.is_variant_null(F.try_variant_get(F.try_parse_json(document), path, "variant"))
    return (
        F.when(found.isNotNull(), found)
        .when(F.coalesce(explicit_null, F.lit(False)), F.lit(None).cast("string"))
        .otherwise(F.lit(default))
    )
