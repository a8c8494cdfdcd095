"""Pattern matches with positions, and masking of strings and comments.

Spark has no function that returns every match with its offset.  One replacement
sets each match and its groups off by a mark; splitting at the mark gives the
text between matches and the matches, whose lengths restore all positions by
running sums, inside the row and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.arrays import empty_array, later_minimum, let, running_sum

# Takes the place of a line break that does not end a logical line, so that
# lines can still be counted; any other vertical tab is blanked beforehand.
JOINED = "\x0b"
# Sets matches off from the text around them; what a text itself has of it is changed beforehand.
MARK = "\0"
NOT_MARK = "\1"

_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'"
_TRIPLE_DOUBLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\z)'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\z)"
_TEMPLATE = r"`(?:[^`\\]++|\\.)*+(?:`|\z)"
_SLASH_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
# A slash after an operator or ``return`` opens a regular expression; the token begins with what stands before.
_REGEX_LITERAL = (
    r"(?:[(,=:\[!&|?{};]|\breturn\b)\s*+/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
)
BEFORE_REGEX = r"\A(?:return|[(,=:\[!&|?{};])\s*+"
_DIRECTIVE = r"#(?:[^\n\\]++|\\.)*+"
_RAW_CPP = r'R"([^()\\\s]{0,16})\((?:(?!\)\1").)*+\)\1"'


def _tokens(first: str, *kinds: str) -> str:
    """One pattern for all kinds; ``first`` lists what they begin with, to pass over other text fast."""
    return f"(?s)(?=[{first}])(?:" + "|".join(kinds) + ")"


TOKENS = {
    "python": _tokens("\"'#", _TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE, r"#[^\n]*+"),
    "javascript": _tokens("\"'`/(,=:\\[!&|?{};r", _SLASH_COMMENT, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX_LITERAL),
    "java": _tokens("\"'/", _SLASH_COMMENT, _TRIPLE_DOUBLE, _DOUBLE, _SINGLE),
    "c++": _tokens("\"'/R#", _SLASH_COMMENT, _RAW_CPP, _DOUBLE, _SINGLE, _DIRECTIVE),
}

BRACKET = r"[()\[\]{}]"
# An opening bracket that may not close on its line; those that plainly do, up to three deep, are passed over.
_FLAT = r"[^()\[\]{}\n]++"
_CLOSED = rf"[(\[{{](?:{_FLAT})?+[)\]}}]"
_CLOSED = rf"[(\[{{](?:{_FLAT}|{_CLOSED})*+[)\]}}]"
_CLOSED = rf"[(\[{{](?:{_FLAT}|{_CLOSED})*+[)\]}}]"
OPEN_AT_LINE_END = rf"\A(?:[^(\[{{]++|{_CLOSED})*+[(\[{{]"
# Behind a parenthesis stands its depth, between these marks, while heads of definitions are looked for.
DEPTH_BEGINS, DEPTH_ENDS = "\3", "\4"
DEPTH = f"{DEPTH_BEGINS}\\d++{DEPTH_ENDS}"
OPENING, CLOSING = rf"\({DEPTH}", rf"\){DEPTH}"
# Blanks that follow something of interest become these, line ends among them the last two.
AFTER, AFTER_BREAK, AFTER_JOINED = "\2", "\5", "\6"


def replace_matches(text: Column, pattern: str, change) -> Column:
    """Rewrite every match with ``change(match)``, which may depend on its text."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x)), "")


def is_comment(token: Column, language: str) -> Column:
    """Whether a token is blanked: a comment, or in C++ a directive."""
    hash_sign = F.startswith(token, F.lit("#"))
    if language == "python":
        return hash_sign
    slashes = F.startswith(token, F.lit("//")) | F.startswith(token, F.lit("/*"))
    return slashes | hash_sign if language == "c++" else slashes


def mask(text: Column, language: str) -> Column:
    """Blank comments and overwrite string literals, keeping every offset.

    Comments (and C++ directives) become spaces (their line breaks stay).  String literals become
    runs of double quotes whose inner line breaks are ``JOINED``.
    """

    def quoted(literal: Column) -> Column:
        return F.translate(F.regexp_replace(literal, r"[^\n]", '"'), "\n", JOINED)

    def cover(token: Column) -> Column:
        blank = F.regexp_replace(token, r"[^\n]", " ")
        covered = F.when(is_comment(token, language), blank)
        if language == "javascript":
            before = F.regexp_extract(token, BEFORE_REGEX, 0)
            covered = covered.when(before != "", F.concat(before, quoted(F.substr(token, F.length(before) + 1))))
        return covered.otherwise(quoted(token))

    return replace_matches(exchange(text, JOINED + MARK, "  "), TOKENS[language], cover)


def logical_lines(text: Column) -> Column:
    """Masked Python text in which line breaks inside brackets or after a backslash are ``JOINED``.

    Brackets may nest to any depth. What follows a bracket lies inside one that closes if some
    later depth is smaller, so a bracket that is never closed joins nothing. Where all brackets
    close on their lines, there is nothing to join.
    """

    def rebuild(parts: Column, depths: Column, later: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            before = F.floor(i / 2).cast("int") - 1
            inside = F.get(depths, before) > F.get(later, before)
            return F.when((i % 2 == 0) & F.coalesce(inside, F.lit(False)), F.translate(x, "\n", JOINED)).otherwise(x)

        return F.array_join(F.transform(parts, part), "")

    def change(x: Column) -> Column:
        return F.when(x.isin("(", "[", "{"), F.lit(1)).otherwise(F.lit(-1))

    def of(parts: Column) -> Column:
        brackets = F.filter(parts, lambda x, i: i % 2 == 1)
        return let(
            running_sum(F.transform(brackets, change), least=0),
            lambda depths: let(later_minimum(depths), lambda later: rebuild(parts, depths, later)),
        )

    joined = F.when(text.rlike(OPEN_AT_LINE_END), let(marked(text, BRACKET, 0), of)).otherwise(text)
    return F.regexp_replace(joined, r"\\\n", " " + JOINED)


def with_depths(text: Column) -> Column:
    """The text with a depth behind each parenthesis, the same for both of a pair.

    ``paired`` matches such a pair whatever its content; ``without_depths`` gives the text back.
    """

    def tagged(parts: Column, depths: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            at = F.floor(i / 2).cast("int")
            depth = F.when(x == "(", F.get(depths, at)).otherwise(F.coalesce(F.get(depths, at - 1), F.lit(0)))
            return F.when(i % 2 == 1, F.concat(x, F.lit(DEPTH_BEGINS), depth.cast("string"), F.lit(DEPTH_ENDS))).otherwise(x)

        return F.array_join(F.transform(parts, part), "")

    def nested(parts: Column) -> Column:
        signs = F.filter(parts, lambda x, i: i % 2 == 1)
        changes = F.transform(signs, lambda x: F.when(x == "(", F.lit(1)).otherwise(F.lit(-1)))
        return let(running_sum(changes, least=0), lambda depths: tagged(parts, depths))

    plain = exchange(text, DEPTH_BEGINS + DEPTH_ENDS, "  ")
    flat = F.regexp_replace(plain, r"[()]", f"$0{DEPTH_BEGINS}1{DEPTH_ENDS}")
    return F.when(text.rlike(r"\([^()]*+\("), let(marked(plain, r"[()]", 0), nested)).otherwise(flat)


def without_depths(text: Column) -> Column:
    return F.regexp_replace(text, DEPTH, "")


def paired(group: str) -> str:
    """Pattern for a parenthesis up to its pair; ``group`` is a name not used elsewhere in the pattern."""
    inside = rf"(?:[^)]++|\)(?!{DEPTH_BEGINS}\k<{group}>{DEPTH_ENDS}))*+"
    return rf"\({DEPTH_BEGINS}(?<{group}>\d++){DEPTH_ENDS}{inside}{CLOSING}"


def mark_blanks(text: Column, before: str, blanks: str = r"\s") -> Column:
    """Set off the blanks, any number of them, that stand right behind a match of ``before``.

    A look-behind for one of ``AFTER``, ``AFTER_BREAK`` and ``AFTER_JOINED`` then tells what an
    unbounded look-behind would. Offsets stay; ``unmark_blanks`` gives the blanks back.
    The blank is tested before what precedes it, so the look-behind runs at blanks only, not at every character.
    """
    plain, marks = " \t\r\f\n" + JOINED, AFTER * 4 + AFTER_BREAK + AFTER_JOINED
    return replace_matches(text, f"(?={blanks})(?<={before})(?:{blanks})++", lambda m: F.translate(m, plain, marks))


def unmark_blanks(text: Column) -> Column:
    return F.translate(text, AFTER + AFTER_BREAK + AFTER_JOINED, " \n" + JOINED)


def line_breaks(text: Column) -> Column:
    """Number of line breaks, joined ones included."""
    without = F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit(JOINED), F.lit(""))
    return F.octet_length(text) - F.octet_length(without)


def exchange(text: Column, characters: str, by: str) -> Column:
    """Replace characters one by one; a text without them is only looked through."""
    present = None
    for c in characters:
        here = F.contains(text, F.lit(c))
        present = here if present is None else present | here
    return F.when(present, F.translate(text, characters, by)).otherwise(text)


def marked(text: Column, pattern: str, groups: int) -> Column:
    """One pass over the text: ``[between, match, group 1, ..., between, match, ...]``."""
    return F.split(set_off(text, pattern, groups), MARK, -1)


def marked_with_depths(text: Column, pattern: str, groups: tuple[str, ...]) -> Column:
    """The same for a pattern that uses ``paired``; ``groups`` name the groups, each one or several like ``${a}${b}``."""
    return F.split(without_depths(_set_off(with_depths(text), pattern, groups)), MARK, -1)


def set_off(text: Column, pattern: str, groups: int) -> Column:
    return _set_off(text, pattern, [f"${i}" for i in range(1, groups + 1)])


def _set_off(text: Column, pattern: str, groups) -> Column:
    return F.regexp_replace(text, pattern, MARK + "".join(f"{g}{MARK}" for g in ("$0", *groups)))


def positions(parts: Column, groups: int) -> Column:
    """``array<bigint>``: for each match the offset (upper half) and the line (lower half) of its end."""
    stride = groups + 2
    n = F.floor((F.size(parts) - 1) / stride).cast("int")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty_array("int"))

    def advance(i: Column) -> Column:
        return let(
            F.concat(F.get(parts, i * stride), F.get(parts, i * stride + 1)),
            lambda x: F.shiftleft(F.length(x).cast("long"), 32) + line_breaks(x),
        )

    return running_sum(F.transform(every, advance), "bigint")


def offset_of(position: Column) -> Column:
    return F.shiftright(position, 32).cast("int")


def line_of(position: Column) -> Column:
    return position.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def matches(text: Column, pattern: str, groups: tuple[str, ...] = ()) -> Column:
    """All matches as ``array<struct<start, line, text, <groups>...>>``.

    ``start`` is a 0-based character offset, ``line`` the 0-based line it is
    on; an unmatched group is ''.  A NUL in the text shows as U+0001.
    """
    return matches_set_off(set_off(exchange(text, MARK, NOT_MARK), pattern, len(groups)), groups)


def matches_set_off(text: Column, groups: tuple[str, ...] = ()) -> Column:
    """The same from a text in which ``set_off`` has marked them."""
    stride = len(groups) + 2
    names = ["text", *groups]

    def rows(p: Column) -> Column:
        def row(end: Column, i: Column) -> Column:
            match = F.get(p["parts"], i * stride + 1)
            return F.struct(
                (offset_of(end) - F.length(match)).alias("start"),
                (line_of(end) - line_breaks(match)).alias("line"),
                *[F.get(p["parts"], i * stride + 1 + k).alias(n) for k, n in enumerate(names)],
            )

        return F.transform(p["at"], row)

    return let(
        F.split(text, MARK, -1),
        lambda parts: let(F.struct(parts.alias("parts"), positions(parts, len(groups)).alias("at")), rows),
    )
