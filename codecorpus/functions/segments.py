"""Functions and classes of a source text, found by line and brace rules inside the row.

No parser is involved.  Strings and comments are masked first, so their content
never counts.  Known limits: in Python, a definition that does not start its
line; in the braced languages, code inside template literals, macros that hide braces, headers whose
parameters nest more than three parentheses deep, and declarations without a body.
Method names of C++ classes are given, qualified ones as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions import lexical
from codecorpus.functions.arrays import empty_array, let, running_sum
from codecorpus.functions.lexical import CLOSING, JOINED, OPENING, line_breaks, line_of, matches, offset_of, paired
from codecorpus.functions.text import WORD, code_pattern, dialect, newline_count, strip, word_class

# --- indentation ------------------------------------------------------------

# What follows a header on its own line, then any number of: blank lines and a
# code line that is indented deeper or starts with a closing bracket.  The block
# therefore ends with its last code line.  {indent} refers to the header's indent.
BLOCK_AFTER_HEADER = (
    r"[^\n]*+(?:(?:\n[^\S\n]*+(?=\n))*+\n(?:{indent}[ \t]++\S[^\n]*+|[ \t]*+[)\]}}][^\n]*+))*+"
)
# The block is captured in a lookahead, so nested definitions match as well.
PYTHON_DEFINITION = code_pattern(
    rf"^([ \t]*+)(?:(?:async[ \t]++)?def|class)[ \t]++({WORD}++)(?=("
    + BLOCK_AFTER_HEADER.format(indent=r"\1")
    + "))",
    multiline=True,
)
STATEMENT_START, TARGET_TEXT, TARGET_END = word_class("([*"), word_class('.,*()[] \t"'), word_class(")]")
PYTHON_ASSIGNMENT = code_pattern(
    rf"^([ \t]*+)(?={STATEMENT_START})(?!(?:if|elif|while|for|return|assert|with|lambda|yield|async|await|del|not)\b)"
    rf"{TARGET_TEXT}*?{TARGET_END}[ \t]*=(?!=)(?=(" + BLOCK_AFTER_HEADER.format(indent=r"\1") + "))",
    multiline=True,
)


# Every pattern for definitions has three groups, so one rule reads all languages.
GROUPS = 3
STRIDE = GROUPS + 2


def masked(content: Column, language: Column) -> Column:
    """The text that definitions are looked for in; NULL for languages without such a rule."""
    key = F.lower(language)
    return (
        F.when(key == "python", let(lexical.mask(content, "python"), lexical.logical_lines))
        .when(key == "javascript", lexical.mask(content, "javascript"))
        .when(key == "java", lexical.mask(content, "java"))
        .when(key.isin("c++", "cpp"), lexical.mask(content, "c++"))
    )


def definition_parts(hidden: Column, language: Column) -> Column:
    """Matches of the language's definition pattern in the masked text, set off by marks."""
    key = F.lower(language)
    return (
        F.when(key == "python", lexical.marked(hidden, PYTHON_DEFINITION, GROUPS))
        .when(key == "javascript", lexical.marked_with_depths(hidden, JAVASCRIPT_TOKEN, NAMES))
        .when(key == "java", lexical.marked_with_depths(hidden, JAVA_TOKEN, JAVA_NAMES))
        .when(key.isin("c++", "cpp"), lexical.marked_with_depths(hidden, CPP_TOKEN, NAMES))
    )


def _segment(node_type: Column, name: Column, start: Column, end: Column, first: Column, last: Column) -> Column:
    return F.struct(
        node_type.alias("node_type"),
        name.alias("name"),
        start.cast("int").alias("start_char"),
        end.cast("int").alias("end_char"),
        first.cast("int").alias("start_line"),
        last.cast("int").alias("end_line"),
    )


def _part(parts: Column, i: Column, k: int) -> Column:
    return F.get(parts, i * STRIDE + k)


def indented_definitions(parts: Column, at: Column) -> Column:
    """Python definitions; the groups are indent, name and the block after the header."""

    def block(end: Column, i: Column) -> Column:
        text, indent, name, body = (_part(parts, i, k) for k in (1, 2, 3, 4))
        is_class = F.startswith(F.ltrim(text), F.lit("class")) | F.startswith(F.ltrim(text, F.lit("\t ")), F.lit("class"))
        return _segment(
            F.when(is_class, F.lit("class_definition")).otherwise(F.lit("function_definition")),
            name,
            offset_of(end) - F.length(text) + F.length(indent),
            offset_of(end) + F.length(body),
            line_of(end),
            line_of(end) + line_breaks(body),
        )

    return F.transform(at, block)


def python_assignments(hidden: Column) -> Column:
    """Assignment statements as ``array<struct<start_line, end_line>>``."""

    def statement(m: Column) -> Column:
        last = m["line"] + line_breaks(m["text"]) + line_breaks(m["block"])
        return F.struct(m["line"].alias("start_line"), last.alias("end_line"))

    return F.transform(matches(hidden, PYTHON_ASSIGNMENT, ("indent", "block")), statement)


# --- braces -----------------------------------------------------------------


# A position where a name begins; the cheap test comes first.
NAME_BEGINS = f"(?={word_class('$@~#')})(?<!{word_class('$.')})"
NAME = word_class("$") + "++"

# Words that look like the name of a definition when a parenthesis follows.
CONTROL_WORDS = (
    "if|for|while|switch|catch|function|with|return|throw|new|else|do|try|synchronized|await|typeof|super|this"
    "|sizeof|case|delete|yield|assert|record|foreach|using|lock|decltype|alignof|noexcept|requires|template|async"
)
_NO_CONTROL = rf"(?!(?:{CONTROL_WORDS})\b)"
_JAVA_MODIFIERS = (
    r"(?:(?:@(?!interface\b)[\w.]++(?:\s*+" + paired("annotation") + r")?|public|private|protected|static|final|abstract"
    r"|synchronized|native|default|strictfp|sealed|non-sealed)(?!\w)\s*+)*+"
)
_TYPE = rf"{NAME}(?:(?:::|\.){NAME})*+(?:\s*+<[^;{{}}()=]*?>)?(?:\s*+\[\s*+\])*+"

# Every token is a header with its opening brace, a single brace, or the
# construction of an object, which must not be taken for a constructor.
# Groups: function or method, class, JavaScript's method or Java's constructor.
NAMES = ("${function}", "${class}", "${method}")
JAVASCRIPT_TOKEN = code_pattern(
    rf"[{{}}]|{NAME_BEGINS}(?:(?:async\s++)?function\b\s*+(?:\*\s*+)?(?<function>{NAME})?\s*+{paired('a')}\s*+\{{"
    rf"|class\s++(?<class>{NAME})(?:\s++extends\s++[^{{;]++)?\s*+\{{"
    rf"|(?:(?:static|async|get|set)\s++)*+(?=#?{NAME}\s*+\(){_NO_CONTROL}(?<method>#?{NAME})\s*+{paired('b')}\s*+\{{)"
)
# Other types with a body give no segment, but constructors; their keyword takes the last place.
JAVA_NAMES = ("${function}", "${class}${type}", "${method}${keyword}")
JAVA_TOKEN = code_pattern(
    rf"[{{}}]|{NAME_BEGINS}(?:new\b\s*+{NAME}|{_JAVA_MODIFIERS}(?:(?:<[^;{{}}()]*?>\s*+)?"
    rf"(?={_TYPE}\s++{NAME}\s*+\(){_NO_CONTROL}{_TYPE}\s++{_NO_CONTROL}(?<function>{NAME})\s*+"
    rf"{paired('a')}(?:\s*+\[\s*+\])*+(?:\s*+throws\s++[\w.,\s]++)?\s*+\{{"
    rf"|class\s++(?<class>{NAME})[^{{;()]*+\{{"
    rf"|(?<keyword>enum|record|interface)\s++(?<type>{NAME})[^{{;()]*+(?:{paired('c')}[^{{;()]*+)?\{{"
    rf"|(?={NAME}\s*+\(){_NO_CONTROL}(?<method>{NAME})\s*+{paired('b')}(?:\s*+throws\s++[\w.,\s]++)?\s*+\{{))"
)
CPP_TOKEN = code_pattern(
    rf"[{{}}]|{NAME_BEGINS}(?:new\b\s*+{NAME}|enum\s++class\b"
    rf"|(?!class\b){_NO_CONTROL}(?:{_TYPE}(?:\s*+[*&]++\s*+|\s++))*?(?=[\w~:]++\s*+\(|operator\b){_NO_CONTROL}"
    rf"(?<function>(?:{NAME}::)*+(?:~?{NAME}|operator\s*+(?:{OPENING}\s*+{CLOSING}|[^\s\w(]++)))\s*+{paired('a')}"
    r"(?:\s*+(?:const|override|final|noexcept|volatile|&&?|->\s*+[\w:<>*& ]++))*+"
    r"(?:\s*+:(?!:)[^{};]*+)?\s*+\{"
    rf"|class\s++(?:\[\[[^\]]*+\]\]\s*+)?(?<class>{NAME})[^{{;()]*+\{{(?<method>))"
)

# What stands before a JavaScript function or class that is part of an expression.
EXPRESSION_BEFORE = code_pattern(
    r"(?:[=(,:?\[!&|+~<>*/%^-]|\b(?:return|typeof|new|await|yield|in|of|case|throw|void|delete))\s*\z"
)


def _node_type(language: Column, before: Column, text: Column, first: Column, second: Column, third: Column) -> Column:
    """Type of a header by the group that is filled; NULL for what is no segment."""
    key = F.lower(language)
    # No word of the pattern is longer than six letters, so with the blanks gone eight characters tell.
    expression = F.right(F.rtrim(before, F.lit(" \t\r\f\n" + JOINED)), F.lit(8)).rlike(EXPRESSION_BEFORE)
    return (
        F.when(
            second != "",
            F.when(key.isin("c++", "cpp"), F.lit("class_specifier")).when(
                F.when(key == "javascript", ~expression).otherwise(third == ""), F.lit("class_declaration")
            ),
        )
        .when(
            third != "",
            F.when(key == "java", F.lit("constructor_declaration")).otherwise(F.lit("method_definition")),
        )
        .when((first != "") & (key == "java"), F.lit("method_declaration"))
        .when((first != "") & (key != "javascript"), F.lit("function_definition"))
        .when((first != "") & ~expression, F.lit("function_declaration"))
        .when((key == "javascript") & F.contains(text, F.lit("function")), F.lit("function_expression"))
    )


def brace_depths(parts: Column, at: Column) -> Column:
    """Depth after each token."""

    def change(_, i: Column) -> Column:
        token = _part(parts, i, 1)
        return F.when(token == "}", F.lit(-1)).when(F.endswith(token, F.lit("{")), F.lit(1)).otherwise(F.lit(0))

    return running_sum(F.transform(at, change))


def _level(code: Column) -> Column:
    return F.shiftright(code, 32)


def _token(code: Column) -> Column:
    return F.shiftright(code.bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")


def _opens_level(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 0


def nesting(language: Column, parts: Column, at: Column, depths: Column) -> Column:
    """Headers as ``array<struct<i, close, around>>``: their token, the brace that closes them, in Java the token they stand in.

    Sorted by level and place, an opening brace is followed by the one that closes it, as none
    of the same level comes between them. In Java each opening brace also stands before all
    that is directly inside it, so the last such entry of the same level is what is around.
    """
    java = F.lower(language) == "java"

    def code(level: Column, i: Column, inner: int) -> Column:
        return F.shiftleft(level.cast("long"), 32) + i * 2 + inner

    def codes(_, i: Column) -> Column:
        token, depth = _part(parts, i, 1), F.get(depths, i)
        return (
            F.when(token == "}", F.array(code(depth + 1, i, 1)))
            .when(~F.endswith(token, F.lit("{")), empty_array("bigint"))
            .when(java, F.array(code(depth, i, 1), code(depth + 1, i, 0)))
            .otherwise(F.array(code(depth, i, 1)))
        )

    def headers(entries: Column, owners: Column, ordinals: Column) -> Column:
        def header(x: Column, k: Column) -> Column:
            after, owner = F.get(entries, k + 1), F.get(owners, F.get(ordinals, k) - 1)
            return F.when(
                ~_opens_level(x) & (F.length(_part(parts, _token(x), 1)) > 1),
                F.struct(
                    _token(x).alias("i"),
                    F.when((_level(after) == _level(x)) & ~_opens_level(after), _token(after)).alias("close"),
                    F.when(_level(owner) == _level(x), _token(owner)).alias("around"),
                ),
            )

        return F.array_sort(F.filter(F.transform(entries, header), lambda h: h["close"].isNotNull()))

    def of(entries: Column) -> Column:
        counts = F.transform(entries, lambda x: F.when(_opens_level(x), F.lit(1)).otherwise(F.lit(0)))
        owners = F.when(java, F.filter(entries, _opens_level))
        return let(
            F.struct(owners.alias("owners"), F.when(java, running_sum(counts)).alias("ordinals")),
            lambda o: headers(entries, o["owners"], o["ordinals"]),
        )

    return let(F.sort_array(F.flatten(F.transform(at, codes))), of)


def braced_definitions(language: Column, parts: Column, at: Column, depths: Column) -> Column:
    """Headers with the text up to the brace that closes them; a constructor bears the name of the type it stands in."""

    def definition(h: Column) -> Column:
        before, text, first, second, third = (_part(parts, h["i"], k) for k in range(STRIDE))
        end, close = F.get(at, h["i"]), F.get(at, h["close"])
        kind = _node_type(language, before, text, first, second, third)
        own_type = F.coalesce(_part(parts, h["around"], 3) == third, F.lit(False))
        name = F.when(first != "", first).when(second != "", second).when(third != "", third)
        return F.when(
            (kind != "constructor_declaration") | own_type,
            _segment(
                kind,
                F.coalesce(name, F.lit(fixed.ANONYMOUS)),
                offset_of(end) - F.length(text),
                offset_of(close),
                line_of(end) - line_breaks(text),
                line_of(close),
            ),
        )

    return F.filter(F.transform(nesting(language, parts, at, depths), definition), lambda s: s.isNotNull())


# --- matches of a pattern, and whole files ----------------------------------


def script_matches(content: Column) -> Column:
    """Pattern fallback for JavaScript: from a match to the next closing brace or the end.

    Positions are those of the match; the code is trimmed when it is taken.
    """

    def run(m: Column) -> Column:
        brace = F.call_function("locate", F.lit("}"), content, m["start"] + 1)
        end = F.when(brace > 0, brace).otherwise(F.length(content))
        name = F.coalesce(
            *[F.when(m[g] != "", m[g]) for g in ("function", "arrow", "class")], F.lit(fixed.ANONYMOUS)
        )
        code = F.substring(content, m["start"] + 1, end - m["start"])
        return _segment(
            F.lit(fixed.SCRIPT_MATCH_TYPE), name, m["start"], end, m["line"], m["line"] + newline_count(code)
        )

    return F.transform(matches(content, dialect(fixed.SCRIPT_DEFINITION), ("function", "arrow", "class")), run)


def whole_file(content: Column, file_name: Column) -> Column:
    return F.array(
        _segment(
            F.lit(fixed.WHOLE_FILE_TYPE),
            file_name,
            F.lit(0),
            F.length(content),
            F.lit(0),
            newline_count(content),
        )
    )


def definitions(language: Column, parts: Column, at: Column, depths: Column) -> Column:
    """Segments by the rule of the language, without fallback; NULL where there is no rule."""
    return F.when(F.lower(language) == "python", indented_definitions(parts, at)).when(
        parts.isNotNull(), braced_definitions(language, parts, at, depths)
    )


def or_fallback(found: Column, content: Column, language: Column, file_name: Column) -> Column:
    """The segments found, else pattern matches (JavaScript), nothing (Python) or the whole file."""
    key = F.lower(language)
    return (
        F.when((key == "python") | (F.size(found) > 0), found)
        .when(key == "javascript", script_matches(content))
        .otherwise(whole_file(content, file_name))
    )


def units(content: Column) -> Column:
    """The text as bytes of equal width per character, so that a piece is found without counting from the start."""
    ascii_only = F.octet_length(content) == F.length(content)
    return F.struct(
        F.when(ascii_only, F.lit(1)).otherwise(F.lit(4)).alias("width"),
        F.when(ascii_only, content.cast("binary")).otherwise(F.encode(content, "UTF-32")).alias("bytes"),
    )


def piece_of(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to ``end`` of what ``units`` made."""
    piece = F.substring(text["bytes"], start * text["width"] + 1, (end - start) * text["width"])
    return F.when(text["width"] == 1, piece.cast("string")).otherwise(F.decode(piece, "UTF-32"))


def code_of(raw: Column, segment: Column) -> Column:
    """Text of a segment from what lies at its place; pattern matches are trimmed."""
    return F.when(segment["node_type"] == fixed.SCRIPT_MATCH_TYPE, strip(raw)).otherwise(raw)
