"""Imports, modules, calls and identifier uses of a source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions import lexical
from codecorpus.functions.arrays import empty_array, let
from codecorpus.functions.lexical import AFTER, AFTER_BREAK, AFTER_JOINED, CLOSING, OPENING, matches, paired, replace_matches
from codecorpus.functions.segments import CONTROL_WORDS
from codecorpus.functions.text import WORD, code_pattern, dialect, word_class

IMPORT_TYPE = "struct<kind:string,text:string,module:string,start_char:int,end_char:int>"
CALL_TYPE = "struct<name:string,text:string,start_char:int,line_no:int>"
USE_TYPE = "struct<name:string,line_no:int>"

DOTTED, MEMBER, WITH_DOLLAR = word_class("."), word_class("$."), word_class("$")
DOTTED_OR_QUOTE = word_class('."')

# --- imports ----------------------------------------------------------------

# ``import`` is a reserved word, so outside strings and comments it is always a statement.
PYTHON_IMPORT = code_pattern(
    rf"(?=[fi])(?<!{DOTTED})(?!from[^\S\n]++__future__\b)"
    rf"(?:from[^\S\n]++(\.*+{DOTTED}*+)[^\S\n]++import\b|import\b(?=[^\S\n]++({WORD}*+)))[^\n;]*[^\s;]"
)
JAVA_IMPORT_STATEMENT = code_pattern(r"\bimport\s[\w$.*\s]+;")
# The module of a wildcard import is the package, of a static one the member.
JAVA_IMPORT = r"\bimport\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;"
SCRIPT_IMPORT_STATEMENT = code_pattern(r'\bimport\b(?:[\w$*{},\s]+?\bfrom\b)?\s*+"++(?:[^\S\n]*+;)?')


# An import for its effects alone names only a module.
SCRIPT_IMPORT_ALONE = r"\bimport\s*[\"']([^\"'\n]+)[\"']"


def _import(kind: Column, text: Column, module: Column, start: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        module.alias("module"),
        start.cast("int").alias("start_char"),
        (start + F.length(text)).cast("int").alias("end_char"),
    )


def _pattern_imports(content: Column, visible: Column, kind: str, pattern: str, groups: tuple[str, ...]) -> Column:
    """Matches whose first character shows in ``visible``, the text without comments and strings."""

    def shown(m: Column) -> Column:
        first = F.ltrim(m["text"], F.lit(" \t\n"))
        at = m["start"] + F.length(m["text"]) - F.length(first) + 1
        return F.substring(visible, at, F.lit(1)) == F.left(first, F.lit(1))

    found = F.filter(matches(content, dialect(pattern), groups), shown)
    return F.transform(found, lambda m: _import(F.lit(kind), m["text"], m["module"], m["start"]))


def python_imports(content: Column, hidden: Column) -> Column:
    """Import statements outside strings; the module is its first word, NULL for relative imports."""

    def statement(m: Column) -> Column:
        text = F.substring(content, m["start"] + 1, F.length(m["text"]))
        first_word = F.regexp_extract(m["origin"], dialect(r"\A(\w+)"), 1)
        plain = F.startswith(m["text"], F.lit("import"))
        module = F.when(plain, m["plain"]).otherwise(first_word)
        kind = F.when(plain, F.lit("import")).otherwise(F.lit("import_from"))
        return _import(kind, text, F.when(module != "", module), m["start"])

    return F.transform(matches(hidden, PYTHON_IMPORT, ("origin", "plain")), statement)


def script_imports(content: Column, visible: Column) -> Column:
    return F.concat(
        _pattern_imports(content, visible, "import", fixed.SCRIPT_IMPORT_FROM, ("names", "module")),
        _pattern_imports(content, visible, "import", SCRIPT_IMPORT_ALONE, ("module",)),
        _pattern_imports(content, visible, "require", fixed.SCRIPT_REQUIRE, ("module",)),
    )


def imports(content: Column, hidden: Column, language: Column) -> Column:
    """``array<struct<kind, text, module, start_char, end_char>>``; ``hidden`` is the masked text.

    What stands in a comment or a string is no import.  Directives of C++ are blank in the
    masked text, and C# has none, so for these comments and strings are masked by themselves.
    """
    key = F.lower(language)
    visible = lexical.mask(content, "java")
    return (
        F.when(key == "python", python_imports(content, hidden))
        .when(key == "javascript", script_imports(content, hidden))
        .when(key == "java", _pattern_imports(content, hidden, "import", JAVA_IMPORT, ("module",)))
        .when(key.isin("c++", "cpp"), let(visible, lambda v: _pattern_imports(content, v, "include", fixed.CPP_INCLUDE, ("module",))))
        .when(key == "c#", let(visible, lambda v: _pattern_imports(content, v, "using", fixed.CSHARP_USING, ("module",))))
        .otherwise(empty_array(IMPORT_TYPE))
    )


def import_parts(content: Column, hidden: Column, language: Column) -> Column:
    """Whole import statements, set off by marks, for use as context."""
    key = F.lower(language)
    return (
        F.when(key == "python", lexical.marked(hidden, PYTHON_IMPORT, 0))
        .when(key == "javascript", lexical.marked(hidden, SCRIPT_IMPORT_STATEMENT, 0))
        .when(key == "java", lexical.marked(hidden, JAVA_IMPORT_STATEMENT, 0))
        .when(
            key.isin("c++", "cpp"),
            lexical.marked(lexical.exchange(content, lexical.MARK, lexical.NOT_MARK), dialect(fixed.CPP_INCLUDE), 0),
        )
    )


def import_spans(parts: Column, at: Column) -> Column:
    """Import statements as ``array<struct<start, end, start_line, end_line>>``."""

    def span(end: Column, i: Column) -> Column:
        text = F.get(parts, i * 2 + 1)
        return F.struct(
            (lexical.offset_of(end) - F.length(text)).alias("start"),
            lexical.offset_of(end).alias("end"),
            (lexical.line_of(end) - lexical.line_breaks(text)).alias("start_line"),
            lexical.line_of(end).alias("end_line"),
        )

    return F.transform(at, span)


# --- calls ------------------------------------------------------------------

PYTHON_WORDS = (
    "False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global"
    "|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield"
)
CALL_ANYWHERE = r"([\w.]+)\s*\("
# A dotted name is taken whole; after another expression (``f(x).g(y)``) it begins behind the dot.
PYTHON_CALL = code_pattern(
    rf"(?={WORD})(?<!{WORD})(?<!{WORD}\.)(?={DOTTED}++\s*+\()(?!(?:{PYTHON_WORDS})\b)(?<![{AFTER}{AFTER_BREAK}{AFTER_JOINED}])"
    rf"({DOTTED}++)\s*+\("
)
# Not calls: a name whose parameters are followed by a body, a name right after a type, and the
# type before a pointer to a function.
WORDS_BEFORE_CALL = "return|throw|else|case|await|yield|typeof|void|delete|in|of|do|co_return|co_await|instanceof|assert|extends"
BODY_FOLLOWS = (
    rf"{paired('a')}\s*+(?:const|override|noexcept|throws\s++[\w.,\s]++)?\s*+(?::(?!:)[^{{}};]*+)?\{{"
)
POINTER_FOLLOWS = rf"{OPENING}\s*+[*&]++\s*+{WITH_DOLLAR}*+\s*+{CLOSING}\s*+\("
# Blanks after ``new`` and the like, or after a type, are set off, so the character before a name tells.
def _braced_call(not_words: str, not_before: str, unless: str = "") -> str:
    return code_pattern(
        rf"(?={WITH_DOLLAR})(?<!{not_before})(?<!{WITH_DOLLAR}\.)(?=({MEMBER}++)\s*+\()(?!(?:{not_words})\b(?!\.))"
        rf"(?<![{AFTER}{AFTER_BREAK}{AFTER_JOINED}])(?:{unless}(?!{MEMBER}++\s*+{BODY_FOLLOWS})){MEMBER}++\s*+(?!{POINTER_FOLLOWS})\("
    )


BRACED_CALL = _braced_call(CONTROL_WORDS, WITH_DOLLAR)
# An annotation of Java is no call; a class may extend what a call gives; ``super(...)`` is one in JavaScript, and in Java a statement of its own.
JAVA_CALL = _braced_call(CONTROL_WORDS, word_class("$@"))
SCRIPT_CALL = _braced_call("|".join(w for w in CONTROL_WORDS.split("|") if w != "super"), WITH_DOLLAR, r"(?<=\bextends\s)|")
DEFINING_BLANK = r"\b(?:new|function)"
TYPE_BLANK = rf"[\w\]](?<!\b(?:{WORDS_BEFORE_CALL}))"
# The same without blanks before a parenthesis, which belong to the call itself.
BLANKS_BEFORE_NAME, BLANKS_IN_LINE = r"\s(?!\s*+\()", r"[ \t](?![ \t]*+\()"


def calls(content: Column, hidden: Column, language: Column, exclude_keywords: bool = True) -> Column:
    """``array<struct<name, text, start_char, line_no>>``: names directly followed by an opening parenthesis.

    ``hidden`` is the masked text; lines are counted from 1. By default strings and comments,
    keywords, constructions with ``new``, annotations of Java and the heads of definitions do
    not count, whatever their parameters.  Without that, every match in the raw
    text does, as a plain pattern search would have it.
    """
    key = F.lower(language)

    def call(m: Column) -> Column:
        start, line = m["start"].cast("int").alias("start_char"), (m["line"] + 1).cast("int").alias("line_no")
        return F.struct(m["name"].alias("name"), m["text"].alias("text"), start, line)

    def braced(text: Column) -> Column:
        found = F.when(key == "javascript", lexical.set_off(text, SCRIPT_CALL, 1)).when(key == "java", lexical.set_off(text, JAVA_CALL, 1))
        return lexical.without_depths(found.otherwise(lexical.set_off(text, BRACED_CALL, 1)))

    if exclude_keywords:
        blanks = lexical.mark_blanks(lexical.mark_blanks(hidden, DEFINING_BLANK, BLANKS_BEFORE_NAME), TYPE_BLANK, BLANKS_IN_LINE)
        python = lexical.set_off(lexical.mark_blanks(hidden, r"\b(?:def|class)"), PYTHON_CALL, 1)
        chain = F.when(key == "python", python).when(
            key.isin("javascript", "java", "c++", "cpp"), let(lexical.with_depths(blanks), braced)
        )
        shown = lexical.unmark_blanks(chain)
    else:
        raw = lexical.exchange(content, lexical.MARK, lexical.NOT_MARK)
        shown = F.when(key == "javascript", lexical.set_off(raw, dialect(fixed.SCRIPT_CALL), 1)).when(
            key.isin("python", "java", "c++", "cpp"), lexical.set_off(raw, dialect(CALL_ANYWHERE), 1)
        )
    return let(shown, lambda x: F.when(x.isNull(), empty_array(CALL_TYPE)).otherwise(F.transform(lexical.matches_set_off(x, ("name",)), call)))


# --- identifier uses --------------------------------------------------------

# Not counted: attributes and keywords.
PYTHON_NAME = code_pattern(
    rf"(?={WORD}(?<!\d))(?<!{DOTTED_OR_QUOTE})(?!(?:{PYTHON_WORDS})\b)({WORD}++)(?!\")"
)
# Not counted either: names of keyword arguments.
KEYWORD_ARGUMENT = code_pattern(rf"(?<=[(,{AFTER}{AFTER_JOINED}]){WORD}++(?=[^\S\n]*+=(?!=))")
ANY_IMPORT = code_pattern(rf"(?=[fi])(?<!{DOTTED})(?:from[^\S\n]++\.*+{DOTTED}*+[^\S\n]++)?import\b[^\n;]*+")
CLASS_NAME = code_pattern(rf"^([ \t]*+class[ \t]++){WORD}++", multiline=True)
FUNCTION_HEAD = code_pattern(
    rf"^[ \t]*+(?:async[ \t]++)?def[ \t]++{WORD}++\s*+" + paired("a"), multiline=True
)
# In the head of a function only defaults and annotations are uses.
NAME_BEING_DEFINED = code_pattern(rf"(?<!{DOTTED})(?<![=:>{AFTER}{AFTER_BREAK}{AFTER_JOINED}])(?!\d){WORD}++")


def python_uses(hidden: Column) -> Column:
    """``array<struct<name, line_no>>``, one element per use, lines counted from 1."""
    imports_gone = replace_matches(
        hidden, ANY_IMPORT, lambda m: F.regexp_replace(m, f"[^{lexical.JOINED}]", "")
    )
    def head(m: Column) -> Column:
        return lexical.unmark_blanks(F.regexp_replace(lexical.mark_blanks(m, "[=:>]"), NAME_BEING_DEFINED, ""))

    uses_only = lexical.without_depths(replace_matches(lexical.with_depths(imports_gone), FUNCTION_HEAD, head))
    arguments = F.regexp_replace(lexical.mark_blanks(uses_only, "[(,]", r"[^\S\n]"), KEYWORD_ARGUMENT, "")
    values_only = lexical.unmark_blanks(arguments)
    lines = F.split(F.regexp_replace(values_only, CLASS_NAME, "$1"), f"[\n{lexical.JOINED}]", -1)
    return F.flatten(
        F.transform(
            lines,
            lambda line, i: F.transform(
                F.regexp_extract_all(line, F.lit(PYTHON_NAME), F.lit(1)),
                lambda n: F.struct(n.alias("name"), (i + 1).alias("line_no")),
            ),
        )
    )
