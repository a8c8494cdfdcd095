"""Per-pair rules as columns: complexity, structure, normalised source, run time, review, leniency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import fixed_values as fixed
from codecorpus.functions import lexical
from codecorpus.functions.arrays import RUNNING_SUM_BLOCK, empty_array, let
from codecorpus.functions.language import bare_suffix
from codecorpus.functions.prompts import fill, verdict
from codecorpus.functions.text import by_alphabet, count_substring

RESULT_TYPE = "struct<passed:boolean,details:string>"


def result(passed: Column | bool, details: Column) -> Column:
    passed = passed if isinstance(passed, Column) else F.lit(passed)
    return F.struct(passed.alias("passed"), details.alias("details"))


UNREADABLE = "text could not be read"


def unless_unreadable(original: Column, converted: Column, otherwise: Column, template: str) -> Column:
    """A pair with a missing text can't be judged and passes by default; the details say so."""
    missing = original.isNull() | converted.isNull()
    return F.when(missing, result(True, fill(template, error=F.lit(UNREADABLE)))).otherwise(otherwise)


def _total(counts: list[Column]) -> Column:
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    return total


# --- complexity -------------------------------------------------------------


def complexity(code: Column, suffix: Column) -> Column:
    """Line, function, class and control counts with their weighted score."""
    functions = F.lit(0)
    for language, markers in fixed.FUNCTION_MARKERS.items():
        functions = F.when(suffix == language, _total([count_substring(code, m) for m in markers])).otherwise(functions)
    lines = F.split(code, "\n", -1)
    counts = F.struct(
        F.size(lines).alias("total_lines"),
        F.size(F.filter(lines, lambda line: line.rlike(r"(?U)[^\s\x1c-\x1f]"))).alias("non_empty_lines"),
        functions.cast("int").alias("functions"),
        count_substring(code, fixed.CLASS_MARKER).alias("classes"),
        _total([count_substring(code, m) for m in fixed.CONTROL_MARKERS]).alias("control_structures"),
    )

    def scored(c: Column) -> Column:
        score = (
            c["functions"] * F.lit(fixed.FUNCTION_WEIGHT)
            + c["classes"] * F.lit(fixed.CLASS_WEIGHT)
            + c["control_structures"] * F.lit(fixed.CONTROL_WEIGHT)
            + c["non_empty_lines"] * F.lit(fixed.LINE_WEIGHT)
        )
        names = ("total_lines", "non_empty_lines", "functions", "classes", "control_structures")
        return F.struct(*[c[n].alias(n) for n in names], score.alias("complexity_score"))

    return let(counts, scored)


def complexity_result(original: Column, converted: Column, source: Column, target: Column) -> Column:
    """First broken rule decides; ratios against nothing are not looked at."""

    def ratio(field: str) -> Column:
        return F.try_divide(converted[field], original[field])

    score = F.when(original["complexity_score"] > 0, ratio("complexity_score")).otherwise(F.lit(1.0))

    def failed(template: str) -> Column:
        return result(False, fill(template, target=target))

    return (
        F.when(ratio("functions") < fixed.MIN_FUNCTION_RATIO, failed(fixed.COMPLEXITY_FUNCTIONS_MISSING))
        .when((original["classes"] > 0) & (converted["classes"] == 0), failed(fixed.COMPLEXITY_CLASSES_MISSING))
        .when(
            (source == target) & (ratio("control_structures") < fixed.MIN_CONTROL_RATIO),
            failed(fixed.COMPLEXITY_CONTROL_MISSING),
        )
        .when(score < fixed.MIN_SCORE_RATIO, failed(fixed.COMPLEXITY_TOO_SIMPLE))
        .when(score > fixed.MAX_SCORE_RATIO, failed(fixed.COMPLEXITY_TOO_COMPLEX))
        .otherwise(result(True, fill(fixed.COMPLEXITY_KEPT, source=source, target=target)))
    )


# --- structure --------------------------------------------------------------

STRUCTURE_FIELDS = ("functions", "classes", "imports", "variables", "control_structures")


def structural_elements(code: Column, suffix: Column) -> Column:
    """Names of functions, classes, imports and variables, and control words, by suffix."""

    def first_group(pattern: str) -> Column:
        """The name of each match, from whichever alternative found it."""
        groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
        found = [
            by_alphabet(code, pattern, lambda p, i=i: F.regexp_extract_all(code, F.lit(p), F.lit(i)))
            for i in range(1, groups + 1)
        ]
        merged = found[0]
        for other in found[1:]:
            merged = F.zip_with(merged, other, lambda a, b: F.when(a != "", a).otherwise(b))
        return merged

    def field(name: str) -> Column:
        chain = None
        for language, patterns in fixed.STRUCTURE_PATTERNS.items():
            names = F.concat(*[first_group(p) for p in patterns[name]])
            chain = F.when(suffix == language, names) if chain is None else chain.when(suffix == language, names)
        return chain.otherwise(empty_array("string")).alias(name)

    return F.struct(*[field(name) for name in STRUCTURE_FIELDS])


def has_structure(code: Column, suffix: Column) -> Column:
    """Whether there is any function, class or control structure; enough for the rule."""

    def field(name: str) -> Column:
        chain = None
        for language, patterns in fixed.STRUCTURE_PATTERNS.items():
            found = by_alphabet(code, "|".join(f"(?:{p})" for p in patterns[name]), code.rlike)
            chain = F.when(suffix == language, found) if chain is None else chain.when(suffix == language, found)
        return chain.otherwise(F.lit(False)).alias(name)

    return F.struct(*[field(name) for name in ("functions", "classes", "control_structures")])


def structure_result(original: Column, converted: Column, source: Column, target: Column) -> Column:
    def lost(field: str) -> Column:
        return original[field] & ~converted[field]

    def failed(template: str) -> Column:
        return result(False, fill(template, target=target))

    return (
        F.when(lost("functions"), failed(fixed.STRUCTURE_FUNCTIONS_MISSING))
        .when(lost("classes"), failed(fixed.STRUCTURE_CLASSES_MISSING))
        .when((source == target) & lost("control_structures"), failed(fixed.STRUCTURE_CONTROL_MISSING))
        .otherwise(result(True, fill(fixed.STRUCTURE_KEPT, source=source, target=target)))
    )


# --- normalised source ------------------------------------------------------


# Stands for a string literal while lines are joined and tidied; literals are compared on their own.
LITERAL = "\x07"
OPEN_STRING = "a string is not closed"
OPEN_BRACKET = "brackets do not pair"
BAD_INDENT = "indentation does not fit"
PYTHON_TYPE = "struct<error:string,text:string,literals:array<string>>"
# Blanks that mean nothing: where either side is no part of a word, unless both sides would grow into one operator.
IDLE_BLANK = (
    r"(?<![\w\s]) (?=\S)(?!(?<=[-+*/%@&|^=<>!:] )=)(?!(?<=\* )\*)(?!(?<=/ )/)(?!(?<=< )<)(?!(?<=> )>)(?!(?<=- )>)|(?<=\w) (?![\w\s])"
)


def _brackets_pair(text: Column) -> Column:
    """Whether each bracket is closed by one of its kind; the open ones are kept as a stack."""

    def step(stack: Column, bracket: Column) -> Column:
        opened = F.translate(bracket, ")]}", "([{")
        return (
            F.when(bracket.isin("(", "[", "{"), F.concat(bracket, stack))
            .when(F.substring(stack, 1, 1) == opened, F.substr(stack, F.lit(2)))
            .otherwise(F.concat(F.lit("!"), stack))
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(lexical.BRACKET), F.lit(0)), F.lit(""), step) == ""


def _levels(widths: Column) -> Column:
    """Level of each line from the widths of their indentation, by a stack of the open widths.

    -1 where a width returns to none of the open ones. Folded in blocks, as ``running_sum`` is.
    """
    state = "struct<open:array<int>,levels:array<int>>"

    def step(acc: Column, width: Column) -> Column:
        def of(kept: Column) -> Column:
            known, deeper = F.array_contains(kept, width), F.size(kept) == F.size(acc["open"])
            stack = F.when(known, kept).otherwise(F.concat(kept, F.array(width)))
            level = F.when(known | deeper, F.size(stack) - 1).otherwise(F.lit(-1))
            return F.struct(stack.alias("open"), F.concat(acc["levels"], F.array(level)).alias("levels")).cast(state)

        return let(F.filter(acc["open"], lambda x: x <= width), of)

    def over(bound: Column) -> Column:
        def add_block(done: Column, start: Column) -> Column:
            begin = F.struct(done["open"].alias("open"), empty_array("int").alias("levels")).cast(state)
            block = F.aggregate(F.slice(bound, start, F.lit(RUNNING_SUM_BLOCK)), begin, step)
            return let(
                block, lambda x: F.struct(x["open"].alias("open"), F.concat(done["levels"], x["levels"]).alias("levels")).cast(state)
            )

        none = F.struct(F.array(F.lit(0)).alias("open"), empty_array("int").alias("levels")).cast(state)
        starts = F.sequence(F.lit(1), F.size(bound), F.lit(RUNNING_SUM_BLOCK))
        return F.when(F.size(bound) == 0, empty_array("int")).otherwise(F.aggregate(starts, none, add_block)["levels"])

    return let(widths, over)


def canonical_python(code: Column) -> Column:
    """``struct<error, text, literals>``: Python text as logical lines with their levels.

    Comments and blank lines go. Lines inside brackets or after a backslash are joined, blanks that mean
    nothing go, indentation becomes the number of open blocks. String literals are listed in order, those
    without quotes or backslashes in double quotes. ``error`` names what no parser would take: a
    missing text, a string or bracket that isn't closed, indentation that returns to no open
    level, comes without a colon before it, or misses after one.
    """
    pattern = lexical.TOKENS["python"]

    def lines_of(parts: Column) -> Column:
        found = F.transform(parts["found"], lambda m: F.when(lexical.is_comment(m, "python"), F.lit("")).otherwise(F.lit(LITERAL)))
        bare = F.array_join(F.zip_with(parts["between"], F.concat(found, F.array(F.lit(""))), lambda b, m: F.concat(b, m)), "")
        literals = F.filter(parts["found"], lambda m: ~lexical.is_comment(m, "python"))
        plain = F.transform(literals, lambda m: F.regexp_replace(m, r"""\A'([^'"\\\n]*)'\z""", '"$1"'))
        cut = F.exists(literals, lambda m: m.rlike(r"""(?s)\A(?:\"{3}(?!.*\"{3}\z)|'{3}(?!.*'{3}\z)|\"{3,5}\z|'{3,5}\z)"""))
        joined = F.translate(lexical.logical_lines(bare), lexical.JOINED, " ")
        lines = F.filter(F.split(joined, "\n", -1), lambda x: x.rlike(r"\S"))
        return let(
            F.struct(bare.alias("bare"), plain.alias("literals"), cut.alias("cut"), lines.alias("lines")), with_levels
        )

    def with_levels(x: Column) -> Column:
        indent = F.transform(x["lines"], lambda y: F.regexp_extract(y, r"\A[ \t\f]*+", 0))
        widths = F.transform(indent, lambda y: F.length(F.regexp_replace(F.translate(y, "\f", ""), r" {8}| {0,7}\t", " " * 8)))
        tidy = F.transform(x["lines"], lambda y: F.regexp_replace(F.regexp_replace(F.trim(F.translate(y, "\t\f", "  ")), " +", " "), IDLE_BLANK, ""))
        return let(F.struct(x.alias("x"), tidy.alias("tidy"), _levels(widths).alias("levels")), judged)

    def judged(y: Column) -> Column:
        levels, tidy = y["levels"], y["tidy"]

        def odd(level: Column, i: Column) -> Column:
            deeper = level > F.coalesce(F.get(levels, i - 1), F.lit(0))
            return (level < 0) | (deeper != F.coalesce(F.endswith(F.get(tidy, i - 1), F.lit(":")), F.lit(False)))

        wrong = F.exists(F.transform(levels, odd), lambda z: z) | F.coalesce(F.endswith(F.get(tidy, F.size(tidy) - 1), F.lit(":")), F.lit(False))
        error = (
            F.when(y["x"]["cut"] | y["x"]["bare"].rlike("[\"']"), F.lit(OPEN_STRING))
            .when(~_brackets_pair(y["x"]["bare"]), F.lit(OPEN_BRACKET))
            .when(wrong, F.lit(BAD_INDENT))
        )
        numbered = F.zip_with(levels, tidy, lambda level, text: F.concat(level.cast("string"), F.lit(" "), text))
        return F.struct(error.alias("error"), F.array_join(numbered, "\n").alias("text"), y["x"]["literals"].alias("literals")).cast(PYTHON_TYPE)

    clean = lexical.exchange(F.regexp_replace(code, r"\r\n?", "\n"), lexical.JOINED + lexical.MARK + LITERAL, "   ")
    parts = let(
        clean,
        lambda c: F.struct(F.split(c, pattern, -1).alias("between"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found")),
    )
    missing = F.struct(F.lit(UNREADABLE).alias("error"), F.lit(None).cast("string").alias("text"), empty_array("string").alias("literals"))
    return F.when(code.isNull(), missing.cast(PYTHON_TYPE)).otherwise(let(parts, lines_of))


def normalised_source_result(original_code: Column, converted_code: Column) -> Column:
    """Whether both texts are the same logical lines; what can't be read fails, and the details say why."""

    def compared(both: Column) -> Column:
        one, two = both["one"], both["two"]
        error = F.coalesce(one["error"], two["error"])
        return (
            F.when(error.isNotNull(), result(False, fill(fixed.SOURCES_ERROR, error=error)))
            .when((one["text"] == two["text"]) & (one["literals"] == two["literals"]), result(True, F.lit(fixed.SOURCES_MATCH)))
            .otherwise(result(False, F.lit(fixed.SOURCES_DIFFER)))
        )

    return let(F.struct(canonical_python(original_code).alias("one"), canonical_python(converted_code).alias("two")), compared)


# --- run time ---------------------------------------------------------------


def runtime_result(
    original_s: Column,
    converted_s: Column,
    original_rc: Column,
    converted_rc: Column,
    original_error: Column | None = None,
    converted_error: Column | None = None,
) -> Column:
    """Outcome of two measured runs: the original is judged first, then the converted, then the ratio.

    No measurement is a failure.
    """
    nothing = F.lit("")
    original_error = nothing if original_error is None else F.coalesce(original_error, nothing)
    converted_error = nothing if converted_error is None else F.coalesce(converted_error, nothing)

    def seconds(value: Column) -> Column:
        return F.format_string("%.3f", value)

    times = {"converted": seconds(converted_s), "original": seconds(original_s)}
    return (
        F.when(original_s.isNull() | (original_s > fixed.RUN_TIMEOUT_SECONDS), result(False, F.lit(fixed.RUN_TIMED_OUT)))
        .when(original_rc != 0, result(False, fill(fixed.RUN_ORIGINAL_FAILED, error=original_error)))
        .when(converted_s.isNull() | (converted_s > fixed.RUN_TIMEOUT_SECONDS), result(False, F.lit(fixed.RUN_TIMED_OUT)))
        .when(converted_rc != 0, result(False, fill(fixed.RUN_CONVERTED_FAILED, error=converted_error)))
        .when(converted_s <= F.lit(fixed.MAX_SLOWDOWN) * original_s, result(True, fill(fixed.RUN_ACCEPTABLE, **times)))
        .otherwise(result(False, fill(fixed.RUN_REGRESSION, **times)))
    )


# --- review -----------------------------------------------------------------


def review_result(answer: Column, error: Column) -> Column:
    """A failed call passes by default, a missing answer fails, an answer is read for its verdict."""
    return (
        F.when(error.isNotNull(), result(True, fill(fixed.REVIEW_CALL_FAILED, error=error)))
        .when(answer.isNull(), result(False, F.lit(fixed.REVIEW_NO_RESPONSE)))
        .otherwise(result(verdict(answer), answer))
    )


# --- leniency ---------------------------------------------------------------


def lenient(res: Column, cross_language: Column, strict: bool, phrases: list[str] | None = None) -> Column:
    """Turn a failure into a pass where its details name a known cross-language issue."""
    if strict:
        return res
    text = F.lower(res["details"])
    known = None
    for phrase in phrases or fixed.LENIENT_PHRASES:
        hit = F.contains(text, F.lit(phrase))
        known = hit if known is None else known | hit
    return F.when(
        cross_language & ~res["passed"] & F.coalesce(known, F.lit(False)),
        result(True, F.concat(F.lit(fixed.LENIENT_PREFIX), res["details"])),
    ).otherwise(res)


def overall(passed_count: Column, total: Column, cross_language: Column, strict: bool) -> Column:
    """Quorum for lenient cross-language pairs, unanimity (also of nobody) otherwise."""
    unanimous = passed_count == total
    if strict:
        return unanimous
    return F.when(cross_language, passed_count >= fixed.LENIENT_QUORUM).otherwise(unanimous)


def pair_languages(original_path: Column, converted_path: Column) -> tuple[Column, Column, Column]:
    source, target = bare_suffix(original_path), bare_suffix(converted_path)
    return source, target, source != target
