import random

from pyspark.sql import functions as F

from codecorpus.functions import context, language, text
from codecorpus.operators import classify, limits, lines
from codecorpus.sources.tree import decode_text

PIECES = ["a", "b c", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "é", "😀", " ", "\t"]


def samples(n=300, seed=1):
    rng = random.Random(seed)
    fixed = ["", "\n", "\r\n", "a", "a\n", "a\r\n", "a\r", "\n\n", "a\n\nb", "\x0c", "x\u2028", "\r\n\r\n"]
    return fixed + ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def test_split_lines_is_that_of_python(spark):
    given = samples()
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    found = rows.select("i", text.split_lines(F.col("s")).alias("x"), text.line_count(F.col("s")).alias("n")).collect()
    for r in found:
        assert r.x == given[r.i].splitlines(), repr(given[r.i])
        assert r.n == len(given[r.i].splitlines()), repr(given[r.i])


def test_strip_is_that_of_python(spark):
    given = samples() + [" \u3000\xa0x \u205f", "\u2003", "\x1f x"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    for r in rows.select("i", text.strip(F.col("s")).alias("x")).collect():
        assert r.x == given[r.i].strip(), repr(given[r.i])


def test_decoding_drops_invalid_bytes_only(spark):
    rng = random.Random(2)
    given = [b"", b"\xff", b"a\xe2\x82b", "\ufffd".encode(), b"\xff" + "\ufffdx".encode(), b"\xf0\x9f\x98", b"\xc3\x28"]
    alphabet = ["é".encode(), b"a", b"\xff", b"\xe2\x82", b"\x80", "😀".encode(), b"\r\n", b"\r", b"\n", "\ufffd".encode()]
    given += [b"".join(rng.choices(alphabet, k=rng.randint(0, 10))) for _ in range(200)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(given)], "i int, content binary")
    for r in decode_text(rows).collect():
        expected = given[r.i].decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert r.content == expected, given[r.i]


def test_truncation_counts_line_feeds_and_keeps_terminators(files_of):
    given = ["a\nb\nc\nd", "a\nb\nc\n", "a\nb\nc", "a\nb\nc\nd\n", "", "\n\n\n\n", "a\x0cb\x0cc\x0cd"]
    found = limits.truncate_lines(files_of(*[(f"{i}.py", s) for i, s in enumerate(given)]), 3).collect()
    for r in found:
        kept = given[int(r.path[:-3])].splitlines(keepends=True) if "\x0c" not in r.content else [r.content]
        assert r.content == "".join(kept[:3])
        assert r.truncated == (len(kept) > 3)
        assert r.size == len(given[int(r.path[:-3])].encode())


def test_chunks_of_lines_join_to_the_lines(files_of):
    given = samples(60)
    files = files_of(*[(str(i), s) for i, s in enumerate(given)])
    chunks = lines.chunk_lines(files, 2)
    assert all(len(r.text.splitlines()) <= 2 for r in chunks.collect())
    joined = {r.path: r.content for r in lines.join_chunks(chunks).collect()}
    for i, s in enumerate(given):
        assert joined.get(str(i), "") == "\n".join(s.splitlines())
    rejoined = {r.path: r.content for r in lines.rechunked(files, 2).collect()}
    assert all(rejoined[str(i)] == "\n".join(s.splitlines()) for i, s in enumerate(given))


def test_lines_know_strings_and_comments(files_of):
    source = 'x = """a\n\nb"""  # c\n# only\n\n\ty = 1'
    found = lines.explode_lines(files_of(("a.py", source))).orderBy("line_no").collect()
    assert [r.text for r in found] == source.split("\n")
    assert [r.is_code for r in found] == [True, False, False, False, False, True]
    assert [source[r.start_char : r.start_char + len(r.text)] for r in found] == source.split("\n")
    assert found[-1].indent == 1 and found[1].is_blank


def test_preview(spark):
    rows = spark.createDataFrame([(n, "\n".join(map(str, range(n)))) for n in (0, 5, 6, 8, 9, 20)], "n int, s string")
    for r in rows.select("n", text.segment_preview(F.col("s")).alias("a"), text.context_preview(F.col("s")).alias("b")).collect():
        every = [str(i) for i in range(r.n)]
        long = every if r.n <= 8 else every[:4] + [f"... ({r.n - 8} lines omitted) ..."] + every[-4:]
        short = every if r.n <= 5 else every[:3] + [f"... ({r.n - 3} lines omitted) ..."]
        assert r.a == "\n".join(long) and r.b == "\n".join(short)


def test_code_fences(spark):
    cases = {
        "```py\nx\n```": "x",
        " ```\na\nb\n``` \n": "a\nb",
        "```x```": "```x```",
        "```\n```": "```\n```",
        "plain": "plain",
        "```py\nx": "```py\nx",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in rows.select("s", text.strip_code_fence(F.col("s")).alias("x")).collect():
        assert r.x == cases[r.s], r.s


def test_json_path_defaults_where_a_step_is_missing(spark):
    rows = spark.createDataFrame(
        [('{"a": {"b": {"c": 1}}, "n": null, "s": "x"}',), ("[1]",), ("no json",), (None,)], "j string"
    )
    found = rows.select(*[text.json_path(F.col("j"), p, "d").alias(p.replace(".", "_")) for p in ("a.b.c", "a.x", "s.y", "n", "s")])
    assert [tuple(r) for r in found.collect()] == [("1", "d", "d", None, "x")] + [("d",) * 5] * 3


def test_suffixes_languages_and_bands(spark):
    cases = {
        "r/a.py": (".py", "Python"),
        "r/A.R": (".R", "R"),
        "r/.py": ("", "unknown"),
        ".py": ("", "unknown"),
        "r/a.": ("", "unknown"),
        "r.py/a": ("", "unknown"),
        "r/a.tar.js": (".js", "JavaScript"),
        "r/x.json": (".json", "JSON"),
        "r/x.go": (".go", "unknown"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    path = F.col("p")
    found = rows.select("p", language.suffix(path), language.language_of(path), language.output_path(path, F.lit("C#")))
    for p, suffix, name, out in found.collect():
        assert (suffix, name) == cases[p], p
        assert out == f"csharp/{p.removesuffix(suffix) if suffix else p}.cs"
    bands = spark.createDataFrame([(n,) for n in (0, 300, 301, 800, 801)], "loc int")
    assert [(r.priority, r.difficulty) for r in classify.priority_band(bands).collect()] == [
        (3, "low"), (3, "low"), (2, "medium"), (2, "medium"), (1, "high")
    ]


def test_counts_take_bytes_and_look_behinds_only_blanks(spark, monkeypatch):
    """Lengths in characters walk through the text, and a look-behind at every character was most of the time of calls."""
    from codecorpus.functions import lexical

    patterns = []
    monkeypatch.setattr(lexical, "replace_matches", lambda t, pattern, change: patterns.append(pattern))
    lexical.mark_blanks(F.col("t"), r"\w", r"\s")
    assert patterns[0].startswith(r"(?=\s)(?<=\w)")
    for counted in (text.newline_count(F.col("t")), text.count_substring(F.col("t"), "if"), lexical.line_breaks(F.col("t"))):
        assert "octet_length(t)" in str(counted) and "char_length" not in str(counted) and "(length(" not in str(counted)


def test_unicode_classes_only_where_a_text_needs_them(spark):
    """ASCII text is matched without them; other text has its Unicode names and spaces all the same."""
    from codecorpus.functions.rules import has_structure, structural_elements

    rows = spark.createDataFrame([("def f(x):\n\x0ba = 1",), ("def gr\u00f6\u00dfe\u00a0(x):\n  \u00e4\u2003= 1",), (None,)], "t string")
    found = structural_elements(F.col("t"), F.lit("py"))
    has = has_structure(F.col("t"), F.lit("py"))["functions"]
    assert [tuple(r) for r in rows.select(found["functions"], found["variables"], has).collect()] == [
        (["f"], ["a"], True), (["gr\u00f6\u00dfe"], ["\u00e4"], True), (None, None, None),
    ]
    assert "(?d)def" in str(found) and "(?dU)def" in str(found)


def test_lines_before_are_cut_from_texts_without_rare_line_ends(spark):
    given = [*samples(), *(s.replace("\r", "").replace("\x0b", "") for s in samples(200, 7)), "a\nb\n\nc", "\n\na\n", None]
    rows = spark.createDataFrame([(s, k) for s in given for k in (0, 1, 2, 9)], "s string, k int")
    s, k, rare = F.col("s"), F.col("k"), F.col("rare")
    by_lines = context.lines_before(text.split_lines(s), k)
    cut = F.when(rare, by_lines).otherwise(context.first_lines_before(s, k))
    found = rows.withColumn("rare", text.has_rare_line_ends(s)).select("s", by_lines.alias("a"), cut.alias("b"), "rare")
    found = found.withColumns({"n": text.line_count(F.col("b")), "m": text.line_count(F.col("b"), rare)}).collect()
    assert {r.rare for r in found} == {True, False, None}
    for r in found:
        assert r.a == r.b, r.s
        assert r.n == r.m, r.s
