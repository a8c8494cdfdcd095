import ast

from codecorpus.operators import context, dependencies, segmentation

PYTHON = '''"""Module text
def not_here():
"""
import os, sys
from a.b import (
    c,
    d,
)
from . import near
LIMIT = 3
NAMES = {
"x": 1,
}


@decorated
class Ä(Base,
        metaclass=M):
    """Text
def neither():
    """
    size = 1  # def comment():

    async def first(self, n=LIMIT, *, k: int = 2) -> str:
        if n:
            return f("def x(): {", k=n)

        # trailing

    def second(self):
        def inner(): return (1,
  2)
        x = \\
    inner()
        return [
    x,
]
# comment at the margin
    def third(self): pass


def tabs():
\tif True:
\t\treturn "class No:"
last = tabs().value
'''


def expected_definitions(source):
    """All definitions by Python's own parser, in source order, with character positions."""
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def offset(line, column):
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode())

    found = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            begin, end = offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset)
            found.append((begin, end, kind, node.name, node.lineno - 1, node.end_lineno - 1))
    return sorted(found)


def test_python_definitions_are_those_of_the_parser(files_of):
    sources = [PYTHON, "", "x = 1\n", "def f(): pass", "class A:\n\n  def f(self):\n    return 1\n\n\n\n", "\n\ndef f():\n    '''a\n'''\n    return 2\n# end"]
    files = files_of(*[(f"{i}.py", s) for i, s in enumerate(sources)])
    rows = segmentation.segment_code(files).collect()
    for i, source in enumerate(sources):
        found = sorted(
            (r.start_char, r.end_char, r.node_type, r.name, r.start_line, r.end_line) for r in rows if r.path == f"{i}.py"
        )
        assert found == expected_definitions(source), i
    for r in rows:
        assert r.code == sources[int(r.path[:-3])][r.start_char : r.end_char]
        assert r.segment_no >= 0


JAVASCRIPT = """import { a } from "x";
// function no() { }
export default class Foo extends Bar {
  constructor(a, b = (1)) { super(a); if (a) { b(); } }
  static async get(x) {
    return `function t() { ${x} }`;
  }
}
const f = function (y) { return /[{]/.test(y); };
async function h({p, q}) { for (const k of p) { await k("}"); } }
foo(function named() { return 1 });
"""
JAVA = """package a.b;
import java.util.*;
/** doc { */
@Entity
public class A<T extends B> extends C implements D {
  public A(int x) throws IOException { this.x = x; }
  @Override
  public Map<String, List<T>> get(String s) {
    if (s.equals("}")) { return new HashMap<>(); }
    Runnable r = new Runnable() { public void run() { go(); } };
    return null;
  }
  abstract int no();
  static class In { }
  enum E { X, Y }
}
"""
CPP = """#include <vector>
#define OPEN {
namespace n {
class Foo : public Bar {
 public:
  Foo(int x) : x_(x) {}
  ~Foo() {}
  int get() const { return x_; }
};
enum class E { a, b };
template <class T> T max(T a, T b) { return a > b ? a : b; }
std::vector<int> *Foo::make(int n) {
  while (n > 0) { n--; }
  return new std::vector<int>(n);
}
}
"""


def named(files, suffix):
    rows = segmentation.segment_code(files).filter(f"path like '%{suffix}'").orderBy("segment_no").collect()
    return [(r.node_type, r.name) for r in rows], rows


def test_braced_languages(files_of):
    files = files_of(("a.js", JAVASCRIPT), ("a.java", JAVA), ("a.cpp", CPP))
    found, rows = named(files, ".js")
    assert found == [
        ("class_declaration", "Foo"),
        ("method_definition", "constructor"),
        ("method_definition", "get"),
        ("function_expression", "<anonymous>"),
        ("function_declaration", "h"),
        ("function_expression", "named"),
    ]
    assert rows[2].code.startswith("static async get(x) {") and rows[2].code.endswith("`;\n  }")
    assert rows[4].code == 'async function h({p, q}) { for (const k of p) { await k("}"); } }'
    found, rows = named(files, ".java")
    assert found == [
        ("class_declaration", "A"),
        ("constructor_declaration", "A"),
        ("method_declaration", "get"),
        ("method_declaration", "run"),
        ("class_declaration", "In"),
    ]
    assert rows[0].code == JAVA[JAVA.index("@Entity") : -1]
    assert rows[2].code.startswith("@Override\n  public Map") and rows[2].code.endswith("return null;\n  }")
    found, rows = named(files, ".cpp")
    assert found == [
        ("class_specifier", "Foo"),
        ("function_definition", "Foo"),
        ("function_definition", "~Foo"),
        ("function_definition", "get"),
        ("function_definition", "max"),
        ("function_definition", "Foo::make"),
    ]
    assert rows[4].code == "T max(T a, T b) { return a > b ? a : b; }"
    assert rows[0].code.endswith("return x_; }\n}")


def test_fallbacks(files_of):
    files = files_of(
        ("a.js", "x = (a) => b\nclass Q"), ("b.js", "var x = 1;"), ("c.java", "int x;"), ("d.py", "x = 1"), ("e.cs", "class X { }\n")
    )
    rows = {(r.path, r.name): r for r in segmentation.segment_code(files).collect()}
    assert set(rows) == {("a.js", "x"), ("a.js", "Q"), ("c.java", "c.java"), ("e.cs", "e.cs")}
    assert rows["a.js", "x"].code == "x = (a) => b\nclass Q" and rows["a.js", "Q"].code == "class Q"
    whole = rows["e.cs", "e.cs"]
    assert (whole.node_type, whole.start_char, whole.end_char) == ("File", 0, 12)
    matched = segmentation.segment_javascript_regex(files_of(("f.js", "é; function f() { if (x) { y } }")))
    assert [r.code for r in matched.collect()] == ["function f() { if (x) { y }"]


def test_stored_segments_give_their_text(files_of, spark):
    files = files_of(("a.py", PYTHON))
    found = segmentation.segment_code(files)
    assert all(r.code == r.code_chunk for r in segmentation.slice_code(files, found).collect())
    by_line = spark.createDataFrame(
        [("r", "a.py", 0, None, None, 3, 4, None), ("r", "a.py", 1, None, None, None, None, "kept")],
        "repo string, path string, segment_no int, start_char int, end_char int, start_line int, end_line int, code string",
    )
    chunks = [r.code_chunk for r in segmentation.slice_code(files, by_line).orderBy("segment_no").collect()]
    assert chunks == ["import os, sys\nfrom a.b import (", "kept"]


def contexts(files):
    rows = segmentation.segment_code(files).join(context.extract_context(files), ["repo", "path", "segment_no"])
    return {(r.path, r.name): r for r in rows.collect()}


def test_context_is_what_ends_before(files_of):
    files = files_of(("a.py", PYTHON), ("a.js", JAVASCRIPT), ("a.java", JAVA), ("a.cpp", CPP))
    found = contexts(files)
    imports = "import os, sys\nfrom a.b import (\n    c,\n    d,\n)\nfrom . import near"
    assert found["a.py", "Ä"].context_code == imports
    assert found["a.py", "first"].context_code == imports
    second = found["a.py", "second"].context_code
    assert second.startswith(imports + "\nasync def first") and "class Ä" not in second
    assert found["a.py", "tabs"].context_code.count("def inner") == 3
    assert found["a.js", "get"].context_code == 'import { a } from "x";'
    assert found["a.js", "h"].context_code.startswith('import { a } from "x";\nclass Foo')
    assert found["a.java", "In"].context_code.startswith("import java.util.*;\n@Override")
    assert found["a.cpp", "~Foo"].context_code == "#include <vector>\nFoo(int x) : x_(x) {}"
    for r in found.values():
        assert r.source_lines == [0, len(r.context_code.splitlines())]


def test_context_without_imports_or_definitions(files_of):
    files = files_of(
        ("a.py", "A = 1\nB = [\n 2,\n]\ndef f():\n  return A\n"),
        ("a.js", "x = (a) => 1;\nclass Q { m() { } }"),
        ("b.js", "let y = 2;\nfoo(function () { });"),
        ("a.java", "// top\n\nclass A { }"),
    )
    found = contexts(files)
    assert found["a.py", "f"].context_code == "A = 1\nB = [\n 2,\n]"
    assert found["a.js", "m"].context_code == "class Q"
    assert found["b.js", "<anonymous>"].context_code == ""
    assert found["a.java", "A"].context_code == "// top"


def test_imports_calls_and_uses(files_of):
    files = files_of(("a.py", PYTHON), ("a.js", JAVASCRIPT + "const z = require('fs');\n"), ("a.java", JAVA), ("a.cpp", CPP))
    imports = {(r.path, r.kind, r.module) for r in dependencies.extract_imports(files).collect()}
    assert imports == {
        ("a.py", "import", "os"),
        ("a.py", "import_from", "a"),
        ("a.py", "import_from", None),
        ("a.js", "import", "x"),
        ("a.js", "require", "fs"),
        ("a.java", "import", "java.util"),
        ("a.cpp", "include", "vector"),
    }
    calls = sorted((r.path, r.name) for r in dependencies.extract_calls(files).collect())
    assert calls == sorted(
        [("a.py", "f"), ("a.py", "inner"), ("a.py", "tabs")]
        + [("a.js", n) for n in ("super", "b", "k", "foo", "require", "test")]
        + [("a.java", n) for n in ("s.equals", "go")]
    )
    tree = ast.parse(PYTHON)
    expected = sorted((n.id, n.lineno) for n in ast.walk(tree) if isinstance(n, ast.Name))
    uses = sorted((r.name, r.line_no) for r in dependencies.extract_variables(files).collect())
    assert uses == expected


def _definitions(spark, path, text):
    files = spark.createDataFrame([("r", path, len(text), text)], "repo string, path string, size long, content string")
    return segmentation.segment_code(files).orderBy("segment_no").collect()


def test_brackets_of_any_depth_and_brackets_that_stay_open(spark):
    deep = "(" * 30 + "\n1,\n" + ")" * 30
    text = f"def f():\n    x = [\n1,\n{deep}]\n    return x\n\ndef g():\n    return 1\n"
    assert [(s.name, s.code.endswith("return x") or s.name == "g") for s in _definitions(spark, "a.py", text)] == [("f", True), ("g", True)]
    assert [s.name for s in _definitions(spark, "a.py", "x = (1,\n2\ndef f():\n    return 1\ndef g():\n    return 2\n")] == ["f", "g"]


def test_many_type_words_and_long_gaps(spark):
    found = _definitions(spark, "a.cpp", "static inline constexpr extern volatile const unsigned long long int f(int x) { return x; }\n")
    assert [(s.name, s.start_char) for s in found] == [("f", 0)]
    gap = "/* " + "c" * 60 + " */"
    kinds = [s.node_type for s in _definitions(spark, "a.js", f"const f = {gap} function g() {{ return 1 }}\nfunction h() {{ }}\n")]
    assert kinds == ["function_expression", "function_declaration"]
    assert [s.name for s in _definitions(spark, "a.js", "const f =" + "\n" * 45 + "class Q { }\nclass R { }\n")] == ["R"]


def test_calls_through_this_and_blanks_of_any_number(spark):
    cases = {
        "a.java": ("class A { void m() { super.x(); this.y(); assert ok(); new     B(); int     g(int a); return     h(1); } }", ["super.x", "this.y", "ok", "h"]),
        "a.js": ("class A { m() { this.go(); self.go(); if (a) { b   (1) } } }", ["this.go", "self.go", "b"]),
        "a.cpp": ("int     g(int);\nint f(int x) { return       g(x); }\n", ["g"]),
        "a.py": ("def         f(a):\n    return g(a)\n", ["g"]),
    }
    rows = [("r", p, len(t), t) for p, (t, _) in cases.items()]
    files = spark.createDataFrame(rows, "repo string, path string, size long, content string")
    found = {}
    for r in dependencies.extract_calls(files).collect():
        found.setdefault(r.path, []).append(r.name)
    assert {p: sorted(n) for p, n in found.items()} == {p: sorted(n) for p, (_, n) in cases.items()}


def test_uses_don_t_depend_on_the_number_of_blanks(spark):
    text = "def f(a=   B, c=      D):\n    g(" + " " * 120 + "key=value)\n"
    files = spark.createDataFrame([("r", "a.py", len(text), text)], "repo string, path string, size long, content string")
    names = [r.name for r in dependencies.extract_variables(files).collect()]
    assert "B" in names and "D" in names and "key" not in names and "value" in names


def test_imports_in_comments_and_strings_don_t_count(spark):
    cases = {
        "a.java": ('// import a.b;\nimport c.d;\nclass A { String s = "import e.f;"; }\n', ["c.d"]),
        "a.cpp": ('/* #include <no.h> */\n#include <yes.h>\nconst char* s = "#include <neither.h>";\n', ["yes.h"]),
        "a.cs": ('// using A;\nusing B;\nclass C { string s = "using D;"; }\n', ["B"]),
        "a.js": ('// import a from "no";\nimport a from "yes";\nimport "side";\nconst s = `require("neither")`;\nconst t = require("too");\n', ["yes", "side", "too"]),
    }
    rows = [("r", p, len(t), t) for p, (t, _) in cases.items()]
    files = spark.createDataFrame(rows, "repo string, path string, size long, content string")
    found = {}
    for r in dependencies.extract_imports(files).collect():
        found.setdefault(r.path, []).append(r.module)
    assert {p: sorted(n) for p, n in found.items()} == {p: sorted(n) for p, (_, n) in cases.items()}


def test_headers_of_any_depth_and_what_else_has_a_body(spark):
    deep = "g(" * 40 + "1" + ")" * 40
    java = "class A { void f(@X(a=@Y(b=@Z(c=@W(1)))) int x) { } @V(a=@U(@T(@S(1)))) int h() { return 1; } }\n"
    assert [(s.node_type, s.name) for s in _definitions(spark, "a.java", java)] == [
        ("class_declaration", "A"), ("method_declaration", "f"), ("method_declaration", "h"),
    ]
    found = _definitions(spark, "a.cpp", "int f(int (*g)(int (*)(int (*)(int)))) { return 1; }\nstruct S { int operator()(int x) { return x; } };\n")
    assert [(s.name, s.start_char) for s in found] == [("f", 0), ("operator()", 64)]
    found = _definitions(spark, "a.js", f"function f(a = {deep}, b = {{x: 1}}) {{ return a; }}\nfunction k() {{ return f(function (z = (1)) {{ }}); }}\n")
    assert [(s.node_type, s.name) for s in found] == [
        ("function_declaration", "f"), ("function_declaration", "k"), ("function_expression", "<anonymous>"),
    ]
    assert found[0].code.endswith("{ return a; }") and found[1].code.endswith("}); }")
    types = "record R(int a) { R(int a, int b) { this(a); } }\nenum E { X(1) { int v() { return 1; } }; E(int x) { } }\ninterface I<T> { default int d() { return 1; } }\nclass C { C() { } static class D extends C { D() { super(); } } C(int x) { } }\n"
    assert [(s.node_type, s.name) for s in _definitions(spark, "b.java", types)] == [
        ("constructor_declaration", "R"), ("method_declaration", "v"), ("constructor_declaration", "E"), ("method_declaration", "d"),
        ("class_declaration", "C"), ("constructor_declaration", "C"), ("class_declaration", "D"), ("constructor_declaration", "D"),
        ("constructor_declaration", "C"),
    ]
    # Parentheses and braces without a pair leave what follows as it is.
    assert [s.name for s in _definitions(spark, "b.js", "a(b;\nfunction f(x = (1)) { c) }\n}\nfunction g() { }\nfunction h( {\n")] == ["f", "g"]


def test_call_sites(spark):
    cases = {
        "a.java": ("class A extends B {\n  A() { super(1); }\n  void f(@X(a=@Y(1)) int x) { assert ok(); }\n}", [("ok", 3)]),
        "a.cpp": ("int f(int (*g)(int (*)(int))) {\n  return g(h(k()));\n}\n", [("g", 2), ("h", 2), ("k", 2)]),
        "a.js": ("class A extends mixin(B) {\n  constructor(a = u(v(w(x(1))))) { super(a); }\n  m(a = (1)) { }\n}", [("mixin", 1), ("super", 2), ("u", 2), ("v", 2), ("w", 2), ("x", 2)]),
        "a.py": ("@d(1)\ndef f(a=g(h(i(j(k(1)))))):\n    return é(a)\n", [("d", 1), ("g", 2), ("h", 2), ("i", 2), ("j", 2), ("k", 2), ("é", 3)]),
    }
    files = spark.createDataFrame([("r", p, len(t), t) for p, (t, _) in cases.items()], "repo string, path string, size long, content string")
    rows = dependencies.extract_calls(files).collect()
    for path, (text, expected) in cases.items():
        assert sorted((r.name, r.line_no) for r in rows if r.path == path) == expected, path
        assert all(text[r.start_char : r.start_char + len(r.text)] == r.text for r in rows if r.path == path)
    used = [r.name for r in dependencies.extract_variables(files).collect()]
    assert sorted(used) == ["a", "d", "g", "é"]  # of a head only names right after a sign


def test_regular_expressions_after_any_number_of_blanks(spark):
    text = "x =" + " " * 40 + "/[{]/;\nfunction f() { return" + " " * 20 + "/}/.test(s); }\nvar q = a / b; function g() { return q / 2 }\n"
    assert [s.name for s in _definitions(spark, "a.js", text)] == ["f", "g"]


def test_a_large_file_in_one_task(spark):
    import time

    n = 25_000
    text = "// é\n" + "".join(f"  int m{i}(int a) {{ if (a > {i}) {{ return f(a, (b)); }} return a; }}\n" for i in range(n))
    files = spark.createDataFrame([("r", "a.java", len(text), "class A {\n" + text + "}\n")], "repo string, path string, size long, content string").coalesce(1)
    start = time.perf_counter()
    assert segmentation.segment_code(files).select("name").distinct().count() == n + 1
    assert time.perf_counter() - start < 60
    last = segmentation.segment_code(files).filter(f"name = 'm{n - 1}'").first()
    assert last.code.startswith(f"int m{n - 1}(int a) {{") and last.code.endswith("return a; }")


def test_stored_segments_are_not_found_again(spark, files_of, tmp_path):
    from codecorpus.operators.common import FILE, segmented

    made = segmented(files_of(("a.py", PYTHON), ("b.js", "function f(x) {\n  return x;\n}\nclass B { m() { } }\n")))
    made.select(*FILE, "content", "language", "_hidden", "segments").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    for run in (segmentation.segment_code, context.extract_context):
        assert sorted(run(stored).collect()) == sorted(run(made.select(*FILE, "size", "content", "language")).collect())
    plan = segmentation.segment_code(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_lines_join_inside_brackets_of_any_depth(spark):
    from pyspark.sql import functions as F

    from codecorpus.functions.lexical import OPEN_AT_LINE_END, logical_lines

    flat = ["", "f(x)\ng[(1)]\n", "a)\nb", "f(g(h(1)), {2: [3]})\nx", "x[1\ty]\n" * 3000, "f(]\n"]
    open_ = {"f(\nx)": "f(\x0bx)", "f(1)(\n2)\n": "f(1)(\x0b2)\n", "((x)\n)": "((x)\x0b)", "f((((x))))\n(\n)": "f((((x))))\n(\x0b)", "(\n": "(\n", "(a \\\nb)\n": "(a \\\x0bb)\n"}
    rows = spark.createDataFrame([(t,) for t in [*flat, *open_]], "t string")
    found = {r.t: (r.slow, r.joined) for r in rows.select("t", F.col("t").rlike(OPEN_AT_LINE_END).alias("slow"), logical_lines(F.col("t")).alias("joined")).collect()}
    assert [found[t] for t in flat] == [(False, t) for t in flat]
    assert {t: found[t] for t in open_} == {t: (True, joined) for t, joined in open_.items()}
