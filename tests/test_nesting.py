import ast
import random
import re

from codecorpus.operators import nesting as n
from codecorpus.operators import symbols as y


def indent_reference(code):
    stack, out = [], []
    for i, line in enumerate(code.split("\n"), 1):
        if re.search(r"\bif\b", line):
            pad = len(line) - len(line.lstrip())
            stack = [e for e in stack if e[1] < pad] + [(i, pad)]
            if len(stack) >= 3:
                out.append((stack[0][0], i, len(stack)))
    return out


def brace_reference(code):
    depth, stack, out = 0, [], []
    for i, line in enumerate(code.split("\n"), 1):
        depth += line.count("{") - line.count("}")
        if re.search(r"\bif\s*\(", line):
            stack.append((i, depth))
        if len(stack) >= 3:
            out.append((stack[0][0], i, len(stack)))
        if "}" in line:
            stack = [e for e in stack if e[1] <= depth]
    return out


def random_code(rng):
    parts = ["if (a) {", "}", "} else {", "x = 1;", "if (b)", "", "foo(() => {", "});", "elif x:", "{ if (q) { }", "if b:"]
    return "\n".join(" " * rng.randrange(0, 9) + rng.choice(parts) for _ in range(rng.randrange(0, 60)))


def grouped(df, count):
    out = {i: [] for i in range(count)}
    for r in df.collect():
        out[r.file_id].append((r.line_start, r.line_end, r.depth))
    return [sorted(out[i]) for i in range(count)]


def test_folds_match_plain_loops(spark, texts):
    rng = random.Random(3)
    codes = [random_code(rng) for _ in range(60)]
    df = texts(*codes)
    assert grouped(n.nested_ifs_indent(df), 60) == [sorted(indent_reference(c)) for c in codes]
    assert grouped(n.nested_ifs_brace(df), 60) == [sorted(brace_reference(c)) for c in codes]


PY = """def f(a):
    if a:
        for x in a:
            if x:
                if x > 1:
                    while x:
                        if x:
                            pass
    if a:
        pass
    elif b:
        pass
    elif c:
        pass
"""


def test_python_chains(spark, texts):
    def depth(node):
        below = max((depth(c) for c in ast.iter_child_nodes(node)), default=0)
        return below + isinstance(node, ast.If)

    expect = sorted((x.lineno, x.end_lineno, depth(x)) for x in ast.walk(ast.parse(PY)) if isinstance(x, ast.If) and depth(x) >= 3)
    assert grouped(n.nested_ifs_python(texts(PY)), 1)[0] == expect
    assert (9, 14, 3) in expect  # elif counts as nesting
    assert {r.severity for r in n.nested_ifs_python(texts(PY)).filter("depth = 4").collect()} == {"high"}


JAVA = """class A {
  public int f(int a) {
    if (a > 0) {
      if (a > 1) {
        if (a > 2) { g(); }
      }
    }
    return 1;
  }
  private void g() { h(); }
}"""


def test_enclosing_function(spark, texts):
    files = texts(("java", JAVA), ("python", PY), ("python", "if a:\n  if b:\n    if c:\n      pass\n"))
    rows = n.enclosing_function(n.nested_ifs(files), files).select("file_id", "function_start", "function_end").distinct().collect()
    assert {tuple(r) for r in rows} == {(0, 2, 9), (1, 1, 15), (2, None, None)}


def test_delta(spark):
    df = spark.createDataFrame([(1, "python", PY, "def f(a):\n    return a\n")], "id int, language string, original_code string, refactored_code string")
    r = n.nested_if_delta(df).first()
    assert (r.nested_ifs_before, r.nested_ifs_after, r.max_depth_before, r.max_depth_after, r.lines_before, r.lines_after) == (3, 0, 4, 0, 15, 3)
    s = n.nested_if_summary(n.nested_if_delta(df), "language").first()
    assert (s.patterns_before, s.patterns_after, s.fewer_pct) == (3, 0, 100.0)


def test_symbols(spark, texts):
    js = y.symbols_javascript(texts("export function go(a) {\nconst add = (x) => x;\n class View {", language="javascript")).orderBy("line_start").collect()
    assert [(r.name, r.type, r.col_start, r.col_end, r.is_arrow) for r in js] == [("go", "function", 16, 18, False), ("add", "function", 6, 9, True), ("View", "class", 7, 11, False)]
    java = y.symbols_java(texts("public static int run(int a) {\nclass A {\nString name() {")).orderBy("line_start").collect()
    assert [(r.name, r.type, r.visibility, r.is_static, r.return_type) for r in java] == [
        ("run", "method", "public", True, "int"), ("A", "class", None, False, None), ("name", "method", "package", False, "String")]
    cpp = y.symbols_cpp(texts("int add(int a) { return a; }\nstruct P {\n#define MAX 3\nif (x) {")).orderBy("line_start").collect()
    assert [(r.name, r.type, r.return_type) for r in cpp] == [("add", "function", "int"), ("P", "struct", None), ("MAX", "macro", None)]


def test_python_symbols(spark, texts):
    rows = y.symbols_python(texts("class A:\n    'Doc'\n    def m(self, x) -> int:\n        return 1\ndef f(): pass\n")).orderBy("line_start").collect()
    assert [(r.name, r.type, r.parent, r.parameters, r.return_type, r.docstring) for r in rows] == [
        ("A", "class", None, None, None, "Doc"), ("m", "function", "A", ["self", "x"], "int", None), ("f", "function", None, [], None, None)]


def test_function_ends(spark, texts):
    code = "def a(x):\n    pass\n\n    y = 1\nz = 2\nasync def b():\n    def c(q):\n        pass\n    return 1"
    rows = y.extract_functions(texts(code)).orderBy("start_line").collect()
    assert [(r.name, r.start_line, r.end_line, r.signature) for r in rows] == [("a", 1, 4, "def a(x)"), ("b", 6, 9, "async def b()"), ("c", 7, 8, "def c(q)")]
