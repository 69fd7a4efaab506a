"""Golden rows and plain restatements of the measures that SQL does not cover."""

import ast

from pyspark.sql import functions as F

from codecorpus.operators import metrics as m
from codecorpus.operators import pyfacts

GOOD = '''import os
from a.b import c


class Shape:
    """Doc."""

    def area(self, x):
        """Area."""
        if x > 0 and x < 9 or x == 4:
            for i in range(x):
                while i:
                    i -= 1
        elif x:
            pass
        return [y for y in range(3)]


async def Run(a, b) -> int:
    try:
        return 1
    except ValueError:
        raise


if __name__ == "__main__":
    with open("f") as fh:
        pass
'''
BAD = "def broken(:\n"


def test_facts_match_a_tree_walk(spark, texts):
    rows = pyfacts.python_facts(texts(GOOD)).collect()
    tree = ast.parse(GOOD)
    for kind in ("If", "While", "For", "FunctionDef", "AsyncFunctionDef", "ClassDef", "BoolOp", "ExceptHandler", "ListComp", "With", "Raise"):
        assert sum(r.kind == kind for r in rows) == sum(type(n).__name__ == kind for n in ast.walk(tree)), kind
    by_pre = {r.pre: r for r in rows}
    for r in rows:
        if r.parent >= 0:
            up = by_pre[r.parent]
            assert up.pre < r.pre <= up.post and r.post <= up.post
    area = next(r for r in rows if r.name == "area")
    assert (area.owner, area.args, area.has_doc, area.n_args) == ("Shape", ["self", "x"], True, 2)


def test_error_rows_and_validity(spark, texts):
    df = texts(GOOD, BAD, "   \n", "x = '\0'")
    errors = {r.file_id: r.message for r in pyfacts.python_facts(df).filter("kind = 'error'").collect()}
    assert errors[1].startswith("Syntax error at line 1") and 3 in errors and set(errors) == {1, 3}
    assert [r.valid for r in pyfacts.python_validity(df).orderBy("file_id").collect()] == [True, False, True, False]
    strict = pyfacts.python_validity(df, blank_is_valid=False).orderBy("file_id").collect()
    assert [r.valid for r in strict] == [True, False, False, False] and "empty" in strict[2].message


def test_structure(spark, texts):
    r = pyfacts.structure_info(texts(GOOD)).first()
    assert [(c.name, c.methods) for c in r.classes] == [("Shape", ["area"])]
    assert [(f.name, f.args) for f in r.functions] == [("area", 2)]
    assert r.imports == ["os", "a.b.c"] and r.has_main and r.docstrings == ["Doc.", "Area."] and r.error is None
    # class, 2 functions, 3 ifs, for, while, try, handler, raise, with, comprehension
    assert r.complexity_score == 13


def test_python_scores(spark, texts):
    row = m.score_python(texts(GOOD, BAD)).orderBy("file_id").collect()
    # 3 ifs + for + while + handler + (2 values - 1) * 2 operators + 1 base = 9 -> 82; no comments: -15; docstrings 1 of 2: no change
    assert (row[0].complexity, row[0].readability, row[0].maintainability) == (82, 85, 100)
    assert (row[1].complexity, row[1].readability, row[1].maintainability) == (65, 20, 25)


def test_python_naming_and_length(spark, texts):
    long_body = "def Bad__name(x):\n" + "".join(f"    x = {i}\n" for i in range(55)) + "class low:\n    pass\n"
    row = m.score_python(texts(long_body)).first()
    assert (row.readability, row.maintainability) == (100 - 15 - 3 - 3, 100 - 10 - 15)


def test_python_counts(spark, texts):
    r = m.counts_python(texts(GOOD)).first()
    assert (r.cyclomatic_complexity, r.function_count, r.class_count, r.lines_of_code) == (10, 2, 1, GOOD.count("\n") + 1)
    assert r.max_nesting_depth == 5


def test_score_dispatch(spark, texts):
    df = texts(("Python", GOOD), ("C++", "if if"), ("java", "class Foo { }"), ("c", "int main() { }"), ("JavaScript", "x"))
    got = [(r.complexity, r.readability, r.maintainability) for r in m.score(df).orderBy("file_id").collect()]
    assert got == [(82, 85, 100), (100, 90, 85), (100, 85, 100), (100, 80, 100), (100, 80, 80)]


def test_keyword_counts_are_substrings(spark, texts):
    # elseif counts else and if
    r = m.score_javascript(texts("elseif // note")).first()
    assert r.complexity == 94


def test_overall_rounds_half_to_even(spark):
    df = spark.createDataFrame([(65, 50, 45), (70, 65, 70), (100, 75, 70)], "complexity int, readability int, maintainability int")
    expect = [int(round(c * 0.4 + r * 0.3 + mm * 0.3)) for c, r, mm in [(65, 50, 45), (70, 65, 70), (100, 75, 70)]]
    assert [r.overall for r in m.overall(df).collect()] == expect


def test_long_functions(spark, texts):
    body = "def first():\n" + "    x = 1\n" * 25 + "y = 2\ndef second():\n" + "    x = 1\n" * 25 + "def third():\n    pass\n"
    rows = m.long_functions(texts(body)).collect()
    # second runs into the header of third, which starts a new function without a report
    assert [(r.name, r.line_no, r.following_lines) for r in rows] == [("first", 1, 26)]


def test_magic_numbers(spark, texts):
    code = "x = 7 + 100\n# y = 8\nimport a8\nz1 = 3.5 * 42.25\nreturn 9\nq = v12\n"
    rows = m.magic_numbers(texts(code)).orderBy("line_no", "literal").collect()
    assert [(r.line_no, r.literal, r.constant) for r in rows] == [(1, "7", "CONSTANT_7"), (4, "42.25", "CONSTANT_42_25")]


def test_issues(spark, texts):
    code = "x" * 101 + "\n\n\n\n# TODO " + "if for while " * 8 + "\n\ndef f():\n" + "    y = 1\n" * 32 + "z = 1\n"
    df = texts(code).withColumn("original_path", F.lit("a.py"))
    got = {r.issue: r.detail for r in m.quality_issues(df).collect()}
    assert got["long_lines"] == "1, 5" and got["long_functions"] == "f(32 lines)"
    assert set(got) == {"long_lines", "long_functions", "low_comment_ratio", "high_complexity", "todo", "blank_runs"}


def test_delimiters_and_semicolons(spark, texts):
    df = texts(("java", "a[\nint x = 1;\nfoo()\n"), ("cpp", "a["), ("java", "{("), ("java", "int x;"))
    got = [r.delimiter_error for r in m.delimiter_check(df).orderBy("file_id").collect()]
    assert got == [None, "Unbalanced brackets: 1", "Unbalanced braces: 1", None]
    assert [(r.file_id, r.line_no) for r in m.missing_semicolon(df).collect()] == [(0, 1), (1, 1), (2, 1)]


def test_splitlines_change(spark):
    df = spark.createDataFrame([(1, "Python", "a\r\nb\n", "a")], "file_id int, language string, original_content string, refactored_content string")
    row = m.metric_change(df).filter("metric = 'lines_of_code'").first()
    assert (row.before, row.after, row.change_pct) == (2, 1, -50.0)
