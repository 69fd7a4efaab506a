import re

import pytest

from codecorpus.operators import compare as c
from codecorpus.operators import rules as r

GOLDEN = [
    ("python", "bool_eq_true", "if a.b == True:", "if a.b:"),
    ("python", "bool_ne_true", "if x != True:", "if not x:"),
    ("python", "list_comprehension", "out = []\nfor i in xs:\n    out.append(i * 2)\n", "out = [i * 2 for i in xs]\n"),
    ("python", "list_comprehension", "out = []\nfor i in xs:\n    other.append(i)\n", "out = []\nfor i in xs:\n    other.append(i)\n"),
    ("python", "type_hints", "import os\nfrom x import y\ndef f(a):\n    pass", "import os\nfrom x import y\nfrom typing import Any\ndef f(a) -> Any:\n    pass"),
    ("python", "except_exception", "try:\n    x\nexcept:\n", "try:\n    x\nexcept Exception:\n    pass"),
    ("javascript", "js_var_const", "  var a = 1;\nvar b;\n", "  const a = 1;\nvar b;\n"),
    ("javascript", "js_var_let", "var a = 1; var b", "let a = 1; var b"),
    ("javascript", "js_arrow", "f(function (x) { return x + 1; })", "f((x) => x + 1)"),
    ("javascript", "js_template_literal", '"a" + name + "b"', "`a${name}b`"),
    ("java", "java_private_field", "  int count;\n  int f() {", "  private int count;\n  int f() {"),
    ("java", "java_diamond", "List<String> a = new ArrayList<String>(", "List<String> a = new List<>("),
    ("java", "java_for_each", "for (A a : as) { System.out.println(a); } for (B b : bs) { x(); }", "as.forEach(System.out::println); for (B b : bs) { x(); }"),
    ("cpp", "cpp_nullptr", "p = NULL; NULLABLE", "p = nullptr; NULLABLE"),
    ("c", "cpp_using", "typedef unsigned long size;", "using size = unsigned long;"),
    ("cpp", "cpp_static_cast", "(int) x", "static_cast<int>(x)"),
    ("cpp", "cpp_unique_ptr", "Foo* f = new Foo(1)", "std::unique_ptr<Foo> f = std::make_unique<Foo>()"),
    ("cpp", "cpp_range_for", "for (int i = 0; i < v.size(); ++i) {", "for(const auto& item : v) {"),
    ("cpp", "cpp_const_member", "int get() { return x; } void set(int a) { x = a; } int h() {this->y;}", "int get() const { return x; } void set(int a) { x = a; } int h() {this->y;}"),
    ("", "tidy", "a  \n\n \n\nb\n\n", "a\n\nb\n"),
    ("", "tidy", "\n\n\na", "\na"),
    ("javascript", "js_doc", "  function f() {\n// c\nfunction g() {", "  /**\n   * TODO: Add function description\n   */\n  function f() {\n// c\nfunction g() {"),
]


@pytest.mark.parametrize("language,rule,before,after", GOLDEN)
def test_rule(spark, texts, language, rule, before, after):
    row = r.apply_rules(texts((language, before)), [rule]).first()
    assert row.new_content == after
    assert bool(row.hits) == (before != after) or rule == "tidy"


def test_tidy_matches_line_loop(spark, texts):
    import random

    rng = random.Random(5)
    codes = ["".join(rng.choice(["a", " ", "\n", "\n", "\t"]) for _ in range(rng.randrange(0, 40))) for _ in range(200)]

    def plain(code):
        out, blank = [], False
        for line in code.split("\n"):
            if line.strip() or not blank:
                out.append(line.rstrip())
            blank = not line.strip()
        return "\n".join(out)

    rows = r.apply_rules(texts(*codes), ["tidy"]).orderBy("file_id").collect()
    assert [x.new_content for x in rows] == [plain(c) for c in codes]


@pytest.mark.parametrize("rules", [["bool_eq_true", "bool_ne_false"], ["js_var_const"], ["cpp_nullptr", "cpp_using"], ["tidy"]])
def test_idempotent(spark, texts, rules):
    df = texts(*[(lang, before) for lang, _, before, _ in GOLDEN])
    once = r.apply_rules(df, rules).select("file_id", "language", r.F.col("new_content").alias("content"))
    assert r.apply_rules(once, rules).filter("content <> new_content").count() == 0


def test_rules_touch_their_language_only(spark, texts):
    row = r.apply_rules(texts(("go", "if x == True: var a = 1; NULL\n"))).first()
    assert row.new_content == "if x == True: var a = 1; NULL\n" and row.hits == {}


def test_docstrings(spark, texts):
    code = "def f(x):\n    return x\n\ndef _g():\n    pass\n\ndef h():\n    'doc'\n"
    row = r.python_docstrings(texts(code)).first()
    assert row.documented == ["f"] and row.new_content.startswith('def f(x):\n    """TODO: Add function description"""\n    return x')


def test_reprocess(spark):
    schema = ("file_id bigint, language string, original_content string, refactored_content string, status string, error_message string, "
              "complexity_score int, readability_score int, maintainability_score int, overall_quality_score int")
    rows = [(1, "python", "def f(x):\n    if x == True:\n        return 1\n", "", "failed", "LLM error", 0, 0, 0, 0),
            (2, "python", "def broken(:\n", "", "failed", "e", 0, 0, 0, 0), (3, "Go", "a\n\n\n\nb", "x\n", "completed", "", 7, 7, 7, 7)]
    got = {x.file_id: x for x in r.reprocess(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].status, got[1].error_message) == ("completed", "LLM error | Enhanced: Added docstring placeholder for f, Function f could benefit from type hints, Simplified boolean comparison (== True)")
    assert got[1].overall_quality_score > 0 and "if x:" in got[1].refactored_content
    assert not got[2].updated and got[2].status == "failed"
    assert not got[3].updated and got[3].refactored_content == "x\n" and got[3].overall_quality_score == 7


def test_comments_annotations_async_null_checks(spark, texts):
    files = texts(("java", "class A {\n  public int run(int a) {\n"), ("javascript", "x;\nfunction go(a) {\n"), ("cpp", "int x;\nstatic int run(int a) {"))
    s = spark.createDataFrame([(0, 1, "run", "Runs.", "a"), (1, 1, "go", "Goes.", "b"), (2, 1, "run", "C.", "c")], "file_id bigint, position int, function_name string, comment string, variable string")
    got = [x.new_content for x in r.add_comments(files, s).orderBy("file_id").collect()]
    assert got[0] == "class A {\n  /**\n\n   * Runs.\n\n   */\n\n  public int run(int a) {\n"
    assert got[1] == "x;\n/**\n * Goes.\n */\nfunction go(a) {\n"
    assert "C." in got[2] and got[2].endswith("static int run(int a) {")
    ann = r.add_annotations(files, s.withColumn("annotations", r.F.array(r.F.lit("Override")))).orderBy("file_id").collect()
    assert "@Override" in ann[0].new_content and ann[1].new_content == "x;\nfunction go(a) {\n"
    assert r.add_async(files, s).filter("file_id = 1").first().new_content == "x;\nasync function go(a) {\n"
    null = r.add_null_checks(texts(("java", "a.run(1); b.x;")), s).first().new_content
    assert null == "if (a != null) { a.run(1); }; b.x;"


def test_long_prose_does_not_overflow(spark, texts):
    """Thousands of words before a name: no deep regex recursion."""
    words = "word " * 30_000
    files = texts(("cpp", words + "run(1);"), ("java", "\n" * 30_000 + "int run("))
    s = spark.createDataFrame([(0, 1, "run", "c"), (1, 1, "run", "c")], "file_id bigint, position int, function_name string, comment string")
    assert r.add_comments(files, s).filter("length(new_content) > length(content)").count() == 2
    body = "int f() {" + "x " * 50_000 + "}"
    assert r.apply_rules(texts(("cpp", body)), ["cpp_const_member"]).first().new_content.startswith("int f() const {")


def test_renames_in_order(spark, texts):
    files = texts("a = a1 + b; a.x(b)", "plain")
    rows = [(0, 1, "rename", "a", "b", 0.9), (0, 2, "rename", "b", "c$", 0.8), (0, 3, "rename", "a", "zz", 0.9), (0, 4, "rename", "x", "y", 0.5)]
    s = spark.createDataFrame(rows, "file_id bigint, position int, kind string, old_name string, new_name string, confidence double")
    got = [x.renamed_content for x in c.apply_renames(files, s).orderBy("file_id").collect()]
    assert got == ["c$ = a1 + c$; c$.x(c$)", "plain"]


def test_renames_reduced_list_equals_full_sequence(spark, texts):
    """Dropping ineffective repeats keeps the result, also with cycles and many suggestions for one file."""
    import random

    rng = random.Random(1)
    names = ["a", "b", "c", "d", "e"]
    seqs = [[(i, rng.choice(names), rng.choice(names)) for i in range(rng.randrange(0, 30))] for _ in range(25)]
    text = "a b c d e ab"
    files = texts(*[text] * len(seqs))
    rows = [(f, p, "rename", o, n, 0.9) for f, seq in enumerate(seqs) for p, o, n in seq]
    s = spark.createDataFrame(rows, "file_id bigint, position int, kind string, old_name string, new_name string, confidence double")

    def plain(seq):
        out = text
        for _, old, new in seq:
            out = re.sub(rf"\b{old}\b", new, out)
        return out

    assert [x.renamed_content for x in c.apply_renames(files, s).orderBy("file_id").collect()] == [plain(q) for q in seqs]


def test_structure_comparison(spark):
    rows = [(1, "class A: pass\ndef f(): pass\n", "def f(): pass\ndef g(): pass\n"), (2, "x = 1", "def broken(:"), (3, "def main(): pass", "x = 1\n" + "if x: pass\n" * 7)]
    got = {x.file_id: x for x in c.compare_structure(spark.createDataFrame(rows, "file_id int, original_content string, refactored_content string")).collect()}
    assert (got[1].removed_classes, got[1].added_functions, got[1].structure_preserved) == (["A"], ["g"], False)
    assert got[2].original_valid and not got[2].refactored_valid and got[2].added_functions is None
    assert got[3].warnings == ["Refactored code is significantly more complex"] and not got[3].structure_preserved


def test_diff_is_symmetric_and_counts_multisets(spark):
    from collections import Counter

    pairs = [("a\nb\na", "a\nc"), ("", "x"), ("a\na", "a\na")]
    rows = [(i, a, b, b, a) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, d string")
    out = df.select("id", c.multiset_changes(r.F.col("a"), r.F.col("b")).alias("x"), c.multiset_changes(r.F.col("c"), r.F.col("d")).alias("y")).orderBy("id").collect()
    for (a, b), row in zip(pairs, out):
        ca, cb = Counter(a.split("\n")), Counter(b.split("\n"))
        assert row.x == row.y == sum(abs(ca[k] - cb[k]) for k in {*ca, *cb})


def test_analysis_messages(texts):
    long = "def long(a):\n" + "    x = 1\n" * 52
    code = f"def f(a) -> int:\n    \"\"\"d\"\"\"\n    for i in range(3):\n        if a == True:\n            pass\n    return a\n\n{long}"
    got = r.enhance(texts(code, "def broken(:\n"), "content").orderBy("file_id").collect()
    assert got[0].improvements == [
        "Added docstring placeholder for long", "Verified efficient range loop", "Simplified boolean comparison (== True)",
        "Long function detected: long (52 lines)", "Function long could benefit from type hints",
    ]
    assert got[1].improvements == []


def test_renames_are_looked_up_once(spark):
    """Chains, swaps, names with special characters and words that only look alike: as one replacement after another."""
    import random
    import re

    from codecorpus.operators import compare as c

    r = random.Random(4)
    names = ["a", "b", "c", "ab", "x1", "é", "total", "c$", "d.e", "a b", ""]
    rows, texts = [], []
    for k in range(60):
        texts.append("".join(r.choice(["a", "b", "c", "ab", "x1", "é", "total", " ", ".", "$", "(", "\n", "+", "🙂"]) for _ in range(60)))
        for p in range(r.randint(1, 8)):
            rows.append((k, p, "rename", r.choice(names[:7] if k % 5 else names[:10]), r.choice(names), 0.9))
    files = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    got = {x.file_id: x.renamed_content for x in c.apply_renames(files, spark.createDataFrame(rows, "file_id int, position int, kind string, old_name string, new_name string, confidence double")).collect()}
    for k, text in enumerate(texts):
        for _, _, _, old, new, _ in sorted(x for x in rows if x[0] == k and x[3] != x[4]):
            text = re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", lambda m: new, text)
        assert got[k] == text, (k, [x[3:5] for x in rows if x[0] == k])


def test_many_renames_cost_little(spark):
    import time

    from codecorpus.operators import compare as c

    def seconds(n):
        files = spark.createDataFrame([(1, "alpha beta gamma " * 4000)], "file_id int, content string")
        s = spark.createDataFrame([(1, i, "rename", f"name{i}", f"other{i}", 0.9) for i in range(n)] + [(1, n, "rename", "beta", "delta", 0.9)], "file_id int, position int, kind string, old_name string, new_name string, confidence double")
        start = time.perf_counter()
        assert c.apply_renames(files, s).first().renamed_content == "alpha delta gamma " * 4000
        return time.perf_counter() - start

    seconds(5)
    assert seconds(400) < 4 * max(seconds(20), 1.0)
