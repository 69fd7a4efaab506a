from pyspark.sql import functions as F

from codecorpus.functions import responses as x
from codecorpus.operators import pairs as p
from codecorpus.operators.pyfacts import python_validity


def cleaned(spark, *rows):
    df = spark.createDataFrame([(i, lang, c) for i, (lang, c) in enumerate(rows)], "id int, language string, content string")
    return [r.code for r in x.clean_response(df).orderBy("id").collect()]


def test_clean_response(spark):
    got = cleaned(
        spark,
        ("Python", "Here:\n```python\ndef f():\n    pass\n```\nDone"),
        ("Python", "[INST] do\nit [/INST]def f():\n    return 1\nSome prose.\nx = 2"),
        ("JavaScript", "```\nno code here\n```\nconst a = 1;\nprose only\n    indented"),
        ("Java", "text\npublic class A {\n    int b;\n}\n\"quoted = x"),
        ("Python", '"\n```\nsorry -->\nnothing'),
        ("Go", "  <<SYS>>s\ny<</SYS>>func main() {}  "),
    )
    assert got == [
        "def f():\n    pass", "def f():\n    return 1\nx = 2", "const a = 1;\n    indented", "public class A {\n    int b;", "", "func main() {}",
    ]


def test_trim_and_fix_responses(spark):
    df = spark.createDataFrame([(1, "a = 1\n# note\nNote: done\nThis is it\n"), (2, "# only\n"), (3, "x\n\n")], "id int, content string")
    assert [r.t for r in df.orderBy("id").select(x.trim_trailing_prose(F.col("content")).alias("t")).collect()] == ["a = 1", "# only", "x"]
    fixes = spark.createDataFrame(
        [(1, "Here is it\n```python\ndef f():\n    # Fixed because x\n    return 1\n```"), (2, "The fix:\nreturn 5\nprose"), (3, "  nothing  ")], "id int, content string")
    assert [r.code for r in x.clean_fix_response(fixes).orderBy("id").collect()] == ["def f():\n    return 1", "return 5", "nothing"]


def test_parse_suggestions(spark):
    df = spark.createDataFrame(
        [(1, 'x {"renames": [{"old_name": "a", "new_name": "b"}, {"old_name": "q"}]} y'), (2, "{broken"), (3, '{"renames": oops}'), (4, "none")], "id int, content string")
    got = {r.id: r.suggestions for r in x.parse_suggestions(df).collect()}
    assert [tuple(n) for n in got[1].renames] == [("a", "b", "Improved naming", 0.7)]
    assert all(got[i].renames == [] and got[i].transformations == [] for i in (2, 3, 4))


def test_pairs_are_valid_and_flat(spark):
    pairs = p.synth_pairs(spark.range(400), seed=3).cache()
    both = pairs.select(F.col("id").alias("file_id"), "language", F.explode(F.array("original_code", "refactored_code")).alias("content"))
    assert python_validity(both).filter("not valid").count() == 0
    assert pairs.filter("language <> 'python'").filter(
        "length(replace(original_code, '{', '')) <> length(replace(original_code, '}', '')) or length(replace(refactored_code, '{', '')) <> length(replace(refactored_code, '}', ''))"
    ).count() == 0
    assert {r.language: r["count"] for r in pairs.groupBy("language").count().collect()} == {k: 100 for k in ("python", "java", "javascript", "csharp")}
    assert pairs.filter("depth not between 3 and 8").count() == 0
    assert pairs.select("original_code", "refactored_code").filter("original_code like '%{_}%' or refactored_code like '%{_}%'").count() == 0


def test_pair_text(spark):
    pairs = p.synth_pairs(spark.range(4000), seed=3)
    row = pairs.filter("language = 'python' and depth = 3 and name = 'age' and pattern = 'method_extraction'").first()
    assert row.original_code == (
        "def process_age(age):\n    if age is not None:\n        if age > 10:\n            if age < 90:\n                return 'success'\n"
        "            else:\n                return 'failed_at_level_2'\n        else:\n            return 'failed_at_level_1'\n"
        "    else:\n        return 'failed_at_level_0'")
    assert row.refactored_code == (
        "def validate_level_0(age):\n    return age is not None\n\ndef validate_level_1(age):\n    return age > 10\n\ndef validate_level_2(age):\n    return age < 90\n\n"
        "def process_age(age):\n" + "".join(f"    if not validate_level_{i}(age):\n        return 'failed_at_level_{i}'\n" for i in range(3)) + "    return 'success'")
    assert (row.metrics_before.complexity, row.metrics_after.lines, row.complexity_reduction, row.depth_reduction) == (30, 14, 6, 2)


def test_split_is_disjoint_complete_and_stable(spark):
    ids = spark.range(5000)
    one = p.split_pairs(ids)
    two = p.split_pairs(ids.repartition(13))
    assert one.join(two, ["id", "split"]).count() == 5000
    share = one.filter("split = 'eval'").count() / 5000
    assert 0.17 < share < 0.23


def test_correction_rounds(spark):
    responses = spark.createDataFrame(
        [(1, 0, "Python", "def f(:\n    return 1"), (2, 0, "Python", "def f():\n    return 1"), (3, 3, "Python", "def f(:\n    return 1"), (4, 0, "Java", "class {")],
        "file_id int, round int, language string, content string")
    originals = spark.createDataFrame([(i, "orig") for i in range(1, 5)], "file_id int, original_content string")
    rows = p.correction_requests(responses, originals).collect()
    assert [(r.file_id, r.round) for r in rows] == [(1, 1)] and "ERROR MESSAGE:\nSyntax error at line 1" in rows[0].user_prompt
