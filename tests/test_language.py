import pytest
from pyspark.sql import functions as F

from codecorpus.functions import dims, language as lang
from codecorpus.functions.patterns import file_extension, literal_of, rx, stable_bucket

CASES = [
    ("test.py", 'def hello():\n    print("Hi")', "Python"),
    ("test.js", 'function hello() {\n  console.log("Hi");\n}', "JavaScript"),
    ("test.jsx", 'import React from "react";\nfunction App() { return <div>Hi</div>; }', "JSX"),
    ("Test.JAVA", "public class Test { }", "Java"),
    ("test.cpp", "#include <iostream>\nint main() { }", "C++"),
    ("test.c", "#include <stdio.h>", "C"),
    ("test.ts", "interface User {\n  name: string;\n}", "TypeScript"),
    ("test.html", "<!DOCTYPE html>", "HTML"),
    ("lib.h", "class A {\n};\nstd::vector x;\nusing namespace std;\nint main() {}", "C++"),
    ("lib.h", "int x;", "C/C++"),
    ("a.m", "def f():\n    pass\nimport os\n", "Python"),
    ("noext", "package main\nfunc add() {\nfmt.Println()", "Go"),
    ("Makefile.in", "", "Makefile"),
    ("x/Dockerfile", "", "Dockerfile"),
    ("home/.bashrc", "", "Configuration"),
    ("data.bin9", "", "Unknown"),
]


def test_detect_language(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(CASES)], "id int, path string, content string")
    got = {r.id: r.language for r in lang.detect_language(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_content_ties_go_to_the_first_language(spark):
    # One hit each for JavaScript and Rust: the earlier declared language wins; no hit at all gives NULL.
    df = spark.createDataFrame([("let a = 1",), ("plain",)], "content string")
    assert [r.language for r in lang.language_by_content(df).collect()] == ["JavaScript", None]


def test_content_guard_agrees_with_plain_patterns(spark):
    import re

    for patterns in dims.CONTENT_PATTERNS.values():
        for p in patterns:
            word = literal_of(p)
            assert word == word.lower()
            sample = re.sub(r"\\s[+*]?|\(\?<!\\w\)", " ", p)
            assert word == "" or word in sample.lower().replace("\\", "")


def test_file_extension(spark):
    paths = {"a/b.tar.gz": ".gz", "a/.bashrc": "", "a.b/c": "", "x.PY": ".py", ".a.b": ".b", "x.h++": ".h++", "no": ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.e for r in df.select("p", file_extension(F.col("p")).alias("e")).collect()} == paths


def test_binary(spark):
    rows = [("a.png", b"text"), ("a.txt", b"abc\x00"), ("a.txt", bytes(range(128, 200))), ("a.txt", b"plain text\n"), ("a.txt", b""), ("a", b"x\x10\x0f0")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert [r.is_binary for r in lang.is_binary(df).collect()] == [True, True, True, False, False, True]


def test_names(spark):
    rows = [("my_name", "python"), ("MyName", "python"), ("myName", "java"), ("My", "java"), ("my_n", "javascript"), ("a-b", "cpp"), ("1!", "cpp"), ("", "cpp")]
    df = spark.createDataFrame(rows, "n string, l string")
    assert [r.v for r in df.select(lang.valid_name(F.col("n"), F.col("l")).alias("v")).collect()] == [True, False, True, False, False, True, False, False]
    styles = spark.createDataFrame([("get_x",), ("getX",), ("Get",), ("get",), ("Get_X",)], "n string")
    assert [r.s for r in styles.select(lang.naming_style(F.col("n")).alias("s")).collect()] == ["snake", "camel", "other", "other", "other"]


def test_unicode_words(spark):
    df = spark.createDataFrame([("éif if ifé x\u00a0if",)], "t string")
    assert df.select(F.regexp_count("t", F.lit(rx(r"\bif\b"))).alias("n")).first().n == 2


@pytest.mark.parametrize("buckets", [7, 10_000])
def test_stable_bucket_is_uniform_and_engine_independent(spark, buckets):
    import hashlib

    rows = spark.range(500).select("id", stable_bucket(F.col("id"), buckets, "s").alias("b")).collect()
    assert all(r.b == int(hashlib.md5(f"s:{r.id}".encode()).hexdigest()[:12], 16) % buckets for r in rows)
