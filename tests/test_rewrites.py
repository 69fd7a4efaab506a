"""Constants and notes written into Python files, against plain restatements."""

import random
import re

from codecorpus.operators import metrics

LITERAL = re.compile(r"\b(?<![a-zA-Z_])(?:[2-9]|[1-9]\d+)(?:\.\d+)?(?![a-zA-Z_])\b")


def magic(x):
    return x not in ("2", "3", "4", "5", "10", "100") and int(float(x)) > 5


def constants(code):
    defined, out = [], []
    for line in code.split("\n"):
        if not line.strip().startswith("#") and '"""' not in line and "'''" not in line and "import " not in line and re.search(r"[=+\-*/%<>]", line):
            defined += [m for m in LITERAL.findall(line) if magic(m) and m not in defined]
            line = LITERAL.sub(lambda m: "CONSTANT_" + m[0].replace(".", "_") if magic(m[0]) else m[0], line)
        out.append(line)
    at = next((i for i, s in enumerate(out) if not (s.startswith(("import ", "from ")) or not s.strip())), len(out))
    if not defined or at == len(out):
        return "\n".join(out), len(defined)
    return "\n".join([*out[:at], "", *(f"CONSTANT_{m.replace('.', '_')} = {m}" for m in defined), "", *out[at:]]), len(defined)


def notes(code, limit=20):
    out, inside, n, indent = [], False, 0, 0
    for line in code.split("\n"):
        if line.strip().startswith("def "):
            inside, n, indent = True, 0, len(line) - len(line.lstrip())
        elif inside:
            n += 1
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                inside = False
                if n > limit:
                    out.insert(len(out) - n, " " * (indent + 4) + "# TODO: Consider breaking this function into smaller functions")
        out.append(line)
    return "\n".join(out)


def files(seed):
    r = random.Random(seed)
    pieces = ["import os", "from a import b", "", "x = 12", "y = 12.5 + x1", "z = v_7 * 7 - 10", "# 99 = no", "a = '''", "if q > 3600 and p != 100:", "    return 5", "k = 6", "print(77)", "w = 1000 / 8.25", "t = 10.5 - 100.25"]
    out = ["", "import os\n", "a = 9"]
    for _ in range(60):
        lines = [r.choice(pieces) for _ in range(r.randint(1, 12))]
        for _ in range(r.randint(0, 3)):
            pad = " " * r.choice([0, 0, 4])
            lines += [f"{pad}def f{r.randint(0, 9)}(a):"] + [pad + "    " * r.choice([0, 1, 1, 1, 2]) * (r.random() < 0.99) + r.choice(["b = 8", "", "pass"]) if r.random() < 0.05 else pad + "    c = a" for _ in range(r.choice([3, 19, 20, 21, 40]))]
        out.append("\n".join(lines))
    return out


def test_constants(spark):
    texts = files(3)
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    got = {r.file_id: (r.new_content, r.constants) for r in metrics.extract_constants(df).collect()}
    assert got == {i: constants(t) for i, t in enumerate(texts)}
    assert metrics.extract_constants(df).columns == ["file_id", "content", "new_content", "constants"]


def test_notes(spark):
    texts = files(4)
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    got = {r.file_id: r.new_content for r in metrics.note_long_functions(df).collect()}
    assert got == {i: notes(t) for i, t in enumerate(texts)}
    assert sum("TODO" in t for t in got.values()) > 2
