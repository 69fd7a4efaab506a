"""Python node facts: the one job that needs a parser and therefore a Python worker.

The helper only walks one file's tree and emits flat rows; every measure on top of them is a column expression.
"""

from __future__ import annotations

import ast

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.functions.patterns import is_blank

FACT_FIELDS = [
    ("pre", "int"), ("post", "int"), ("parent", "int"), ("kind", "string"), ("name", "string"), ("line", "int"),
    ("end_line", "int"), ("col", "int"), ("end_col", "int"), ("n_values", "int"), ("n_args", "int"), ("args", "array<string>"),
    ("returns", "string"), ("has_doc", "boolean"), ("doc", "string"), ("if_depth", "int"), ("if_height", "int"),
    ("block_depth", "int"), ("owner", "string"), ("message", "string"),
]
FACT_TYPE = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FACT_FIELDS) + ">>"
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
FACT_ARROW = pa.list_(pa.struct([(n, _ARROW[t]) for n, t in FACT_FIELDS]))

_BLOCKS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_KEPT = _BLOCKS + (
    ast.ExceptHandler, ast.BoolOp, ast.With, ast.AsyncWith, ast.Try, ast.Raise, ast.ListComp, ast.SetComp, ast.DictComp,
    ast.GeneratorExp, ast.Import, ast.ImportFrom,
)


def _describe(node: ast.AST) -> dict:
    row = {"kind": type(node).__name__, "line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None),
           "col": getattr(node, "col_offset", None), "end_col": getattr(node, "end_col_offset", None)}
    if isinstance(node, ast.BoolOp):
        row["n_values"] = len(node.values)
    elif isinstance(node, ast.Import):
        row["args"] = [a.name for a in node.names]
    elif isinstance(node, ast.ImportFrom):
        row["args"] = [f"{node.module or ''}.{a.name}" for a in node.names]
    elif isinstance(node, ast.If):
        test = node.test
        if isinstance(test, ast.Compare):
            equal_to = test.comparators[0].value if len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq) and isinstance(test.comparators[0], ast.Constant) else None
            if isinstance(test.left, ast.Name) and test.left.id == "__name__":
                row["name"] = "__name__"
            elif equal_to is True or equal_to is False:
                row["name"] = f"== {equal_to}"
    elif isinstance(node, ast.For) and isinstance(node.iter, ast.Call) and isinstance(node.iter.func, ast.Name) and node.iter.func.id == "range":
        row["name"] = "range"
    elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
        row |= {"name": node.name, "doc": ast.get_docstring(node)}
        first = node.body[0]
        row["has_doc"] = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        if isinstance(node, _FUNCTIONS):
            row |= {"args": [a.arg for a in node.args.args], "n_args": len(node.args.args),
                    "returns": ast.unparse(node.returns) if node.returns else None}
    elif isinstance(node, ast.Expr):
        row |= {"kind": "Text", "doc": node.value.value}
    return row


def file_facts(code: str) -> list[dict]:
    """Flat facts of one file in pre-order; a single ``error`` row when it does not parse. Iterative, so depth is no limit."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [{"kind": "error", "line": e.lineno, "message": f"Syntax error at line {e.lineno}: {e.msg}"}]
    except Exception as e:  # NUL bytes, parser recursion or memory limits
        return [{"kind": "error", "message": f"AST parsing error: {e}"}]
    rows: list[dict] = []
    stack = [(tree, -1, 0, 0, None, None)]  # node, kept parent, enclosing ifs, enclosing blocks, enclosing class, exit row
    while stack:
        node, parent, ifs, blocks, owner, done = stack.pop()
        if done is not None:
            done["post"] = len(rows) - 1
            if done["parent"] >= 0:
                up = rows[done["parent"]]
                up["if_height"] = max(up["if_height"], done["if_height"] + (up["kind"] == "If"))
            continue
        text = isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
        if isinstance(node, _KEPT) or text:
            is_if, is_block = isinstance(node, ast.If), isinstance(node, _BLOCKS)
            row = _describe(node) | {"pre": len(rows), "parent": parent, "if_depth": ifs + is_if, "if_height": int(is_if),
                                     "block_depth": blocks + is_block, "owner": owner}
            rows.append(row)
            stack.append((node, parent, ifs, blocks, owner, row))
            parent, ifs, blocks = row["pre"], ifs + is_if, blocks + is_block
            owner = node.name if isinstance(node, ast.ClassDef) else owner
        for child in reversed(list(ast.iter_child_nodes(node))):
            stack.append((child, parent, ifs, blocks, owner, None))
    return rows


def _facts_batch(codes: pa.Array) -> pa.Array:
    return pa.array([None if c is None else file_facts(c) for c in codes.to_pylist()], type=FACT_ARROW)


def facts_column(code: Column) -> Column:
    """Array of node facts of a Python text (NULL in, NULL out); Arrow batches, no shuffle."""
    return F.arrow_udf(_facts_batch, FACT_TYPE)(code)


def with_facts(df: DataFrame, content: str, language: str = "language", out: str = "facts") -> DataFrame:
    """Append the facts of Python rows (NULL for others) in a batch operator.

    Unlike :func:`facts_column` this is a barrier for the optimizer: use it on a text that itself depends on facts, so that the
    long expression behind it is evaluated once and never copied into the arguments of a second Python call.
    """
    names = df.columns
    at, lang = names.index(content), names.index(language)

    def run(batches):
        for batch in batches:
            languages = pc.utf8_lower(batch.column(lang))
            codes = pc.if_else(pc.equal(languages, "python"), batch.column(at), pa.scalar(None, batch.column(at).type))
            yield pa.RecordBatch.from_arrays([*batch.columns, _facts_batch(codes)], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, _fact_type())]))


def _fact_type() -> T.ArrayType:
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
    return T.ArrayType(T.StructType([T.StructField(n, kinds[t]) for n, t in FACT_FIELDS]))


def python_facts(files: DataFrame, content: str = "content", language: str = "language", key: str = "file_id") -> DataFrame:
    """One row per kept node of every Python file, or one ``error`` row."""
    picked = files.filter(F.lower(F.col(language)) == "python")
    return picked.select(key, F.inline(facts_column(F.col(content))))


def _names(facts: Column, *kinds: str) -> Column:
    return F.filter(facts, lambda n: n["kind"].isin(*kinds))


def complexity_of(facts: Column) -> Column:
    """Structural complexity: control flow, nested definitions, handlers, raises and comprehensions count one each."""
    kinds = ["If", "While", "For", "Try", "With", "FunctionDef", "ClassDef", "AsyncFunctionDef", "ExceptHandler", "Raise",
             "ListComp", "DictComp", "SetComp", "GeneratorExp"]
    return F.size(_names(facts, *kinds))


def structure_struct(facts: Column) -> Column:
    classes, functions = _names(facts, "ClassDef"), _names(facts, "FunctionDef")
    return F.struct(
        F.transform(
            classes,
            lambda c: F.struct(
                c["name"].alias("name"), c["line"].alias("line"),
                F.transform(F.filter(functions, lambda f: f["parent"] == c["pre"]), lambda f: f["name"]).alias("methods"),
            ),
        ).alias("classes"),
        F.transform(functions, lambda f: F.struct(f["name"].alias("name"), f["line"].alias("line"), f["n_args"].alias("args"))).alias("functions"),
        F.flatten(F.transform(_names(facts, "Import", "ImportFrom"), lambda n: n["args"])).alias("imports"),
        # Most nodes have no name; a comparison with none must not make the answer unknown.
        F.exists(facts, lambda n: ((n["kind"] == "FunctionDef") & n["name"].eqNullSafe("main")) | ((n["kind"] == "If") & n["name"].eqNullSafe("__name__"))).alias("has_main"),
        F.transform(_names(facts, "Text"), lambda n: F.substring(n["doc"], 1, 100)).alias("docstrings"),
        complexity_of(facts).alias("complexity_score"),
        F.get(F.transform(_names(facts, "error"), lambda n: n["message"]), F.lit(0)).alias("error"),
    )


def structure_info(files: DataFrame, content: str = "content", language: str = "language", key: str = "file_id") -> DataFrame:
    """Classes with methods, functions with argument counts, imports, main flag, docstring heads and complexity per file."""
    picked = files.filter(F.lower(F.col(language)) == "python")
    return picked.select(key, facts_column(F.col(content)).alias("__f")).select(key, structure_struct(F.col("__f")).alias("__s")).select(key, "__s.*")


def error_message(facts: Column) -> Column:
    return F.get(F.transform(_names(facts, "error"), lambda n: n["message"]), F.lit(0))


def python_validity(
    files: DataFrame, content: str = "content", language: str = "language", key: str = "file_id", blank_is_valid: bool = True
) -> DataFrame:
    """(file, valid, message); blank text counts as valid or, for the adapter variant, as invalid."""
    picked = files.filter(F.lower(F.col(language)) == "python")
    blank = is_blank(F.col(content))
    message = error_message(F.col("__f"))
    if not blank_is_valid:
        message = F.when(F.col("__b"), "Code is empty or contains only whitespace").otherwise(message)
    else:
        message = F.when(~F.col("__b"), message)
    return (
        picked.select(key, facts_column(F.col(content)).alias("__f"), blank.alias("__b"))
        .select(key, message.alias("message"))
        .withColumn("valid", F.col("message").isNull())
    )
