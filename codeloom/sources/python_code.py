"""Python sources: parsed on the executors into rows of elements.

A file is parsed some statements at a time, cut where a line begins a statement of the
module, so that only the tree of PIECE characters (or of one longer statement) is held
beside its text; rows wait as Arrow columns until the file is known to have no error.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import on_tables

ELEMENTS = "path string, kind string, name string, line_number long, end_line long, complexity long, context string, class_context string, decorators array<string>, args array<string>, bases array<string>, full_name string, alias string, value string, docstring string"
COLUMNS = [x.split()[0] for x in ELEMENTS.split(", ")]
ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for x in ELEMENTS.split(", ")])
#: Characters that are parsed at a time, and where a statement may begin: no mark of a clause of the one before.
PIECE, BEGINS = 100_000, re.compile(r"\n(?=[^\W\d]|@)(?!(?:else|elif|except|finally)\b)")

DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.ListComp, ast.GeneratorExp, ast.match_case)


def complexity(node: ast.AST) -> int:
    """1 and the decisions within: branches but not their `elif`, loops, handlers, contexts, cases, list comprehensions and generators (each once, whatever loops it has); a chain of n conditions counts n - 1."""
    further = {id(x.orelse[0]) for x in ast.walk(node) if isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and x.orelse[0].col_offset == x.col_offset}
    return 1 + sum(len(x.values) - 1 if isinstance(x, ast.BoolOp) else isinstance(x, DECISIONS) and id(x) not in further for x in ast.walk(node))


def notebook_source(text: str) -> str:
    """The code cells of a notebook, without their magic lines."""
    cells = (c for c in json.loads(text).get("cells", []) if c.get("cell_type") == "code")
    lines = ("".join(c["source"]) if isinstance(c["source"], list) else c["source"] for c in cells)
    return "\n".join(x for block in lines for x in block.split("\n") if not x.lstrip().startswith(("%", "!")))


class Visitor(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path, self.rows = path, []
        self.scope: list[tuple[str, str]] = []  # (kind, name)

    def add(self, kind: str, name: str, node: ast.AST, **more) -> None:
        row = dict.fromkeys(COLUMNS) | {"path": self.path, "kind": kind, "name": name, "line_number": node.lineno, "end_line": getattr(node, "end_lineno", None)}
        row["context"] = self.scope[-1][1] if self.scope else None
        row["class_context"] = next((n for k, n in reversed(self.scope) if k == "class"), None)
        self.rows.append(row | more)

    def function(self, node) -> None:
        a = node.args
        args = [x.arg for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x]
        self.add("function", node.name, node, complexity=complexity(node), decorators=["@" + ast.unparse(d) for d in node.decorator_list], args=args, docstring=ast.get_docstring(node))
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(("function", node.name))
        for child in (*a.defaults, *filter(None, a.kw_defaults), *node.body):
            self.visit(child)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node, decorators=["@" + ast.unparse(d) for d in node.decorator_list], bases=[ast.unparse(b) for b in node.bases], docstring=ast.get_docstring(node))
        for child in (*node.decorator_list, *node.bases):
            self.visit(child)
        self.scope.append(("class", node.name))
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", x.name, node, full_name=x.name, alias=x.asname)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for x in node.names:
            self.add("import", x.name, node, full_name=f"{base}.{x.name}" if base.strip(".") else base + x.name, alias=x.asname)

    def visit_Call(self, node: ast.Call) -> None:
        full = ast.unparse(node.func)
        name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else None
        if name:
            self.add("call", name, node, full_name=full, args=[ast.unparse(x) for x in node.args] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords])
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            for x in target.elts if isinstance(target, ast.Tuple | ast.List) else [target]:
                if isinstance(x, ast.Name) and isinstance(node.value, ast.Lambda):
                    self.add("function", x.id, node, complexity=complexity(node.value), args=[y.arg for y in node.value.args.args])
                elif isinstance(x, ast.Name | ast.Attribute):
                    self.add("variable", x.id if isinstance(x, ast.Name) else x.attr, node, value=ast.unparse(node.value)[:4096])
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.add("variable", node.target.id, node, value=ast.unparse(node.value)[:4096] if node.value else None)
        self.generic_visit(node)


def lines_of(text: str) -> int:
    return text.count("\n") + text.count("\r") - text.count("\r\n")


def statements(text: str, size: int) -> Iterator[tuple[ast.Module, int]]:
    """The trees of a source's statements, about `size` characters at a time, each with the number of lines before it.

    What is cut off is a whole number of statements if it parses by itself: inside a
    string, brackets or a continued line it does not, and more is taken, twice as much
    each time. An error is that of all that is left.
    """
    at, line = 0, 0
    while True:
        step = size
        while True:
            cut = BEGINS.search(text, at + step) if at + step < len(text) else None
            stop = cut.end() if cut else len(text)
            part = text[at:stop]
            try:
                tree = ast.parse(part)
                break
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                if not cut:
                    if getattr(e, "lineno", None) is not None:
                        e.lineno += line
                    raise
                step *= 2
        yield tree, line
        if not cut:
            return
        at, line = stop, line + lines_of(part)


def elements_of(path: str, text: str | None, size: int = PIECE) -> Iterator[list[dict]]:
    """Rows of the elements of one file, some statements at a time."""
    for tree, line in statements(notebook_source(text) if path.endswith(".ipynb") else text or "", size):
        visitor = Visitor(path)
        visitor.visit(tree)
        for row in visitor.rows if line else ():
            row["line_number"] += line
            row["end_line"] = row["end_line"] and row["end_line"] + line
        yield visitor.rows


FAILS = (SyntaxError, ValueError, RecursionError)


def failed(path: str, e: Exception) -> list[dict]:
    return [dict.fromkeys(COLUMNS) | {"path": path, "kind": "error", "name": type(e).__name__, "line_number": getattr(e, "lineno", None)}]


def parse_text(path: str, text: str | None, size: int = PIECE) -> list[dict]:
    """Elements of one file; a row of kind `error` if it can't be read."""
    try:
        return [row for rows in elements_of(path, text, size) for row in rows]
    except FAILS as e:
        return failed(path, e)


def parse(files: DataFrame) -> DataFrame:
    """Rows of elements of files (path, text)."""

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                path = path.as_py()
                try:
                    yield from [batch_of(rows) for rows in elements_of(path, text.as_py()) if rows]
                except FAILS as e:
                    yield batch_of(failed(path, e))

    return files.select("path", "text").mapInArrow(run, ELEMENTS)


def symbol_index(elements: DataFrame) -> DataFrame:
    """(symbol, paths): where functions and classes are defined, first path first."""
    defined = elements.filter("kind in ('function', 'class')").select(F.col("name").alias("symbol"), "path").distinct()
    return defined.groupBy("symbol").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a Python file for each customer nation, with a function for each customer that calls that of the customer before it."""
    line = F.concat(F.lit("def f"), F.col("c_custkey").cast("string"), F.lit("(a, b):\n    if a and b:\n        return f"), F.expr("cast(greatest(c_custkey - 1, 0) as string)"), F.lit("(a)\n"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", F.struct("c_custkey", line.alias("line")).alias("x"))
    return rows.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.concat(F.lit("/src/n"), F.col("c_nationkey").cast("string"), F.lit(".py")).alias("path"), F.array_join(F.transform("x", lambda x: x["line"]), "").alias("text"))


@on_tables("""SELECT '/src/n' || c_nationkey || '.py' AS path, 'function' AS kind, 'f' || c_custkey AS name, CAST((row_number() OVER w - 1) * 3 + 1 AS BIGINT) AS line_number, CAST(3 AS BIGINT) AS complexity FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)
UNION ALL SELECT '/src/n' || c_nationkey || '.py', 'call', 'f' || greatest(c_custkey - 1, 0), CAST((row_number() OVER w - 1) * 3 + 3 AS BIGINT), NULL FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def python_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(sources_of(spark, sf_dir)).select("path", "kind", "name", "line_number", "complexity")
