"""From parsed elements to node and edge tables: containment, upserts, parameters, modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.graph import Graph
from ..registry import on_graph, on_tables


def directory_chain(files: DataFrame) -> DataFrame:
    """(parent, child, kind): each directory in the one above it, each file in the last, every pair once."""
    rows = files.select("path", fn.ancestors(F.col("path")).alias("above")).distinct()
    into = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("above")), lambda k: F.struct(F.get("above", k - 2).alias("parent"), F.get("above", k - 1).alias("child")))).alias("e"))
    directories = into.select("e.parent", "e.child", F.lit("directory").alias("kind")).filter("parent is not null")
    return directories.union(rows.select(F.element_at("above", -1), "path", F.lit("file"))).distinct()


@on_graph("""+p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM functions)
SELECT '/src' AS parent, '/src/' || parts[3] AS child, 'directory' AS kind FROM p GROUP BY parts[3] UNION SELECT '/src/' || parts[3], path, 'file' FROM p""")
def directories(g: Graph) -> DataFrame:
    return directory_chain(g.functions)


def uid(name: str = "name", path: str = "path", line: str = "line_number") -> F.Column:
    """An element's id: name, path and line without a mark between them."""
    return F.concat(name, path, F.col(line).cast("string"))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last in order."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


@on_tables("SELECT l_orderkey, l_linenumber, arg_max(l_partkey, l_extendedprice * 1000000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey"]).drop("l_extendedprice")


@on_graph("SELECT name, path, min(id) AS id FROM functions GROUP BY name, path")
def first_definition(g: Graph) -> DataFrame:
    return first_wins(g.functions.select("name", "path", "id"), ["name", "path"], ["id"])


def parameters_of(elements: DataFrame) -> DataFrame:
    """(path, name, line_number, arg): arguments of functions, each name once."""
    return elements.filter("kind = 'function'").select("path", "name", "line_number", F.explode("args").alias("arg")).distinct()


def contained(elements: DataFrame) -> DataFrame:
    """(path, outer, name, line_number): methods in classes and functions in functions, by name within a file; doubles of a name all count."""
    inner = elements.filter("kind = 'function'").select("path", "name", "line_number", F.coalesce("context", "class_context").alias("outer")).filter("outer is not null")
    outer = elements.filter("kind in ('class', 'function')").select("path", F.col("name").alias("outer"), F.col("line_number").alias("outer_line"))
    return inner.join(outer, ["path", "outer"]).filter("outer_line < line_number").select("path", "outer", "name", "line_number")


def import_edges(elements: DataFrame) -> DataFrame:
    """(path, module, alias, line_number): one edge of a file and module, properties of the last."""
    rows = elements.filter("kind = 'import'").select("path", F.col("full_name").alias("module"), "alias", "line_number")
    return last_wins(rows, ["path", "module"], ["line_number"])


def call_edges(resolved: DataFrame, elements: DataFrame) -> DataFrame:
    """(path, context, target, name, line_number, defined_at): resolved calls joined to every definition of that name in the target file."""
    defined = elements.filter("kind in ('function', 'class')").select(F.col("path").alias("target"), "name", F.col("line_number").alias("defined_at"))
    return resolved.join(defined, ["target", "name"]).select("path", "context", "target", "name", "line_number", "defined_at").distinct()
