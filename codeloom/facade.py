"""One object that answers questions about a graph by name, and SQL over its views."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search, traversal
from .operators.graph import Graph, reach, reversed_edges
from .plans import rules

WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|set|reset|cache|uncache|refresh|load|add|analyze|call|use|grant|revoke|msck|repair|export|import)\b", re.I)


def read_only(sql: str) -> str:
    """The statement, if it only reads; words inside quotes don't count."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not re.match(r"\s*(select|with|from|values|\()", bare, re.I) or ";" in bare.rstrip().rstrip(";") or WRITES.search(re.sub(r"\breplace\s*\(", "(", bare, flags=re.I)):
        raise ValueError("only statements that read are allowed")
    return sql.rstrip().rstrip(";")


@dataclass
class Engine:
    graph: Graph
    spark: SparkSession

    def _function(self, name: str) -> DataFrame:
        return search.named(self.graph.functions, name)

    def analyse(self, kind: str, target: str) -> DataFrame:
        """Answers one of the kinds of questions on a name."""
        g = self.graph
        kinds: dict[str, Callable[[], DataFrame]] = {
            "callers": lambda: search.callers_of(g, self._function(target)),
            "callees": lambda: g.functions.join(g.calls.join(self._function(target).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")), "id", "left_semi"),
            "all_callers": lambda: g.functions.join(reach(self._function(target), reversed_edges(g.calls)), "id", "left_semi"),
            "all_callees": lambda: g.functions.join(reach(self._function(target), g.calls), "id", "left_semi"),
            "importers": lambda: g.imports.filter(F.col("imported_name") == target),
            "hierarchy": lambda: search.hierarchy(g, int(target)),
            "overrides": lambda: self._function(target).join(g.methods.withColumnRenamed("function_id", "id"), "id"),
            "dead_code": lambda: search.dead(g, tuple(filter(None, target.split(",")))),
            "variable": lambda: search.named(g.variables, target),
            "dependencies": lambda: search.co_imported(g, int(target)),
            "fuzzy": lambda: search.fuzzy(g.functions, target),
            "search": lambda: search.ranked(g, target),
            "impact": lambda: traversal.impact(g, self._function(target)),
            "complexity": lambda: self._function(target).select("id", "name", "complexity"),
            "decorator": lambda: g.functions.filter(F.array_contains("decorators", target)),
            "argument": lambda: g.functions.join(g.parameters.filter(F.col("arg") == target).select(F.col("function_id").alias("id")), "id", "left_semi"),
        }
        if kind not in kinds:
            raise ValueError(f"unknown kind {kind}; one of {', '.join(sorted(kinds))}")
        return kinds[kind]()

    def sql(self, statement: str) -> DataFrame:
        """A reading statement over the views functions, classes, calls and so on."""
        for f in fields(self.graph):
            getattr(self.graph, f.name).createOrReplaceTempView(f.name)
        return self.spark.sql(read_only(statement))

    def audit(self, *scope: str, settings: rules.Settings = rules.Settings()) -> DataFrame:
        """Counts of every rule, within some files or folders if given."""
        return rules.audit(self.graph, settings, scope)
