"""Compiler-made symbol indexes (SCIP): decoding, names and kinds of symbols, and call edges by an as-of join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..registry import on_graph

#: Numbers of fields of the messages that are read, and the bit of a role that marks definitions. Fixed values.
DOCUMENT, PATH, OCCURRENCE, SYMBOL_INFO, LANGUAGE = 2, 1, 2, 3, 4
RANGE, SYMBOL, ROLES, DEFINITION = 1, 2, 3, 1
INFO_SYMBOL, DOCUMENTATION, KIND, DISPLAY_NAME = 1, 3, 5, 6
#: Kinds of symbols. Fixed values.
METHOD, FUNCTION, CLASS, VARIABLE, FIELD = 26, 17, 7, 61, 15

OCCURRENCES = "path string, language string, symbol string, line long, definition boolean, kind int, display_name string, documentation string"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; the value of a nested one is its bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def line_of(packed: bytes) -> int:
    """The first number of a range is its line, from 0; lines count from 1."""
    return varint(packed, 0)[0] + 1 if packed else 1


def document(data: bytes) -> list[tuple]:
    path = language = ""
    told: dict[str, tuple[int, str, str]] = {}
    seen = []
    for number, value in fields(data):
        if number == PATH:
            path = value.decode()
        elif number == LANGUAGE:
            language = value.decode()
        elif number == SYMBOL_INFO:
            symbol, kind, name, text = "", 0, "", []
            for n, v in fields(value):
                if n == INFO_SYMBOL:
                    symbol = v.decode()
                elif n == KIND:
                    kind = v
                elif n == DISPLAY_NAME:
                    name = v.decode()
                elif n == DOCUMENTATION:
                    text.append(v.decode())
            told[symbol] = (kind, name, "\n".join(text))
        elif number == OCCURRENCE:
            line, symbol, roles = 1, "", 0
            for n, v in fields(value):
                if n == RANGE:
                    line = line_of(v) if isinstance(v, bytes) else v + 1
                elif n == SYMBOL:
                    symbol = v.decode()
                elif n == ROLES:
                    roles = v
            seen.append((symbol, line, bool(roles & DEFINITION)))
    return [(path, language, symbol, line, definition, *told.get(symbol, (0, "", ""))) for symbol, line, definition in seen if symbol and not symbol.startswith("local ")]


def occurrences(files: DataFrame) -> DataFrame:
    """A row for each occurrence of a global symbol in index files (content), each decoded in the task that reads it."""
    names = [x.split()[0] for x in OCCURRENCES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for number, value in fields(bytes(content)):
                    if number == DOCUMENT and (rows := document(value)):
                        yield pd.DataFrame(rows, columns=names)

    return files.select("content").mapInPandas(run, OCCURRENCES)


def name_of(symbol: Column) -> Column:
    """What a person calls a symbol: its last part, without marks of its kind."""
    bare = F.regexp_replace(F.regexp_replace(symbol, r"[.#]+$", ""), r"\(\)\.?$", "")
    last = F.element_at(F.split(bare, "[/#]"), -1)
    return F.when(last == "", symbol).otherwise(last)


def kind_of(symbol: Column, kind: Column) -> Column:
    """The kind as told, or guessed from the symbol where none is."""
    guessed = F.when(symbol.endswith("()."), FUNCTION).when(symbol.endswith("#"), CLASS).otherwise(0)
    return F.when(F.coalesce(kind, F.lit(0)) == 0, guessed).otherwise(kind)


def label_of(kind: Column) -> Column:
    return F.when(kind.isin(METHOD, FUNCTION), "Function").when(kind == CLASS, "Class").when(kind.isin(VARIABLE, FIELD), "Variable")


def definitions(found: DataFrame) -> DataFrame:
    """(symbol, path, line, name, label, documentation): where symbols are defined; of several places the first."""
    rows = found.filter("definition").withColumn("label", label_of(kind_of(F.col("symbol"), F.col("kind"))))
    first = rows.groupBy("symbol").agg(F.min(F.struct("path", "line", "label", "documentation")).alias("x"))
    return first.select("symbol", "x.path", "x.line", name_of(F.col("symbol")).alias("name"), "x.label", F.nullif(F.col("x.documentation"), F.lit("")).alias("documentation"))


def call_edges(found: DataFrame) -> DataFrame:
    """(caller, caller_path, callee, callee_path, callee_name, line): each reference to a defined symbol, from the definition at or above it in its file: one pass over each file in order."""
    above = Window.partitionBy("path").orderBy("line", F.col("definition").desc(), "symbol").rowsBetween(Window.unboundedPreceding, 0)
    owns = F.col("definition") & (F.coalesce(label_of(kind_of(F.col("symbol"), F.col("kind"))), F.lit("")) == "Function")
    rows = found.withColumn("caller", F.last(F.when(owns, F.col("symbol")), ignorenulls=True).over(above)).filter("not definition and caller is not null")
    known = definitions(found).select(F.col("symbol").alias("callee"), F.col("path").alias("callee_path"), F.col("name").alias("callee_name"))
    return rows.select("caller", F.col("path").alias("caller_path"), F.col("symbol").alias("callee"), "line").join(known, "callee").select("caller", "caller_path", "callee", "callee_path", "callee_name", "line")


def supplemented(symbols: DataFrame, elements: DataFrame) -> DataFrame:
    """Definitions with what a parser knows of the function of the same name in the file (complexity, decorators, arguments): of several the last by line."""
    rows = elements.filter("kind = 'function'").groupBy("path", "name").agg(F.max_by(F.struct("complexity", "decorators", "args", "end_line"), F.struct("line_number", "end_line")).alias("x"))
    return symbols.join(rows, ["path", "name"], "left").select(*symbols.columns, F.coalesce("x.complexity", F.lit(1)).alias("complexity"), "x.decorators", "x.args", "x.end_line")


def occurrences_of(g: Graph) -> DataFrame:
    """The graph's functions as definitions and its calls as references on the line of their caller."""
    symbol = F.concat(F.lit("py . . "), F.expr("substring(path, 2)"), F.lit("/f"), F.col("id").cast("string"), F.lit("()."))
    defined = g.functions.select("path", F.lit("python").alias("language"), symbol.alias("symbol"), F.col("line_number").alias("line"), F.lit(True).alias("definition"), F.lit(0).alias("kind"), F.lit("").alias("display_name"), F.lit("").alias("documentation"))
    ends = g.functions.select("id", "path", "line_number", symbol.alias("symbol"))
    used = g.calls.join(ends.select(F.col("id").alias("src"), "path", "line_number"), "src").join(ends.select(F.col("id").alias("dst"), "symbol"), "dst")
    return defined.union(used.select("path", F.lit("python"), "symbol", F.col("line_number"), F.lit(False), F.lit(0), F.lit(""), F.lit("")))


@on_graph("""+d AS (SELECT id, path, 'py . . ' || substr(path, 2) || '/f' || id || '().' AS symbol FROM functions)
SELECT a.symbol AS caller, a.path AS caller_path, b.symbol AS callee, b.path AS callee_path, 'f' || b.id AS callee_name, a.id AS line FROM calls JOIN d a ON a.id = src JOIN d b ON b.id = dst""")
def index_call_edges(g: Graph) -> DataFrame:
    return call_edges(occurrences_of(g))


@on_graph("SELECT 'py . . ' || substr(path, 2) || '/f' || id || '().' AS symbol, path, id AS line, 'f' || id AS name, 'Function' AS label FROM functions")
def index_definitions(g: Graph) -> DataFrame:
    return definitions(occurrences_of(g)).select("symbol", "path", "line", "name", "label")
