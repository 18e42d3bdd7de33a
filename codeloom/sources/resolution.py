"""Which file a call or a base class means: a cascade of joins, the first candidate that holds wins."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint
from ..registry import on_tables
from .python_code import parse, sources_of, symbol_index

SELF = ("self", "this", "super", "super()", "cls", "@")


def of_language(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, paths): of symbols by language those of the one language that the calls' files are in; symbols without a language serve all."""
    from .discovery import language

    langs = calls.select(language(F.col("path")).alias("lang")).distinct()
    kept = symbols.join(langs, "lang", "left_semi").union(symbols.filter("lang is null").select("lang", *(c for c in symbols.columns if c != "lang")))
    return kept.select("symbol", F.explode("paths").alias("path")).distinct().groupBy("symbol").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def buckets(resolved: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds to resolved calls which ends they have: caller and callee are a function, a class or a file. Names of classes meet those that the files define."""
    classes = elements.filter("kind = 'class'").select(F.col("path").alias("target"), "name").distinct().withColumn("called_class", F.lit(True))
    callers = elements.filter("kind = 'class'").select("path", F.col("name").alias("context")).distinct().withColumn("caller_class", F.lit(True))
    rows = resolved.join(classes, ["target", "name"], "left").join(callers, ["path", "context"], "left")
    caller = F.when(F.col("context").isNull(), "file").when(F.col("caller_class"), "class").otherwise("function")
    return rows.withColumn("caller_kind", caller).withColumn("called_kind", F.when(F.col("called_class"), "class").otherwise("function")).drop("called_class", "caller_class")


def module_path(full_name: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.ltrim(full_name, F.lit(".")), F.lit("."), F.lit("/")))


def resolve_calls(elements: DataFrame, symbols: DataFrame, skip_external: bool = False) -> DataFrame:
    """(path, context, line_number, name, target, how) of calls.

    In order: the file itself for names of self and for names defined there; the
    first file that defines the receiver's type (`receiver_type`, where a parser infers
    one); the only file that defines the name; the only one that defines an import's
    full name, or the first whose path holds it; of several, the first whose path holds
    an import's full name, with a slash for each dot; the first. Calls of a builtin's name are dropped, whatever they
    are called on. symbols: (symbol, paths), and of one language group if it has `lang`.
    """
    calls = elements.filter("kind = 'call'").filter(~F.col("name").isin(*dir(builtins)))
    if "receiver_type" not in calls.columns:
        calls = calls.withColumn("receiver_type", F.lit(None).cast("string"))
    if "lang" in symbols.columns:
        symbols = of_language(symbols, calls)
    base = F.split_part("full_name", F.lit("."), F.lit(1))
    chained = F.size(F.split("full_name", r"\.")) > 2
    calls = calls.withColumn("base", base).withColumn("lookup", F.when(F.col("full_name").contains(".") & ~(chained & base.isin(*SELF)), base).otherwise(F.col("name")))
    calls = calls.withColumn("own", base.isin(*SELF) & F.col("full_name").contains(".") & ~chained)
    local = elements.filter("kind in ('function', 'class')").select("path", F.col("name").alias("lookup")).distinct().withColumn("local", F.lit(True))
    imported = elements.filter("kind = 'import'").groupBy("path", F.coalesce("alias", F.element_at(F.split("full_name", r"\."), -1)).alias("lookup")).agg(F.min("full_name").alias("import_name"))
    names = elements.filter("kind = 'import'").groupBy("path").agg(F.collect_set(F.replace("full_name", F.lit("."), F.lit("/"))).alias("imports"))
    rows = calls.join(local, ["path", "lookup"], "left").join(local.withColumnRenamed("lookup", "name").withColumnRenamed("local", "called_local"), ["path", "name"], "left").join(imported, ["path", "lookup"], "left").join(names, "path", "left")
    rows = rows.join(symbols.withColumnRenamed("symbol", "lookup").withColumnRenamed("paths", "found"), "lookup", "left").join(symbols.withColumnRenamed("symbol", "name").withColumnRenamed("paths", "called"), "name", "left")
    rows = rows.join(symbols.withColumnRenamed("symbol", "receiver_type").withColumnRenamed("paths", "typed"), "receiver_type", "left").join(symbols.withColumnRenamed("symbol", "import_name").withColumnRenamed("paths", "direct"), "import_name", "left")
    by_full_name = F.when(F.size("direct") == 1, F.get("direct", F.lit(0)))
    by_import = F.get(F.filter("found", lambda p: p.contains(module_path(F.col("import_name")))), F.lit(0))
    part = F.when(F.col("import_name").contains("."), F.regexp_replace("import_name", r"\.[^.]*$", "")).otherwise(F.col("import_name"))
    by_package = F.get(F.filter("found", lambda p: p.contains(module_path(part))), F.lit(0))
    by_name = F.get(F.filter("called", lambda p: F.exists(F.coalesce("imports", F.array().cast("array<string>")), lambda i: p.contains(i))), F.lit(0))
    choices = [
        ("self", F.when(F.col("own"), F.col("path"))),
        ("local", F.when(F.col("local"), F.col("path"))),
        ("type", F.get("typed", F.lit(0))),
        ("unique", F.when(F.size("found") == 1, F.get("found", F.lit(0)))),
        ("import", F.when(F.size("found") > 1, F.coalesce(by_full_name, by_import, by_package))),
        ("called_local", F.when(F.col("called_local"), F.col("path"))),
        ("named", by_name),
        ("first", F.get("called", F.lit(0))),
        ("unresolved", F.col("path")),
    ]
    best = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("target"), F.lit(how).alias("how"))) for how, c in choices))
    rows = rows.withColumn("best", best).select("path", "context", "line_number", "name", "best.target", "best.how")
    return rows.filter("how not in ('first', 'unresolved')") if skip_external else rows


def resolve_bases(elements: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, child, parent, target): base classes with the file that defines them, `object` left out."""
    bases = elements.filter("kind = 'class'").select("path", F.col("name").alias("child"), F.explode("bases").alias("base")).filter("base <> 'object'")
    bases = bases.withColumn("parent", F.element_at(F.split("base", r"\."), -1))
    local = elements.filter("kind = 'class'").select("path", F.col("name").alias("parent")).distinct().withColumn("local", F.lit(True))
    imported = elements.filter("kind = 'import'").groupBy("path", F.coalesce("alias", F.element_at(F.split("full_name", r"\."), -1)).alias("first")).agg(F.min("full_name").alias("import_name"))
    rows = bases.withColumn("first", F.split_part("base", F.lit("."), F.lit(1))).join(local, ["path", "parent"], "left").join(imported, ["path", "first"], "left").join(symbols.withColumnRenamed("symbol", "parent"), "parent", "left")
    part = F.when(F.col("import_name").contains("."), F.regexp_replace("import_name", r"\.[^.]*$", "")).otherwise(F.col("import_name"))
    by_import = F.get(F.filter("paths", lambda p: p.contains(module_path(part))), F.lit(0))
    target = F.coalesce(F.when(F.col("local") & ~F.col("base").contains("."), F.col("path")), by_import, F.when(F.size("paths") == 1, F.get("paths", F.lit(0))))
    return rows.select("path", "child", "parent", target.alias("target")).filter("target is not null")


@on_tables("""SELECT '/src/n' || a.c_nationkey || '.py' AS path, 'f' || b.c_custkey AS name, '/src/n' || b.c_nationkey || '.py' AS target, CASE WHEN a.c_nationkey = b.c_nationkey THEN 'local' ELSE 'unique' END AS how FROM customer a JOIN customer b ON b.c_custkey = greatest(a.c_custkey - 1, 0)""")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = checkpoint(parse(sources_of(spark, sf_dir)))  # read by many joins, parsed once
    return resolve_calls(elements, symbol_index(elements)).select("path", "name", "target", "how")


def split_bases(elements: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base classes of all files but those of C#, whose bases may be interfaces; and of those, each base with whether its name is that of an interface (`I` and a capital letter): edges of implementation, not of inheritance."""
    sharp = F.col("path").endswith(".cs")
    others = resolve_bases(elements.filter(~sharp), symbols)
    bases = resolve_bases(elements.filter(sharp), symbols)
    return others, bases.withColumn("implements", F.col("parent").rlike("^I[A-Z]"))


@on_tables("""SELECT '/src/n' || c_nationkey || '.py' AS path, count(*) AS calls, 'function' AS caller_kind, 'function' AS called_kind FROM customer GROUP BY c_nationkey""")
def call_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = checkpoint(parse(sources_of(spark, sf_dir)))  # read by many joins, parsed once
    return buckets(resolve_calls(elements, symbol_index(elements)), elements).groupBy("path", "caller_kind", "called_kind").agg(F.count("*").alias("calls"))
