"""Look-ups of code elements and of what relates to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..registry import on_graph, on_tables
from .graph import Graph, top

#: Kinds of results in the ranked search and their scores in the project and in dependencies.
SCORES = {"function": (0.9, 0.7), "class": (0.8, 0.6), "variable": (0.7, 0.5), "content": (0.6, 0.4)}
KINDS = ("functions", "classes", "variables", "modules")


def nodes(g: Graph) -> DataFrame:
    """All elements with their label; modules have no place."""
    at = ["id", "name", "path", "line_number", "is_dependency"]
    modules = g.modules.select("id", "name", F.col("name").alias("path"), F.lit(None).cast("long").alias("line_number"), F.lit(False).alias("is_dependency"))
    return (
        g.functions.select(F.lit("Function").alias("label"), *at)
        .union(g.classes.select(F.lit("Class"), *at))
        .union(g.variables.select(F.lit("Variable"), *at))
        .union(modules.select(F.lit("Module"), *at))
    )


def named(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("name") == name)


def fuzzy(df: DataFrame, name: str, distance: int = 2) -> DataFrame:
    """Names within an edit distance, whatever their case."""
    found = df.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(name.lower()), distance).cast("long"))
    return found.filter("distance >= 0")


def holds(text: str, *columns: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found |= F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return found


@on_graph("SELECT id, name, path, line_number FROM functions WHERE name = 'hot bolt' ORDER BY id LIMIT 20")
def find_function(g: Graph) -> DataFrame:
    return top(named(g.functions, "hot bolt").select("id", "name", "path", "line_number"), 20, "id")


@on_graph("SELECT id, name, path, line_number FROM classes WHERE name = 'Customer#000000007' ORDER BY id LIMIT 20")
def find_class(g: Graph) -> DataFrame:
    return top(named(g.classes, "Customer#000000007").select("id", "name", "path", "line_number"), 20, "id")


@on_graph("SELECT id, name, CAST(levenshtein(lower(name), 'hot bot') AS BIGINT) AS distance FROM functions WHERE levenshtein(lower(name), 'hot bot') <= 2 ORDER BY distance, id LIMIT 20")
def fuzzy_name(g: Graph) -> DataFrame:
    return top(fuzzy(g.functions, "hot bot").select("id", "name", "distance"), 20, "distance", "id")


@on_graph("SELECT id, name, path, is_dependency FROM variables WHERE contains(name, 'urgent') ORDER BY is_dependency, name, id LIMIT 20")
def find_variable(g: Graph) -> DataFrame:
    return top(g.variables.filter(F.col("name").contains("urgent")).select("id", "name", "path", "is_dependency"), 20, "is_dependency", "name", "id")


@on_graph("""SELECT kind, id, name FROM (
(SELECT 0 AS kind, id, name FROM functions WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(docstring), 'ring') ORDER BY id LIMIT 20)
UNION ALL (SELECT 1, id, name FROM classes WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(docstring), 'ring') ORDER BY id LIMIT 20)) ORDER BY kind, id LIMIT 20""")
def find_content(g: Graph) -> DataFrame:
    one = top(g.functions.filter(holds("ring", "name", "source", "docstring")).select(F.lit(0).alias("kind"), "id", "name"), 20, "id")
    two = top(g.classes.filter(holds("ring", "name", "source", "docstring")).select(F.lit(1).alias("kind"), "id", "name"), 20, "id")
    return top(one.union(two), 20, "kind", "id")


@on_graph("SELECT id, name, full_import_name FROM modules WHERE contains(lower(name), '00007')")
def find_module(g: Graph) -> DataFrame:
    return g.modules.filter(holds("00007", "name")).select("id", "name", "full_import_name")


@on_graph("SELECT path, module_id, alias, imported_name, line_number FROM imports WHERE alias = 'supplier#000000003' OR imported_name = 'Supplier#000000004'")
def find_imports(g: Graph) -> DataFrame:
    return g.imports.filter((F.col("alias") == "supplier#000000003") | (F.col("imported_name") == "Supplier#000000004")).select("path", "module_id", "alias", "imported_name", "line_number")


def ranked(g: Graph, text: str, n: int = 15) -> DataFrame:
    """Names by kind, then contents, each with the score of its kind; the best n."""
    parts = [
        ("function", g.functions.filter(F.col("name").contains(text))),
        ("class", g.classes.filter(F.col("name").contains(text))),
        ("variable", g.variables.filter(F.col("name").contains(text))),
        ("content", g.functions.filter(holds(text, "source", "docstring"))),
    ]
    found = None
    for kind, rows in parts:
        inside, outside = SCORES[kind]
        rows = rows.select(F.lit(kind).alias("kind"), "id", "name", F.when(F.col("is_dependency"), outside).otherwise(inside).alias("score"))
        found = rows if found is None else found.union(rows)
    return top(found, n, F.desc("score"), "kind", "id")


@on_graph("""SELECT * FROM (
SELECT 'function' AS kind, id, name, CASE WHEN is_dependency THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS score FROM functions WHERE contains(name, 'rod')
UNION ALL SELECT 'class', id, name, CASE WHEN is_dependency THEN 0.6 ELSE 0.8 END FROM classes WHERE contains(name, 'rod')
UNION ALL SELECT 'variable', id, name, CASE WHEN is_dependency THEN 0.5 ELSE 0.7 END FROM variables WHERE contains(name, 'rod')
UNION ALL SELECT 'content', id, name, CASE WHEN is_dependency THEN 0.4 ELSE 0.6 END FROM functions WHERE contains(lower(source), 'rod') OR contains(lower(docstring), 'rod'))
ORDER BY score DESC, kind, id LIMIT 15""")
def ranked_search(g: Graph) -> DataFrame:
    return ranked(g, "rod")


@on_graph("SELECT id, name, path FROM functions WHERE id IN (SELECT function_id FROM parameters WHERE arg = 'arg7') ORDER BY id LIMIT 50")
def functions_by_argument(g: Graph) -> DataFrame:
    having = g.parameters.filter("arg = 'arg7'").select(F.col("function_id").alias("id"))
    return top(g.functions.join(having, "id", "left_semi").select("id", "name", "path"), 50, "id")


@on_graph("SELECT id, name, path FROM functions WHERE list_contains([decorator], '@celery.task') ORDER BY id LIMIT 50")
def functions_by_decorator(g: Graph) -> DataFrame:
    return top(g.functions.filter(F.array_contains(F.array("decorator"), "@celery.task")).select("id", "name", "path"), 50, "id")


def callers_of(g: Graph, targets: DataFrame) -> DataFrame:
    """(id, name, path, is_dependency, target): who calls one of the target ids."""
    calls = g.calls.join(targets.select(F.col("id").alias("dst")), "dst")
    return calls.join(g.functions.select(F.col("id").alias("src"), "name", "path", "line_number", "is_dependency"), "src").select(F.col("src").alias("id"), "name", "path", "line_number", "is_dependency", F.col("dst").alias("target"))


@on_graph("SELECT DISTINCT f.id, f.name, f.path, f.is_dependency, c.dst AS target FROM calls c JOIN functions t ON t.id = c.dst AND t.name = 'hot bolt' JOIN functions f ON f.id = c.src ORDER BY is_dependency, f.id, target LIMIT 20")
def direct_callers(g: Graph) -> DataFrame:
    found = callers_of(g, named(g.functions, "hot bolt")).select("id", "name", "path", "is_dependency", "target").distinct()
    return top(found, 20, "is_dependency", "id", "target")


@on_graph("SELECT DISTINCT t.id, t.name, t.path, t.is_dependency FROM calls c JOIN functions f ON f.id = c.src AND f.name = 'hot ring' JOIN functions t ON t.id = c.dst ORDER BY is_dependency, t.id LIMIT 20")
def direct_callees(g: Graph) -> DataFrame:
    sources = named(g.functions, "hot ring").select(F.col("id").alias("src"))
    called = g.calls.join(sources, "src", "left_semi").select(F.col("dst").alias("id"))
    return top(g.functions.join(called, "id", "left_semi").select("id", "name", "path", "is_dependency"), 20, "is_dependency", "id")


@on_graph("SELECT i.path, string_agg(i.imported_name || ':' || i.line_number, ',' ORDER BY i.imported_name) AS imports FROM imports i JOIN modules m ON m.id = i.module_id WHERE m.name = 'Supplier#000000002' OR contains(m.full_import_name, '00008') GROUP BY i.path ORDER BY i.path LIMIT 20")
def importers(g: Graph) -> DataFrame:
    module = g.modules.filter((F.col("name") == "Supplier#000000002") | F.col("full_import_name").contains("00008")).select(F.col("id").alias("module_id"))
    rows = g.imports.join(module, "module_id").select("path", F.struct("imported_name", "line_number").alias("i"))
    rows = rows.groupBy("path").agg(F.sort_array(F.collect_list("i")).alias("i"))
    return top(rows.select("path", F.array_join(F.transform("i", lambda i: F.concat_ws(":", i["imported_name"], i["line_number"])), ",").alias("imports")), 20, "path")


def scopes(g: Graph, variables: DataFrame) -> DataFrame:
    """(variable_id, label, name, path, line, is_dependency): what holds each variable (id): functions, classes, and its file, whose name is null."""
    at = ["id", "name", "path", F.col("line_number").cast("long").alias("line"), "is_dependency"]
    named_scopes = g.functions.select(F.lit("function").alias("label"), *at).union(g.classes.select(F.lit("class"), *at))
    held = variables.select(F.col("id").alias("variable_id")).join(g.holders, "variable_id").join(named_scopes, ["label", "id"])
    files = variables.select(F.col("id").alias("variable_id"), F.lit("file"), F.lit(None).cast("string"), "path", F.lit(None).cast("long"), "is_dependency")
    return held.select("variable_id", "label", "name", "path", "line", "is_dependency").union(files).distinct()


_SCOPES = """+named AS (SELECT 'function' AS label, id, name, path, line_number AS line, is_dependency FROM functions UNION ALL SELECT 'class', id, name, path, line_number, is_dependency FROM classes),
scopes AS (SELECT h.variable_id, n.label, n.name, n.path, n.line, n.is_dependency FROM holders h JOIN named n USING (label, id) UNION ALL SELECT id, 'file', NULL, path, NULL, is_dependency FROM variables)"""


@on_graph(f"{_SCOPES} SELECT coalesce(s.name, 'file_level') AS container, s.label AS container_type, s.path, s.line, v.id, v.value, s.is_dependency FROM variables v JOIN scopes s ON s.variable_id = v.id WHERE v.name = 'high_f' ORDER BY s.is_dependency, s.path, v.line_number, container_type, v.id LIMIT 20")
def variable_containers(g: Graph) -> DataFrame:
    """The functions, classes and files that contain the variables of a name."""
    own = named(g.variables, "high_f")
    rows = scopes(g, own).join(own.select(F.col("id").alias("variable_id"), "value", F.col("line_number").alias("variable_line")), "variable_id")
    rows = top(rows, 20, "is_dependency", "path", "variable_line", "label", "variable_id")
    return rows.select(F.coalesce("name", F.lit("file_level")).alias("container"), F.col("label").alias("container_type"), "path", "line", F.col("variable_id").alias("id"), "value", "is_dependency")


def hierarchy(g: Graph, class_id: int) -> DataFrame:
    """(relation, id, name): parents, children and methods of a class."""
    names = g.classes.select("id", "name")
    up = g.inherits.filter(F.col("child") == class_id).select(F.lit("parent").alias("relation"), F.col("parent").alias("id")).join(names, "id")
    down = g.inherits.filter(F.col("parent") == class_id).select(F.lit("child").alias("relation"), F.col("child").alias("id")).join(names, "id")
    own = g.methods.filter(F.col("class_id") == class_id).select(F.lit("method").alias("relation"), F.col("function_id").alias("id")).join(g.functions.select("id", "name"), "id")
    return up.union(down).union(own).select("relation", "id", "name")


@on_graph("SELECT 'parent' AS relation, c.id, c.name FROM inherits i JOIN classes c ON c.id = i.parent WHERE i.child = 7 UNION ALL SELECT 'child', c.id, c.name FROM inherits i JOIN classes c ON c.id = i.child WHERE i.parent = 7 UNION ALL SELECT 'method', f.id, f.name FROM methods m JOIN functions f ON f.id = m.function_id WHERE m.class_id = 7")
def class_hierarchy(g: Graph) -> DataFrame:
    return hierarchy(g, 7)


@on_graph("SELECT c.id AS class_id, c.name AS class_name, f.id, f.name, f.path FROM methods m JOIN functions f ON f.id = m.function_id AND f.name = 'red plate' JOIN classes c ON c.id = m.class_id ORDER BY class_id, f.id LIMIT 50")
def overrides(g: Graph) -> DataFrame:
    rows = named(g.functions, "red plate").select(F.col("id").alias("function_id"), "name", "path").join(g.methods, "function_id")
    rows = rows.join(g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name")), "class_id")
    return top(rows.select("class_id", "class_name", F.col("function_id").alias("id"), "name", "path"), 50, "class_id", "id")


def dead(g: Graph, without: tuple[str, ...] = ()) -> DataFrame:
    """Functions of the project that no function of the project calls, but for entry points and tests by name, decorators `without` and ignored directories."""
    name = F.col("name")
    own = g.functions.filter(~F.col("is_dependency") & ~fn.under(F.col("path")))
    rows = own.filter(~name.isin("main", "setup", "run") & ~name.rlike("^__.*__$") & ~name.startswith("_test") & ~name.startswith("test_") & ~fn.has_name(name, "main", "application", "entry", "entrypoint"))
    if without:
        rows = rows.filter(F.col("decorator").isNull() | ~F.col("decorator").isin(*without))
    called = g.calls.join(own.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return rows.join(called, "id", "left_anti")


@on_graph("SELECT id, name, path, line_number FROM functions WHERE NOT is_dependency AND (decorator IS NULL OR decorator <> '@app.route(''/x'')') AND id NOT IN (SELECT dst FROM calls JOIN functions s ON s.id = src WHERE NOT s.is_dependency) ORDER BY path, line_number LIMIT 50")
def dead_code(g: Graph) -> DataFrame:
    return top(dead(g, ("@app.route('/x')",)).select("id", "name", "path", "line_number"), 50, "path", "line_number")


@on_graph("SELECT id, name, path FROM functions f WHERE NOT starts_with(name, '_') AND NOT EXISTS (SELECT 1 FROM calls WHERE dst = f.id)")
def dead_code_simple(g: Graph) -> DataFrame:
    return g.functions.filter(~F.col("name").startswith("_")).join(g.calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name", "path")


@on_graph("SELECT 'Module' AS label, id, name, name AS path FROM modules ORDER BY name, id LIMIT 50")
def find_by_type(g: Graph) -> DataFrame:
    return top(nodes(g).filter("label = 'Module'").select("label", "id", "name", "path"), 50, "name", "id")


def co_imported(g: Graph, module_id: int) -> DataFrame:
    """Modules that files import beside this one, with the number of such files."""
    files = g.imports.filter(F.col("module_id") == module_id).select("path")
    return g.imports.filter(F.col("module_id") != module_id).join(files, "path", "left_semi").groupBy("module_id", "imported_name").agg(F.count("*").alias("n_files"))


@on_graph("SELECT module_id, imported_name, count(*) AS n_files FROM imports WHERE module_id <> 5 AND path IN (SELECT path FROM imports WHERE module_id = 5) GROUP BY ALL ORDER BY n_files DESC, module_id LIMIT 50")
def module_deps(g: Graph) -> DataFrame:
    return top(co_imported(g, 5), 50, F.desc("n_files"), "module_id")


def module_dependencies_of(g: Graph, name: str, most: int = 50) -> DataFrame:
    """(part, name, detail): files that import a module, with the line, and modules that such files import beside it, with the alias; the first `most` of each by name."""
    own = g.modules.filter(F.col("name") == name).select(F.col("id").alias("module_id"))
    hits = g.imports.join(own, "module_id", "left_semi")
    importers = hits.select(F.lit("importer").alias("part"), F.col("path").alias("name"), F.col("line_number").cast("string").alias("detail")).distinct()
    beside = g.imports.join(hits.select("path").distinct(), "path", "left_semi").join(own, "module_id", "left_anti")
    others = beside.join(g.modules.select(F.col("id").alias("module_id"), "name"), "module_id").select(F.lit("import"), "name", F.col("alias")).distinct()
    return top(importers, most, "name", "detail").union(top(others.toDF("part", "name", "detail"), most, "name", "detail"))


@on_graph("""+hits AS (SELECT i.* FROM imports i JOIN modules m ON m.id = i.module_id WHERE m.name = 'Supplier#000000003'),
a AS (SELECT DISTINCT path AS name, CAST(line_number AS VARCHAR) AS detail FROM hits ORDER BY 1, 2 LIMIT 50), b AS (SELECT DISTINCT m.name, i.alias AS detail FROM imports i JOIN modules m ON m.id = i.module_id WHERE i.path IN (SELECT path FROM hits) AND m.name <> 'Supplier#000000003' ORDER BY 1, 2 LIMIT 50)
SELECT 'importer' AS part, name, detail FROM a UNION ALL SELECT 'import', name, detail FROM b""")
def module_dependencies(g: Graph) -> DataFrame:
    return module_dependencies_of(g, "Supplier#000000003")


@on_graph(f"{_SCOPES} SELECT v.id, v.path, v.line_number, v.value, CASE s.label WHEN 'file' THEN 'module' ELSE s.label END AS scope_type, coalesce(s.name, 'module_level') AS scope_name, v.is_dependency FROM variables v JOIN scopes s ON s.variable_id = v.id WHERE v.name = 'medium_p'")
def variable_scope(g: Graph) -> DataFrame:
    """The variables of a name with each scope they stand in; that of a file is the module."""
    own = named(g.variables, "medium_p")
    rows = scopes(g, own).select(F.col("variable_id").alias("id"), F.when(F.col("label") == "file", "module").otherwise(F.col("label")).alias("scope_type"), F.coalesce("name", F.lit("module_level")).alias("scope_name"))
    return own.select("id", "path", "line_number", "value", "is_dependency").join(rows, "id").orderBy("is_dependency", "path", "line_number", "scope_type")


@on_graph("SELECT id, name, complexity FROM functions WHERE name = 'old rod' ORDER BY id LIMIT 1")
def complexity_of(g: Graph) -> DataFrame:
    return top(named(g.functions, "old rod").select("id", "name", "complexity"), 1, "id")


@on_graph("SELECT id, name, path, complexity FROM functions WHERE NOT is_dependency ORDER BY complexity DESC, id LIMIT 10")
def top_complexity(g: Graph) -> DataFrame:
    return top(g.functions.filter("not is_dependency").select("id", "name", "path", "complexity"), 10, F.desc("complexity"), "id")


@on_graph("SELECT split_part(path, '/', 3) AS repository, count(DISTINCT path) AS files, count(*) AS functions FROM functions GROUP BY 1")
def list_repositories(g: Graph) -> DataFrame:
    return g.functions.groupBy(F.split_part("path", F.lit("/"), F.lit(3)).alias("repository")).agg(F.count_distinct("path").alias("files"), F.count("*").alias("functions"))


@on_graph("""SELECT label, id, name FROM (SELECT 'Function' AS label, id, name FROM functions UNION ALL SELECT 'Class', id, name FROM classes UNION ALL SELECT 'Variable', id, name FROM variables UNION ALL SELECT 'Module', id, name FROM modules) WHERE contains(lower(name), '00001') OR contains(lower(name), 'gear') ORDER BY label, id LIMIT 50""")
def find_pattern(g: Graph) -> DataFrame:
    return top(nodes(g).filter(holds("00001", "name") | holds("gear", "name")).select("label", "id", "name"), 50, "label", "id")


@on_graph("SELECT DISTINCT f.path FROM calls c JOIN functions t ON t.id = c.dst AND t.path = (SELECT min(path) FROM functions) JOIN functions f ON f.id = c.src WHERE f.path <> t.path")
def incremental_affected(g: Graph) -> DataFrame:
    file = g.functions.agg(F.min("path").alias("path"))
    targets = g.functions.join(F.broadcast(file), "path", "left_semi").select(F.col("id").alias("dst"), F.col("path").alias("target"))
    callers = g.calls.join(targets, "dst").join(g.functions.select(F.col("id").alias("src"), "path"), "src")
    return callers.filter("path <> target").select("path").distinct()


@on_graph("SELECT path, count(*) AS functions FROM functions GROUP BY path ORDER BY functions DESC, path LIMIT 20")
def functions_per_file(g: Graph) -> DataFrame:
    return top(g.functions.groupBy("path").agg(F.count("*").alias("functions")), 20, F.desc("functions"), "path")


@on_graph("SELECT f.id, f.name, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) e JOIN functions f USING (id) GROUP BY f.id, f.name ORDER BY degree DESC, f.id LIMIT 5")
def hubs(g: Graph) -> DataFrame:
    ends = g.calls.select(F.col("src").alias("id")).union(g.calls.select("dst"))
    return top(ends.groupBy("id").agg(F.count("*").alias("degree")).join(g.functions.select("id", "name"), "id"), 5, F.desc("degree"), "id")


def mutual(calls: DataFrame) -> DataFrame:
    """(src, dst), src the smaller: functions that call each other."""
    calls = calls.select("src", "dst").distinct()
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return calls.filter("src < dst").join(back, ["src", "dst"], "left_semi")


@on_tables("""WITH c AS (SELECT DISTINCT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS src, l_partkey AS dst FROM lineitem)
SELECT c.src, c.dst FROM c JOIN c r ON r.src = c.dst AND r.dst = c.src WHERE c.src < c.dst""")
def mutual_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On all steps of an order, of which the graph's calls are a part, so that some go both ways."""
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    steps = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lag("l_partkey").over(by_order).alias("src"), F.col("l_partkey").alias("dst"))
    return mutual(steps.filter("src is not null"))


@on_graph("SELECT count(*) FILTER (WHERE docstring = '') AS missing, count(*) FILTER (WHERE docstring <> '') AS present FROM functions")
def docstring_presence(g: Graph) -> DataFrame:
    return g.functions.agg(F.count_if(F.col("docstring") == "").alias("missing"), F.count_if(F.col("docstring") != "").alias("present"))


@on_graph("SELECT m.class_id, p.parent, count(*) AS n FROM methods m JOIN inherits p ON p.child = m.class_id JOIN functions f ON f.id = m.function_id JOIN methods pm ON pm.class_id = p.parent JOIN functions pf ON pf.id = pm.function_id AND pf.name = f.name GROUP BY ALL")
def overrides_of_parent(g: Graph) -> DataFrame:
    own = g.methods.join(g.functions.select(F.col("id").alias("function_id"), "name"), "function_id").select("class_id", "name")
    pairs = own.join(g.inherits.withColumnRenamed("child", "class_id"), "class_id")
    return pairs.join(own.select(F.col("class_id").alias("parent"), "name"), ["parent", "name"]).groupBy("class_id", "parent").agg(F.count("*").alias("n"))


@on_graph("SELECT id, name, path FROM functions WHERE regexp_matches(lower(source), 'brand#1[0-9]') AND regexp_matches(lower(source), 'promo|economy')")
def secrets_scan(g: Graph) -> DataFrame:
    return g.functions.filter(F.lower("source").rlike("brand#1[0-9]") & F.lower("source").rlike("promo|economy")).select("id", "name", "path")
