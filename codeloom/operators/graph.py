"""The property graph: typed frames of nodes and edges, and hops over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Nodes and edges of a code base. Edges of calls keep one row for each call site."""

    functions: DataFrame  # id, name, path, line_number, end_line, complexity, docstring, source, is_dependency, decorator, decorators (all of them, the first also in decorator)
    classes: DataFrame  # id, name, path, line_number, end_line, docstring, source, is_dependency
    variables: DataFrame  # id, name, path, line_number, value, is_dependency
    modules: DataFrame  # id, name, full_import_name, path (null if outside the project)
    calls: DataFrame  # src, dst (function ids)
    imports: DataFrame  # path, module_id, imported_name, alias, line_number
    inherits: DataFrame  # child, parent (class ids)
    methods: DataFrame  # class_id, function_id
    parameters: DataFrame  # function_id, arg
    changes: DataFrame  # path, ts, kind
    class_calls: DataFrame  # src (function id), dst (class id): calls of a class
    holders: DataFrame  # variable_id, label ('function' or 'class'), id: what a variable is declared in, beside its file


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph that stands for the warehouse tables: parts are functions, customers classes, suppliers modules, orders variables."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    part, line = t("part"), t("lineitem")
    path = F.concat(F.lit("/src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit(".py"))
    decorator = F.when(F.col("p_type") == "PROMO", "@app.route('/x')").when(F.col("p_type") == "ECONOMY", "@click.command()").when(F.col("p_type") == "SMALL", "@celery.task").when(F.col("p_type") == "LARGE", "@pytest.fixture")
    functions = part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        path.alias("path"),
        F.col("p_partkey").alias("line_number"),
        (F.col("p_partkey") + F.col("p_size")).alias("end_line"),
        (F.col("p_size") % 20).cast("long").alias("complexity"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("docstring"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("source"),
        (F.col("p_partkey") % 17 == 0).alias("is_dependency"),
        decorator.alias("decorator"),
        F.array_compact(F.array(decorator, F.when(F.col("p_size") % 7 == 0, "@admin_required"), F.when(F.col("p_size") % 11 == 0, "@overload"))).alias("decorators"),
    )
    customer = t("customer")
    class_path = F.concat(F.lit("/src/"), F.lower("c_mktsegment"), F.lit("/models.py"))
    classes = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), class_path.alias("path"), F.col("c_custkey").alias("line_number"), (F.col("c_custkey") + 10).alias("end_line"), F.col("c_mktsegment").alias("docstring"), F.col("c_name").alias("source"), (F.col("c_custkey") % 19 == 0).alias("is_dependency"))
    orders = t("orders")
    variables = orders.select(F.col("o_orderkey").alias("id"), F.lower(F.concat_ws("_", F.substring("o_orderpriority", 3, 20), "o_orderstatus")).alias("name"), F.concat(F.lit("/src/orders/"), F.lower("o_orderstatus"), F.lit(".py")).alias("path"), F.col("o_orderkey").alias("line_number"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 23 == 0).alias("is_dependency"))
    modules = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("vendor."), F.lower("s_name")).alias("full_import_name"), F.when(F.col("s_suppkey") % 6 == 0, "/src/tests/helpers.py").alias("path"))
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    calls = line.select(F.lag("l_partkey").over(by_order).alias("src"), F.col("l_partkey").alias("dst"), "l_quantity").filter("l_quantity >= 49 and src <> dst").select("src", "dst").distinct()
    imports = line.select("l_partkey", "l_suppkey").join(functions.select(F.col("id").alias("l_partkey"), "path"), "l_partkey").groupBy("path", F.col("l_suppkey").alias("module_id")).agg(F.min("l_partkey").alias("line_number"))
    imports = imports.join(modules.select(F.col("id").alias("module_id"), F.col("name").alias("imported_name")), "module_id").select("path", "module_id", "imported_name", F.lower("imported_name").alias("alias"), "line_number")
    inherits = customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent"))
    methods = line.filter("l_quantity >= 49").select("l_orderkey", "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.col("o_custkey").alias("class_id"), F.col("l_partkey").alias("function_id")).distinct()
    parameters = line.select(F.col("l_partkey").alias("function_id"), F.concat(F.lit("arg"), F.col("l_linenumber").cast("string")).alias("arg")).distinct()
    files = functions.select("path").distinct().groupBy().agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a row for each file: some thousands
    changes = t("events").crossJoin(F.broadcast(files)).select(F.expr("element_at(paths, cast(user_id % size(paths) as int) + 1)").alias("path"), "ts", F.col("event_type").alias("kind"))
    class_calls = line.filter("l_quantity = 48").select("l_orderkey", "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.col("l_partkey").alias("src"), F.col("o_custkey").alias("dst"))
    holders = orders.filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("variable_id"), F.when(F.col("o_orderkey") % 3 == 0, "class").otherwise("function").alias("label"), F.col("o_custkey").alias("id"))
    return Graph(functions, classes, variables, modules, calls, imports, inherits, methods, parameters, changes, class_calls, holders)


#: The same graph as common table expressions, for checks by another engine.
SQL = """
functions AS (SELECT p_partkey AS id, p_name AS name, '/src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '.py' AS path, p_partkey AS line_number, p_partkey + p_size AS end_line, CAST(p_size % 20 AS BIGINT) AS complexity, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS docstring, p_name || ' ' || p_type || ' ' || p_brand AS source, p_partkey % 17 = 0 AS is_dependency, CASE p_type WHEN 'PROMO' THEN '@app.route(''/x'')' WHEN 'ECONOMY' THEN '@click.command()' WHEN 'SMALL' THEN '@celery.task' WHEN 'LARGE' THEN '@pytest.fixture' END AS decorator, list_filter([CASE p_type WHEN 'PROMO' THEN '@app.route(''/x'')' WHEN 'ECONOMY' THEN '@click.command()' WHEN 'SMALL' THEN '@celery.task' WHEN 'LARGE' THEN '@pytest.fixture' END, CASE WHEN p_size % 7 = 0 THEN '@admin_required' END, CASE WHEN p_size % 11 = 0 THEN '@overload' END], lambda d: d IS NOT NULL) AS decorators FROM part),
classes AS (SELECT c_custkey AS id, c_name AS name, '/src/' || lower(c_mktsegment) || '/models.py' AS path, c_custkey AS line_number, c_custkey + 10 AS end_line, c_mktsegment AS docstring, c_name AS source, c_custkey % 19 = 0 AS is_dependency FROM customer),
variables AS (SELECT o_orderkey AS id, lower(substr(o_orderpriority, 3, 20) || '_' || o_orderstatus) AS name, '/src/orders/' || lower(o_orderstatus) || '.py' AS path, o_orderkey AS line_number, o_orderstatus AS value, o_orderkey % 23 = 0 AS is_dependency FROM orders),
modules AS (SELECT s_suppkey AS id, s_name AS name, 'vendor.' || lower(s_name) AS full_import_name, CASE WHEN s_suppkey % 6 = 0 THEN '/src/tests/helpers.py' END AS path FROM supplier),
calls AS (SELECT DISTINCT src, dst FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS src, l_partkey AS dst, l_quantity FROM lineitem) WHERE l_quantity >= 49 AND src <> dst),
imports AS (SELECT path, l_suppkey AS module_id, s_name AS imported_name, lower(s_name) AS alias, min(l_partkey) AS line_number FROM lineitem JOIN functions ON functions.id = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY path, l_suppkey, s_name),
inherits AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0),
class_calls AS (SELECT l_partkey AS src, o_custkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 48),
holders AS (SELECT o_orderkey AS variable_id, CASE WHEN o_orderkey % 3 = 0 THEN 'class' ELSE 'function' END AS label, o_custkey AS id FROM orders WHERE o_orderkey % 3 < 2),
methods AS (SELECT DISTINCT o_custkey AS class_id, l_partkey AS function_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49),
parameters AS (SELECT DISTINCT l_partkey AS function_id, 'arg' || CAST(l_linenumber AS VARCHAR) AS arg FROM lineitem),
files AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT path FROM functions)),
changes AS (SELECT path, ts, event_type AS kind FROM events JOIN files ON rank = user_id % n)
"""


def hop(frontier: DataFrame, edges: DataFrame, column: str = "id") -> DataFrame:
    """Distinct nodes one edge (src, dst) from the frontier."""
    return edges.join(frontier.select(F.col(column).alias("src")), "src").select(F.col("dst").alias(column)).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def within(seeds: DataFrame, edges: DataFrame, depth: int, least: int = 0) -> DataFrame:
    """(id, hops): nodes up to `depth` edges from a seed, with the fewest hops. One plan: each level comes from the one before. From three levels on, the edges are written once and read by each."""
    level = seeds.select("id").distinct()
    found = level.withColumn("hops", F.lit(0)) if least == 0 else None
    edges = edges.select("src", "dst").distinct()
    if depth > 2:
        edges = checkpoint(edges)
    for k in range(1, depth + 1):
        level = hop(level, edges)
        step = level.withColumn("hops", F.lit(k))
        found = step if found is None else found.union(step)
    return found.groupBy("id").agg(F.min("hops").alias("hops"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder that the session names in spark.checkpoint.dir. Where it names none, a local master takes a temporary one; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): all nodes that a path of one edge or more leads to from a seed; a seed on a cycle is among them. Loops until no new node is met; each level is written once."""
    edges = checkpoint(edges.select("src", "dst").distinct())
    level = checkpoint(hop(seeds.select("id").distinct(), edges))
    levels = [level]
    while not level.isEmpty():
        level = checkpoint(hop(level, edges).join(union_of(levels), "id", "left_anti"))
        levels.append(level)
    return union_of(levels)


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows; give an order that has no ties."""
    return df.orderBy(*order).limit(n)
