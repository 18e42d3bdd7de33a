"""Traversals of the call, containment and inheritance graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import on_graph, on_tables
from .graph import Graph, checkpoint, hop, reach, reversed_edges, top, union_of, within


def seeds_of(g: Graph, least: int, most: int) -> DataFrame:
    return g.functions.filter(F.col("id").between(least, most)).select("id")


@on_graph("""+r AS (SELECT dst AS id FROM calls WHERE src BETWEEN 20 AND 40 UNION SELECT c.dst FROM r JOIN calls c ON c.src = r.id)
SELECT f.id, f.name, f.path, f.is_dependency FROM r JOIN functions f USING (id) ORDER BY is_dependency, path, line_number LIMIT 50""")
def all_callees(g: Graph) -> DataFrame:
    found = reach(seeds_of(g, 20, 40), g.calls)
    return top(g.functions.join(found, "id", "left_semi"), 50, "is_dependency", "path", "line_number").select("id", "name", "path", "is_dependency")


@on_graph("""+r AS (SELECT src AS id FROM calls WHERE dst BETWEEN 5 AND 25 UNION SELECT c.src FROM r JOIN calls c ON c.dst = r.id)
SELECT f.id, f.name, f.path, f.is_dependency FROM r JOIN functions f USING (id) ORDER BY is_dependency, path, line_number LIMIT 50""")
def all_callers(g: Graph) -> DataFrame:
    found = reach(seeds_of(g, 5, 25), reversed_edges(g.calls))
    return top(g.functions.join(found, "id", "left_semi"), 50, "is_dependency", "path", "line_number").select("id", "name", "path", "is_dependency")


def chains(starts: DataFrame, ends: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(path, length): trails of at most `depth` edges, no edge twice, from a start to an end.

    A level is extended only by edges from which an end can still be reached in
    the steps that are left.
    """
    edges = checkpoint(edges.select("src", "dst").distinct())
    near = [ends.select("id").distinct()]
    for _ in range(depth - 1):
        near.append(checkpoint(near[-1].union(hop(near[-1], reversed_edges(edges))).distinct()))
    level = starts.select(F.array("id").alias("path"), F.col("id").alias("at"))
    found = None
    for k in range(1, depth + 1):
        open_ = edges.join(near[depth - k].select(F.col("id").alias("dst")), "dst", "left_semi")
        level = level.join(open_, F.col("at") == F.col("src"))
        step = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.concat_ws(">", F.get("path", i - 1), F.get("path", i))), F.concat_ws(">", "src", "dst"))
        level = level.filter(step == 0).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
        hit = level.join(ends.select(F.col("id").alias("at")), "at", "left_semi").select("path", F.lit(k).alias("length"))
        found = hit if found is None else found.union(hit)
    return found


@on_graph("""+r AS (SELECT src, dst AS node, '>' || src || '>' || dst || '>' AS trail, '|' || src || '>' || dst || '|' AS used, 1 AS length FROM calls WHERE src < 20
UNION ALL SELECT r.src, c.dst, r.trail || c.dst || '>', r.used || c.src || '>' || c.dst || '|', length + 1 FROM r JOIN calls c ON c.src = r.node WHERE length < 5 AND NOT contains(r.used, '|' || c.src || '>' || c.dst || '|'))
SELECT trim(trail, '>') AS path, length FROM r WHERE node BETWEEN 400 AND 900 ORDER BY length, path LIMIT 20""")
def call_chain(g: Graph) -> DataFrame:
    found = chains(g.functions.filter("id < 20"), seeds_of(g, 400, 900), g.calls, 5)
    return top(found.select(F.array_join("path", ">").alias("path"), "length"), 20, "length", "path")


@on_graph("""+r AS (SELECT id, 0 AS hops FROM functions WHERE starts_with(path, '/src/brand_13/') UNION ALL SELECT DISTINCT c.dst, r.hops + 1 FROM r JOIN calls c ON c.src = r.id WHERE r.hops < 4)
SELECT r.id, min(r.hops) AS hops, f.name, f.path FROM r JOIN functions f USING (id) GROUP BY r.id, f.name, f.path""")
def blast_radius(g: Graph) -> DataFrame:
    seeds = g.functions.filter(F.col("path").startswith("/src/brand_13/"))
    return within(seeds, g.calls, 4).join(g.functions.select("id", "name", "path"), "id")


def impact(g: Graph, seeds: DataFrame, depth: int = 3, most: int = 50) -> DataFrame:
    """(direction, id, hops): callers and callees outside the seeds, nearest first, at most `most` in each direction."""
    found = None
    for direction, edges in (("callers", reversed_edges(g.calls)), ("callees", g.calls)):
        rows = within(seeds, edges, depth, 1).join(seeds.select("id"), "id", "left_anti")
        rows = top(rows, most, "hops", "id").select(F.lit(direction).alias("direction"), "id", "hops")
        found = rows if found is None else found.union(rows)
    return found


@on_graph("""+d AS (SELECT dst AS id, 1 AS hops FROM calls WHERE src BETWEEN 10 AND 14 UNION ALL SELECT DISTINCT c.dst, hops + 1 FROM d JOIN calls c ON c.src = d.id WHERE hops < 3),
u AS (SELECT src AS id, 1 AS hops FROM calls WHERE dst BETWEEN 10 AND 14 UNION ALL SELECT DISTINCT c.src, hops + 1 FROM u JOIN calls c ON c.dst = u.id WHERE hops < 3)
(SELECT 'callees' AS direction, id, min(hops) AS hops FROM d WHERE id NOT BETWEEN 10 AND 14 GROUP BY id ORDER BY hops, id LIMIT 50)
UNION ALL (SELECT 'callers', id, min(hops) AS hops FROM u WHERE id NOT BETWEEN 10 AND 14 GROUP BY id ORDER BY hops, id LIMIT 50)""")
def impact_hops(g: Graph) -> DataFrame:
    return impact(g, seeds_of(g, 10, 14))


def call_tree(seeds: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(src, dst, depth): edges of the forward tree. An edge counts if it leads to a node that no earlier level has; edges within a level and back are dropped."""
    level = within(seeds, edges, depth)
    edges = edges.select("src", "dst").distinct()
    rows = edges.join(level.select(F.col("id").alias("src"), F.col("hops").alias("from")), "src").join(level.select(F.col("id").alias("dst"), F.col("hops").alias("depth")), "dst")
    return rows.filter(F.col("depth") == F.col("from") + 1).select("src", "dst", "depth")


@on_graph("""+r AS (SELECT id, 0 AS hops FROM functions WHERE id BETWEEN 30 AND 40 UNION ALL SELECT DISTINCT c.dst, r.hops + 1 FROM r JOIN calls c ON c.src = r.id WHERE r.hops < 4),
l AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)
SELECT c.src, c.dst, b.hops AS depth FROM calls c JOIN l a ON a.id = c.src JOIN l b ON b.id = c.dst WHERE b.hops = a.hops + 1""")
def execution_flow(g: Graph) -> DataFrame:
    return call_tree(seeds_of(g, 30, 40), g.calls)


@on_graph("""+r AS (SELECT id, 0 AS hops FROM functions WHERE id BETWEEN 30 AND 40 UNION ALL SELECT DISTINCT c.dst, r.hops + 1 FROM r JOIN calls c ON c.src = r.id WHERE r.hops < 4)
SELECT hops AS depth, count(*) AS n FROM (SELECT id, min(hops) AS hops FROM r GROUP BY id) GROUP BY hops""")
def depth_histogram(g: Graph) -> DataFrame:
    return within(seeds_of(g, 30, 40), g.calls, 4).groupBy(F.col("hops").alias("depth")).agg(F.count("*").alias("n"))


def neighbourhood(g: Graph, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(category, id): callers, then callees, then imported modules; each id in the first category that has it, seeds in none."""
    callers = within(seeds, reversed_edges(g.calls), depth, 1).select(F.lit(0).alias("rank"), F.lit("caller").alias("category"), "id")
    callees = within(seeds, g.calls, depth, 1).select(F.lit(1), F.lit("callee"), "id")
    first = Window.partitionBy("id").orderBy("rank")
    own = callers.union(callees).join(seeds.select("id"), "id", "left_anti").withColumn("k", F.row_number().over(first)).filter("k = 1").select("category", "id")
    files = g.functions.join(seeds.select("id"), "id", "left_semi").select("path").distinct()
    return own.union(g.imports.join(files, "path", "left_semi").select(F.lit("import").alias("category"), F.col("module_id").alias("id")).distinct())


@on_graph("""SELECT category, id FROM (SELECT 'caller' AS category, src AS id FROM calls WHERE dst BETWEEN 50 AND 55 UNION SELECT 'callee', dst FROM calls WHERE src BETWEEN 50 AND 55 AND dst NOT IN (SELECT src FROM calls WHERE dst BETWEEN 50 AND 55)) WHERE id NOT BETWEEN 50 AND 55
UNION ALL SELECT DISTINCT 'import', module_id FROM imports WHERE path IN (SELECT path FROM functions WHERE id BETWEEN 50 AND 55)""")
def seed_neighbourhood(g: Graph) -> DataFrame:
    return neighbourhood(g, seeds_of(g, 50, 55))


@on_graph("""SELECT DISTINCT id FROM (SELECT src AS id FROM calls WHERE dst BETWEEN 60 AND 70 UNION SELECT dst FROM calls WHERE src BETWEEN 60 AND 70) WHERE id NOT BETWEEN 60 AND 70""")
def neighbours(g: Graph) -> DataFrame:
    seeds = seeds_of(g, 60, 70)
    return hop(seeds, g.calls).union(hop(seeds, reversed_edges(g.calls))).distinct().join(seeds, "id", "left_anti")


@on_graph("SELECT dst AS id, count(*) AS degree FROM calls GROUP BY dst")
def in_degree(g: Graph) -> DataFrame:
    return g.calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


#: The longest chain that is followed, as by the query language of property graphs: what bounds a cycle.
LONGEST_CHAIN = 30


def inheritance_depth(g: Graph, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(id, depth): the longest chain of bases from a class to a root, a class without bases. From the roots downwards, each level the distinct children of the one above, so that several bases multiply no rows; classes that only a cycle holds have no root and no row."""
    edges = checkpoint(g.inherits.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct())
    level = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    levels = []
    for depth in range(1, longest + 1):
        level = checkpoint(hop(level, edges))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
    found = union_of(levels) if levels else level.withColumn("depth", F.lit(0))
    return found.groupBy("id").agg(F.max("depth").alias("depth"))


@on_graph("""+h AS (SELECT DISTINCT child, parent FROM inherits), r AS (SELECT DISTINCT child AS id, 1 AS depth FROM h WHERE parent NOT IN (SELECT child FROM h) UNION SELECT h.child, depth + 1 FROM r JOIN h ON h.parent = r.id WHERE depth < 30)
SELECT id, max(depth) AS depth FROM r GROUP BY id""")
def class_depth(g: Graph) -> DataFrame:
    return inheritance_depth(g)


@on_tables("""SELECT r_regionkey AS repository, count(DISTINCT n_nationkey) AS directories, count(DISTINCT c_custkey) AS files, count(DISTINCT o_orderkey) AS classes, count(l_orderkey) AS functions
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_regionkey""")
def repo_stats(spark, sf_dir):
    """Contents of each repository along the containment chain. Each level is counted below its own parent before it moves up, so no join multiplies rows."""

    def t(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    per_order = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("functions"))
    per_customer = t("orders").select("o_orderkey", "o_custkey").join(per_order, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("classes"), F.sum("functions").alias("functions"))
    per_nation = t("customer").select("c_custkey", "c_nationkey").join(per_customer, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files"), F.sum("classes").alias("classes"), F.sum("functions").alias("functions"))
    rows = t("nation").join(per_nation, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("repository"))
    return rows.agg(F.count("*").alias("directories"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "classes", "functions")))


def orphans(nodes: DataFrame, contains: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no chain of containment leads to from a root."""
    return nodes.select("id").join(roots.select("id"), "id", "left_anti").join(reach(roots, contains), "id", "left_anti")


@on_tables("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphan_nodes(spark, sf_dir):
    """Customers that no large order leads to."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 300000").select((-F.col("o_orderkey") - 1).alias("src"), F.col("o_custkey").alias("dst"))
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return orphans(files, orders, orders.select(F.col("src").alias("id")))


@on_graph("""SELECT src, dst FROM calls WHERE src BETWEEN 100 AND 130 AND dst <> src
UNION ALL SELECT a.src, b.dst FROM calls a JOIN calls b ON b.src = a.dst WHERE a.src BETWEEN 100 AND 130""")
def two_step_paths(g: Graph) -> DataFrame:
    one = g.calls.filter(F.col("src").between(100, 130))
    return one.union(one.withColumnRenamed("dst", "via").join(g.calls.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst"))

