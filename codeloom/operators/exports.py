"""Graphs for views, sub-graphs, the multigraph of calls and likeness, full text, listings and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..registry import on_both, on_graph, on_tables
from .graph import Graph, checkpoint, reach, top

EXPORT_LIMIT = 500


def nodes(g: Graph) -> DataFrame:
    """(label, uid, name, path, line): all nodes of the graph, uid with its label so that two labels never clash."""
    files = g.functions.select("path").union(g.classes.select("path")).union(g.variables.select("path")).union(g.imports.select("path")).distinct()
    parts = [files.select(F.lit("File").alias("label"), F.concat(F.lit("file:"), "path").alias("uid"), fn.basename(F.col("path")).alias("name"), "path", F.lit(0).cast("long").alias("line"))]
    parts.append(g.modules.select(F.lit("Module"), F.concat(F.lit("module:"), F.col("id").cast("string")), "name", F.lit(""), F.lit(0).cast("long")))
    for label, rows in (("Class", g.classes), ("Function", g.functions), ("Variable", g.variables)):
        parts.append(rows.select(F.lit(label), F.concat(F.lit(f"{label.lower()}:"), F.col("id").cast("string")), "name", "path", F.col("line_number").cast("long")))
    return reduce(DataFrame.union, parts)


def uid(label: str, column: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))


def edges(g: Graph) -> DataFrame:
    """(type, src, dst): calls of functions and classes, imports, bases, and what files and classes contain."""
    parts = [
        g.calls.select(F.lit("CALLS").alias("type"), uid("function", "src").alias("src"), uid("function", "dst").alias("dst")),
        g.class_calls.select(F.lit("CALLS"), uid("function", "src"), uid("class", "dst")),
        g.imports.select(F.lit("IMPORTS"), uid("file", "path"), uid("module", "module_id")),
        g.inherits.select(F.lit("INHERITS"), uid("class", "child"), uid("class", "parent")),
        g.methods.select(F.lit("CONTAINS"), uid("class", "class_id"), uid("function", "function_id")),
        *(rows.select(F.lit("CONTAINS"), uid("file", "path"), uid(label, "id")) for label, rows in (("function", g.functions), ("class", g.classes), ("variable", g.variables))),
    ]
    return reduce(DataFrame.union, parts)


def export(g: Graph, limit: int = EXPORT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The first nodes of each label and the first edges of each type, of these only edges with both ends among the nodes."""
    every = nodes(g)
    kept = reduce(DataFrame.union, [top(every.filter(F.col("label") == label), limit, "uid") for label in ("File", "Module", "Class", "Function", "Variable")])
    lines = edges(g)
    drawn = reduce(DataFrame.union, [top(lines.filter(F.col("type") == kind), limit, "src", "dst") for kind in ("CONTAINS", "CALLS", "IMPORTS", "INHERITS")])
    return kept, between(drawn, kept)


def between(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return lines.join(kept.select(F.col("uid").alias("src")), "src", "left_semi").join(kept.select(F.col("uid").alias("dst")), "dst", "left_semi").select("type", "src", "dst")


def repository(g: Graph, folder: str) -> tuple[DataFrame, DataFrame]:
    """All nodes that the files below a folder contain, at any depth, and all edges that leave them."""
    lines = edges(g)
    contains = lines.filter("type = 'CONTAINS'").select("src", "dst")
    seeds = nodes(g).filter((F.col("label") == "File") & F.col("path").startswith(folder)).select(F.col("uid").alias("id"))
    inside = reach(seeds, contains).union(seeds).distinct().withColumnRenamed("id", "uid")
    return nodes(g).join(inside, "uid", "left_semi"), lines.join(inside.withColumnRenamed("uid", "src"), "src", "left_semi")


_NODES = """listed AS (SELECT path FROM functions UNION SELECT path FROM classes UNION SELECT path FROM variables UNION SELECT path FROM imports),
nodes AS (SELECT 'File' AS label, 'file:' || path AS uid, regexp_extract(path, '[^/]*$') AS name, path, 0::BIGINT AS line FROM listed UNION ALL SELECT 'Module', 'module:' || id, name, '', 0 FROM modules
UNION ALL SELECT 'Class', 'class:' || id, name, path, line_number FROM classes UNION ALL SELECT 'Function', 'function:' || id, name, path, line_number FROM functions UNION ALL SELECT 'Variable', 'variable:' || id, name, path, line_number FROM variables),
edges AS (SELECT 'CALLS' AS type, 'function:' || src AS src, 'function:' || dst AS dst FROM calls UNION ALL SELECT 'CALLS', 'function:' || src, 'class:' || dst FROM class_calls UNION ALL SELECT 'IMPORTS', 'file:' || path, 'module:' || module_id FROM imports
UNION ALL SELECT 'INHERITS', 'class:' || child, 'class:' || parent FROM inherits UNION ALL SELECT 'CONTAINS', 'class:' || class_id, 'function:' || function_id FROM methods
UNION ALL SELECT 'CONTAINS', 'file:' || path, 'function:' || id FROM functions UNION ALL SELECT 'CONTAINS', 'file:' || path, 'class:' || id FROM classes UNION ALL SELECT 'CONTAINS', 'file:' || path, 'variable:' || id FROM variables)"""
_EXPORT = f"""+{_NODES}, kept AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY label ORDER BY uid) <= 500), drawn AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY type ORDER BY src, dst) <= 500)"""


@on_graph(f"{_EXPORT} SELECT * FROM kept")
def export_nodes(g: Graph) -> DataFrame:
    return export(g)[0]


@on_graph(f"{_EXPORT} SELECT * FROM drawn WHERE src IN (SELECT uid FROM kept) AND dst IN (SELECT uid FROM kept)")
def export_edges(g: Graph) -> DataFrame:
    return export(g)[1]


_INSIDE = f"""+{_NODES}, inside AS (SELECT uid FROM nodes WHERE label = 'File' AND starts_with(path, '/src/brand_13') UNION SELECT e.dst FROM inside i JOIN edges e ON e.src = i.uid AND e.type = 'CONTAINS')"""


@on_graph(f"{_INSIDE} SELECT * FROM nodes WHERE uid IN (SELECT uid FROM inside)")
def repository_nodes(g: Graph) -> DataFrame:
    return repository(g, "/src/brand_13")[0]


@on_graph(f"{_INSIDE} SELECT * FROM edges WHERE src IN (SELECT uid FROM inside)")
def repository_edges(g: Graph) -> DataFrame:
    return repository(g, "/src/brand_13")[1]


def any_callers(g: Graph, name: str, path: str | None = None) -> DataFrame:
    """(label, uid, name, path, called): who calls a function or class of this name, in a file if given; where no such call is known in that file, those of the name in any file."""
    every = nodes(g)
    calls = edges(g).filter("type = 'CALLS'")
    wanted = every.filter(F.col("label").isin("Function", "Class") & (F.col("name") == name))
    here = wanted.filter(F.col("path") == path) if path is not None else wanted
    if path is not None and calls.join(here.select(F.col("uid").alias("dst")), "dst", "left_semi").isEmpty():
        here = wanted
    met = calls.join(here.select(F.col("uid").alias("dst"), F.col("path").alias("called")), "dst").select(F.col("src").alias("uid"), "called")
    return every.filter(F.col("label").isin("Function", "Class", "File")).join(met, "uid").select("label", "uid", "name", "path", "called").distinct()


@on_graph(f"+{_NODES} SELECT DISTINCT n.label, n.uid, n.name, n.path, t.path AS called FROM nodes t JOIN edges e ON e.dst = t.uid AND e.type = 'CALLS' JOIN nodes n ON n.uid = e.src WHERE t.label IN ('Function', 'Class') AND t.name = 'hot bolt' AND n.label IN ('Function', 'Class', 'File')")
def callers_by_name(g: Graph) -> DataFrame:
    return any_callers(g, "hot bolt", "/src/nowhere.py")


@on_graph(f"+{_NODES} SELECT DISTINCT n.label, n.uid, n.name, n.path, t.path AS called FROM nodes t JOIN edges e ON e.dst = t.uid AND e.type = 'CALLS' JOIN nodes n ON n.uid = e.src WHERE t.label IN ('Function', 'Class') AND t.name = 'Customer#000000003' AND n.label IN ('Function', 'Class', 'File')")
def callers_of_class(g: Graph) -> DataFrame:
    return any_callers(g, "Customer#000000003")


def most_called(g: Graph, rows: DataFrame, most: int = 50) -> DataFrame:
    """The `most` functions (id) of a set that the most calls lead to; of equals the first by id. Those without calls count 0."""
    degree = g.calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return top(rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), most, F.desc("degree"), "id")


@on_graph("SELECT id, count(c.dst) AS degree FROM functions f LEFT JOIN calls c ON c.dst = f.id WHERE starts_with(path, '/src/brand_1') GROUP BY id ORDER BY degree DESC, id LIMIT 50")
def truncated_by_degree(g: Graph) -> DataFrame:
    return most_called(g, g.functions.filter(F.col("path").startswith("/src/brand_1")).select("id"))


def combined(g: Graph, vectors: DataFrame, least: float = 0.85) -> DataFrame:
    """(src, dst, type, provenance, confidence): calls and imports as they were extracted, and functions whose vectors (id, embedding) are alike, as inferred. One multigraph: two nodes may have several edges."""
    from .vectors import similar_pairs

    structural = edges(g).filter("type in ('CALLS', 'IMPORTS')").select("src", "dst", "type", F.lit("extracted").alias("provenance"), F.lit(1.0).alias("confidence"))
    alike = similar_pairs(vectors.select(F.col("id").alias("vec_id"), "embedding"), least, single=True)
    alike = alike.select(uid("function", "a"), uid("function", "b"), F.lit("SEMANTICALLY_SIMILAR"), F.lit("inferred"), F.round("similarity", 4))
    return structural.union(alike)


_COSINE = "list_dot_product(a.embedding, b.embedding) / greatest(sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding)), 1e-300)"


@on_both(f"""+{_NODES}, alike AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 0)
SELECT src, dst, type, 'extracted' AS provenance, 1.0::DOUBLE AS confidence FROM edges WHERE type IN ('CALLS', 'IMPORTS') UNION ALL SELECT 'function:' || a, 'function:' || b, 'SEMANTICALLY_SIMILAR', 'inferred', round(s, 4) FROM alike WHERE s > 0.3""")
def combined_graph(g: Graph, spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the vectors of even ids, which stand for functions that have one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 2 = 0")
    return combined(g, rows.select(F.col("vec_id").alias("id"), "embedding"), 0.3)


def full_text(docs: DataFrame, query: str, most: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): the documents (id, text) that hold some word of the query, by BM25. One pass counts the query's words in each document; frequencies are sums over all of them."""
    wanted = sorted(set(query.lower().split()))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9_]+"), lambda w: w != "")
    counted = docs.select("id", words.alias("words"))
    counted = counted.select("id", F.size("words").alias("n"), *((F.size("words") - F.size(F.array_remove("words", x))).alias(f"c{k}") for k, x in enumerate(wanted)))
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"d{k}") for k in range(len(wanted))))
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log1p((F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        score += idf * F.col(f"c{k}") * (k1 + 1) / (F.col(f"c{k}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hits = counted.filter(reduce(lambda x, y: x | y, (F.col(f"c{k}") > 0 for k in range(len(wanted))), F.lit(False))).join(F.broadcast(totals), F.lit(True))
    return top(hits.select("id", F.round(score, 6).alias("score")), most, F.desc("score"), "id")


@on_graph("""+w AS (SELECT id, list_filter(regexp_split_to_array(lower(source), '[^a-z0-9_]+'), lambda x: x <> '') AS words FROM functions),
c AS (SELECT id, len(words) AS n, len(list_filter(words, lambda x: x = 'hot')) AS h, len(list_filter(words, lambda x: x = 'promo')) AS p FROM w),
t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (h > 0) AS dh, count(*) FILTER (p > 0) AS dp FROM c)
SELECT id, round(ln(1 + (docs - dh + 0.5) / (dh + 0.5)) * h * 2.2 / (h + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - dp + 0.5) / (dp + 0.5)) * p * 2.2 / (p + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, t WHERE h > 0 OR p > 0 ORDER BY score DESC, id LIMIT 20""")
def full_text_search(g: Graph) -> DataFrame:
    return full_text(g.functions.select("id", F.col("source").alias("text")), "promo hot")


def snapshot(g: Graph, vectors: DataFrame) -> DataFrame:
    """(part, label, n, percent): nodes of each label, edges of each type, and of functions those that have a vector (id), with their share."""
    by_label = nodes(g).groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "label", "n", F.lit(None).cast("double").alias("percent"))
    lines = edges(g).select("type").union(g.parameters.select(F.lit("HAS_PARAMETER"))).union(g.holders.select(F.lit("CONTAINS")))
    by_type = lines.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge"), "type", "n", F.lit(None).cast("double"))
    marked = g.functions.select("id").join(vectors.select("id").distinct().withColumn("has", F.lit(True)), "id", "left")
    covered = marked.agg(F.count("has").alias("n"), F.count("*").alias("of")).select(F.lit("embedded"), F.lit("Function"), "n", F.when(F.col("of") == 0, 0.0).otherwise(F.round(F.col("n") * 100.0 / F.col("of"), 1)))
    return by_label.union(by_type).union(covered)


@on_both(f"""+{_NODES}, lines AS (SELECT type FROM edges UNION ALL SELECT 'HAS_PARAMETER' FROM parameters UNION ALL SELECT 'CONTAINS' FROM holders)
SELECT 'node' AS part, label, count(*) AS n, NULL::DOUBLE AS percent FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*), NULL FROM lines GROUP BY type
UNION ALL SELECT 'embedded', 'Function', count(*) FILTER (id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)), round(count(*) FILTER (id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)) * 100.0::DOUBLE / count(*), 1) FROM functions""")
def graph_snapshot(g: Graph, spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(g, spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id")))


def drifted(g: Graph, files: DataFrame, since: str) -> DataFrame:
    """(path, changed, via): other files that an edge of any type, either way, joins to something in these files (path), and that changed since a time: how often, and by which types."""
    own = nodes(g).join(files.select("path").distinct(), "path", "left_semi").select("uid")
    lines = edges(g)
    ways = lines.union(lines.select("type", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = ways.join(own.withColumnRenamed("uid", "src"), "src", "left_semi").select("type", F.col("dst").alias("uid")).distinct()
    near = near.join(nodes(g).select("uid", "path"), "uid").join(files.select("path").distinct(), "path", "left_anti")
    near = near.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("via"))
    recent = g.changes.filter(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("path").agg(F.count("*").alias("changed"))
    return near.join(recent, "path").select("path", "changed", "via")


@on_graph(f"""+{_NODES}, own AS (SELECT uid FROM nodes WHERE path IN ('/src/brand_13/promo.py', '/src/automobile/models.py')), ways AS (SELECT type, src, dst FROM edges UNION ALL SELECT type, dst, src FROM edges),
near AS (SELECT DISTINCT type, path FROM ways JOIN nodes ON uid = dst WHERE src IN (SELECT uid FROM own) AND path NOT IN ('/src/brand_13/promo.py', '/src/automobile/models.py'))
SELECT path, changed, via FROM (SELECT path, string_agg(type, ',' ORDER BY type) AS via FROM near GROUP BY path) JOIN (SELECT path, count(*) AS changed FROM changes WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY path) USING (path)""")
def drift_all_edges(g: Graph) -> DataFrame:
    files = g.functions.sparkSession.createDataFrame([("/src/brand_13/promo.py",), ("/src/automobile/models.py",)], "path string")
    return drifted(g, files, "2024-01-20 00:00:00")


def checks(g: Graph, vectors: DataFrame | None = None) -> DataFrame:
    """(check, ok, count): whether there are functions, calls and embeddings to answer from."""
    parts = [("functions", g.functions), ("classes", g.classes), ("calls", g.calls)]
    if vectors is not None:
        parts.append(("embeddings", vectors))
    rows = reduce(DataFrame.union, [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("check"), "count") for name, df in parts])
    return rows.select("check", (F.col("count") > 0).alias("ok"), "count")


@on_graph("SELECT 'functions' AS \"check\", count(*) > 0 AS ok, count(*) AS count FROM functions UNION ALL SELECT 'classes', count(*) > 0, count(*) FROM classes UNION ALL SELECT 'calls', count(*) > 0, count(*) FROM calls")
def doctor(g: Graph) -> DataFrame:
    return checks(g)


#: What a listing of C and C++ elements shows.
LISTINGS = ("function", "class", "import", "struct", "enum", "union", "macro", "variable")


def listing(elements: DataFrame, kind: str) -> DataFrame:
    """(name, path, line_number): the elements of a kind in C and C++ files, by path and line."""
    if kind.rstrip("s") not in {x.rstrip("s") for x in LISTINGS}:
        raise ValueError(f"unknown kind {kind}; one of {', '.join(LISTINGS)}")
    mine = F.regexp_extract("path", r"\.([^.]+)$", 1).isin("c", "h", "cpp", "hpp", "hh")
    rows = elements.filter(mine & (F.col("kind") == next(x for x in LISTINGS if x.rstrip("s") == kind.rstrip("s"))))
    return rows.select("name", "path", "line_number").orderBy("path", "line_number")


def null_last(*columns: str) -> list[Column]:
    """Sort keys of text with nulls as empty text, as an application that sorts `x or ""` has them."""
    return [F.coalesce(F.col(c), F.lit("")).asc() for c in columns]


@on_tables("SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, doc_id FROM documents ORDER BY coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, ''), doc_id LIMIT 30")
def sorted_with_nulls(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), "doc_id")
    return rows.orderBy(*null_last("lang"), "doc_id").limit(30)


def payload(g: Graph, files: list[str], locks: DataFrame | None = None, lane: str | None = None, depth: int = 5, most: int = 50) -> DataFrame:
    """(bucket, id, name, path, hops, truncated): what a change of files touches: their functions, transitive callers and callees outside them, imported modules, and locks of other lanes. Each bucket keeps its `most` most called functions, and says how many it left out."""
    from ..plans.commands import lock_overlaps
    from .graph import reversed_edges, within

    seeds = checkpoint(g.functions.filter(F.col("path").isin(*files)).select("id", "name", "path"))
    calls = checkpoint(g.calls.select("src", "dst").distinct())
    found = None
    for bucket, lines in (("touched", None), ("callers", reversed_edges(calls)), ("callees", calls)):
        rows = seeds.select("id", F.lit(0).alias("hops")) if lines is None else within(seeds, lines, depth, 1).join(seeds.select("id"), "id", "left_anti")
        rows = checkpoint(rows)
        left_out = max(0, rows.count() - most)
        kept = most_called(g, rows, most).join(g.functions.select("id", "name", "path"), "id")
        one = kept.select(F.lit(bucket).alias("bucket"), "id", "name", "path", "hops", F.lit(left_out).cast("long").alias("truncated"))
        found = one if found is None else found.union(one)
    modules = g.imports.filter(F.col("path").isin(*files)).select(F.split_part("imported_name", F.lit("."), F.lit(1)).alias("name")).distinct()
    found = found.union(modules.select(F.lit("modules"), F.lit(None).cast("long"), "name", F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0).cast("long")))
    if locks is not None:
        paths = g.functions.sparkSession.createDataFrame([(f,) for f in files], "path string")
        held = lock_overlaps(paths, locks, lane or "")
        found = found.union(held.select(F.lit("locks"), F.lit(None).cast("long"), F.col("lane"), F.col("locked"), F.lit(None).cast("int"), F.lit(0).cast("long")).distinct())
    return found


_FILES = ("/src/brand_13/promo.py", "/src/brand_13/small.py")


@on_graph(f"""+s AS (SELECT id FROM functions WHERE path IN {_FILES}),
d AS (SELECT id, 0 AS hops FROM s UNION SELECT c.dst, hops + 1 FROM d JOIN calls c ON c.src = d.id WHERE hops < 5), u AS (SELECT id, 0 AS hops FROM s UNION SELECT c.src, hops + 1 FROM u JOIN calls c ON c.dst = u.id WHERE hops < 5),
b AS (SELECT 'touched' AS bucket, id, 0 AS hops FROM s UNION ALL SELECT 'callees', id, min(hops) FROM d WHERE id NOT IN (SELECT id FROM s) GROUP BY id UNION ALL SELECT 'callers', id, min(hops) FROM u WHERE id NOT IN (SELECT id FROM s) GROUP BY id),
r AS (SELECT b.*, (SELECT count(*) FROM calls WHERE dst = b.id) AS degree, greatest(count(*) OVER (PARTITION BY bucket) - 50, 0) AS truncated FROM b)
SELECT bucket, r.id, name, path, hops, truncated FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY degree DESC, id) <= 50) r JOIN functions f ON f.id = r.id
UNION ALL SELECT DISTINCT 'modules', NULL::BIGINT, split_part(imported_name, '.', 1), NULL, NULL::INTEGER, 0 FROM imports WHERE path IN {_FILES}""")
def blast_radius_payload(g: Graph) -> DataFrame:
    return payload(g, list(_FILES))
