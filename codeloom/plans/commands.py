"""Reports for agents: change impact, hotspots, entry points, drift and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.graph import Graph, hop, reversed_edges, top
from ..operators.search import nodes
from ..operators.traversal import seeds_of
from ..registry import on_graph, on_tables

#: Decorator leaf -> (framework, category, base score). Fixed values.
FRAMEWORKS = {
    "route": ("flask", "http", 5.0), "get": ("fastapi", "http", 5.0), "post": ("fastapi", "http", 5.0), "put": ("fastapi", "http", 5.0), "delete": ("fastapi", "http", 5.0), "patch": ("fastapi", "http", 5.0), "websocket": ("fastapi", "http", 5.0),
    "api_view": ("django", "http", 5.0), "command": ("click", "cli", 4.0), "group": ("click", "cli", 4.0), "callback": ("typer", "cli", 4.0), "task": ("celery", "task", 3.0), "shared_task": ("celery", "task", 3.0), "fixture": ("pytest", "test", 1.0), "parametrize": ("pytest", "test", 1.0),
}


def hotspots_of(changes: DataFrame, functions: DataFrame, calls: DataFrame, n: int = 15) -> DataFrame:
    """Files by changes times calls from anywhere; risk is the share of the highest, in percent."""
    churn = changes.groupBy("path").agg(F.count("*").alias("commits"))
    degree = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    central = functions.select("id", "path").join(degree, "id").groupBy("path").agg(F.sum("degree").alias("centrality"))
    rows = churn.join(central, "path").withColumn("raw", F.col("commits") * F.col("centrality"))
    most = rows.agg(F.max("raw").alias("most"))
    return top(rows.join(F.broadcast(most), F.lit(True)).select("path", "commits", "centrality", F.round(F.col("raw") / F.col("most") * 100, 1).alias("risk")), n, F.desc("risk"), "path")


@on_graph("""+k AS (SELECT path, count(*) AS commits FROM changes GROUP BY path), d AS (SELECT f.path, CAST(count(*) AS BIGINT) AS centrality FROM calls c JOIN functions f ON f.id = c.dst GROUP BY f.path), m AS (SELECT path, commits, centrality, commits * centrality AS raw FROM k JOIN d USING (path))
SELECT path, commits, centrality, round(raw / (SELECT max(raw) FROM m) * 100, 1) AS risk FROM m ORDER BY risk DESC, path LIMIT 15""")
def hotspots(g: Graph) -> DataFrame:
    return hotspots_of(g.changes, g.functions, g.calls)


def full_name(decorator: Column) -> Column:
    """A decorator without its mark and arguments."""
    return F.trim(F.substring_index(F.ltrim(F.trim(decorator), F.lit("@ ")), "(", 1))


def classified(functions: DataFrame) -> DataFrame:
    """Functions that one of their decorators registers with a framework: framework, category and base score of the highest, the first of equals, and all decorators that do (matched)."""
    table = F.create_map(*[x for k, v in FRAMEWORKS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("framework"), F.lit(v[1]).alias("category"), F.lit(v[2]).alias("base")))])

    def role(name: Column) -> Column:
        return F.try_element_at(table, F.substring_index(name, ".", -1))

    known = F.filter(F.transform("decorators", full_name), lambda name: role(name).isNotNull())
    rows = functions.withColumn("matched", F.array_distinct(known)).filter("size(matched) > 0").withColumn("roles", F.transform("matched", role))
    highest = F.array_max(F.transform("roles", lambda r: r["base"]))
    return rows.withColumn("role", F.get(F.filter("roles", lambda r: r["base"] == highest), F.lit(0))).select("*", "role.*").drop("role", "roles")


@on_graph("""SELECT id, name, framework, score FROM (SELECT f.id, f.name, t.framework, coalesce(d.n, 0) AS n, round(t.base + least(coalesce(d.n, 0), 20) * 0.25, 2) AS score FROM functions f
JOIN (VALUES ('@app.route(''/x'')', 'flask', 5.0::DOUBLE), ('@click.command()', 'click', 4.0), ('@celery.task', 'celery', 3.0), ('@pytest.fixture', 'pytest', 1.0)) t(decorator, framework, base) USING (decorator)
LEFT JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY dst) d ON d.dst = f.id WHERE NOT f.is_dependency) ORDER BY score DESC, n DESC, name, id LIMIT 20""")
def entrypoints(g: Graph) -> DataFrame:
    degree = g.calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    rows = classified(g.functions.filter("not is_dependency")).join(degree, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("score", F.round(F.col("base") + F.least("n", F.lit(20)) * 0.25, 2))
    return top(rows, 20, F.desc("score"), F.desc("n"), "name", "id").select("id", "name", "framework", "score")


@on_graph("""SELECT 'Function' AS label, count(*) AS n FROM functions UNION ALL SELECT 'Class', count(*) FROM classes UNION ALL SELECT 'Variable', count(*) FROM variables UNION ALL SELECT 'Module', count(*) FROM modules
UNION ALL SELECT 'CALLS', count(*) FROM calls UNION ALL SELECT 'IMPORTS', count(*) FROM imports UNION ALL SELECT 'INHERITS', count(*) FROM inherits UNION ALL SELECT 'HAS_PARAMETER', count(*) FROM parameters""")
def snapshot_counts(g: Graph) -> DataFrame:
    edges = None
    for label, rows in (("CALLS", g.calls), ("IMPORTS", g.imports), ("INHERITS", g.inherits), ("HAS_PARAMETER", g.parameters)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        edges = one if edges is None else edges.union(one)
    return nodes(g).groupBy("label").agg(F.count("*").alias("n")).union(edges)


@on_graph("""SELECT DISTINCT f.path, h.changed FROM (SELECT src AS id FROM calls WHERE dst BETWEEN 0 AND 40 UNION SELECT dst FROM calls WHERE src BETWEEN 0 AND 40) n JOIN functions f USING (id)
JOIN (SELECT path, count(*) AS changed FROM changes WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY path) h USING (path) WHERE id NOT BETWEEN 0 AND 40""")
def drift(g: Graph) -> DataFrame:
    """Files of neighbours of the seeds that changed since a time."""
    seeds = seeds_of(g, 0, 40)
    near = hop(seeds, g.calls).union(hop(seeds, reversed_edges(g.calls))).distinct().join(seeds, "id", "left_anti")
    recent = g.changes.filter(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp")).groupBy("path").agg(F.count("*").alias("changed"))
    return g.functions.join(near, "id", "left_semi").select("path").distinct().join(recent, "path")


@on_graph("""SELECT f.id, f.name, NOT EXISTS (SELECT 1 FROM calls c JOIN functions s ON s.id = c.src WHERE c.dst = f.id AND contains(s.path, '/promo')) AS untested FROM functions f WHERE f.path IN (SELECT path FROM changes WHERE kind = 'error' AND ts < TIMESTAMP '2024-01-02 00:00:00')""")
def untested_touched(g: Graph) -> DataFrame:
    """Functions in changed files, and whether no test calls them (here: no promo file)."""
    files = g.changes.filter((F.col("kind") == "error") & (F.col("ts") < F.lit("2024-01-02 00:00:00").cast("timestamp"))).select("path").distinct()
    tests = g.functions.filter(F.col("path").contains("/promo")).select(F.col("id").alias("src"))
    tested = g.calls.join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("tested", F.lit(True))
    return g.functions.join(files, "path", "left_semi").join(tested, "id", "left").select("id", "name", F.col("tested").isNull().alias("untested"))


def lock_overlaps(paths: DataFrame, locks: DataFrame, lane: str) -> DataFrame:
    """(lane, locked, path): files at or below a path that another lane has locked. Meets by directories above the file, an equality join."""
    path = F.split_part("path", F.lit(":"), F.lit(1))
    places = paths.select("path", F.explode(F.array_append(fn.ancestors(path), path)).alias("locked"))
    return places.join(locks.filter(F.col("lane") != lane), "locked").select("lane", "locked", "path").distinct()


@on_graph("""SELECT DISTINCT l.lane, l.locked, f.path FROM functions f JOIN (VALUES ('a', '/src/brand_13'), ('b', '/src/brand_13/promo.py'), ('c', '/src/brand_1')) l(lane, locked) ON f.path = l.locked OR starts_with(f.path, l.locked || '/') WHERE l.lane <> 'c'""")
def lock_overlap(g: Graph) -> DataFrame:
    locks = g.functions.sparkSession.createDataFrame([("a", "/src/brand_13"), ("b", "/src/brand_13/promo.py"), ("c", "/src/brand_1")], "lane string, locked string")
    return lock_overlaps(g.functions.select("path").distinct(), locks, "c")


@on_graph("""SELECT DISTINCT i.imported_name, split_part(m.full_import_name, '.', 1) AS top_level FROM imports i JOIN modules m ON m.id = i.module_id WHERE i.path IN (SELECT path FROM functions WHERE id < 5)""")
def touched_modules(g: Graph) -> DataFrame:
    files = g.functions.filter("id < 5").select("path").distinct()
    rows = g.imports.join(files, "path", "left_semi").join(g.modules.select(F.col("id").alias("module_id"), "full_import_name"), "module_id")
    return rows.select("imported_name", F.split_part("full_import_name", F.lit("."), F.lit(1)).alias("top_level")).distinct()


@on_graph("""SELECT name, count(*) AS definitions, count(DISTINCT path) AS files, min(id) AS first_id FROM functions GROUP BY name HAVING count(*) > 1""")
def duplicate_names(g: Graph) -> DataFrame:
    return g.functions.groupBy("name").agg(F.count("*").alias("definitions"), F.count_distinct("path").alias("files"), F.min("id").alias("first_id")).filter("definitions > 1")


def replay(events: DataFrame) -> DataFrame:
    """Tokens of review packets against raw diffs, four characters a token, over events that have both."""
    packet, raw = F.floor(F.col("packet_chars") / 4), F.floor(F.col("raw_chars") / 4)
    both = (F.col("packet_chars") > 0) & (F.col("raw_chars") > 0)
    rows = events.agg(F.sum(F.when(both, packet)).alias("packet_tokens"), F.sum(F.when(both, raw)).alias("raw_tokens"), F.count_if(both).alias("comparable"))
    return rows.withColumn("reduction", F.round(100 - F.col("packet_tokens") / F.col("raw_tokens") * 100, 2))


@on_tables("""SELECT CAST(sum(value // 4) FILTER (WHERE value > 0 AND k > 0) AS BIGINT) AS packet_tokens, CAST(sum(k * 100 // 4) FILTER (WHERE value > 0 AND k > 0) AS BIGINT) AS raw_tokens, count(*) FILTER (WHERE value > 0 AND k > 0) AS comparable,
round(100 - (sum(value // 4) FILTER (WHERE value > 0 AND k > 0))::DOUBLE / (sum(k * 100 // 4) FILTER (WHERE value > 0 AND k > 0))::DOUBLE * 100, 2) AS reduction FROM (SELECT CAST(floor(value) AS BIGINT) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def replay_metrics(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor("value").alias("packet_chars"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("raw_chars"))
    return replay(events)


@on_tables("""SELECT event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-02 00:00:00')""")
def sync_missing(spark, sf_dir):
    """Commits of one line that the other does not have (clicks by users without an early purchase)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    theirs = events.filter((F.col("event_type") == "purchase") & (F.col("ts") < F.lit("2024-01-02 00:00:00").cast("timestamp"))).select("user_id")
    return events.filter("event_type = 'click'").join(theirs, "user_id", "left_anti").select("event_id")


@on_graph("""SELECT id, array_to_string(list_slice(string_split(source, ' '), 1, 2), chr(10)) AS snippet, greatest(1, length(source) // 4) AS token_estimate FROM functions WHERE id < 100""")
def snippets(g: Graph) -> DataFrame:
    lines = F.split("source", " ")
    return g.functions.filter("id < 100").select("id", F.array_join(F.slice(lines, 1, 2), "\n").alias("snippet"), F.greatest(F.lit(1).cast("long"), F.floor(F.length("source") / 4)).alias("token_estimate"))


@on_graph("""SELECT id, count(*) OVER () AS total FROM functions WHERE contains(path, '/brand_7/') ORDER BY id LIMIT 10 OFFSET 5""")
def paged(g: Graph) -> DataFrame:
    rows = g.functions.filter(F.col("path").contains("/brand_7/")).select("id")
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total"))), F.lit(True)).orderBy("id").offset(5).limit(10)


@on_tables("""WITH d AS (SELECT o_orderkey AS ref, o_custkey AS file, epoch_us(o_orderdate) AS line FROM orders) SELECT r.ref, max(arg_max_ref) AS enclosing FROM (SELECT r.ref, last_value(CASE WHEN kind = 0 THEN ref END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, kind, ref ROWS UNBOUNDED PRECEDING) AS arg_max_ref, kind FROM (SELECT ref, file, line, CASE WHEN ref % 3 = 0 THEN 0 ELSE 1 END AS kind FROM d) r) r WHERE kind = 1 GROUP BY r.ref""")
def asof_enclosing(spark, sf_dir):
    """For each reference the latest definition at or above it in its file: one pass over each file in order, no range join."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("line"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("kind"))
    return enclosing(rows).select("ref", "enclosing")


def enclosing(rows: DataFrame) -> DataFrame:
    """Rows (ref, file, line, kind), kind 0 of definitions, 1 of references: the references with their enclosing definition."""
    above = Window.partitionBy("file").orderBy("line", "kind", "ref").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("enclosing", F.last(F.when(F.col("kind") == 0, F.col("ref")), ignorenulls=True).over(above)).filter("kind = 1")


#: Advice by situation. `{name}` is filled from what is known.
ADVICE = {
    "before_edit": "Check what calls {symbol} before you change it.",
    "after_edit": "Run the tests that reach {symbol}.",
    "review": "Read the callers outside the change first.",
    "rename": "Rename every reference to {symbol}, tests included.",
    "delete": "Make sure that nothing calls {symbol}.",
    "stuck": "Search for a similar function and read how it is used.",
    "lock": "Another lane has locked {path}; agree first.",
}


def advise(situation: str, values: dict[str, str], now: str) -> dict[str, str]:
    """Advice for a situation, with an id of the hour and the text's digest."""
    import hashlib

    said = ADVICE[situation]
    for name, value in values.items():
        said = said.replace("{" + name + "}", value)
    return {"id": f"adv_{now}_{hashlib.md5(said.encode()).hexdigest()[:6]}", "situation": situation, "text": said}
