"""Changes from version control, and review packets of them."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.exports import most_called
from ..operators.graph import Graph, hop, reversed_edges
from ..registry import on_graph, on_tables

#: What lists the files of each kind of change.
COMMANDS = {
    "diff": ("diff", "--name-only", "{base}"),
    "staged": ("diff", "--cached", "--name-only"),
    "workdir": ("diff", "--name-only"),
    "untracked": ("ls-files", "--others", "--exclude-standard"),
}
#: In this order a review looks for changes.
ORDER = ("diff", "staged", "workdir", "untracked")


def git(folder: str, *arguments: str) -> str:
    """What git says in a folder; nothing where there is no repository or no git."""
    try:
        return subprocess.run(["git", "-C", folder, *arguments], capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def changed_files(spark: SparkSession, folder: str, kind: str, base: str = "HEAD") -> DataFrame:
    """(path): files of a kind of change."""
    lines = git(folder, *(x.format(base=base) for x in COMMANDS[kind])).splitlines()
    return spark.createDataFrame([(x,) for x in dict.fromkeys(filter(None, lines))], "path string")


def first_changes(spark: SparkSession, folder: str, base: str = "HEAD", locked: list[str] = ()) -> tuple[str, DataFrame]:
    """The first kind of change that has files, and these; else the locked files."""
    for kind in ORDER:
        files = changed_files(spark, folder, kind, base)
        if not files.isEmpty():
            return kind, files
    return "locked", spark.createDataFrame([(x,) for x in locked], "path string")


#: What stands before each commit of a log.
RECORD = "\x1e"


def log_text(folder: str, since: str = "90 days ago") -> str:
    """A record a commit, each behind the character 0x1e: a line `sha seconds`, then its files."""
    return git(folder, "log", f"--since={since}", "--name-only", "--pretty=format:%x1e%H %ct")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(record) of a stored log, split where records begin, so that many tasks read one file."""
    return spark.read.text(path, lineSep=RECORD).withColumnRenamed("value", "record")


def commits(records: DataFrame) -> DataFrame:
    """(sha, ts, path) of a log's records (record). A record holds all it needs, so their order is of no account; those without files give no row."""
    rows = records.select(F.filter(F.transform(F.split("record", "\n"), F.trim), lambda line: line != "").alias("lines")).filter("size(lines) > 1")
    head = F.split(F.get("lines", F.lit(0)), " ")
    return rows.select(head[0].alias("sha"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("path"))


def churn(rows: DataFrame) -> DataFrame:
    """(path, commits, last): how many commits touched a file, and when the last did."""
    return rows.groupBy("path").agg(F.count_distinct("sha").alias("commits"), F.max("ts").alias("last"))


@on_tables("SELECT '/f' || user_id % 20 AS path, count(DISTINCT event_id) AS commits, max(ts) AS last FROM events GROUP BY 1")
def commit_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return churn(events.select(F.col("event_id").cast("string").alias("sha"), "ts", F.concat(F.lit("/f"), (F.col("user_id") % 20).cast("string")).alias("path")))


def packet(g: Graph, files: DataFrame, most: int = 50, patterns: tuple[str, ...] = (), is_test: Callable[[Column], Column] = fn.is_test_path) -> DataFrame:
    """(part, id, name, path, untested): a review's touched functions, each with whether no test calls it, and their direct callers and callees outside the change; the `most` most called of each part. Files that no function is indexed in come as `unindexed`, with their path alone."""
    from .discovery import ignored

    files = files.select("path").distinct().filter(~ignored(F.ltrim("path", F.lit("/")), list(patterns)))
    touched = g.functions.join(files, "path", "left_semi").select("id", "name", "path")
    tests = g.functions.filter(is_test(F.col("path"))).select(F.col("id").alias("src"))
    tested = g.calls.join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    found = None
    for part, rows in (("touched", touched.select("id")), ("callers", hop(touched, reversed_edges(g.calls))), ("callees", hop(touched, g.calls))):
        if part != "touched":
            rows = rows.join(touched.select("id"), "id", "left_anti")
        rows = most_called(g, rows, most).select("id").join(g.functions.select("id", "name", "path"), "id")
        rows = rows.join(tested.withColumn("tested", F.lit(True)), "id", "left")
        one = rows.select(F.lit(part).alias("part"), "id", "name", "path", F.when(F.lit(part == "touched"), F.col("tested").isNull()).alias("untested"))
        found = one if found is None else found.union(one)
    bare = files.join(g.functions.select("path").distinct(), "path", "left_anti")
    return found.union(bare.select(F.lit("unindexed"), F.lit(None).cast("long"), F.lit(None).cast("string"), "path", F.lit(None).cast("boolean")))


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path): files whose text is not the one that was indexed. indexed: (path, sha1); current: (path, text)."""
    return current.select("path", F.sha1("text").alias("now")).join(indexed, "path").filter("now <> sha1").select("path")


_FILES = "('/src/brand_13/promo.py', '/src/brand_13/small.py', '/src/new.py')"


@on_graph(f"""+s AS (SELECT id FROM functions WHERE path IN {_FILES}), n AS (SELECT 'touched' AS part, id FROM s UNION SELECT 'callers', src FROM calls WHERE dst IN (SELECT id FROM s) AND src NOT IN (SELECT id FROM s) UNION SELECT 'callees', dst FROM calls WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s))
SELECT part, n.id, name, path, CASE WHEN part = 'touched' THEN NOT EXISTS (SELECT 1 FROM calls c JOIN functions t ON t.id = c.src WHERE c.dst = n.id AND contains(t.path, '/promo')) END AS untested FROM n JOIN functions USING (id) QUALIFY row_number() OVER (PARTITION BY part ORDER BY (SELECT count(*) FROM calls WHERE dst = n.id) DESC, n.id) <= 50 UNION ALL SELECT 'unindexed', NULL, NULL, '/src/new.py', NULL""")
def review_packet(g: Graph) -> DataFrame:
    files = g.functions.sparkSession.createDataFrame([(x,) for x in ("/src/brand_13/promo.py", "/src/brand_13/small.py", "/src/new.py", "/dist/a.js")], "path string")
    return packet(g, files, patterns=("dist/",), is_test=lambda path: path.contains("/promo"))
