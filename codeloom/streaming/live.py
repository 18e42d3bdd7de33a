"""A live index of sources: a scan first, then a stream of file events, each change parsed once.

The index keeps files by the hash of their content and the elements parsed from them,
in versions. A scan parses only files whose hash is new and drops those that are gone;
a batch of events does the same for its paths. Each batch commits under its own mark,
so a stream that is stopped, or killed after a commit, goes on without doing a batch
twice: the index then equals that of a scan of the files as they are.

Of several events of a path the last one holds; moving a file deletes the one path and
creates the other. A null text of a file that is created or changed counts as empty.
Events without a path are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as fn
from ..operators.graph import Graph, checkpoint
from ..registry import on_graph, on_tables
from ..sources.python_code import parse, sources_of
from ..sources.versions import Versions

#: kind: created, modified, deleted or moved (then `to` is the new path).
EVENTS = "path string, kind string, to string, text string, ts timestamp"
Parser = Callable[[DataFrame], DataFrame]


@dataclass
class LiveIndex:
    """Files (path, hash) and their elements, in a folder that all machines share."""

    spark: SparkSession
    folder: str
    parser: Parser = parse

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.folder, {"files": ["path"], "elements": ["path"]})

    def files(self) -> DataFrame:
        found = self.versions.read("files")
        return self.spark.createDataFrame([], "path string, hash string") if found is None else found

    def elements(self) -> DataFrame | None:
        return self.versions.read("elements")

    def scan(self, files: DataFrame, under: str = "", mark: str | None = None) -> int:
        """Brings the index up to files (path, text), which are all that is under a folder; the number of files parsed."""
        files = hashed(files)
        known = self.files().filter(F.col("path").startswith(under))
        gone = known.join(files.select("path"), "path", "left_anti").select("path")
        return self._apply(files, gone, mark)

    def apply(self, events: DataFrame, mark: str | None = None) -> int:
        """Brings the index up to a batch of events; the number of files parsed."""
        events = settled(events)
        return self._apply(hashed(events.filter("not gone").select("path", "text")), events.filter("gone").select("path"), mark)

    def delete(self, path: str) -> None:
        """Drops a file, or all files under a folder."""
        inside = self.files().filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")).select("path")
        self._apply(self.spark.createDataFrame([], "path string, text string, hash string"), inside, None)

    def _apply(self, files: DataFrame, gone: DataFrame, mark: str | None) -> int:
        if mark is not None and self.versions.has(mark):
            return 0
        fresh = checkpoint(files.join(self.files(), ["path", "hash"], "left_anti"))
        gone = checkpoint(gone.distinct())
        # a file without elements still ends those that it had
        ended = fresh.select("path").union(gone)
        elements = checkpoint(self.parser(fresh.select("path", "text")))
        empty = ended.join(elements.select("path").distinct(), "path", "left_anti")
        self.versions.commit({"files": fresh.select("path", "hash"), "elements": elements}, {"files": gone, "elements": empty}, mark)
        return fresh.count()

    def follow(self, events: DataFrame, checkpoint_dir: str, name: str = "events", once: bool = False) -> StreamingQuery:
        """Applies a stream of events, a batch after another; started again with the same folder and name it goes on where it stopped."""
        writer = events.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda batch, epoch: self.apply(batch, f"{name} {epoch}") and None)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def hashed(files: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return files.filter("path is not null").select("path", text.alias("text"), F.sha2(text, 256).alias("hash"))


def settled(events: DataFrame) -> DataFrame:
    """(path, text, gone): what is left of each path after its last event; at the same time a creation outlasts a deletion."""
    moved = F.col("kind") == "moved"
    both = events.select(F.explode(F.array(F.struct("path", F.col("text"), (F.col("kind").isin("deleted") | moved).alias("gone"), "ts"), F.struct(F.when(moved, F.col("to")).alias("path"), F.col("text"), F.lit(False).alias("gone"), "ts"))).alias("e")).select("e.*")
    last = Window.partitionBy("path").orderBy(F.desc("ts"), F.col("gone"), F.desc("text"))
    return both.filter("path is not null").withColumn("k", F.row_number().over(last)).filter("k = 1").select("path", "text", "gone")


def emptied(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """(directory): those above deleted files that hold no other file, at any depth."""

    def above(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(fn.ancestors(F.col("path"))).alias("directory")).distinct()

    left = files.join(deleted.select("path").distinct(), "path", "left_anti")
    return above(deleted).join(above(left), "directory", "left_anti")


def affected(changed: DataFrame, functions: DataFrame, calls: DataFrame, classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """(path): changed files, files that call into them, and files whose classes inherit from theirs."""
    changed = changed.select("path").distinct()
    callers = functions.join(changed, "path", "left_semi").select(F.col("id").alias("dst")).join(calls, "dst").select(F.col("src").alias("id"))
    heirs = classes.join(changed, "path", "left_semi").select(F.col("id").alias("parent")).join(inherits, "parent").select(F.col("child").alias("id"))
    return changed.union(functions.join(callers, "id", "left_semi").select("path")).union(classes.join(heirs, "id", "left_semi").select("path")).distinct()


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all machines share."""
    checkpoint(spark.range(0))  # sets the folder in tests, where none is named
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/live-{uuid.uuid4().hex}"


_PYTHON = "SELECT '/src/n' || c_nationkey || '.py' AS path, 'f' || c_custkey AS name, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 3 + 1 AS BIGINT) AS line_number, c_nationkey AS n FROM customer"


@on_tables(f"""WITH f AS ({_PYTHON}) SELECT CASE WHEN n % 7 = 3 THEN '/src/moved/n' || n || '.py' ELSE path END AS path, name, line_number FROM f WHERE n % 5 <> 4
UNION ALL SELECT CASE WHEN n % 7 = 3 THEN '/src/moved/n' || n || '.py' ELSE path END, 'extra', max(line_number) + 3 FROM f WHERE n % 5 <> 4 AND n % 3 = 0 GROUP BY path, n""")
def live_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of an index after a scan, a second scan with changed and missing files, and events that move some."""
    index = LiveIndex(spark, scratch(spark))
    files = checkpoint(sources_of(spark, sf_dir)).withColumn("n", F.regexp_extract("path", r"n(\d+)\.py", 1).cast("int"))
    index.scan(files.select("path", "text"))
    grown = F.when(F.col("n") % 3 == 0, F.concat("text", F.lit("def extra():\n    return f0(1, 2)\n"))).otherwise(F.col("text"))
    changed = files.filter("n % 5 <> 4").withColumn("text", grown)
    index.scan(changed.select("path", "text"))
    moves = changed.filter("n % 7 = 3").select("path", F.lit("moved").alias("kind"), F.concat(F.lit("/src/moved/n"), "n", F.lit(".py")).alias("to"), "text", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    index.apply(moves, "moves")
    index.apply(moves, "moves")  # a second time: nothing
    return index.elements().filter("kind = 'function'").select("path", "name", "line_number")


@on_graph("""+d AS (SELECT DISTINCT path FROM functions WHERE id % 2 = 0 OR contains(path, '/brand_13/')), l AS (SELECT DISTINCT path FROM functions WHERE path NOT IN (SELECT path FROM d)),
a AS (SELECT DISTINCT unnest(['/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) AS directory FROM d)
SELECT directory FROM a WHERE directory NOT IN (SELECT unnest(['/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) FROM l)""")
def emptied_directories(g: Graph) -> DataFrame:
    return emptied(g.functions.select("path").distinct(), g.functions.filter("id % 2 = 0 or contains(path, '/brand_13/')").select("path"))


@on_graph("""+ch AS (SELECT DISTINCT path FROM functions WHERE id % 97 = 0 UNION SELECT DISTINCT path FROM classes WHERE id = 30)
SELECT path FROM ch UNION SELECT s.path FROM calls c JOIN functions t ON t.id = c.dst JOIN functions s ON s.id = c.src WHERE t.path IN (SELECT path FROM ch)
UNION SELECT k.path FROM inherits i JOIN classes p ON p.id = i.parent JOIN classes k ON k.id = i.child WHERE p.path IN (SELECT path FROM ch)""")
def affected_heirs(g: Graph) -> DataFrame:
    changed = g.functions.filter("id % 97 = 0").select("path").union(g.classes.filter("id = 30").select("path"))
    return affected(changed, g.functions, g.calls, g.classes, g.inherits)
