"""Change streams: debounce, incremental maintenance and a registry of watchers."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..registry import on_graph, on_tables

EVENTS = "path string, kind string, ts timestamp"


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(path, first, fires, events): events of a path meet until it is quiet; it fires then. For batches and, with the watermark, for streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    sessions = events.groupBy("path", F.session_window("ts", quiet).alias("session")).agg(F.count("*").alias("events"))
    return sessions.select("path", F.col("session.start").alias("first"), F.col("session.end").alias("fires"), "events")


@on_tables("""SELECT user_id AS path, min(ts) AS first, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), "ts")
    return debounced(events, "1 hour")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; at the same time the last in order of kind."""
    last = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("kind"))
    return events.withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")


@on_graph("SELECT path, arg_max(kind, {'t': ts, 'k': kind}) AS kind, max(ts) AS ts FROM changes GROUP BY path")
def latest_change(g: Graph) -> DataFrame:
    return latest(g.changes).select("path", "kind", "ts")


def affected(changed: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(path): changed files and the files that call into them, taken before the old rows go."""
    own = functions.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("dst"))
    callers = calls.join(own, "dst", "left_semi").select(F.col("src").alias("id"))
    return changed.select("path").union(functions.join(callers, "id", "left_semi").select("path")).distinct()


def replaced(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The old rows but those of changed files, and the new rows."""
    return old.join(changed.select("path").distinct(), "path", "left_anti").unionByName(new)


def without_calls(calls: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """Calls but those that leave functions of these files."""
    gone = functions.join(files.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("src"))
    return calls.join(gone, "src", "left_anti")


@on_graph("SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM functions WHERE path IN (SELECT path FROM changes WHERE kind = 'error' AND ts < TIMESTAMP '2024-01-02 00:00:00'))")
def calls_without_changed(g: Graph) -> DataFrame:
    files = g.changes.filter((F.col("kind") == "error") & (F.col("ts") < F.lit("2024-01-02 00:00:00").cast("timestamp"))).select("path")
    return without_calls(g.calls, g.functions, files)


@on_graph("""+ch AS (SELECT DISTINCT path FROM changes WHERE kind = 'signup' AND ts < TIMESTAMP '2024-01-01 12:00:00') SELECT path FROM ch UNION SELECT s.path FROM calls c JOIN functions t ON t.id = c.dst JOIN functions s ON s.id = c.src WHERE t.path IN (SELECT path FROM ch)""")
def affected_files(g: Graph) -> DataFrame:
    changed = g.changes.filter((F.col("kind") == "signup") & (F.col("ts") < F.lit("2024-01-01 12:00:00").cast("timestamp")))
    return affected(changed, g.functions, g.calls)


@dataclass
class Watchers:
    """Running watches by path: each a stream of an event folder into a table of debounced changes."""

    spark: SparkSession
    running: dict[str, StreamingQuery] = field(default_factory=dict)

    def watch(self, path: str, out: str, checkpoint: str, apply=None, once: bool = False) -> StreamingQuery:
        """Follows the parquet event log in `path`. apply(batch, epoch) maintains the graph; without it the changes are appended to `out`."""
        if path in self.running and self.running[path].isActive:
            return self.running[path]
        changes = debounced(self.spark.readStream.schema(EVENTS).parquet(path))
        writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
        writer = writer.foreachBatch(apply) if apply else writer.format("parquet").option("path", out)
        self.running[path] = writer.start()
        return self.running[path]

    def unwatch(self, path: str) -> bool:
        query = self.running.pop(path, None)
        if query:
            query.stop()
        return query is not None

    def listed(self) -> list[str]:
        return sorted(str(PurePosixPath(p)) for p, q in self.running.items() if q.isActive)
