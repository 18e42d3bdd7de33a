"""Bundles: a graph as JSON lines in an archive, and back."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ("nodes.jsonl", "edges.jsonl")


def export_frames(nodes: DataFrame, edges: DataFrame, out: str, prefix: str | None = None) -> None:
    """Writes nodes (id, label, path, ...) and edges (src, dst, type, ...) as JSON lines below `out`, with counts by label. With a prefix, nodes below it and edges that touch one of them."""
    if prefix:
        nodes = nodes.filter(F.col("path").startswith(prefix))
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    nodes.write.mode("overwrite").json(f"{out}/nodes")
    edges.write.mode("overwrite").json(f"{out}/edges")
    counts = nodes.groupBy("label").agg(F.count("*").alias("n")).union(edges.groupBy("type").agg(F.count("*")))
    counts.coalesce(1).write.mode("overwrite").json(f"{out}/stats")


def archive(folder: str, target: str, metadata: dict) -> None:
    """Puts an exported folder of the driver's file system into one archive, part after part."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.json", json.dumps(metadata))
        for name in FILES:
            with z.open(name, "w") as out:
                for part in sorted(Path(folder, name.removesuffix(".jsonl")).glob("part-*.json")):
                    with part.open("rb") as lines:
                        while chunk := lines.read(1 << 20):
                            out.write(chunk)


def unpack(source: str, folder: str) -> None:
    """Unpacks an archive, refusing members that would leave the folder."""
    with zipfile.ZipFile(source) as z:
        base = Path(folder).resolve()
        for member in z.namelist():
            if not (base / member).resolve().is_relative_to(base):
                raise ValueError(f"unsafe member {member}")
        z.extractall(base)


def import_frames(spark: SparkSession, nodes: str, edges: str, known: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an import, with ids of the graph that takes them: a node that is known by its key keeps the known id, others get ids behind the largest. Edges of unknown ends are skipped."""
    found = spark.read.json(nodes)
    mapping = found.select(F.col("id").alias("old"), key).join(known.select(F.col("id").alias("have"), key), key, "left")
    shift = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("largest"))
    mapping = mapping.join(F.broadcast(shift), F.lit(True)).select("old", F.coalesce("have", F.col("largest") + 1 + F.col("old")).alias("new"))
    ends = spark.read.json(edges).join(mapping.withColumnRenamed("old", "src").withColumnRenamed("new", "src_new"), "src").join(mapping.withColumnRenamed("old", "dst").withColumnRenamed("new", "dst_new"), "dst")
    nodes_out = found.join(mapping.withColumnRenamed("old", "id"), "id").drop("id").withColumnRenamed("new", "id")
    return nodes_out, ends.drop("src", "dst").withColumnRenamed("src_new", "src").withColumnRenamed("dst_new", "dst")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of the new frame replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest_bundles(listing: DataFrame) -> DataFrame:
    """Of each bundle name, the one generated last; of equals the first by url."""
    best = F.max_by(F.struct(*listing.columns), F.struct("generated_at", F.negate(F.crc32(F.col("url").cast("binary")))))
    return listing.groupBy("name").agg(best.alias("b")).select("b.*").orderBy("name")


def deleted(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The graph without what lies below a path: edges go first."""
    gone = nodes.filter((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/")).select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left
