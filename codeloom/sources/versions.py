"""Tables in versions: each commit adds rows, of which the newest of a key holds; a version counts once its manifest is written.

A commit writes its rows under its number first and the manifest last. Whoever reads
takes the versions that have a manifest, so a commit that was killed half-way leaves
the old state, and the next one overwrites what it left. A commit may carry a mark (a
stream's batch); one whose mark is there already is not made again. There is one
writer at a time. `compact` writes the present state as one version, from which
readers then begin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("version", T.LongType()), T.StructField("mark", T.StringType()), T.StructField("base", T.BooleanType())])


@dataclass
class Versions:
    """Tables in a folder that all machines share. keys: of each table the columns that name what a row belongs to."""

    spark: SparkSession
    folder: str
    keys: dict[str, list[str]]

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def manifest(self) -> DataFrame:
        """(version, mark, base): a row for each commit."""
        if not self._there(f"{self.folder}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.folder}/manifest")

    def last(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def has(self, mark: str) -> bool:
        return not self.manifest().filter(F.col("mark") == mark).isEmpty()

    def write(self, tables: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> int:
        """The rows of the next version, which does not count yet. gone: keys whose rows end."""
        version = self.last() + 1
        for name, rows in tables.items():
            kept = rows.withColumn("_gone", F.lit(False))
            if gone and name in gone:
                kept = kept.unionByName(gone[name].select(*self.keys[name]).distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            kept.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        return version

    def publish(self, version: int, mark: str | None = None, base: bool = False) -> None:
        self.spark.createDataFrame([(version, mark, base)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version}")

    def commit(self, tables: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, mark: str | None = None) -> int:
        """Makes a version of new rows; its number. The last one's if the mark is there already."""
        if mark is not None and self.has(mark):
            return self.last()
        version = self.write(tables, gone)
        self.publish(version, mark)
        return version

    def read(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The present rows of a table, or those of a version: of each key those of its newest version. None before the first commit."""
        known = self.manifest() if upto is None else self.manifest().filter(F.col("version") <= upto)
        first = known.filter("base").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        numbers = sorted(r.version for r in known.filter(F.col("version") >= first).collect())  # a row for each commit since the last compaction
        paths = [p for p in (f"{self.folder}/{name}/version={n}" for n in numbers) if self._there(p)]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").option("mergeSchema", True).parquet(*paths)
        if len(paths) > 1:
            newest = rows.groupBy(*self.keys[name]).agg(F.max("version").alias("version"))
            rows = rows.join(newest, [*self.keys[name], "version"], "left_semi")
        return rows.filter("not _gone").drop("_gone", "version")

    def compact(self) -> int:
        """One version of all that holds now."""
        tables = {name: rows for name in self.keys if (rows := self.read(name)) is not None}
        version = self.write(tables)
        self.publish(version, base=True)
        return version
