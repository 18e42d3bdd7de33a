"""A stored vector index: rows in inverted lists around trained centroids.

Centroids are fitted by k-means on a sample of at most SAMPLE rows, drawn by a hash of
their ids; every row is then put into the list of its nearest centroid and written
with its distance from it. A search looks into the `probes` lists nearest to a query:
more probes, more recall. The exact search goes on from there: the distance of the
k-th row found bounds which lists can still hold a nearer one (by the triangle
inequality with the widest distance of a list), and only those are read too.

Rows are upserted by id, in versions (sources.versions): an insert of the same rows
again changes nothing. Queries are a stated set; what they ask of lists is counted, and
broadcast while it is at most PROBES rows, so that rows stay where they are whatever a
list holds. More meet rows by list, in blocks of bounded size. Null or empty vectors, and
those of another length than the centroids, are not indexed and find nothing. Of equal
distances the smaller id is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import on_tables
from ..sources.versions import Versions
from ..streaming.live import scratch
from .graph import checkpoint
from .vectors import BLOCK, CHUNK, FOUND, NONE, best_of, column_of, embeddings, found_batch, matrix, nearer, nearest_in, search_all

#: Most rows that centroids are fitted on, rounds of k-means, and pairs of a query and a list that are broadcast.
SAMPLE, ROUNDS, PROBES = 20_000, 12, 65_536
ROW = "vec_id long, embedding array<double>"


def fitted(rows: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of a sample: k-means from points that are drawn far from each other."""
    n = rows.count()
    share = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))
    some = rows.filter(share).orderBy("vec_id").limit(sample).select("embedding").collect()
    points = np.array([r.embedding for r in some], np.float64)
    if not len(points):
        return np.zeros((0, 0))
    rng, centres = np.random.default_rng(5), points[:1]
    away = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < min(lists, len(points)) and away.max() > 0:
        centres = np.vstack((centres, points[rng.choice(len(points), p=away / away.sum())]))
        away = np.minimum(away, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        near = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


@dataclass
class VectorIndex:
    """An index in a folder that all machines share."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.folder, {"centroids": ["list"], "rows": ["vec_id"]})

    def build(self, rows: DataFrame, lists: int) -> None:
        """Fits centroids and stores all rows (vec_id, embedding)."""
        centres = fitted(usable(rows), lists)
        table = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centroid array<double>")
        self.versions.commit({"centroids": table, "rows": self._placed(rows, centres)})

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, mark: str | None = None) -> None:
        """Stores rows in the place of those of the same ids; drops the ids in gone."""
        self.versions.commit({"rows": self._placed(rows, self.centroids())}, {} if gone is None else {"rows": gone}, mark)

    def centroids(self) -> np.ndarray:
        found = self.versions.read("centroids").orderBy("list").collect()  # as many as were asked for
        return np.array([r.centroid for r in found], np.float64)

    def rows(self) -> DataFrame:
        """(vec_id, embedding, list, distance): distance from the list's centroid."""
        return self.versions.read("rows")

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        size = centres.shape[1] if centres.size else 0
        kept = usable(rows).filter(F.size("embedding") == size)
        return kept.mapInArrow(nearest_lists(centres, 1), f"{ROW}, list int, distance double")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, vec_id, distance, rank): the k nearest rows of those in the `probes` lists nearest to each query (vec_id, embedding)."""
        return ranked(self._looked(self._probes(queries, probes), k), k)

    def search_exact(self, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
        """The k nearest of all rows: probed lists first, then all that can hold a nearer one."""
        every = checkpoint(self._probes(queries, None).withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("distance", "list"))))
        first = checkpoint(ranked(self._looked(every.filter(F.col("turn") <= probes), k), k))
        bound = first.filter(F.col("rank") == k).select("query", F.col("distance").alias("bound"))
        reach = self.rows().groupBy("list").agg(F.max("distance").alias("widest"))  # a row for each list
        more = every.filter(F.col("turn") > probes).join(bound, "query", "left").join(F.broadcast(reach), "list")
        # a little more than the bound, for the rounding of distances
        more = more.filter(F.col("bound").isNull() | (F.col("distance") - F.col("widest") <= F.col("bound") * (1 + 1e-9) + 1e-9))
        return ranked(first.select("query", "vec_id", "distance").union(self._looked(checkpoint(more), k)), k)

    def _probes(self, queries: DataFrame, probes: int | None) -> DataFrame:
        centres = self.centroids()
        size = centres.shape[1] if centres.size else 0
        found = usable(queries).filter(F.size("embedding") == size).mapInArrow(nearest_lists(centres, probes or len(centres)), f"{ROW}, list int, distance double")
        return found.withColumnRenamed("vec_id", "query").withColumnRenamed("embedding", "target")

    def _looked(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, vec_id, distance): the k nearest at least of the rows in each query's lists, which meet as matrices."""
        rows = self.rows().select("vec_id", "embedding", "list")
        if asked.limit(PROBES + 1).count() <= PROBES:
            return rows.mapInArrow(looking(asked.select("query", "list").toArrow(), asked.select("query", "target").dropDuplicates(["query"]).toArrow(), self.spark, k), FOUND)
        most = [df.groupBy("list").count().agg(F.max("count")).first()[0] or 1 for df in (asked, rows)]
        blocks, chunks = -(-most[0] // BLOCK), -(-most[1] // CHUNK)

        def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("list", "block", "chunk")

        queries = asked.select(F.col("query").alias("vec_id"), F.col("target").alias("embedding"), "list")
        return dealt(queries, "block", blocks, "chunk", chunks).cogroup(dealt(rows, "chunk", chunks, "block", blocks)).applyInArrow(lambda left, right: nearest_in(left, right, k), FOUND)


def looking(pairs: pa.Table, queries: pa.Table, spark: SparkSession, k: int):  # noqa: ANN201
    """Rows against the queries that ask for their lists; pairs and queries were counted to be few."""
    ids = queries["query"].to_numpy()
    order = np.argsort(ids)
    vectors = matrix(column_of(queries, "target"))[order] if len(ids) else np.zeros((0, 0))
    at, lists = np.searchsorted(ids[order], pairs["query"].to_numpy()), pairs["list"].to_numpy()
    shared = spark.sparkContext.broadcast((ids[order], vectors, {int(x): at[lists == x] for x in np.unique(lists)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, asking = shared.value
        best = NONE
        for batch in batches:
            if not batch.num_rows:
                continue
            own, m, lists = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding")), batch.column("list").to_numpy()
            for x in np.unique(lists).tolist():
                if x in asking:
                    best = nearer(best, best_of(ids[asking[x]], vectors[asking[x]], own[lists == x], m[lists == x], k), k)
        yield found_batch(best)

    return run


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def nearest_lists(centres: np.ndarray, n: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            d = distances(matrix(batch.column("embedding")), centres)
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(d)), near.shape[1])
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32)), pa.array(d[at, near.ravel()])], names=["vec_id", "embedding", "list", "distance"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query. Spark keeps the first k of a query in each partition before rows meet."""
    nearest_first = Window.partitionBy("query").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)


def recall(index: VectorIndex, rows: DataFrame, queries: DataFrame, k: int, probes: int) -> float:
    """The share of the k truly nearest rows that a search with so many probes finds."""
    true = search_all(usable(rows), usable(queries), k).select("query", "vec_id")
    found = index.search(queries, k, probes).select("query", "vec_id")
    return found.join(true, ["query", "vec_id"], "left_semi").count() / max(true.count(), 1)


_L2 = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ^ 2)))"


@on_tables(f"SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 4) AS distance FROM (SELECT b.vec_id AS query, a.vec_id, {_L2} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_L2}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id % 10 <> 7) WHERE rank <= 5")
def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against the rows of an index that was built, added to twice and deleted from."""
    rows = embeddings(spark, sf_dir)
    index = VectorIndex(spark, scratch(spark))
    index.build(rows.filter("vec_id % 3 <> 1"), 16)
    for _ in range(2):
        index.upsert(rows.filter("vec_id % 3 = 1"), rows.filter("vec_id % 10 = 7 and vec_id % 3 <> 1").select("vec_id"), "rest")
    index.upsert(rows.limit(0), rows.filter("vec_id % 10 = 7").select("vec_id"))
    found = index.search_exact(rows.filter("vec_id % 100 = 0"), 5, 4)
    return found.select("query", "vec_id", "rank", F.round("distance", 4).alias("distance"))
