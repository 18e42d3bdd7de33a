"""Nearest neighbours, similarity edges and naming rules over embeddings.

Searches take a stated set of queries against all rows. Few queries (they are counted)
are broadcast, and every row is scored against them in one pass, with a partial top-k
a partition. More are dealt into blocks and the rows into chunks; each pair of a block
and a chunk is a task of bounded size, and nothing passes through the driver. Pairs of
alike vectors are found by blocks around pivots: the triangle inequality of angles
leaves out pairs of blocks that can hold none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..functions import vectors as v
from ..registry import on_graph, on_tables
from .graph import Graph, checkpoint, top

#: Queries whose vectors one broadcast holds, and rows of a chunk that meets a block of queries beyond that.
BLOCK, CHUNK = 4096, 16_384
#: Queries whose distances from a batch of rows are held at a time.
QUERIES = 256


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vector_of(rows: DataFrame, vec_id: int) -> list[float]:
    """The vector of an id; an empty one, to which nothing is near, where there is none."""
    row = rows.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"]) if row else []


def nearest(rows: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector, exactly."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return top(rows.select(key, v.similarity(v.l2(F.col("embedding"), target)).alias("score"), v.l2(F.col("embedding"), target).alias("distance")), k, "distance", key).select(key, "score")


_L2 = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ^ 2)))"
_COS = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"


@on_tables(f"SELECT vec_id, round(1 / (1 + d), 4) AS score FROM (SELECT a.vec_id, {_L2} AS d FROM embeddings a, embeddings b WHERE b.vec_id = 0) ORDER BY d, vec_id LIMIT 8")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return nearest(rows, vector_of(rows, 0), 8)


@on_tables(f"SELECT vec_id, round(1 / (1 + d), 4) AS score FROM (SELECT a.vec_id, {_L2} AS d FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label = 2) ORDER BY d, vec_id LIMIT 8")
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of an allowed set are ranked."""
    rows = embeddings(spark, sf_dir)
    allowed = rows.filter("label = 2").select("vec_id")
    return nearest(rows.join(allowed, "vec_id", "left_semi"), vector_of(rows, 0), 8)


def best_of(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, distance): the k nearest of some rows for each query, some queries at a time. Products find who may be among them, with all ties of the last one; their distances are then added up as an engine does."""
    n, norms = min(k, len(own)), (m**2).sum(1)
    found = [(ids[:0], own[:0], np.empty(0))]
    for at in range(0, len(ids) if n > 0 else 0, QUERIES):
        x = vectors[at : at + QUERIES]
        size = (x**2).sum(1)
        d = size[:, None] + norms[None] - 2 * x @ m.T
        edge = np.partition(d, n - 1, axis=1)[:, n - 1] + 1e-12 * (size + norms.max())
        i, j = np.nonzero(d <= edge[:, None])
        exact = np.zeros(len(i))
        for c in range(x.shape[1]):
            exact += (x[i, c] - m[j, c]) ** 2
        q, j, s = first_of_each(i, own[j], -np.sqrt(exact), k)
        found.append((ids[at + q], j, -s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


FOUND = "query long, vec_id long, distance double"


def found_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query", "vec_id", "distance"])


def search_all(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, vec_id, distance, rank): the k nearest rows of each query, itself included, by id where they are as near."""
    rows, queries = rows.select("vec_id", "embedding"), queries.select("vec_id", "embedding")
    n = queries.count()
    found = by_broadcast(rows, queries, k) if n <= block else by_chunks(rows, queries, k, -(-n // block), max(1, -(-rows.count() // CHUNK)))
    ranked = Window.partitionBy("query").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def nearer(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query of two results."""
    q, i, s = first_of_each(*(np.concatenate(x) for x in ((a[0], b[0]), (a[1], b[1]), (-a[2], -b[2]))), k)
    return q, i, -s


NONE = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)


def by_broadcast(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    wanted = queries.toArrow()  # counted: a block at most
    shared = rows.sparkSession.sparkContext.broadcast((wanted["vec_id"].to_numpy(), matrix(column_of(wanted, "embedding"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        best = NONE
        for batch in batches:
            if batch.num_rows and len(ids):
                best = nearer(best, best_of(ids, vectors, batch.column("vec_id").to_numpy(), matrix(batch.column("embedding")), k), k)
        yield found_batch(best)

    return rows.mapInArrow(run, FOUND)


def by_chunks(rows: DataFrame, queries: DataFrame, k: int, blocks: int, chunks: int) -> DataFrame:
    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    grid = dealt(queries, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    return grid.cogroup(dealt(rows, "chunk", chunks, "block", blocks).groupBy("block", "chunk")).applyInArrow(lambda left, right: nearest_in(left, right, k), FOUND)


def nearest_in(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest of some rows for some queries (vec_id, embedding)."""
    if not len(queries) or not len(rows):
        return pa.Table.from_batches([found_batch(NONE)])
    sides = ((x["vec_id"].to_numpy(), matrix(column_of(x, "embedding"))) for x in (queries, rows))
    return pa.Table.from_batches([found_batch(best_of(*next(sides), *next(sides), k))])


@on_tables(f"SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 4) AS distance FROM (SELECT b.vec_id AS query, a.vec_id, {_L2} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_L2}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE rank <= 5")
def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    rows = embeddings(spark, sf_dir)
    return search_all(rows, rows.filter("vec_id % 100 = 0"), 5).select("query", "vec_id", "rank", F.round("distance", 4).alias("distance"))


#: Rows of a block at the most and (while there are few) at the least, blocks that few rows make, rows of a tile, and the most pivots that blocks form around.
BLOCK_ROWS, LEAST_ROWS, FEW_BLOCKS, TILE, MOST_PIVOTS = 32_768, 2048, 8, 2048, 512


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a column, a row each."""
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) == 1 and lengths[0].as_py():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array(column.to_pylist(), np.float64)


def units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def blocked(rows: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """Rows (id, embedding, what else they have, block, low, high): each in its block, once for each pair of blocks that can hold a pair above the threshold.

    A block is the vectors nearest to one of some pivots (drawn by a hash, a bounded
    number), cut by a hash where there are many. Of two blocks the angle between their
    pivots, less the widest angles within both, bounds the angle of any pair. A row is
    sent once for each block, so blocks are as large as a task can hold.
    """
    n = rows.count()
    block_rows = block_rows or min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // FEW_BLOCKS)))
    drawn = min(MOST_PIVOTS, -(-n // block_rows))
    if drawn <= 1:
        return rows.withColumn("block", F.lit(0)).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    pivots = rows.select(F.xxhash64("id", F.lit(3)).alias("h"), "id", "embedding").orderBy("h", "id").limit(drawn).collect()
    centres = units(np.array([r["embedding"] for r in pivots], np.float64))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = units(matrix(batch.column("embedding"))) @ shared.value.T
                pivot = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(s)), pivot], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])

    assigned = checkpoint(rows.mapInArrow(near, T.StructType([*rows.schema, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
    told = assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()  # a row for each pivot
    parts, widest = {r.pivot: -(-r.n // block_rows) for r in told}, {r.pivot: r.widest for r in told}
    first, at = {}, 0
    for pivot in sorted(parts):
        first[pivot], at = at, at + parts[pivot]
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    reach = np.arccos(min(1.0, max(-1.0, threshold))) + 1e-9
    meets = {p: [q for q in sorted(parts) if between[p, q] - widest[p] - widest[q] <= reach] for p in parts}
    others = [(p, first[p], parts[p], [b for q in meets[p] for b in range(first[q], first[q] + parts[q])]) for p in sorted(parts)]
    plan = rows.sparkSession.createDataFrame(others, "pivot int, first int, parts int, others array<int>")
    dealt = assigned.join(F.broadcast(plan), "pivot").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode("others"))
    return dealt.select(*rows.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def sides(batches: Iterable[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    """The two blocks of a pair of blocks, by id; one block that meets itself is both."""
    both = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
    left = both.filter(pc.equal(both["block"], both["low"][0]))
    return left, left if both["low"][0] == both["high"][0] else both.filter(pc.equal(both["block"], both["high"][0]))


def column_of(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece; of a bounded table."""
    return pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table.schema.field(name).type)


def tiles(left: pa.Table, right: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine): places in two blocks whose vectors' cosine exceeds the threshold, a tile at a time; of a block with itself each pair once."""
    if not len(left) or not len(right):
        return
    same = left is right
    x = units(matrix(column_of(left, "embedding")))
    y = x if same else units(matrix(column_of(right, "embedding")))
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    for i0 in range(0, len(x), TILE):
        for j0 in range(i0 if same else 0, len(y), TILE):
            s = x[i0 : i0 + TILE] @ y[j0 : j0 + TILE].T
            i, j = np.nonzero(s > threshold)
            at, to = i + i0, j + j0
            keep = a[at] < b[to] if same else a[at] != b[to]
            yield at[keep], to[keep], s[i, j][keep]


def in_single(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of float vectors, added up in their order in single precision, each product exact until it is added (fused)."""
    out = np.zeros(len(left), np.float32)
    for k in range(left.shape[1]):
        out = (out + left[:, k].astype(np.float64) * right[:, k]).astype(np.float32)
    return out


def vectors_as_given(rows: DataFrame, column: str) -> Column:
    """Vectors of floats as they are, others as doubles."""
    return F.col(column) if rows.schema[column].dataType == T.ArrayType(T.FloatType()) else F.col(column).cast("array<double>")


def similar_pairs(rows: DataFrame, threshold: float, key: str = "vec_id", block_rows: int | None = None, single: bool = False) -> DataFrame:
    """(a, b, similarity): pairs whose cosine exceeds the threshold. Pairs of blocks that can hold one are multiplied, each a task of its own, a tile at a time; only pairs above the threshold come out. single: cosines from products in single precision, as engines take them that keep the type of float vectors."""
    slack = 1e-5 if single else 0.0
    dealt = blocked(rows.select(F.col(key).cast("long").alias("id"), vectors_as_given(rows, "embedding").alias("embedding")), threshold - slack, block_rows)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(batches)
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if single and len(left) and len(right):
            x, y = (matrix(column_of(side, "embedding")).astype(np.float32) for side in (left, right))
            p, q = (np.sqrt(in_single(m, m).astype(np.float64)) for m in (x, y))
        for i, j, s in tiles(left, right, threshold - slack):
            if single:
                s = in_single(x[i], y[j]).astype(np.float64) / np.maximum(p[i] * q[j], 1e-300)
                i, j, s = i[s > threshold], j[s > threshold], s[s > threshold]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(s)], names=["a", "b", "similarity"])

    return dealt.groupBy("low", "high").applyInArrow(pairs, "a long, b long, similarity double")


@on_tables(f"SELECT a, b, round(s, 4) AS similarity FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE s > 0.3")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(embeddings(spark, sf_dir), 0.3).select("a", "b", F.round("similarity", 4).alias("similarity"))


def centroids(rows: DataFrame, group: str) -> DataFrame:
    """(group, centroid): element-wise means."""
    parts = rows.select(group, F.posexplode("embedding").alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))


_CENTROID = "c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


@on_tables(f"WITH {_CENTROID} SELECT vec_id, e.label, round({_COS.format(a='embedding', b='centroid')}, 4) AS similarity FROM embeddings e JOIN c USING (label)")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    own = rows.join(centroids(rows, "label"), "label")
    return own.select("vec_id", "label", F.round(v.cosine(F.col("embedding"), F.col("centroid")), 4).alias("similarity"))


@dataclass(frozen=True)
class Named:
    """Vectors of what functions do and of what things are called."""

    functions: DataFrame  # id, behaviour, naming; name, path where the functions have them
    files: DataFrame  # path, naming


def at_least(threshold: float) -> float:
    """The largest number below a threshold: more than it is the threshold at least."""
    return float(np.nextafter(threshold, -np.inf))


def misleading_name(rows: DataFrame, warn: float = 0.15) -> DataFrame:
    """(id, metric): functions whose name is less like what they do than warn. rows: id, behaviour, naming."""
    return rows.withColumn("metric", v.cosine(F.col("behaviour"), F.col("naming"))).filter(F.col("metric") < warn).select("id", "metric")


def inconsistent_naming(rows: DataFrame, behaviour_similarity: float = 0.85, name_dissimilarity: float = 0.5) -> DataFrame:
    """(a, b, metric): pairs that behave alike, at least so much, and whose names are less alike than name_dissimilarity. Names travel with what is compared, so that pairs that behave alike need no join."""
    alike = at_least(behaviour_similarity)
    dealt = blocked(rows.select(F.col("id").cast("long").alias("id"), vectors_as_given(rows, "behaviour").alias("embedding"), vectors_as_given(rows, "naming").alias("naming")), alike)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(batches)
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if len(left) and len(right):
            x, y = (matrix(column_of(side, "naming")) for side in (left, right))
            p, q = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        for i, j, _ in tiles(left, right, alike):
            metric = np.einsum("ij,ij->i", x[i], y[j]) / np.maximum(p[i] * q[j], 1e-300)
            i, j, metric = i[metric < name_dissimilarity], j[metric < name_dissimilarity], metric[metric < name_dissimilarity]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(metric)], names=["a", "b", "metric"])

    return dealt.groupBy("low", "high").applyInArrow(pairs, "a long, b long, metric double")


def module_mismatch(rows: DataFrame, files: DataFrame, warn: float = 0.3) -> DataFrame:
    """(path, metric): files whose name is less like the mean of what their functions do than warn."""
    means = centroids(rows.select("path", F.col("behaviour").alias("embedding")), "path")
    both = files.join(means, "path").withColumn("metric", v.cosine(F.col("naming"), F.col("centroid")))
    return both.filter(F.col("metric") < warn).select("path", "metric")


def first_of_each(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples the k of each a with the highest s, the smaller b in a tie."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    at = np.arange(len(a))
    starts = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], at, 0)) if len(a) else at
    return a[at - starts < k], b[at - starts < k], s[at - starts < k]


def better_name(rows: DataFrame, self_low: float = 0.4, exemplar_high: float = 0.7, behaviour: float = 0.5, max_exemplars: int = 3) -> DataFrame:
    """(id, exemplars, metric): for badly named functions the well named ones that behave most alike, each an id. Of a pair of blocks only the best of each badly named one come out."""
    own = rows.select(F.col("id").cast("long").alias("id"), vectors_as_given(rows, "behaviour").alias("embedding"), v.cosine(F.col("behaviour"), F.col("naming")).alias("own"))
    dealt = blocked(own.filter((F.col("own") < self_low) | (F.col("own") > exemplar_high)), behaviour)

    def exemplars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(batches)
        for bad, good in ((left, right),) if left is right else ((left, right), (right, left)):
            bad, good = bad.filter(pc.less(bad["own"], self_low)), good.filter(pc.greater(good["own"], exemplar_high))
            a, b, metric = bad["id"].to_numpy(), good["id"].to_numpy(), bad["own"].to_numpy()
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for i, j, s in tiles(bad, good, behaviour):
                best = first_of_each(*(np.concatenate(x) for x in zip(best, (i, b[j], s), strict=True)), max_exemplars)
            yield pa.RecordBatch.from_arrays([pa.array(a[best[0]]), pa.array(best[1]), pa.array(best[2]), pa.array(metric[best[0]])], names=["a", "b", "similarity", "own"])

    found = dealt.groupBy("low", "high").applyInArrow(exemplars_of, "a long, b long, similarity double, own double")
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_exemplars)
    exemplars = F.transform(F.sort_array(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"])
    return ranked.groupBy(F.col("a").alias("id")).agg(exemplars.alias("exemplars"), F.first("own").alias("metric"))


def with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, behaviour, naming): the vector of a function and that of its name, here the next row's."""
    rows = embeddings(spark, sf_dir)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    names = rows.join(n, F.lit(True)).select(((F.col("vec_id") + F.col("n") - 1) % F.col("n")).alias("vec_id"), F.col("embedding").alias("naming"))
    return rows.select("vec_id", F.col("embedding").alias("behaviour")).join(names, "vec_id").withColumnRenamed("vec_id", "id")


_NAMES = "e AS (SELECT a.vec_id, a.embedding AS behaviour, b.embedding AS naming FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))"
_UNIT = "list_transform({x}, lambda y: y::DOUBLE / sqrt(list_sum(list_transform({x}, lambda z: z::DOUBLE * z::DOUBLE))))"
#: Unit vectors, so that a pair's cosine is one product.
_UNITS = f"{_NAMES}, u AS MATERIALIZED (SELECT vec_id, {_UNIT.format(x='behaviour')} AS behaviour, {_UNIT.format(x='naming')} AS naming FROM e)"


@on_tables(f"WITH {_NAMES} SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, {_COS.format(a='behaviour', b='naming')} AS s FROM e) WHERE s < -0.1")
def rule_misleading_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misleading_name(with_names(spark, sf_dir), -0.1).select(F.col("id").alias("vec_id"), F.round("metric", 4).alias("similarity"))


@on_tables(f"WITH {_UNITS} SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.behaviour, b.behaviour) >= 0.3 AND list_inner_product(a.naming, b.naming) < 0.0")
def rule_inconsistent_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that behave alike and are named apart."""
    return inconsistent_naming(with_names(spark, sf_dir), 0.3, 0.0).select("a", "b")


@on_tables(f"""WITH {_UNITS}, s AS (SELECT *, list_inner_product(behaviour, naming) AS own FROM u),
p AS (SELECT a.vec_id, b.vec_id AS other, list_inner_product(a.behaviour, b.behaviour) AS x FROM s a JOIN s b ON a.own < 0.0 AND b.own > 0.1)
SELECT vec_id, string_agg(other, ',' ORDER BY rank) AS exemplars FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, other) AS rank FROM p WHERE x > 0.2) WHERE rank <= 3 GROUP BY vec_id""")
def rule_better_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For badly named rows the three well named ones that behave most alike."""
    found = better_name(with_names(spark, sf_dir), 0.0, 0.1, 0.2)
    return found.select(F.col("id").alias("vec_id"), F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ",").alias("exemplars"))


@on_tables(f"WITH {_CENTROID} SELECT vec_id FROM embeddings e JOIN c USING (label) WHERE {_COS.format(a='embedding', b='centroid')} < 0.1")
def rule_module_content_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows far from the centroid of their module (label)."""
    rows = embeddings(spark, sf_dir)
    own = rows.join(centroids(rows, "label"), "label")
    return own.filter(v.cosine(F.col("embedding"), F.col("centroid")) < 0.1).select("vec_id")


@on_tables("SELECT label, count(*) AS n, count(embedding) AS embedded, round(count(embedding) * 100.0::DOUBLE / count(*), 1) AS coverage FROM embeddings GROUP BY label")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"), F.round(F.count("embedding") * 100.0 / F.count("*"), 1).alias("coverage"))


@on_tables("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), chr(9)) AS line FROM embeddings")
def embedding_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", v.tsv(F.col("embedding")).alias("line"))


@on_graph("SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, '_+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words FROM classes")
def humanised_names(g: Graph) -> DataFrame:
    return g.classes.select("id", fn.humanised(F.col("name")).alias("words"))
