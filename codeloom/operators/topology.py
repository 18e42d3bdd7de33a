"""Communities, surprise of edges between them, density clusters and projections."""

from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import on_graph, on_tables
from .graph import Graph, checkpoint, top
from .vectors import embeddings

#: A community of more than this share of the nodes (and more than three) is cut again.
LARGE_SHARE = 0.25


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) for graphs of any size: each node takes the most frequent label around it, the smaller in a tie. Synchronous, so its rounds are bounded."""
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        own = labels.select(F.col("id").alias("src"), "community", F.lit(1).alias("n"))
        votes = votes.union(own).groupBy("src", "community").agg(F.sum("n").alias("n"))
        labels = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("community", F.struct("n", F.negate("community"))).alias("community"))
        labels = checkpoint(labels)
    return labels


def coin(node: int, turn: int) -> int:
    return crc32(f"{node}:{turn}".encode())


#: A level of Louvain goes on while a round raises modularity by one part of this many.
LEAST_RISE = 10_000


def is_small(raised: int, total: int, depth: int) -> bool:
    return 2 * raised * LEAST_RISE < total * total * 2**depth


def sums_before(group: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each row the sum of k over the rows of its group that come before it."""
    order = np.argsort(group, kind="stable")
    ahead = np.cumsum(k[order]) - k[order]
    first = np.append(True, np.diff(group[order]) != 0)
    out = np.empty_like(k)
    out[order] = ahead - ahead[first][np.cumsum(first) - 1]
    return out


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, depth: int = 0, k: np.ndarray | None = None, total: int = 0) -> dict[int, int]:
    """Community of each node of an undirected graph, with edges a < b of weight w, by moves that raise modularity, level after level.

    All nodes of a round choose by the same state: the neighbouring community of the highest gain, their own
    and then the smaller one in a tie. The moves are drawn in the order of a hash of the round. A community gives
    in a round if the first move that touches it leads out of it, else it receives; only moves from one that
    gives to one that receives are made. Of the moves that a community shares, a later one counts all earlier
    ones as made, though some may not be: its gain can only be higher, as edges between nodes that move together
    are left out. If it is still positive the node moves, so each round raises modularity and the first move is
    always made. A level ends when no node wants to move or when a round has raised modularity by less than one
    part in LEAST_RISE; the last level is one in which no node wants to move at all. Whole numbers only, so that
    `louvain_of` gets the same from joins. The resolution is (3/2)**depth. k and total: weights of the nodes, by
    their order, and of the whole graph, where the edges are those between communities of an earlier level.
    """
    up, down = 3**depth, 2**depth
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    w = np.concatenate((w, w))
    x, y = ends, np.roll(ends, len(a))
    if k is None:
        k = np.bincount(x, w, len(names)).astype(np.int64)
        total = int(k.sum())
    of, ids = np.arange(len(names)), names  # names are sorted, so that the order of places is theirs
    while True:
        n, home, turn = len(ids), np.arange(len(ids)), 0
        while True:
            size = np.bincount(home, k, n).astype(np.int64)
            pairs, inverse = np.unique(np.concatenate((x * n + home[y], np.arange(n) * n + home)), return_inverse=True)
            links = np.bincount(inverse, np.concatenate((w, np.zeros(n, np.int64)))).astype(np.int64)
            node, to = pairs // n, pairs % n
            stays = home[node] == to
            gain = total * down * links - up * k[node] * (size[to] - k[node] * stays)
            order = np.lexsort((to, ~stays, -gain, node))
            first = order[np.unique(node[order], return_index=True)[1]]
            want = first[~stays[first]]
            if not len(want):
                break
            coins = np.array([coin(i, turn) for i in ids[node[want]].tolist()])
            want = want[np.lexsort((node[want], coins))]
            mover, to, source = node[want], to[want], home[node[want]]
            rises = gain[want] - gain[stays][mover]  # pairs are sorted: the own community of each node, by nodes
            least = np.full((2, n), len(want))
            np.minimum.at(least[0], source, np.arange(len(want)))
            np.minimum.at(least[1], to, np.arange(len(want)))
            gives = least[0] < least[1]
            earlier = sums_before(source, k[mover] * gives[source]) + sums_before(to, k[mover] * ~gives[to])
            goes = gives[source] & ~gives[to] & (rises > up * k[mover] * earlier)
            raised = int((rises - up * k[mover] * earlier)[goes].sum())
            home[mover[goes]] = to[goes]
            turn += 1
            if is_small(raised, total, depth):
                break
        of = home[of]
        if not turn:
            return dict(zip(names.tolist(), ids[of].tolist(), strict=True))
        kept, places = np.unique(home, return_inverse=True)
        ids, of = ids[kept], np.searchsorted(kept, of)
        k = np.bincount(places, k, len(kept)).astype(np.int64)
        x, y = places[x], places[y]
        pairs, inverse = np.unique((x * len(kept) + y)[x != y], return_inverse=True)
        w = np.bincount(inverse, w[x != y]).astype(np.int64)
        x, y = pairs // len(kept), pairs % len(kept)


def communities_of(edges: list[tuple[int, int]], depth: int = 0) -> dict[int, int]:
    """Louvain communities; those that are too large are cut again at a finer resolution, and so on. Named by their least node."""
    weight = Counter((min(e), max(e)) for e in edges if e[0] != e[1])
    found = {x: x for e in edges for x in e}
    if weight:
        pairs = np.array(sorted(weight), np.int64)
        found |= louvain(pairs[:, 0], pairs[:, 1], np.array([weight[e] for e in sorted(weight)], np.int64), depth)
    groups: dict[int, list[int]] = defaultdict(list)
    for x, c in found.items():
        groups[c].append(x)
    out: dict[int, int] = {}
    for c, nodes in groups.items():
        if len(nodes) > max(3, int(LARGE_SHARE * len(found))):
            out |= {x: x for x in nodes} | communities_of([e for e in edges if e[0] != e[1] and found[e[0]] == found[e[1]] == c], depth + 1)
        else:
            out |= dict.fromkeys(nodes, min(nodes))
    return out


#: Edges up to which one task gets the same result sooner.
LOUVAIN_EDGES = 500_000


def moves(near: DataFrame, home: DataFrame, total: int, depth: int, turn: int) -> DataFrame:
    """(id, to, raised): the moves of a round of `louvain`, from edges (a, b, w, k of a) in both directions and nodes (id, k, c)."""
    up, down = 3**depth, 2**depth
    sizes = home.groupBy("c").agg(F.sum("k").alias("size"))
    held = home.join(sizes.hint("merge"), "c").select("id", "k", F.col("c").alias("to"), "size")
    around = near.join(held.select(F.col("id").alias("b"), "to", "size").hint("merge"), "b").select("a", "k", "to", "size", "w", F.lit(False).alias("own"))
    around = around.union(held.select("id", "k", "to", "size", F.lit(0).cast("long"), F.lit(True))).repartition("a")
    links = around.groupBy("a", "to").agg(F.max("k").alias("k"), F.max("size").alias("size"), F.sum("w").alias("w"), F.max("own").alias("own"))
    gain = F.lit(total * down) * F.col("w") - F.lit(up) * F.col("k") * (F.col("size") - F.when(F.col("own"), F.col("k")).otherwise(0))
    links = links.withColumn("gain", gain)
    best = links.groupBy(F.col("a").alias("id")).agg(F.max("k").alias("k"), F.max_by("to", F.struct("gain", "own", -F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("own"), F.struct("to", "gain"))).alias("stays"))
    drawn = F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(turn))).cast("binary"))
    want = best.filter("to <> stays.to").select("id", "k", "to", (F.col("gain") - F.col("stays.gain")).alias("rises"), drawn.alias("coin"), F.explode(F.array(F.struct(F.col("stays.to").alias("c"), F.lit(True).alias("out")), F.struct(F.col("to").alias("c"), F.lit(False).alias("out")))).alias("touched"))
    want = want.select("id", "k", "to", "rises", "coin", "touched.*")
    drawn_first = Window.partitionBy("c").orderBy("coin", "id")
    touched = want.withColumn("right", F.col("out") == F.first("out").over(drawn_first))
    touched = touched.withColumn("earlier", F.coalesce(F.sum(F.when(F.col("right"), F.col("k"))).over(drawn_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = touched.filter("right").groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.max("to").alias("to"), F.max("rises").alias("rises"), F.sum("earlier").alias("earlier"))
    return both.filter("n = 2").select("id", "to", (F.col("rises") - F.lit(up) * F.col("k") * F.col("earlier")).alias("raised")).filter("raised > 0")


def louvain_of(edges: DataFrame, depth: int = 0, in_one_task: int = LOUVAIN_EDGES) -> DataFrame:
    """`louvain` by joins, for graphs of any size: (id, community) from edges (a, b, w) with a < b. A round is one plan of joins of nodes and edges; a level that has few edges left goes to one task."""
    both = checkpoint(edges.select("a", "b", "w").union(edges.select("b", "a", "w")))
    nodes = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    total = int(nodes.agg(F.sum("k")).first()[0])
    of = nodes.select("id", F.col("id").alias("community"))

    def rest(batch: pd.DataFrame) -> pd.DataFrame:
        weights = dict(zip(batch["a"].tolist(), batch["k"].tolist(), strict=True))
        pairs = batch[batch["a"] < batch["b"]]
        found = louvain(pairs["a"].to_numpy(), pairs["b"].to_numpy(), pairs["w"].to_numpy(), depth, np.array([weights[x] for x in sorted(weights)], np.int64), total)
        return pd.DataFrame(found.items(), columns=["community", "c"])

    while True:
        near = checkpoint(both.join(nodes.select(F.col("id").alias("a"), "k").hint("merge"), "a").select("a", "b", "w", "k"))
        if near.count() <= 2 * in_one_task and 4 * 3**depth * total**2 < 2**63:  # numpy would not tell of numbers that are too large
            last = near.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(rest, "community long, c long")
            return checkpoint(of.join(last, "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        home, turn = nodes.select("id", "k", F.col("id").alias("c")), 0
        while True:
            home = checkpoint(home.select("id", "k", "c").join(moves(near, home, total, depth, turn).hint("merge"), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), "raised"))
            raised = home.agg(F.sum(F.col("raised").cast("decimal(38,0)"))).first()[0]
            turn += raised is not None
            if raised is None or is_small(int(raised), total, depth):
                break
        if not turn:
            return of
        of = checkpoint(of.join(home.select(F.col("id").alias("community"), "c").hint("merge"), "community").select("id", F.col("c").alias("community")))
        place = home.select("id", "c")
        between = near.join(place.select(F.col("id").alias("b"), F.col("c").alias("to")).hint("merge"), "b").join(place.select(F.col("id").alias("a"), "c").hint("merge"), "a")
        both = checkpoint(between.filter("c <> to").groupBy(F.col("c").alias("a"), F.col("to").alias("b")).agg(F.sum("w").alias("w")))
        nodes = checkpoint(home.groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")))


def cut_again(edges: DataFrame, in_one_task: int = LOUVAIN_EDGES, depth: int = 0) -> DataFrame:
    """`communities_of` by joins, within one task, with the same result, while the edges are few. The edges are read several times."""
    if edges.count() <= in_one_task:

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            found = communities_of(sorted(zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True)), depth)
            return pd.DataFrame(sorted(found.items()), columns=["id", "community"])

        return edges.select("src", "dst", F.lit(0).alias("part")).groupBy("part").applyInPandas(run, "id long, community long")
    weighed = checkpoint(edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w")))
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if not weighed.isEmpty():
        found = every.join(louvain_of(weighed, depth, in_one_task).hint("merge"), "id", "left").select("id", F.coalesce("community", "id").alias("c"))
    else:
        found = every.select("id", F.col("id").alias("c"))
    found = checkpoint(found)
    groups = found.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("community"))
    out = checkpoint(found.join(groups.hint("merge"), "c").select("id", "c", "n", "community"))
    most = max(3, int(LARGE_SHARE * out.count()))
    for c in [r.c for r in out.filter(F.col("n") > most).select("c").distinct().collect()]:  # three at the most
        inside = out.filter(F.col("c") == c).select("id")
        part = checkpoint(edges.filter("src <> dst").join(inside.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi").select("src", "dst"))
        finer = cut_again(part, in_one_task, depth + 1).withColumnRenamed("community", "finer")
        out = checkpoint(out.join(finer.hint("merge"), "id", "left").select("id", "c", "n", F.coalesce("finer", F.when(F.col("c") == c, F.col("id")), "community").alias("community")))
    return out.select("id", "community")


def communities(edges: DataFrame, in_one_task: int = LOUVAIN_EDGES) -> DataFrame:
    """(id, community). Louvain by joins; within one task, with the same result, while the graph has few edges."""
    return cut_again(checkpoint(edges.select("src", "dst")), in_one_task)


@on_graph()
def communities_louvain(g: Graph) -> DataFrame:
    return communities(g.calls)


@on_graph()
def communities_propagated(g: Graph) -> DataFrame:
    return label_propagation(g.calls)


def cross_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges whose ends are in different communities."""
    a = member.select(F.col("id").alias("src"), F.col("community").alias("src_community"))
    b = member.select(F.col("id").alias("dst"), F.col("community").alias("dst_community"))
    return edges.join(a, "src").join(b, "dst").filter("src_community <> dst_community").select("src", "dst", "src_community", "dst_community")


def surprise_of(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b, edges, surprise): how unlikely the edges between two communities are for their sizes, 0 to 10."""
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    pairs = cross_edges(edges, member).groupBy(F.least("src_community", "dst_community").alias("a"), F.greatest("src_community", "dst_community").alias("b")).agg(F.count("*").alias("edges"))
    pairs = pairs.join(sizes.select(F.col("community").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("community").alias("b"), F.col("size").alias("size_b")), "b")
    value = F.round(F.greatest(F.least(-F.log2(F.col("edges") / (F.col("size_a") * F.col("size_b"))), F.lit(10.0)), F.lit(0.0)), 2)
    return pairs.select("a", "b", "edges", value.alias("surprise"))


def by_brand(g: Graph) -> DataFrame:
    """A given partition of the functions: the directory they are in."""
    return g.functions.select("id", F.split_part("path", F.lit("/"), F.lit(3)).alias("community"))


_CROSS = "m AS (SELECT id, split_part(path, '/', 3) AS community FROM functions), x AS (SELECT src, dst, a.community AS src_community, b.community AS dst_community FROM calls JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.community <> b.community)"


@on_graph(f"+{_CROSS} SELECT * FROM x")
def cross_community(g: Graph) -> DataFrame:
    return cross_edges(g.calls, by_brand(g))


@on_graph(f"+{_CROSS}, s AS (SELECT community, count(*) AS size FROM m GROUP BY community), p AS (SELECT least(src_community, dst_community) AS a, greatest(src_community, dst_community) AS b, count(*) AS edges FROM x GROUP BY ALL) SELECT a, b, edges, round(greatest(least(-log2(edges / (sa.size * sb.size)), 10), 0), 2) AS surprise FROM p JOIN s sa ON sa.community = a JOIN s sb ON sb.community = b ORDER BY surprise DESC, a, b LIMIT 50")
def surprise(g: Graph) -> DataFrame:
    return top(surprise_of(g.calls, by_brand(g)), 50, F.desc("surprise"), "a", "b")


def density_labels(points: np.ndarray, least: int = 5, samples: int = 3) -> np.ndarray:
    """Clusters by density: a minimum spanning tree over mutual reachability, condensed; stable clusters of `least` points or more, -1 for noise."""
    n = len(points)
    labels = np.full(n, -1)
    if n < least:
        return labels
    d = np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1), 0)) if n <= 512 else np.sqrt(np.maximum((points**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * points @ points.T, 0))
    core = np.partition(d, min(samples, n - 1), axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    inside[0], best = True, reach[0].copy()
    tree = []
    for _ in range(n - 1):
        k = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((float(best[k]), int(link[k]), k))
        inside[k] = True
        closer = reach[k] < best
        best[closer], link[closer] = reach[k][closer], k
    # single linkage: children of each merge
    parent, members, left = list(range(2 * n - 1)), {k: 1 for k in range(n)}, {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (length, a, b) in enumerate(sorted(tree)):
        a, b, new = root(a), root(b), n + step
        parent[a] = parent[b] = new
        members[new] = members[a] + members[b]
        left[new] = (a, b, length)

    def points_of(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += left[y][:2]
        return out

    chosen: dict[int, float] = {}
    # condensed tree from the top: a cluster lives until it falls apart into two of the least size
    stack, order, kids, born = [2 * n - 2], [], {}, {2 * n - 2: 0.0}
    stability: dict[int, float] = {}
    while stack:
        c = stack.pop()
        order.append(c)
        at, total = c, 0.0
        while at >= n:
            a, b, length = left[at]
            density = 1 / max(length, 1e-12)
            big = [x for x in (a, b) if members[x] >= least]
            if len(big) == 2:
                total += members[at] * (density - born[c])
                kids[c] = big
                for x in big:
                    born[x] = density
                    stack.append(x)
                break
            total += (members[at] - (members[big[0]] if big else 0)) * (density - born[c])
            if not big:
                break
            at = big[0]
        stability[c] = total
    for c in reversed(order):
        below = sum(stability[k] for k in kids.get(c, ()))
        if c in kids and (below > stability[c] or c == 2 * n - 2):
            stability[c] = below
        else:
            chosen[c] = stability[c]
    done: set[int] = set()
    number = 0
    for c in order:
        if c in chosen and c not in done:
            labels[points_of(c)] = number
            number += 1
            below = list(kids.get(c, ()))
            while below:
                x = below.pop()
                done.add(x)
                below += kids.get(x, ())
    return labels


#: Points that one task may hold for density clustering.
DENSITY_POINTS = 3000


def density_clusters_of(rows: DataFrame, most: int = DENSITY_POINTS) -> DataFrame:
    """(vec_id, cluster) of the first `most` points by id: the tree needs all distances, so the report is bounded, as the feature is."""
    drawn = top(rows.select("vec_id", "embedding"), most, "vec_id")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("vec_id")
        return pd.DataFrame({"vec_id": batch["vec_id"], "cluster": density_labels(np.array(batch["embedding"].to_list(), np.float64))})

    return drawn.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(run, "vec_id long, cluster long")


@on_tables()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters_of(embeddings(spark, sf_dir))


def pca(rows: DataFrame) -> DataFrame:
    """(vec_id, x, y): the two main components. Means and products are summed a partition at a time, so the driver gets one small matrix."""

    def sums(batches):
        n, s, p = 0, 0.0, 0.0
        for b in batches:
            m = np.array(b["embedding"].to_list(), np.float64).reshape(len(b), -1)
            if len(m):
                n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    parts = rows.select("embedding").mapInPandas(sums, "n long, s array<double>, p array<double>").toPandas()
    n, mean = parts["n"].sum(), np.sum(parts["s"].map(np.array).to_list(), axis=0)
    mean = mean / n
    covariance = np.sum(parts["p"].map(np.array).to_list(), axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(0), [0, 1]])  # the largest weight of an axis is positive

    def project(batches):
        for b in batches:
            m = (np.array(b["embedding"].to_list(), np.float64).reshape(len(b), -1) - mean) @ axes
            yield pd.DataFrame({"vec_id": b["vec_id"], "x": m[:, 0], "y": m[:, 1]})

    return rows.select("vec_id", "embedding").mapInPandas(project, "vec_id long, x double, y double")


@on_tables()
def pca2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca(embeddings(spark, sf_dir))
