"""N-gram Jaccard join by partitioning the universe of shingles.

Sets are a document's distinct word shingles. Two sets of sizes s and t whose
Jaccard similarity is 0.8 or more differ in at most H = (s + t) / 9 shingles. For
each band of sizes, a hash cuts the universe of shingles into segments, and a set
into as many subsets. If a set is compared in segments whose allocations add up
to H + 1, then by the pigeonhole principle a partner within H agrees in one of
them: an allocation of 1 finds an equal subset; an allocation of 2 also finds one
that differs by one shingle, through the subsets less one shingle each
(the one-deletion neighbourhood). Bands of small sets have few segments with
neighbourhoods, bands of large sets many segments without.

Every set is indexed in all segments of its own band and probes that band and the
lower ones that can hold a partner. A band has more segments than a probe needs:
it allocates to those of the least cost, estimated from shingle frequencies
that were counted over all documents, so that empty subsets and those of widespread
passages alone are not probed. The estimate bears on speed alone.

Rows that share a key make a bucket. A bucket is never expanded into all pairs:
its members are first compared with one of them, exactly; linked documents merge
into components. What remains are pairs of a bucket between different components.
They are looked at in blocks of bounded size by sketches of parity bits, about as
many as a set has shingles: as many bits as two sketches differ in, the sets differ
in at least. Only pairs that
pass this bound, which loses no link, come out and are compared exactly. Exact
copies merge beforehand by the hash of their set.

Texts that are null or have no words have an empty set and are linked with
nothing. Shorter texts than a shingle have one shingle, all their words. Rows with
the same doc_id are one document, whichever of their texts a partner matches; a
row without doc_id is linked to its exact copies only.
Other columns are ignored; an empty table gives an empty result. Shingles are
compared by 64-bit hashes, sets of exact copies too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Sizes of a band reach from its least to about so many times as much.
RATIO = 1.4
#: Bands up to this size allocate 2 to a segment, those above 1.
NEIGHBOURHOODS_TO = 150
#: More segments than the largest probe of a band needs.
SLACK = 1.12
#: Shingles that so many documents of a slice of a few megabytes have are counted as frequent, the most frequent of them kept.
FREQUENT, MOST_FREQUENT = 3, 200_000
KEY_BITS = 48
#: Bits of the sketch of a small set, and the most that a set has.
SKETCH_BITS, MOST_SKETCH_BITS = 1024, 1 << 16
#: Rows of a bucket that are compared with each other or with as many others in one step.
CHUNK = 512
#: Roles of a bucket's rows, in the order of preference as its centre: probing whole, probing less one, indexed whole, indexed less one.
PROBE, PROBE_LESS, INDEX, INDEX_LESS = range(4)


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A random value of each byte, and the base of the polynomial that joins the bytes of a word, with its inverse modulo 2**64.
BYTES = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; longer only where a word is.
PIECE = 1 << 20


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.array([[BASE], [INVERSE]], np.uint64).repeat(n, 1)
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the data start, and their hashes."""
    starts, hashes, at = [], [], 0
    every = np.frombuffer(data, np.uint8)
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            ends = np.flatnonzero(SPACES[every[at:stop]])
            if len(ends):
                stop = at + int(ends[-1]) + 1
            else:  # a word longer than a piece
                while stop < len(data) and not SPACES[every[stop]]:
                    stop += 1
        piece = every[at:stop]
        up, down = powers(1 << max(10, int(stop - at - 1).bit_length()))
        edges = np.flatnonzero(np.diff(SPACES[piece], prepend=True, append=True))
        begin, end = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[piece] * up[: len(piece)])))
        hashes.append(common.mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def joined(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        out ^= out >> np.uint64(29)
    return common.mix64(out + np.uint64(size))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    data = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
    starts, h = word_hashes(b"\n".join(data))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(x) + 1 for x in data])))).tolist()
    runs = joined(h, WORDS)
    sets = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WORDS:
            s = np.sort(runs[a : b - WORDS + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            sets.append(joined(h[a:b], b - a) if b > a else h[a:b])
    return sets


def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in common.slices(batches):
        yield batch, shingle_sets(common.texts(batch))


def set_hash(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


INFO = "doc_id long, n_shingles long, set_hash long, shingle long, n_docs long"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's size and set hash; and with a null size the shingles that are frequent in a slice, where copies count once."""
    names = [x.split()[0] for x in INFO.split(", ")]
    for batch, sets in of_text(batches):
        hashes = [set_hash(s) for s in sets]
        different = {h: s for h, s in zip(hashes, sets, strict=True) if h is not None}
        nothing = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.int64()), nothing, nothing], names=names)
        if different:
            every, n = np.unique(np.concatenate(list(different.values())), return_counts=True)
            often = n >= FREQUENT
            if often.any():
                nothing = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(every[often].view(np.int64)), pa.array(n[often])], names=names)


@cache
def band_of(size: int) -> tuple[int, int]:
    """The number of the band of a size, and the largest size in it."""
    k, least = 0, 1
    while True:
        following = max(least + 1, int(least * RATIO))
        if size < following:
            return k, following - 1
        k, least = k + 1, following


@cache
def segments_of(largest: int) -> tuple[int, int]:
    """Segments of the band of this largest size; the most that one is allocated."""
    need = (largest + largest * 5 // 4) // 9 + 1
    each = 2 if largest <= NEIGHBOURHOODS_TO else 1
    return (-(-need // 2) + 1 if each == 2 else int(np.ceil(SLACK * need))), each


def bands_to_probe(size: int) -> list[tuple[int, int]]:
    """Lower bands that can hold a partner of a set of this size."""
    found, at = [], band_of(size)
    least = -(-4 * size // 5)
    while least <= size and band_of(least)[0] < at[0]:
        found.append(band_of(least))
        least = found[-1][1] + 1
    return found


def signatures(s: np.ndarray, cost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and roles of a set. cost: how many documents may have each shingle."""
    mixed = common.mix64(s ^ np.uint64(0x5851F42D4C957F2D))
    own = band_of(len(s))
    for band, largest in [own, *bands_to_probe(len(s))]:
        m, each = segments_of(largest)
        segment = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        there = segment[starts]
        sums, price = np.zeros(m, np.uint64), np.full(m, np.inf)
        sums[there] = np.add.reduceat(mixed, starts)
        # the rarest shingle bounds how many documents share a subset; of equal ones, the largest subset
        price[there] = np.minimum.reduceat(cost, starts) + 1 / (1 + np.diff(starts, append=len(s)))
        need = (len(s) + min(len(s), largest)) // 9 + 1
        if each == 2:  # a neighbourhood multiplies the rows that are looked up
            need = -(-need // 2)
        probes = np.zeros(m, bool)
        probes[np.argsort(price, kind="stable")[:need]] = True
        names = common.mix64(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        roles = np.where(probes, PROBE, INDEX)
        shown = np.ones(m, bool) if band == own[0] else probes
        yield common.mix64(sums + names)[shown], roles[shown]
        if each == 2:
            less = shown[segment]
            yield common.mix64(sums[segment] - mixed + names[segment])[less], np.where(probes[segment], PROBE_LESS, INDEX_LESS)[less]


def keys_of(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (key, node, role) of all documents, of exact copies in a partition only of the first."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value
        seen: set[int] = set()
        for batch, sets in of_text(batches):
            keys, roles, nodes = [], [], []
            for node, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                h = set_hash(s)
                if h is None or h in seen or node is None:
                    continue
                seen.add(h)
                cost = np.ones(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    cost = np.where(known[at] == s, n[at], 1.0)
                for k, r in signatures(s, cost):
                    keys.append(k)
                    roles.append(r)
                    nodes.append(np.full(len(k), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) >> np.uint64(64 - KEY_BITS)).astype(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roles).astype(np.int8))], names=["key", "node", "role"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, node long, role byte")


def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, role and node: those of buckets with a probe, with the bucket's first node as its centre."""
    last, centre, first = -1, -1, INDEX_LESS
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, role = (batch.column(c).to_numpy() for c in ("key", "node", "role"))
        starts = np.diff(key, prepend=last) != 0
        begin = np.where(starts, np.arange(len(key)), -1)
        begin = np.maximum.accumulate(begin)
        carried = begin < 0
        begin = np.maximum(begin, 0)
        hub, hub_role = np.where(carried, centre, node[begin]), np.where(carried, first, role[begin])
        last, centre, first = key[-1], hub[-1], hub_role[-1]
        kept = (hub_role <= PROBE_LESS) & (node != hub)
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key, node, role, hub, hub_role.astype(np.int8))], names=["key", "node", "role", "hub", "hub_role"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, size, sketch, shingles) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in of_text(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "size", "sketch", "shingles"])

    return docs.select("doc_id", "text").join(common.broadcast_if_small(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, size long, sketch binary, shingles binary")


def sketch(s: np.ndarray) -> bytes:
    """For each of a number of classes of shingles, whether the set has an odd number of them. The number is a power of two near the size of the set: random sets then differ in more bits than sets that link may."""
    bits = min(max(SKETCH_BITS, 1 << int(len(s)).bit_length()), MOST_SKETCH_BITS)
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all of the least length: a class of a shorter sketch is two of one twice as long."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for k, x in enumerate(sketches):
        row = np.frombuffer(x, np.uint64)
        while len(row) > least // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


def near_by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block, the pairs of a block that may link and have different roots."""
    names = ("key", "low", "high", "chunk", "a", "role", "root", "size")
    block: tuple | None = None
    parts: list[dict] = []

    def pairs() -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0] if c != "sketch"}
        if len(rows["a"]) < 2 or (rows["root"] == rows["root"][0]).all():
            return
        whole, probe = np.isin(rows["role"], (PROBE, INDEX)), rows["role"] <= PROBE_LESS
        within = block[1] == block[2]
        left = np.arange(len(rows["a"])) if within else np.flatnonzero(rows["chunk"] == block[1])
        right = left if within else np.flatnonzero(rows["chunk"] == block[2])
        sketches = folded([x for p in parts for x in p["sketch"]])
        step = max(1, 16 * SKETCH_BITS // (sketches.shape[1] * 64))
        for k in range(0, len(left), step):
            i, j = left[k : k + step, None], right[None, :]
            small, large = np.minimum(rows["size"][i], rows["size"][j]), np.maximum(rows["size"][i], rows["size"][j])
            ok = (rows["root"][i] != rows["root"][j]) & (whole[i] | whole[j]) & (probe[i] | probe[j]) & (5 * small >= 4 * large)
            if within:
                ok &= i < j
            x, y = np.nonzero(ok)
            x, y = i[x, 0], j[0, y]
            apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1, dtype=np.int64)
            near = 9 * apart <= rows["size"][x] + rows["size"][y]
            if near.any():
                x, y = rows["a"][x[near]], rows["a"][y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        columns["sketch"] = batch.column("sketch").to_pylist()
        changes = np.flatnonzero((np.diff(columns["key"], prepend=-1) != 0) | (np.diff(columns["low"], prepend=-1) != 0) | (np.diff(columns["high"], prepend=-1) != 0))
        for start, stop in zip([0, *changes[changes > 0]], [*changes[changes > 0], batch.num_rows]):
            this = tuple(int(columns[c][start]) for c in ("key", "low", "high"))
            if this != block:
                if parts:
                    yield from pairs()
                block, parts = this, []
            parts.append({c: v[start:stop] for c, v in columns.items()})
    if parts:
        yield from pairs()


def blocks(rows: DataFrame) -> DataFrame:
    """Deals the rows of each key into chunks by a hash, and each chunk into a block with itself and with every other chunk. Keys of more rows than a chunk were counted; no task holds all rows of a key."""
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(common.broadcast_if_small(common.checkpoint(large)), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("a"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "a", "role", "root", "size", "sketch")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "x"):
        linked = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                linked.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common_ones = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common_ones >= 80 * (len(both) - common_ones))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y, sizes in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "sizes")), strict=True):
            x, y = folded([x, y])
            near.append(9 * int(np.bitwise_count(x ^ y).sum()) <= sizes)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that may link by their sizes and sketches: a hundredth of what the sets take."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b").filter("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
    return both.select("a", "b", "x", "y", (F.col("size_a") + F.col("size_b")).alias("sizes")).mapInArrow(bounded, "a long, b long").distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to, of every document."""
    told = common.checkpoint(docs.select("doc_id", "text").mapInArrow(describe, INFO))
    info = told.filter("n_shingles is not null").select("doc_id", "n_shingles", "set_hash")
    often = told.filter("shingle is not null").groupBy("shingle").agg(F.sum("n_docs").alias("n")).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()
    order = np.argsort(known := often["shingle"].to_numpy(np.int64).view(np.uint64))
    frequent = known[order], often["n"].to_numpy(np.float64)[order]

    copies = common.checkpoint(info.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    rows = keys_of(docs, frequent).repartition("key").sortWithinPartitions("key", "role", "node")
    members = rows.mapInArrow(centred, "key long, node long, role byte, hub long, hub_role byte")
    # copies in other partitions stand for the first
    repeated = common.checkpoint(info.join(copies.filter("n > 1"), "set_hash").filter("doc_id <> first").select(F.col("doc_id").alias("node"), "first"))
    members = common.checkpoint(members)

    def at_first(df: DataFrame, column: str) -> DataFrame:
        found = common.broadcast_if_small(repeated).withColumnRenamed("node", column)
        return df.join(found, column, "left").withColumn(column, F.coalesce("first", column)).drop("first")

    members = at_first(at_first(members, "node"), "hub").filter("node <> hub")
    star = members.filter(f"hub_role = {PROBE} or role = {INDEX}").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    star = common.checkpoint(star.groupBy("a", "b").agg(F.count("*").alias("n")))
    ids = members.select(F.col("node").alias("doc_id")).union(members.select("hub")).distinct()
    sets = common.checkpoint(sets_of(docs, ids))

    # first each document with the one it shares the most buckets with
    best = star.groupBy("b").agg(F.max_by("a", F.struct("n", F.negate("a"))).alias("a")).select("a", "b")
    links = common.checkpoint(verify(best, sets))
    found = common.components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of different components."""
        root = common.broadcast_if_small(found)
        for c in ("a", "b"):
            pairs = pairs.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return pairs.filter("root_a <> root_b")

    more = apart(star.join(best, ["a", "b"], "left_anti").select("a", "b"))
    links = common.checkpoint(links.union(verify(near(more.select("a", "b"), sets), sets)))
    found = common.components(links)

    # then the rest of each bucket that still spans components
    own = members.select("key", F.col("node").alias("a"), "role").join(common.broadcast_if_small(found).select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    spans = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    own = own.join(common.broadcast_if_small(spans), "key", "left_semi").join(sets.select(F.col("doc_id").alias("a"), "size", "sketch").dropDuplicates(["a"]), "a")
    rest = blocks(own).mapInArrow(near_by_sketch, "a long, b long").distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    found = common.components(links.union(verify(rest, sets)))

    # every document by its first copy
    result = info.join(copies.select("set_hash", "first"), "set_hash", "left").withColumn("node", F.coalesce("first", "doc_id"))
    return result.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k : k + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r USING (doc_id)"""
