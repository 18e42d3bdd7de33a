"""Filter interaction audit: how filters overlap, in every order of applying them.

A packed bitmap index holds, for each chunk of documents and each part, one bit a
document for each filter (set where the document fails) and each label. Counts for
every subset of filters applied before come from AND-NOT and popcount over these bits,
and are summed over the chunks by Spark. An order of filters is a chain of subsets, so
all orders together cost no more than all subsets.

The condition "identical to any smaller doc_id's text" compares 128-bit digests of
texts: for each digest that occurs twice or more its smallest doc_id is found by an
aggregation, and documents look it up. Digests with more than HOT_ROWS documents are
looked up by broadcast (there are at most rows / HOT_ROWS of them), the others by a
shuffle unless they were counted to be few.

Null texts count as empty, and equal each other; a null part is the empty string.
Documents without a doc_id never fail for a copy and never make another one fail; rows
that share doc_id and text do not make each other fail. Labels that a doc_id has more
than once count if any of its rows says 1; documents without labels count as 0.
Repeated rows count as often as they stand there. Very long texts are read one at a
time. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS, LABELS = "ABCDE", ("good", "toxic")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Documents in a chunk of the index.
CHUNK = 1 << 16
#: A digest with more documents than this is looked up by broadcast.
HOT_ROWS = 100_000

CAPITALS = np.array([65 <= b <= 90 for b in range(256)])
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
FLAGS = "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, high long, low long"


def judge(text: str) -> tuple[bool, bool, bool, bool, int, int]:
    """The four conditions on a text alone, and its digest."""
    data = text.encode("utf-8", "surrogatepass")
    words, seen = data.split(), np.frombuffer(data, np.uint8)
    digest = xxhash.xxh3_128_intdigest(data)
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * int(CAPITALS[seen].sum()) > MOST_CAPITALS * len(text),
        bool(SYMBOL[seen].any()),
        (digest >> 64) - (1 << 63),
        (digest & (1 << 64) - 1) - (1 << 63),
    )


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = FLAGS.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
    types = [pa.bool_()] * 4 + [pa.int64()] * 2
    for batch in common.slices(batches):
        found = list(zip(*map(judge, common.texts(batch)), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=names)


def document_filters(docs: DataFrame, hot_rows: int = HOT_ROWS, broadcast: int = common.BROADCAST_ROWS) -> DataFrame:
    """doc_id, part and whether each of the five filters would remove the document."""
    flags = common.checkpoint(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(_flags, FLAGS))
    copies = common.checkpoint(flags.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    if copies.count() <= broadcast:
        found = flags.join(F.broadcast(copies), ["high", "low"], "left")
    else:
        hot = F.broadcast(copies.filter(F.col("n") > hot_rows))  # at most rows / hot_rows
        cold = copies.filter(F.col("n") <= hot_rows)
        found = flags.join(hot, ["high", "low"]).unionByName(flags.join(hot, ["high", "low"], "left_anti").join(cold, ["high", "low"], "left"))
    return found.select("doc_id", "part", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with good and toxic."""
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic")
    joined = flags.join(common.broadcast_if_small(common.checkpoint(said)), "doc_id", "left")
    return joined.select(*flags.columns, *(F.coalesce(x, F.lit(False)).alias(x) for x in LABELS))


def index(flags: DataFrame, filters: Sequence[str], labels: Sequence[str], part: str = "part", chunk: int = CHUNK) -> DataFrame:
    """The packed index: for each chunk and part its number of documents and the bits of each filter and label."""
    names = [*filters, *labels]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            codes = rows.column(part).combine_chunks().dictionary_encode()
            order = np.argsort(codes.indices.to_numpy(), kind="stable")  # the rows of a part side by side
            sizes = np.bincount(codes.indices.to_numpy(), minlength=len(codes.dictionary))
            cuts = np.cumsum(sizes)[:-1]
            bits = [[np.packbits(x).tobytes() for x in np.split(rows.column(name).to_numpy()[order].astype(bool), cuts)] for name in names]
            return pa.RecordBatch.from_arrays([codes.dictionary, pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in bits)], names=["part", "n", *names])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                held.append(batch.slice(at, chunk))
                if sum(x.num_rows for x in held) >= chunk:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return flags.select(part, *names).mapInArrow(pack, ", ".join(["part string", "n long", *(f"{x} binary" for x in names)]))


def subset_counts(indexed: DataFrame, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """For each part, filter and subset of the other filters (bits of `before`, bit k for filter k): documents that are left after the subset, that the filter then removes, that fail it but are gone, and removed ones with each label."""

    def popcount(bits: np.ndarray) -> int:
        return int(np.bitwise_count(bits).sum())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                every = np.packbits(np.ones(row["n"], bool))
                fails = [np.frombuffer(row[x], np.uint8) for x in filters]
                marks = [np.frombuffer(row[x], np.uint8) for x in labels]
                for before in range(1 << len(filters)):
                    left = every
                    for k, bits in enumerate(fails):
                        if before >> k & 1:
                            left = left & ~bits
                    for k, bits in enumerate(fails):
                        if not before >> k & 1:
                            removed = left & bits
                            n = popcount(removed)
                            found = [popcount(left) - n, n, popcount(bits & ~left), *(popcount(removed & x) for x in marks)]
                            key = (row["part"], before, k)
                            sums[key] = sums.get(key, 0) + np.array(found, np.int64)
                if len(sums) > CHUNK:
                    yield batch_of(sums)
                    sums = {}
        if sums:
            yield batch_of(sums)

    names = ["kept", "removed", "redundant", *(f"{x}_lost" for x in labels)]

    def batch_of(sums: dict[tuple[str, int, int], np.ndarray]) -> pa.RecordBatch:
        parts, before, which = zip(*sums, strict=True)
        values = np.stack(list(sums.values()))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(before, pa.int32()), pa.array(which, pa.int32()), *(pa.array(values[:, k]) for k in range(values.shape[1]))], names=["part", "before", "which", *names])

    counted = indexed.mapInArrow(count, "part string, before int, which int, " + ", ".join(f"{x} long" for x in names))
    return counted.groupBy("part", "before", "which").agg(*(F.sum(x).alias(x) for x in names))


def orders(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """A row for each order of the filters and each step: the filter and the subset before it. Factorial in the number of filters alone."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(filters[j] for j in order), step, k, before))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, which int, before int")


def audit(flags: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """For each part, order of filters and step what the filter does there. flags: part, and a boolean for each filter and label."""
    counts = common.checkpoint(subset_counts(index(flags, filters, labels), filters, labels))
    steps = orders(flags.sparkSession, filters)
    full = (1 << len(filters)) - 1
    lone = counts.filter(F.col("before") == F.lit(full) - F.expr("shiftleft(1, which)")).select("part", "which", F.col("removed").alias("unique_fails"))
    joined = counts.join(F.broadcast(steps), ["which", "before"])
    shapley = joined.groupBy("part", "which").agg(F.sum("removed").alias("shapley"))
    joined = joined.join(common.broadcast_if_small(lone), ["part", "which"]).join(common.broadcast_if_small(shapley), ["part", "which"])
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in labels), "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = document_filters(common.table(spark, sf_dir, "documents"))
    return audit(labelled(flags, common.table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS x, filter_order[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, filter_order, step, x, contains(fails, x) AS fails_it, fails = x AS alone, regexp_matches(fails, '[' || before || '0]') AS gone, good, toxic, n FROM m, s),
g AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND fails_it AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails_it AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""
