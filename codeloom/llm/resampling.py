"""Target-distribution importance resampling: documents drawn by hashed n-gram features.

Every text gives a feature for each run of one or two consecutive words. Features fall
into buckets by CRC-32; the buckets' shares in a target (benchmark) and in the corpus
give each bucket a gain, a document's weight is the mean gain of its features, and
Gumbel noise from its id turns the highest scores into a draw by weight.

The words of a slice of texts are numbered by an integer dictionary: each distinct word
gets an id, an n-gram is the tuple of its words' ids, packed into one integer. Each
distinct tuple's bytes are put together and hashed once (the CRC of a pair goes on from
that of its first word), and the buckets are joined back to all places by the tuple's
rank. The dictionary is one of a slice, not of the corpus: a shuffle of all distinct
pairs would move more bytes than the texts have. Only sums by bucket leave a task.

Null texts have no features: weight 0. Very long texts are read in pieces. Documents
whose doc_id is null have a null score and are never drawn, though they count in the
sums of the corpus. Repeated rows have equal scores and ranks side by side, in no
certain order. Other columns are ignored. An empty table gives an empty result; an
empty target has shares of nothing (T = 0).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7


def features(piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature that ends at a word of a piece not repeated from the one before.

    Ids number the distinct words; a pair is the tuple of its ids.
    """
    n, skip = len(piece.start), int(piece.repeated)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, first, ids = np.unique(piece.keys(), return_index=True, return_inverse=True)
    text = piece.data.tobytes()
    dictionary = [text[a:b] for a, b in zip(piece.start[first].tolist(), piece.stop[first].tolist(), strict=True)]
    single = np.fromiter(map(zlib.crc32, dictionary), np.uint32, len(dictionary))
    begun = [zlib.crc32(b" ", c) for c in single.tolist()]  # a word and a blank, to go on from
    ids = ids.astype(np.uint64)
    follows = np.flatnonzero(piece.row[1:] == piece.row[:-1])
    tuples = ids[follows] * np.uint64(len(dictionary)) + ids[follows + 1]
    distinct, place = ranks(tuples)
    left, right = np.divmod(distinct, np.uint64(len(dictionary)))
    hashed = np.fromiter(map(zlib.crc32, map(dictionary.__getitem__, right.tolist()), map(begun.__getitem__, left.tolist())), np.uint32, len(distinct))
    own, pair = np.arange(skip, n), follows + 1 >= skip
    return (
        np.concatenate((single[ids[own].astype(np.int64)], hashed[place[pair]])).astype(np.int64) % BUCKETS,
        np.concatenate((piece.row[own], piece.row[follows[pair] + 1])),
    )


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and which of them each value is."""
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ranked[fresh], place


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in a table of texts. The driver gets BUCKETS sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in common.slices(batches, limit=words.PIECE_BYTES):
            for piece in words.pieces(batch, words.MARK, repeat=1):
                total += np.bincount(features(piece)[0], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the log of its smoothed share in the target over that in the corpus, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document. gain: a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=words.PIECE_BYTES):
            rows = batch.num_rows
            n_words, n, total = (np.zeros(rows, np.int64) for _ in range(3))
            for piece in words.pieces(batch, words.MARK, repeat=1):
                bucket, row = features(piece)
                n_words += np.bincount(piece.row[int(piece.repeated) :], minlength=rows)
                n += np.bincount(row, minlength=rows)
                total += summed(row, gain[bucket], rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def summed(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sum of integers by row, exactly: below 2**53 as doubles."""
    return np.bincount(row, weights=values, minlength=rows).astype(np.int64)


def in_order(rows: DataFrame, *by: F.Column) -> DataFrame:
    """rows with `place` (from 0), their place in the order of by: sorted by ranges and numbered range by range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    numbered = common.checkpoint(sorted_.mapInArrow(number, sorted_.withColumn("place", F.lit(0).cast("long")).schema))
    sizes = numbered.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "range").withColumn("place", F.col("place") + F.col("before")).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document with its features, weight, score and, if it is drawn, its rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("may", (F.col("n_words") >= LEAST_WORDS) & F.col("doc_id").isNotNull())
    placed = in_order(scored, F.col("may").desc(), F.col("score").desc(), F.col("doc_id"), F.col("n_features"))
    drawn = placed.filter("may").count() * percent // 100
    rank = F.when(F.col("may") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: crc is the table of CRC-32, made by its rule.
OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
low AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM low),
f AS (SELECT side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS g FROM w),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
k AS (SELECT g, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM h, crc),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN k USING (g) GROUP BY bucket),
z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, z),
v AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
o AS (SELECT w.id AS doc_id, len(words) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.id)[1 : 8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN v ON w.id = v.id WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) FILTER (may) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * n // 100 THEN place END AS rank FROM r"""
