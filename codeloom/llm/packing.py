"""Packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end id. Only longer ones are cut, into pieces
of the full length after a first piece of the rest. Pieces over a third of a
sequence are matched: the largest is paired with the largest partner that still
fits, at most two in a sequence. The smaller ones, largest first, go to the
sequence with the least gap that holds them, or open new ones.

All of that depends on lengths alone, so the plan is made from a histogram of at
most `capacity` lengths: runs of sequences that hold the same lengths are placed
together, and no document comes to the driver. Each piece then finds its place
by its rank among the pieces of its length. Ranks are counted in salted parts of
a length, so that a length with many pieces is no hot group.

Null and empty texts are the end id alone. Repeated rows and ids are packed each.
Other columns are ignored; an empty table gives an empty result. Ties between
pieces of a length go by doc_id, then piece; equal ones are interchangeable.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
END_ID = 0
#: Pieces of one length that are ranked together.
PART = 512

#: Outside these characters, or with a special token, a text goes to the tokenizers library itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-ɏ‐-‧€]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizers library gives them; tiktoken reads the same vocabulary, several times as fast, for plain texts."""

    def __init__(self, name: str = TOKENIZER) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path(f"{name}.json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                ids = np.array([*encoder.encode(text), END_ID], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank, per_sequence, sequence, offset): from this rank on, pieces of the length fill sequences from this one on, so many in each from the offset."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> runs (first sequence, how many)
    sequences = 0

    def place(length: int, count: int, per: int, sequence: int, offset: int) -> None:
        rows.append((length, int(used[length]), per, sequence, offset))
        used[length] += count
        left[length] -= count

    third = capacity // 3
    for large in range(capacity, third, -1):  # greedy matching, two of more than a third at most
        partner = min(large, capacity - large)
        while left[large]:
            while partner > third and not left[partner]:
                partner -= 1
            if partner <= third:
                n = int(left[large])
                place(large, n, 1, sequences, 0)
                gaps[capacity - large].append((sequences, n))
            elif partner == large:
                n = int(left[large]) // 2
                if not n:
                    partner -= 1
                    continue
                place(large, 2 * n, 2, sequences, 0)
                gaps[capacity - 2 * large].append((sequences, n))
            else:
                n = int(min(left[large], left[partner]))
                place(large, n, 1, sequences, 0)
                place(partner, n, 1, sequences, large)
                gaps[capacity - large - partner].append((sequences, n))
            sequences += n
    for small in range(third, 0, -1):  # best fit
        gap = small
        while left[small]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                per = capacity // small
                gaps[capacity].append((sequences, -(-int(left[small]) // per)))
                sequences += gaps[capacity][-1][1]
                gap = capacity
            first, n = gaps[gap].pop()
            per = gap // small
            whole = min(n, int(left[small]) // per)
            if whole:
                place(small, whole * per, per, first, capacity - gap)
                gaps[gap - per * small].append((first, whole))
            rest = int(left[small]) if whole < n and left[small] < per else 0
            if rest:
                place(small, rest, rest, first + whole, capacity - gap)
                gaps[gap - rest * small].append((first + whole, 1))
            over = n - whole - bool(rest)
            if over:
                gaps[gap].append((first + whole + bool(rest), over))
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, part: int = PART) -> DataFrame:
    """Adds the rank of each piece among those of its length, from 0."""
    most = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // part))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return cut.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k")).drop("salt", "k", "base")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    cut = common.checkpoint(pieces(docs, capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(plan(histogram, capacity).tolist()), np.int64).reshape(-1, 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        starts = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            if not len(length):
                continue
            row = rows[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            k = rank - row[:, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(row[:, 3] + k // row[:, 2]), "offset": pa.array(row[:, 4] + k % row[:, 2] * length)})

    return ranked(cut).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
