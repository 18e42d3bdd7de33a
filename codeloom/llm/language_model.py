"""LM scoring: an n-gram model of words, held in Elias-Fano tries that documents query.

Tokens are words and one end a text. The model interpolates three orders,

    p(w | u v) = a(u v w) + b(u v) * (a(v w) + b(v) * (c(w) + 1) / (N + V + 1)),

where a is the count of an n-gram, less DISCOUNT, over that of its context, for n-grams
counted twice or more, and b what these leave of their context's share; two starts
stand before a text. a is quantised to a byte, rounded down, before b is taken, so
that the sum over all words stays at one (less what quantising b loses).

Training goes over all texts once an order. A task sorts and counts the n-grams of up
to GATHERED tokens and sends them to shards by their context, as sorted deltas. A
context with more than SHARD_TOKENS tokens, of which there are at most N /
SHARD_TOKENS, is split among shards by its successors. A shard sums counts and builds
one trie (elias_fano.Trie) of at most about SHARD_TOKENS pairs. Triples are only
counted where both their pairs are kept, if the pairs were found small enough to be
broadcast; else all are counted and the same ones kept.

Documents look up all of a slice's distinct n-grams at once. Models of at most
BROADCAST_BYTES are broadcast. Beyond that, each UNIT_TOKENS of documents become a unit
that sends its distinct n-grams to the shards, gets their values back and is summed
up: the same numbers by another way. What is written of a unit is its words and which
of them each token is; what goes to a shard and back are compressed deltas and codes,
and where they belong in the unit is found again from its tokens.

Levels are read in place, as NumPy views of the Arrow buffers or broadcast bytes that
hold them; no file of one machine is involved. Keys of words have 64 bits; in tries a
context is told by 40 of them and a successor by 24 of its own beside its shard.

Null texts are empty: one end. Very long texts are read in pieces. Repeated rows each
have their score, and count each in training. Rows without a doc_id are held in
training (a null remainder is not 2) and have a null held_out. Other columns are
ignored. An empty table gives an empty result; without training texts every token is
unknown.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .elias_fano import CHILD, CHILD_BITS, Sequence, Trie

DISCOUNT, LEAST_COUNT = 0.75, 2
#: Keys of the marks of a text; steps of a quantised probability in an octave.
START, END, STEPS = np.uint64(1), np.uint64(2), 8
#: Tokens for each shard; tokens that a task sorts at a time, of triples half as many; bytes of a model that may be broadcast, and of the pairs that triples are chosen by.
SHARD_TOKENS, GATHERED, BROADCAST_BYTES, PAIR_BYTES = 2_000_000, 2_500_000, 160_000_000, 128_000_000
#: Tokens of a unit of documents that asks shards.
UNIT_TOKENS = 500_000
#: Bytes of text that are expanded at a time, to about 100 times as much, beside a worker's copy of the model.
SLICE_BYTES = 1_000_000
U = np.uint64


def held_out() -> F.Column:
    return common.id_crc("doc_id") % 7 == 2


# What a text says


@dataclass
class Tokens:
    """The keys of some texts with their marks; at[] are the places of tokens, row[] whose they are."""

    keys: np.ndarray
    at: np.ndarray
    row: np.ndarray

    def paired(self) -> np.ndarray:
        """Places that end a pair: tokens, and words repeated from the piece before."""
        at = np.flatnonzero(self.keys != START)
        return at[at > 0]


def tokens(piece: words.Piece, rows: int) -> Tokens:
    fresh = len(piece.start) - int(piece.repeated)
    n = np.bincount(piece.row, minlength=rows)
    starts = np.full(rows, 2, np.int64)
    if piece.repeated:
        starts[0] = max(2 - int(piece.repeated), 0)
    ends = np.zeros(rows, np.int64)
    ends[piece.closed] = 1
    first = np.cumsum(starts + n + ends) - (starts + n + ends)  # of each row
    keys = np.full(int((starts + n + ends).sum()), START, np.uint64)
    place = first[piece.row] + starts[piece.row] + np.arange(len(piece.row)) - (np.cumsum(n) - n)[piece.row]
    keys[place] = piece.keys()
    marks = (first + starts + n)[piece.closed]
    keys[marks] = END
    at = np.concatenate((place[len(place) - fresh :], marks))
    row = np.concatenate((piece.row[len(place) - fresh :], piece.closed))
    order = np.argsort(at, kind="stable")
    return Tokens(keys, at[order], row[order])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in common.slices(batches, limit=SLICE_BYTES):
        for piece in words.pieces(batch, words.BLANK, repeat=2, limit=SLICE_BYTES):
            yield tokens(piece, batch.num_rows)


def pair_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context >> U(64 - 40) << U(CHILD_BITS) | word & CHILD


# Shards


@dataclass(frozen=True)
class Shards:
    """Where n-grams are: by context, but for hot contexts, whose successors are dealt out; words by their own keys."""

    n: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # contexts (40 bits), ascending
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # tokens behind each

    def of_word(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix64(keys) % U(self.n)).astype(np.int64)

    def of_pair(self, pairs: np.ndarray) -> np.ndarray:
        context = pairs >> U(CHILD_BITS)
        by = np.where(self.is_hot(context), pairs, context)
        return (common.mix64(by) % U(self.n)).astype(np.int64)

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(context), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)] == context


def cut(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values."""
    edges = np.flatnonzero(np.diff(which)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(which)], strict=True):
        if stop > start:
            yield int(which[start]), slice(start, stop)


def deltas(values: np.ndarray) -> bytes:
    """Ascending values as the bytes of their differences, byte by byte, so that the many zeros compress."""
    return planes(np.diff(values, prepend=U(0)))


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).reshape(-1).view(kind)


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each is there."""
    values = np.sort(values)
    at = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    return values[at], np.diff(at, append=len(values))


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values = values[order]
    at = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    return values[at], np.add.reduceat(counts[order], at, dtype=np.int64) if len(at) else counts[:0].astype(np.int64)


def gathered(parts: Iterator[np.ndarray], limit: int = GATHERED) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= limit:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


# Training


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n) of every distinct token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in gathered(t.keys[t.at] for t in read(batches)):
            keys, n = counted(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
        common.release()

    return common.checkpoint(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))


PAIRS = "shard int, keys binary, counts binary"


def count_pairs(texts: DataFrame, shards: Shards) -> DataFrame:
    """A row for each shard: its kept pairs and their counts and quantised probabilities, and what they leave of each context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in gathered(pair_of(t.keys[t.at - 1], t.keys[t.at]) for t in read(batches)):
            pairs, n = counted(pairs)
            which = shards.of_pair(pairs)
            order = np.argsort(which.astype(np.uint32), kind="stable")
            pairs, n, which = pairs[order], n[order].astype(np.uint32), which[order]
            for shard, some in cut(which):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([deltas(pairs[some])]), pa.array([planes(n[some])])], names=["shard", "keys", "counts"])
        common.release()

    def keep(table: pa.Table) -> pa.Table:
        pairs, n = summed(np.concatenate([undeltas(x) for x in table["keys"].to_pylist()]), np.concatenate([unplaned(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64))
        context = pairs >> U(CHILD_BITS)
        at = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        total = np.add.reduceat(n, at)
        hot = shards.is_hot(context[at])
        total[hot] = shards.totals[np.searchsorted(shards.hot, context[at][hot])]
        total = np.repeat(total, np.diff(at, append=len(context)))
        kept = n >= LEAST_COUNT
        pairs, n, context, total = pairs[kept], n[kept], context[kept], total[kept]
        code = quantised((n - DISCOUNT) / total)
        at = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        mass = np.add.reduceat(probability(code), at) if len(at) else np.zeros(0)
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "keys": [deltas(pairs)], "counts": [planes(n.astype(np.uint64))], "codes": [code.tobytes()], "contexts": [deltas(context[at])], "mass": [mass.tobytes()]})

    rows = texts.mapInArrow(count, PAIRS)
    return common.checkpoint(rows.groupBy("shard").applyInArrow(keep, PAIRS + ", codes binary, contexts binary, mass binary"))


def quantised(p: np.ndarray) -> np.ndarray:
    """The number of steps down from one, rounded down in probability."""
    return np.clip(np.ceil(-np.log2(np.maximum(p, 1e-300)) * STEPS), 0, 255).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    """Of a step; the last one, to which all that are smaller would be raised, counts as nothing."""
    return TABLE[code]


TABLE = np.where(np.arange(256) < 255, 2.0 ** (-np.arange(256) / STEPS), 0.0)
TRIE = ["roots", "pairs", "pair_code", "pair_left", "pointers", "triples", "triple_code"]
TRIE_COLUMNS = "shard int, " + ", ".join(f"{x} binary" for x in TRIE)


def open_tries(rows: list[dict]) -> dict[int, Trie]:
    return {row["shard"]: Trie.open(row) for row in rows}


def collected(table: DataFrame) -> list[dict]:
    """The rows of a table whose size was checked, a few at a time: the driver's heap never holds them all."""
    rows = [row.asDict() for row in table.coalesce(16).toLocalIterator()]
    common.release()
    return rows


def bytes_of(table: DataFrame) -> int:
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "binary"]
    return table.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0


def look_up_pairs(tries: dict[int, Trie], shards: Shards, pairs: np.ndarray) -> np.ndarray:
    """The number of each of ascending pairs in its shard, -1 where a pair is not kept."""
    which, number = shards.of_pair(pairs), np.full(len(pairs), -1, np.int64)
    order = np.argsort(which.astype(np.uint32), kind="stable")
    for shard, some in cut(which[order]):
        if shard in tries:
            number[order[some]] = tries[shard].find_pairs(pairs[order[some]])
    return number


def count_triples(texts: DataFrame, pairs: DataFrame, shards: Shards, broadcast: int) -> DataFrame:
    """The tries: pairs with their triples."""
    shared = None
    if bytes_of(pairs.select("keys")) <= broadcast:  # the bound of what a trie of them takes
        tries = pairs.select("shard", "keys", "codes").mapInArrow(pairs_alone, TRIE_COLUMNS)
        shared = texts.sparkSession.sparkContext.broadcast(collected(tries))

    def triples(t: Tokens, kept: dict[int, Trie] | None) -> np.ndarray:
        """(pair, last word's key) of each triple, as columns."""
        at = t.paired()
        pair, there = np.zeros(len(t.keys), np.uint64), np.zeros(len(t.keys), bool)
        pair[at] = pair_of(t.keys[at - 1], t.keys[at])
        there[at] = True
        if kept is not None:
            distinct, place = ranks(pair[at])
            there[at] = (look_up_pairs(kept, shards, distinct) >= 0)[place]
        known = t.at[there[t.at] & there[t.at - 1]]
        return np.stack((pair[known - 1], t.keys[known] & CHILD), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = open_tries(shared.value) if shared is not None else None
        for rows in gathered((triples(t, kept) for t in read(batches)), GATHERED // 2):
            pair, place = ranks(rows[:, 0])
            which = shards.of_pair(pair)
            order = np.argsort(which.astype(np.uint32), kind="stable")  # pairs by shard, still ascending in each
            new = np.empty(len(order), np.uint64)
            new[order] = np.arange(len(order), dtype=np.uint64)
            both, n = counted(new[place] << U(CHILD_BITS) | rows[:, 1])
            owner = (both >> U(CHILD_BITS)).astype(np.int64)
            children = np.bincount(owner, minlength=len(order))
            ends = np.cumsum(children)
            for shard, some in cut(which[order]):
                inside = slice(int(ends[some.start] - children[some.start]), int(ends[some.stop - 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), *(pa.array([x]) for x in (deltas(pair[order[some]]), planes(children[some].astype(np.uint32)), planes((both[inside] & CHILD).astype(np.uint32)), planes(n[inside].astype(np.uint32))))], names=["shard", "keys", "children", "last", "counts"]
                )
        common.release()

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pairs, n_pair, code = undeltas(row["keys"]), unplaned(row["counts"], np.uint64).astype(np.int64), np.frombuffer(row["codes"], np.uint8)
        found, counts = [], []
        for part in (batch.slice(k, 1).to_pylist()[0] for batch in right.to_batches() for k in range(batch.num_rows)):
            keys = undeltas(part["keys"])
            place = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[place] == keys if len(pairs) else np.zeros(len(keys), bool)
            children = unplaned(part["children"], np.uint32)
            known = np.repeat(known, children)
            found.append((np.repeat(place, children).astype(np.uint64) << U(CHILD_BITS) | unplaned(part["last"], np.uint32).astype(np.uint64))[known])
            counts.append(unplaned(part["counts"], np.uint32)[known])
        triples, n = summed(np.concatenate(found), np.concatenate(counts)) if found else (pairs[:0], n_pair[:0])
        del found, counts
        triples, n = triples[n >= LEAST_COUNT], n[n >= LEAST_COUNT]
        owner = (triples >> U(CHILD_BITS)).astype(np.int64)
        triple_code = quantised((n - DISCOUNT) / n_pair[owner])
        rest = 1 - np.bincount(owner, weights=probability(triple_code), minlength=len(pairs))
        columns = Trie.columns(pairs, code, triples, triple_code, np.floor(np.clip(rest, 0, 1) * 65535))
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), **{k: pa.array([columns[k]], pa.binary()) for k in TRIE}})

    rows = texts.mapInArrow(count, "shard int, keys binary, children binary, last binary, counts binary")
    out = common.checkpoint(pairs.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(build_or_none(build), TRIE_COLUMNS))
    if shared is not None:
        shared.unpersist()
    return out


def build_or_none(build):  # noqa: ANN001, ANN201
    """A shard that has triples but no kept pair has no trie."""
    empty = pa.schema([("shard", pa.int32()), *((k, pa.binary()) for k in TRIE)]).empty_table()
    return lambda left, right: build(left, right) if left.num_rows else empty


def pairs_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            columns = Trie.columns(undeltas(row["keys"]), np.frombuffer(row["codes"], np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), *(pa.array([columns[k]], pa.binary()) for k in TRIE)], names=["shard", *TRIE])


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and which of them each value is."""
    order = np.argsort(values)
    sorted_ = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return sorted_[fresh], place


def narrow(counts: np.ndarray) -> np.ndarray:
    """As the smallest kind of integer that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1")


VOCABULARY = "shard int, words binary, counts binary, contexts binary, left binary"


def vocabulary(counts: DataFrame, pairs: DataFrame, shards: Shards) -> DataFrame:
    """For each shard its words with their counts, and what pairs leave of the share of each context."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(undeltas(row["contexts"]).view(np.int64)), pa.array(np.frombuffer(row["mass"], np.float64))], names=["key", "mass"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("shard", pa.array(shards.of_word(batch.column("key").to_numpy().view(np.uint64)).astype(np.int32)))

    def build(table: pa.Table) -> pa.Table:
        is_word = table["mass"].is_null().to_numpy()
        keys = table["key"].to_numpy().view(np.uint64)
        out = {"shard": pa.array([table["shard"][0].as_py()], pa.int32())}
        order = np.argsort(keys[is_word])
        out |= {"words": [Sequence.dump(keys[is_word][order], 1 << 64)], "counts": [narrow(table["n"].to_numpy()[is_word][order]).tobytes()]}
        mass, contexts = table["mass"].to_numpy()[~is_word], keys[~is_word]
        order = np.argsort(contexts)
        return pa.table(out | {"contexts": [Sequence.dump(contexts[order], 1 << 40)], "left": [np.floor(np.clip(1 - mass[order], 0, 1) * 65535).astype(np.uint16).tobytes()]})

    contexts = pairs.select("contexts", "mass").mapInArrow(decode, "key long, mass double").groupBy("key").agg(F.sum("mass").alias("mass"))
    rows = counts.select("key", "n", F.lit(None).cast("double").alias("mass")).union(contexts.select("key", F.lit(None).cast("long"), "mass"))
    return common.checkpoint(rows.mapInArrow(deal, "key long, n long, mass double, shard int").groupBy("shard").applyInArrow(build, VOCABULARY))


@dataclass
class Model:
    """Tables of a trained model: a row a shard."""

    shards: Shards
    tokens: int
    distinct: int
    vocabulary: DataFrame
    tries: DataFrame


def train(texts: DataFrame, shard_tokens: int = SHARD_TOKENS, broadcast: int = PAIR_BYTES) -> Model:
    """texts: a column text, a row for each training text."""
    texts = texts.select("text")
    counts = count_words(texts)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("key") == int(END)).select(F.lit(int(START)).alias("key"), "n")
    behind = counts.filter(F.col("key") != int(END)).union(ends)  # a context's tokens: a start has as many as there are ends
    behind = behind.groupBy(F.shiftrightunsigned("key", 24).alias("context")).agg(F.sum("n").alias("n"))
    hot = sorted(map(tuple, behind.filter(F.col("n") > shard_tokens).collect()))  # at most total / shard_tokens
    shards = Shards(total // shard_tokens + 1, np.array([x for x, _ in hot], np.uint64), np.array([n for _, n in hot], np.int64))
    pairs = count_pairs(texts, shards)
    return Model(shards, total, distinct, vocabulary(counts, pairs, shards), count_triples(texts, pairs, shards, broadcast))


# Scoring


def squeezed(*arrays: np.ndarray) -> bytes:
    body = pickle.dumps([(x.dtype.str, planes(x)) for x in arrays])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return [unplaned(x, np.dtype(kind)) for kind, x in pickle.loads(body)]


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=U(0))


def joined(parts: list[tuple[Tokens, int]]) -> Tokens:
    """Tokens of several slices behind each other, each with the number of rows before it."""
    before = np.cumsum([0, *(len(t.keys) for t, _ in parts[:-1])])
    return Tokens(np.concatenate([t.keys for t, _ in parts]), np.concatenate([t.at + n for (t, _), n in zip(parts, before, strict=True)]), np.concatenate([t.row + n for t, n in parts]))


def packed(t: Tokens, rows: int) -> bytes:
    keys, place = ranks(t.keys)
    own = np.zeros(len(place), bool)
    own[t.at] = True
    return squeezed(steps(keys), narrow(place), np.packbits(own), narrow(np.bincount(t.row, minlength=rows)))


def unpacked(data: bytes) -> Tokens:
    keys, place, own, n = unsqueezed(data)
    at = np.flatnonzero(np.unpackbits(own, count=len(place)))
    return Tokens(np.cumsum(keys, dtype=np.uint64)[place], at, np.repeat(np.arange(len(n)), n))


@dataclass
class Unit:
    """The distinct n-grams of a slice of texts, each asked for once, and how its tokens read the answers."""

    keys: np.ndarray  # of words, ascending
    pairs: np.ndarray  # ascending
    first: np.ndarray  # of each distinct triple which pair it begins with
    last: np.ndarray  # and the key of its last word
    word: np.ndarray  # of each token which word it is
    context: np.ndarray  # which word is before it
    pair: np.ndarray  # which pair it ends
    before: np.ndarray  # which pair is before it, -1 for none
    triple: np.ndarray  # which triple it ends, -1 for none
    row: np.ndarray  # whose it is

    @staticmethod
    def of(t: Tokens) -> Unit:
        keys, key = ranks(t.keys)
        at = t.paired()
        pairs, place = ranks(pair_of(t.keys[at - 1], t.keys[at]))
        pair = np.full(len(t.keys), -1, np.int64)
        pair[at] = place
        before = pair[t.at - 1]
        some = np.flatnonzero(before >= 0)
        triples, place = ranks(before[some].astype(np.uint64) << U(32) | key[t.at[some]].astype(np.uint64))
        triple = np.full(len(t.at), -1, np.int64)
        triple[some] = place
        last = keys[(triples & U(0xFFFFFFFF)).astype(np.int64)]
        return Unit(keys, pairs, (triples >> U(32)).astype(np.int64), last & CHILD, key[t.at], key[t.at - 1], pair[t.at], before, triple, t.row)


@dataclass
class Ask:
    """What a unit asks of one shard; *_at says where in the unit the answers go."""

    words: np.ndarray
    words_at: np.ndarray
    contexts: np.ndarray
    contexts_at: np.ndarray
    pairs: np.ndarray
    pairs_at: np.ndarray
    first: np.ndarray  # which of these pairs a triple begins with
    last: np.ndarray
    triples_at: np.ndarray

    def dump(self) -> bytes:
        """What a shard must know: words, contexts and pairs ascend; of pairs each context, how many there are of it and the successors."""
        behind = self.pairs >> U(CHILD_BITS)
        at = np.flatnonzero(np.diff(behind, prepend=~behind[:1]))
        return squeezed(steps(self.words), steps(self.contexts), steps(behind[at]), narrow(np.diff(at, append=len(behind))), (self.pairs & CHILD).astype(np.uint32), narrow(np.bincount(self.first, minlength=len(self.pairs))), self.last.astype(np.uint32))

    @staticmethod
    def load(data: bytes) -> Ask:
        *ascending, successors, child, n, last = unsqueezed(data)
        words_, contexts, behind = (np.cumsum(x, dtype=np.uint64) for x in ascending)
        pairs = np.repeat(behind << U(CHILD_BITS), successors) | child
        at = [np.arange(len(x)) for x in (words_, contexts, pairs, last)]
        return Ask(words_, at[0], contexts, at[1], pairs, at[2], np.repeat(at[2], n), last.astype(np.uint64), at[3])


def asks(unit: Unit, shards: Shards) -> dict[int, Ask]:
    of_pair = shards.of_pair(unit.pairs)
    parts = []
    for which in (shards.of_word(unit.keys), shards.of_word(unit.keys >> U(24)), of_pair, of_pair[unit.first]):
        order = np.argsort(which.astype(np.uint32), kind="stable")
        parts.append({shard: order[some] for shard, some in cut(which[order])})
    inside = np.zeros(len(unit.pairs), np.int64)
    for at in parts[2].values():
        inside[at] = np.arange(len(at))
    none = np.zeros(0, np.int64)
    found = {}
    for shard in set().union(*parts):
        words_at, contexts_at, pairs_at, triples_at = (part.get(shard, none) for part in parts)
        found[shard] = Ask(unit.keys[words_at], words_at, unit.keys[contexts_at] >> U(24), contexts_at, unit.pairs[pairs_at], pairs_at, inside[unit.first[triples_at]], unit.last[triples_at], triples_at)
    return found


#: Codes of what no table holds: no probability, and all of the share left.
NONE, ALL = 255, 65535


def answer(ask: Ask, words_: dict | None, trie: Trie | None) -> list[np.ndarray]:
    """Counts of words, and as codes: shares that contexts leave, probabilities of pairs and shares they leave, probabilities of triples."""
    n, left = np.zeros(len(ask.words), np.int64), np.full(len(ask.contexts), ALL, np.uint16)
    own, rest, deep = np.full(len(ask.pairs), NONE, np.uint8), np.full(len(ask.pairs), ALL, np.uint16), np.full(len(ask.triples_at), NONE, np.uint8)
    if words_ is not None:
        at = words_["words"].find(ask.words)
        n[at >= 0] = words_["counts"][at[at >= 0]]
        at = words_["contexts"].find(ask.contexts)
        left[at >= 0] = words_["left"][at[at >= 0]]
    if trie is not None:
        number = trie.find_pairs(ask.pairs)
        found = np.flatnonzero(number >= 0)
        own[found] = trie.pair_code[number[found]]
        rest[found] = trie.pair_left[number[found]]
        begins = np.zeros(len(number), bool)
        begins[found] = trie.has_triples(number[found])
        some = np.flatnonzero(begins[ask.first])
        at = trie.find_triples(number[ask.first[some]], ask.last[some])
        deep[some[at >= 0]] = trie.triple_code[at[at >= 0]]
    return [n, left, own, rest, deep]


def finish(unit: Unit, answers: dict[int, list[np.ndarray]], asked: dict[int, Ask], rows: int, total: int, distinct: int) -> list[np.ndarray]:
    """Tokens, known tokens, base score and score of each row."""
    n, left = np.zeros(len(unit.keys), np.int64), np.full(len(unit.keys), ALL, np.uint16)
    own, rest, deep = np.full(len(unit.pairs), NONE, np.uint8), np.full(len(unit.pairs), ALL, np.uint16), np.full(len(unit.first) + 1, NONE, np.uint8)  # the last one for no triple
    for shard, ask in asked.items():
        for into, at, values in zip((n, left, own, rest, deep), (ask.words_at, ask.contexts_at, ask.pairs_at, ask.pairs_at, ask.triples_at), answers[shard], strict=True):
            into[at] = values
    left, rest, own, deep = left / 65535, rest / 65535, probability(own), probability(deep)
    base = (n + 1.0) / (total + distinct + 1)
    share = np.where(unit.before >= 0, rest[unit.before] if len(rest) else 1.0, 1.0)
    p = deep[unit.triple] + share * (own[unit.pair] + left[unit.context] * base[unit.word])
    sums = [np.ones(len(p)), n[unit.word] > 0, np.log10(base)[unit.word], np.log10(p)]
    return [np.bincount(unit.row, weights=x, minlength=rows) for x in sums]


def open_words(row: dict) -> dict:
    words_, contexts = Sequence(row["words"]), Sequence(row["contexts"])
    return {"words": words_, "counts": widened(row["counts"], words_.n), "contexts": contexts, "left": np.frombuffer(row["left"], np.uint16)}


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored_batch(batch: pa.RecordBatch, sums: list[np.ndarray], **more: pa.Array) -> pa.RecordBatch:
    n, known, base, score = sums
    columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score), **more}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def score_by_broadcast(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((collected(model.vocabulary), collected(model.tries)))
    shards, total, distinct = model.shards, model.tokens, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tries = shared.value
        known, opened = {row["shard"]: open_words(row) for row in vocabulary}, open_tries(tries)
        for batch in common.slices(batches, limit=SLICE_BYTES):
            sums = [np.zeros(batch.num_rows) for _ in range(4)]
            for piece in words.pieces(batch, words.BLANK, repeat=2, limit=SLICE_BYTES):
                unit = Unit.of(tokens(piece, batch.num_rows))
                asked = asks(unit, shards)
                answers = {k: answer(ask, known.get(k), opened.get(k)) for k, ask in asked.items()}
                for into, values in zip(sums, finish(unit, answers, asked, batch.num_rows, total, distinct), strict=True):
                    into += values
            yield scored_batch(batch, sums)
        common.release()

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def score_by_join(docs: DataFrame, model: Model) -> DataFrame:
    """As by broadcast: units of documents are written, what they ask goes to the shards, and the answers come back."""
    shards, total, distinct = model.shards, model.tokens, model.distinct

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = row = TaskContext.get().partitionId() << 33
        held, rows, ids = [], [], []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([packed(joined(held), len(rows))], pa.binary())], names=["unit", "rows", "ids", "body"])

        for batch in common.slices(batches, limit=SLICE_BYTES):
            own = batch.column("doc_id").to_pylist()
            for piece in words.pieces(batch, words.BLANK, repeat=2, limit=SLICE_BYTES):
                held.append((tokens(piece, batch.num_rows), len(rows)))
                rows, ids = rows + list(range(row, row + len(own))), ids + own
                if sum(len(t.at) for t, _ in held) >= UNIT_TOKENS:
                    yield ready()
                    unit, held, rows, ids = unit + 1, [], [], []
            row += len(own)
        if held:
            yield ready()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, body in zip(batch.column("unit"), batch.column("body"), strict=True):
                asked = asks(Unit.of(unpacked(body.as_py())), shards)
                yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int32()), pa.array([unit.as_py()] * len(asked), pa.int64()), pa.array([x.dump() for x in asked.values()], pa.binary())], names=["shard", "unit", "body"])
        common.release()

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = right.to_pylist()
        known = next((open_words(x) for x in tables if x["words"] is not None), None)
        trie = next((Trie.open(x) for x in tables if x["roots"] is not None), None)
        bodies = []
        for body in left["body"]:
            n, *codes = answer(Ask.load(body.as_py()), known, trie)
            bodies.append(squeezed(narrow(n), *codes))
        return pa.table({"unit": left["unit"], "shard": left["shard"], "body": pa.array(bodies, pa.binary())})

    def finish_unit(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        unit = Unit.of(unpacked(row["body"]))
        answers = {k.as_py(): unsqueezed(x.as_py()) for k, x in zip(right["shard"], right["body"], strict=True)}
        n, known, base, score = finish(unit, answers, asks(unit, shards), len(row["ids"]), total, distinct)
        return pa.table({"row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": score})

    units = common.checkpoint(docs.select("doc_id", "text").mapInArrow(split, "unit long, rows array<long>, ids array<long>, body binary"))
    asked = units.select("unit", "body").mapInArrow(ask, "shard int, unit long, body binary")
    tables = model.vocabulary.unionByName(model.tries, allowMissingColumns=True)
    answers = asked.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(look_up, "unit long, shard int, body binary")
    done = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(finish_unit, "row long, " + SCORED)
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    return done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums).drop("row")


def score(docs: DataFrame, model: Model, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Every document with its tokens, those known, and its log10 probability by counts alone and by the model."""
    small = bytes_of(model.vocabulary) + bytes_of(model.tries) <= broadcast
    found = (score_by_broadcast if small else score_by_join)(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs.filter(~F.coalesce(held_out(), F.lit(False)))))
