"""Quality rules: counting rules and a character n-gram language model.

The model is an interpolated modified Kneser-Ney model of characters, of order
five and across words (blanks between words count as one), for each language.
Spark counts the n-grams of all whole documents in two folds, dealt by a hash of
the text, and derives the lower orders, discounts and back-off weights by joins:
the tables grow with the corpus and stay in Spark. A document is scored by the
fold that it is not in, so that no text vouches for itself.

Scoring looks n-grams up by 64-bit hashes in one sorted array of probabilities and
one of back-off weights. The arrays are broadcast if they were counted to have at
most `broadcast` entries. Beyond that, documents are dealt into groups of bounded
size, each asks the tables by a join for the n-grams it has, and is scored with
the answers: the same numbers, by another way.

Two bands for each language reject documents of too low or too high a perplexity. They
are set from the documents of least perplexity alone, the quarter and the twentieth of
those that pass the counting rules: junk has a high perplexity, so up to about two
thirds of a language may be junk before it moves them. A spread of less than
LEAST_SPREAD counts as that.

Null texts count as empty: no words, so the rules reject them. A null language is
that of the empty name; where the other fold has no text of it, the perplexity is
null and the counting rules decide. Repeated rows are scored alike and all kept;
ties at a band's edge are inside. Very long texts are read in pieces. Other columns
of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
START, END = "\x02", "\x03"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The bands lie so many times the distance from LOW to MIDDLE above and below MIDDLE.
REACH, REACH_DOWN, LOW, MIDDLE, LEAST_SPREAD = 7.5, 5.0, 0.05, 0.25, 0.05
#: Characters that a worker expands at a time; bits of a character's number in a packed n-gram; n-grams it gathers before it merges them.
PIECE, SYMBOL_BITS, GATHERED = 1 << 18, 12, 2_000_000
#: Entries of the arrays that may be broadcast (12 bytes each), and bytes of text in a group of documents beyond that.
BROADCAST_ENTRIES, GROUP_BYTES = 8_000_000, 32_000_000

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MODEL_KEYS = ["fold", "lang"]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + common.mix64(ids[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + common.mix64(ids[2:] ^ np.uint64(0x165667B19E3779F9))
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    often = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= often
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def count_rules(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
    )


def plain(words: list[bytes]) -> str:
    """What the model reads of a text: its words, a blank between two. A null character would be lost at an n-gram's end."""
    return b" ".join(words).decode("utf-8", "surrogatepass").replace("\0", "�")


def fold_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & 1


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts with their marks, ORDER - 1 before and one behind, at most about PIECE at a time, and the number of the text of each that is predicted (-1 for those that are context only)."""
    points, owners, n = [], [], 0
    for k, text in enumerate(texts):
        every = common.code_points(START * (ORDER - 1) + text + END)
        for at in range(ORDER - 1, len(every), PIECE):
            part = every[at - ORDER + 1 : at + PIECE]
            owner = np.full(len(part), k, np.int32)
            owner[: ORDER - 1] = -1
            points.append(part)
            owners.append(owner)
            n += len(part)
            if n >= PIECE:
                yield np.concatenate(points), np.concatenate(owners)
                points, owners, n = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(owners)


class Counter:
    """Counts n-grams exactly, packed as numbers of the characters met so far."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number = np.zeros(0x110000, np.uint16)
        self.alphabet = np.zeros(1, np.uint32)
        self.parts: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, of: tuple[int, str], points: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.unique(points[self.number[points] == 0])
        if len(self.alphabet) + len(fresh) > 1 << SYMBOL_BITS:
            if len(self.alphabet) > 1:  # a new alphabet
                yield from self.emit()
                yield from self.add(of, points, owner)
            else:  # more characters than numbers
                half = len(points) // 2
                yield from self.add(of, points[:half], owner[:half])
                later = owner[half - ORDER + 1 :].copy()
                later[: ORDER - 1] = -1
                yield from self.add(of, points[half - ORDER + 1 :], later)
            return
        self.number[fresh] = np.arange(len(self.alphabet), len(self.alphabet) + len(fresh))
        self.alphabet = np.concatenate((self.alphabet, fresh))
        ids = self.number[points].astype(np.uint64)
        n = len(points) - ORDER + 1
        keys = np.zeros(n, np.uint64)
        for k in range(ORDER):
            keys = keys << np.uint64(SYMBOL_BITS) | ids[k : k + n]
        parts = self.parts.setdefault(of, [])
        parts.append(summed(keys[owner[ORDER - 1 :] >= 0]))
        if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > min(GATHERED, max(len(parts[0][0]), 1 << 18)):
            self.parts[of] = [merged(parts)]
        if sum(len(p[0][0]) for p in self.parts.values()) > 2 * GATHERED:
            yield from self.emit()

    def emit(self) -> Iterator[pa.RecordBatch]:
        shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(SYMBOL_BITS)
        for (fold, lang), parts in self.parts.items():
            keys, counts = merged(parts)
            for at in range(0, len(keys), 1 << 18):
                some = keys[at : at + (1 << 18)]
                grams = self.alphabet[(some[:, None] >> shifts & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)]
                grams = np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), fold, np.int32)), pa.array([lang] * len(some), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(counts[at : at + (1 << 18)])], names=["fold", "lang", "gram", "n"])
        self.clear()


def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(starts, append=len(keys))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def by_model(batch: pa.RecordBatch) -> dict[tuple[int, str], list[int]]:
    """The rows of a batch by the fold and language of their texts."""
    found: dict[tuple[int, str], list[int]] = {}
    for k, (text, lang) in enumerate(zip(common.texts(batch), batch.column("lang").to_pylist(), strict=True)):
        found.setdefault((fold_of(text), lang or ""), []).append(k)
    return found


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in common.slices(batches):
        every = common.texts(batch)
        for of, rows in by_model(batch).items():
            texts = [x for x in (plain(words_of(every[k])) for k in rows) if x]
            for points, owner in pieces(texts):
                yield from counter.add(of, points, owner)
    yield from counter.emit()


def counted(docs: DataFrame) -> DataFrame:
    """(fold, lang, gram, n): how often each n-gram of the highest order stands in the documents of a fold and language."""
    return docs.select("text", "lang").mapInArrow(count_grams, "fold int, lang string, gram string, n long").groupBy(*MODEL_KEYS, "gram").agg(F.sum("n").alias("n"))


def levels(grams: DataFrame) -> DataFrame:
    """(fold, lang, gram, n, size) of all orders. Below the highest an n-gram counts the kinds of characters before it."""
    parts = [grams]
    for _ in range(ORDER - 1):
        parts.append(common.checkpoint(parts[-1].groupBy(*MODEL_KEYS, F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    every = parts[0].withColumn("size", F.lit(ORDER))
    for k, part in enumerate(parts[1:], 1):
        every = every.union(part.withColumn("size", F.lit(ORDER - k)))
    return every


def discounts(every: DataFrame) -> DataFrame:
    """A row for each fold, language and order: what is taken off counts of one, two, and three or more."""
    sizes = [F.count(F.when(F.col("n") == k, 1)).alias(f"t{k}") for k in (1, 2, 3, 4)]
    t = [F.greatest(F.col(f"t{k}"), F.lit(1)) for k in (1, 2, 3, 4)]
    y = t[0] / (t[0] + 2 * t[1])
    cuts = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
    bounded = [F.least(F.greatest(c, F.lit(0.05)), F.lit(top)).alias(f"d{k}") for k, (c, top) in enumerate(zip(cuts, (0.95, 1.9, 2.8), strict=True), 1)]
    return every.groupBy(*MODEL_KEYS, "size").agg(F.count("*").alias("kinds"), *sizes).select(*MODEL_KEYS, "size", "kinds", *bounded)


def model_table(grams: DataFrame) -> DataFrame:
    """(fold, lang, gram, back, log): the probability of each n-gram and, where back is true, the back-off weight of each context.

    The rows of a context are bounded by the alphabet. The back-off weight of the empty
    context is already multiplied with the share of one unknown character.
    """
    every = levels(grams)
    of_context = Window.partitionBy(*MODEL_KEYS, "size", "context")
    rows = every.join(common.broadcast_if_small(common.checkpoint(discounts(every)), 10_000), [*MODEL_KEYS, "size"])
    rows = rows.withColumn("cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    rows = rows.withColumn("total", F.sum("n").over(of_context)).withColumn("back", F.sum("cut").over(of_context) / F.col("total") / F.when(F.col("size") == 1, F.col("kinds") + 1).otherwise(1))
    rows = common.checkpoint(rows.select(*MODEL_KEYS, "size", "gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "back", (F.min("gram").over(of_context) == F.col("gram")).alias("first")))
    out = rows.filter("first").select(*MODEL_KEYS, F.col("context").alias("gram"), F.lit(True).alias("back"), F.log("back").alias("log"))
    lower = None
    for size in range(1, ORDER + 1):
        level = rows.filter(F.col("size") == size)
        if lower is not None:
            level = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower.withColumnRenamed("gram", "suffix"), [*MODEL_KEYS, "suffix"])
        p = level.select(*MODEL_KEYS, "gram", (F.col("own") + F.col("back") * (F.col("p") if size > 1 else 1)).alias("p"))
        lower = common.checkpoint(p) if size < ORDER else p
        out = out.union(lower.select(*MODEL_KEYS, "gram", F.lit(False).alias("back"), F.log("p").alias("log")))
    return out


#: Multipliers of the characters of an n-gram, the last one first.
FACTORS = [pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(ORDER)]


def salt(fold: int, lang: str, order: int, back: bool) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"{fold} {order} {int(back)} {lang}".encode("utf-8", "surrogatepass")))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        grams, out = batch.column("gram").to_pylist(), np.zeros(batch.num_rows, np.uint64)
        names = list(zip(batch.column("fold").to_pylist(), batch.column("lang").to_pylist(), map(len, grams), batch.column("back").to_pylist(), strict=True))
        salts = {x: salt(*x) for x in set(names)}
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        points, ends = common.code_points("".join(grams)).astype(np.uint64), np.cumsum(sizes)
        for k in range(ORDER):
            some = np.flatnonzero(sizes > k)
            out[some] += points[ends[some] - 1 - k] * np.uint64(FACTORS[k])
        out = common.mix64(out + np.fromiter(map(salts.__getitem__, names), np.uint64, len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(batch.column("log").to_numpy().astype(np.float32))], names=["key", "log"])


def entries(table: DataFrame) -> DataFrame:
    """(key, log): n-grams and contexts of a model by their hashes."""
    return table.mapInArrow(hashed, "key long, log float")


class Model:
    """Sorted hash arrays; where the leading bits of a hash begin is kept too, so that a look-up takes few steps."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def open(self) -> Model:
        self.shift = np.uint64(64 - max(1, int(len(self.keys)).bit_length()))
        self.begins = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        return self

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The logs of keys, NaN where there is none."""
        out = np.full(len(keys), np.nan, np.float32)
        if not len(self.keys):
            return out
        head = (keys >> self.shift).astype(np.int64)
        at, stop = self.begins[head], self.begins[head + 1]
        left = np.arange(len(keys))
        while len(left):
            inside = at < stop
            left, at, stop = left[inside], at[inside], stop[inside]
            found = self.keys[at] == keys[left]
            out[left[found]] = self.logs[at[found]]
            miss = ~found
            left, at, stop = left[miss], at[miss] + 1, stop[miss]
        return out

    def score(self, texts: list[str], fold: int, lang: str) -> np.ndarray:
        """The sum of log probabilities of each text's characters and its end; NaN without a model of the language."""
        out = np.zeros(len(texts))
        nothing = self.look_up(common.mix64(np.array([salt(fold, lang, 0, True)])))[0]
        if np.isnan(nothing):
            return np.full(len(texts), np.nan)
        for points, owner in pieces(texts):
            wide = points.astype(np.uint64)
            at = np.flatnonzero(owner >= 0)
            sums = [np.zeros(len(wide), np.uint64)]  # of the n characters that end at a place
            for k in range(ORDER):
                longer = sums[-1].copy()
                longer[k:] += wide[: len(wide) - k] * np.uint64(FACTORS[k])
                sums.append(longer)
            ranked = np.argsort(sums[ORDER][at])  # equal n-grams side by side: each is looked up once
            at = at[ranked]
            sorted_sums = sums[ORDER][at]
            fresh = np.concatenate(([True], sorted_sums[1:] != sorted_sums[:-1]))
            once = at[fresh]
            total, left = np.zeros(len(once)), np.arange(len(once))
            for order in range(ORDER, 0, -1):
                value = self.look_up(common.mix64(sums[order][once[left]] + salt(fold, lang, order, False)))
                there = ~np.isnan(value)
                total[left[there]] += value[there]
                left = left[~there]
                if not len(left):
                    break
                if order > 1:
                    total[left] += np.nan_to_num(self.look_up(common.mix64(sums[order - 1][once[left] - 1] + salt(fold, lang, order - 1, True))))
            total[left] += nothing
            out += np.bincount(owner[at], weights=total[np.cumsum(fresh) - 1], minlength=len(texts))
        return out


def measured(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    every = common.texts(batch)
    split = [words_of(x) for x in every]
    counts = np.array([count_rules(t, w) for t, w in zip(every, split, strict=True)], np.int64).reshape(-1, 5)
    logs = np.full(len(every), np.nan)
    for (fold, lang), rows in by_model(batch).items():
        rows = [k for k in rows if split[k]]
        texts = [plain(split[k]) for k in rows]
        if texts:
            logs[rows] = -model.score(texts, 1 - fold, lang) / np.array([len(x) + 1 for x in texts])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(logs, mask=np.isnan(logs))], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"])


MEASURED = f"doc_id long, lang string, {COUNTS}, log_perplexity double"


def measure_by_broadcast(docs: DataFrame, found: DataFrame) -> DataFrame:
    table = found.toArrow()  # counted before
    model = Model(table["key"].to_numpy().view(np.uint64), table["log"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.open()
        for batch in common.slices(batches):
            yield measured(batch, model)

    return docs.select("doc_id", "text", "lang").mapInArrow(run, MEASURED)


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of documents the hashes that scoring them may look up, once each."""
    last, gathered, n = None, [], 0

    def batch_of() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(gathered))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), last, np.int64)), pa.array(keys.view(np.int64))], names=["group", "key"])

    for batch in common.slices(batches):
        groups = batch.column("group").to_numpy()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(start, stop - start)
            if groups[start] != last or n > GATHERED:
                if gathered:
                    yield batch_of()
                last, gathered, n = int(groups[start]), [], 0
            every = common.texts(part)
            for (fold, lang), rows in by_model(part).items():
                for points, _ in pieces([plain(words_of(every[k])) for k in rows]):
                    sums = np.zeros(len(points), np.uint64)
                    for order in range(ORDER + 1):
                        if order:
                            sums[order - 1 :] += points[: len(points) - order + 1] * np.uint64(FACTORS[order - 1])
                        for back in (False, True):
                            gathered.append(np.unique(common.mix64(sums + salt(1 - fold, lang, order, back))))
                            n += len(gathered[-1])
    if gathered:
        yield batch_of()


def measure_by_join(docs: DataFrame, found: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """As by broadcast, with the answers to what each group of documents asks."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(total // group_bytes + 1))
    dealt = docs.select("doc_id", "text", "lang", group.alias("group"))
    asks = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(asked, "group long, key long")
    answers = asks.distinct().join(found.hint("shuffle_hash"), "key").select("group", "key", "log")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(right["key"].to_numpy().view(np.uint64), right["log"].to_numpy()).open()
        return pa.Table.from_batches([measured(part, model) for part in common.slices(iter(left.to_batches()))], pa.schema(MEASURED_ARROW))

    return dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(run, MEASURED)


MEASURED_ARROW = [("doc_id", pa.int64()), ("lang", pa.string()), *((x.split()[0], pa.int64()) for x in COUNTS.split(", ")), ("log_perplexity", pa.float64())]


def measure(docs: DataFrame, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, lang, the counts and the log perplexity (null without words) of every document."""
    found = common.checkpoint(entries(model_table(common.checkpoint(counted(docs)))))
    return measure_by_broadcast(docs, found) if found.count() <= broadcast else measure_by_join(docs, found)


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, reach: float = REACH, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """Every document with its counts, verdict and perplexity."""
    scored = common.checkpoint(measure(docs, broadcast)).withColumn("base_failed", failed()).withColumn("language", F.coalesce("lang", F.lit("")))
    bands = (
        scored.filter(~F.col("base_failed"))
        .groupBy("language")
        .agg(F.percentile_approx("log_perplexity", F.array(F.lit(LOW), F.lit(MIDDLE)), F.lit(10000)).alias("q"))
        .select(
            "language",
            (F.col("q")[1] - REACH_DOWN * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))).alias("lower"),
            (F.col("q")[1] + reach * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))).alias("upper"),
        )
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return scored.join(common.broadcast_if_small(bands, 10_000), "language", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can state."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: The counting rules; the verdict of the bands has no SQL.
BASE_SQL = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, words[k : k + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM t WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN r USING (doc_id)"""
