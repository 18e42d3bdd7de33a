"""Quality classification by co-training.

Two logistic classifiers see different views of a document: one its text (what its
words say, shares of kinds of characters, repetition, word lengths), one its metadata
(source, language, length). What words say is one feature: the mean log odds of good
quality over a text's distinct words, hashed, counted in the labelled sample; of a
labelled document the counts leave its own words out. Over some rounds each labels all unlabelled documents of which
it is sure, and the other learns from them too: the classes weigh what they do
among the labels, and all together no more than a number that grows by round. The
unlabelled documents stay in Spark; a fit takes sums over them. Each view is then calibrated on labelled
documents that it did not learn from, and the two log odds add up, less the prior
that both contain; a document is rejected where the combined probability of good
quality is under a half.

Null and empty texts are rejected with score 0. Null metadata are values of their
own. Labels of repeated or clashing rows count by their mean; without labels of
both classes every document with text is kept with score 1. Repeated rows are
each scored; of labelled rows with one doc_id one, by a hash, is learned from; other columns pass by; an empty table gives an empty result. Very long
texts are read whole; a probability of exactly a half is good quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the sample of labelled documents, drawn by a hash of doc_id.
LABELLED = 6000
#: Rounds, how sure a view must be, and the weight of the documents labelled so in the first round.
ROUNDS, SURE, EACH_ROUND = 5, 0.95, 200
THRESHOLD = 0.5
RIDGE = 1.0
#: Rows of sums, one a task, that are added up at a time: in a task of the next level, at last on the driver.
FAN_IN = 64
SYMBOLS, UPPER, LOWER, DIGITS, PUNCTUATION = (np.array([chr(b) in s for b in range(256)]) for s in ("#*$%&|<>@^~_=+{}[]\\/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:!?'\"()-"))
META_BUCKETS = 64
#: Bits of a word's hash, and labelled documents that a word must stand in to say something.
WORD_BITS, LEAST_DOCS = 18, 3


def word_hashes(text: str) -> np.ndarray:
    """Distinct hashes of a text's words, in lower case."""
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    return np.unique(np.fromiter(map(crc32, words), np.int64, len(words)) & ((1 << WORD_BITS) - 1))


@dataclass
class WordOdds:
    """In how many labelled documents of either label each hashed word stands."""

    n: np.ndarray  # documents of label 0 and 1
    counts: np.ndarray  # (words, 2)

    def say(self, h: np.ndarray, but: int | None = None) -> float:
        """The mean log odds of words, without the counts of the document itself if it is one of label `but`."""
        if not len(h):
            return 0.0
        c, n = self.counts[h].astype(float), self.n.astype(float)
        if but is not None:
            c[:, but] -= 1
            n[but] -= 1
        known = c.sum(1) >= LEAST_DOCS
        odds = np.log((c[:, 1] + 0.5) / (n[1] + 1)) - np.log((c[:, 0] + 0.5) / (n[0] + 1))
        return float(np.where(known, odds, 0.0).mean())


def text_view(text: str, says: float = 0.0) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    upper, lower = kinds[UPPER].sum(), kinds[LOWER].sum()
    lines = data.count(b"\n") + 1
    return [
        says,
        kinds[SYMBOLS].sum() / size,
        kinds[ord("|")] / n,
        upper / max(upper + lower, 1),
        kinds[DIGITS].sum() / size,
        kinds[PUNCTUATION].sum() / n,
        kinds[ord("!")] / n,
        len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(len, words)) / n / 10,
        np.log1p(n) / 10,
        np.log1p(n / lines) / 5,
    ]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    row = [0.0] * (2 * META_BUCKETS + 12)
    row[xxhash.xxh32_intdigest(f"s{source}") % META_BUCKETS] = 1.0
    row[META_BUCKETS + xxhash.xxh32_intdigest(f"l{lang}") % META_BUCKETS] = 1.0
    row[2 * META_BUCKETS + (11 if n_chars is None else min(10, int(np.log2(max(n_chars, 1)) * 0.75)))] = 1.0
    return row


TEXT_SIZE, META_SIZE = len(text_view("")), len(meta_view(None, None, None))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack(((x - self.mean) / self.scale, np.ones(len(x)))) @ self.beta, -15, 15)


Views = tuple[np.ndarray, np.ndarray]
#: Sums over all unlabelled documents of what a function makes of their views.
Pool = Callable[[Callable[[Views], np.ndarray]], np.ndarray]


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack(((x - mean) / scale, np.ones(len(x))))


def sure(teacher: Logistic, x: np.ndarray) -> list[np.ndarray]:
    """The rows that a view is sure are of label 0, and of label 1."""
    p = 1 / (1 + np.exp(-teacher.odds(x)))
    return [1 - p >= SURE, p >= SURE]


def moments(views: Views, teachers: list[Logistic]) -> np.ndarray:
    """For each view and label that the other view is sure of: the number of rows, their sum and that of squares."""
    out = []
    for v in (0, 1):
        for rows in sure(teachers[1 - v], views[1 - v]):
            x = views[v][rows]
            out += [[float(len(x))], x.sum(0), (x * x).sum(0)]
    return np.concatenate(out)


def slopes(z: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Second derivatives and gradient of the log likelihood, in one row."""
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -15, 15)))
    return np.concatenate((((z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z).ravel(), z.T @ (weight * (y - p))))


def pool_slopes(views: Views, teachers: list[Logistic], models: list[Logistic], weights: list[list[float]]) -> np.ndarray:
    out = []
    for v in (0, 1):
        bad, good = sure(teachers[1 - v], views[1 - v])
        rows = bad | good
        y = good[rows].astype(float)
        out.append(slopes(standard(views[v][rows], models[v].mean, models[v].scale), y, np.where(y == 1, weights[v][1], weights[v][0]), models[v].beta))
    return np.concatenate(out)


def fit_views(views: tuple[np.ndarray, ...], y: np.ndarray, teachers: list[Logistic] | None = None, pool: Pool | None = None, mass: tuple[float, float] = (0.0, 0.0)) -> list[Logistic]:
    """Ridge logistic regressions by Newton steps, one a view, of labelled rows and of those in the pool that the other view's teacher is sure of: at most `mass` a label, shared evenly by all of them."""
    found, weights = [], [[0.0, 0.0] for _ in views]
    sums = pool(partial(moments, teachers=teachers)) if pool else None
    for v, x in enumerate(views):
        n, first, second = float(len(x)), x.sum(0), (x * x).sum(0)
        if sums is not None:
            for label in (0, 1):
                m, one, two = sums[0], sums[1 : 1 + x.shape[1]], sums[1 + x.shape[1] : 1 + 2 * x.shape[1]]
                sums = sums[1 + 2 * x.shape[1] :]
                w = weights[v][label] = min(1.0, mass[label] / m) if m else 0.0
                n, first, second = n + w * m, first + w * one, second + w * two
        mean = first / n
        found.append(Logistic(mean, np.maximum(np.sqrt(np.maximum(second / n - mean**2, 0)), 1e-3), np.zeros(x.shape[1] + 1)))
    z = [standard(x, m.mean, m.scale) for x, m in zip(views, found, strict=True)]
    for _ in range(20):
        more = pool(partial(pool_slopes, teachers=teachers, models=found, weights=weights)) if pool else None
        largest = 0.0
        for k, m in enumerate(found):
            size = len(m.beta)
            both = slopes(z[k], y, np.ones(len(y)), m.beta)
            if more is not None:
                both, more = both + more[: len(both)], more[len(both) :]
            ridge = np.append(np.full(size - 1, RIDGE), 1e-3)
            step = np.linalg.solve(both[: size * size].reshape(size, size) + np.diag(ridge), both[size * size :] - ridge * m.beta)
            m.beta = m.beta + np.clip(step, -5, 5)
            largest = max(largest, np.abs(step).max())
        if largest < 1e-5:
            break
    return found


def fit(x: np.ndarray, y: np.ndarray) -> Logistic:
    return fit_views((x,), y)[0]


@dataclass
class Model:
    words: WordOdds
    text: Logistic
    meta: Logistic
    text_calibration: Logistic
    meta_calibration: Logistic
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: combined, by the text, by the metadata."""
        a = self.text_calibration.odds(self.text.odds(text)[:, None])
        b = self.meta_calibration.odds(self.meta.odds(meta)[:, None])
        return tuple(1 / (1 + np.exp(-v)) for v in (a + b - self.prior, a, b))


def co_train(views: Views, y: np.ndarray, free: Views | Pool, words: WordOdds | None = None) -> Model | None:
    """views: text and metadata of labelled documents; free: of unlabelled ones, or sums over them; words: what the text views were made with."""
    if len(set(y.tolist())) < 2:
        return None
    fold = np.arange(len(y)) % 4 == 0  # calibrates, and is not learned from
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold = np.zeros(len(y), bool)
    pool = free if callable(free) else lambda job: job(free)
    learned, share = tuple(v[~fold] for v in views), float(y.mean())
    models = fit_views(learned, y[~fold])
    for round_ in range(1, ROUNDS + 1):
        mass = EACH_ROUND * round_
        models = fit_views(learned, y[~fold], models, pool, (mass * (1 - share), mass * share))
    held = fold if fold.any() else np.ones(len(y), bool)
    calibrated = [fit(m.odds(x[held])[:, None], y[held]) for m, x in zip(models, views, strict=True)]
    return Model(words, *models, *calibrated, float(np.log(y[held].mean() / (1 - y[held].mean()))))


def view_batches(batches: Iterator[pa.RecordBatch], words: WordOdds | None) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    for batch in common.slices(batches):
        every = common.texts(batch)
        text = np.array([text_view(x, words.say(word_hashes(x)) if words else 0.0) for x in every])
        meta = np.array([meta_view(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
        yield batch, every, text, meta


VIEWS = "doc_id long, text_view array<double>, meta_view array<int>"


def named(m: np.ndarray) -> pa.Array:
    return pa.array([np.flatnonzero(row).astype(np.int32) for row in m], pa.list_(pa.int32()))


def labelled_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, every, text, meta in view_batches(batches, None):
        hashes = pa.array([word_hashes(x).astype(np.int32) for x in every], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("draw"), pa.array(list(text)), named(meta), hashes], names=["doc_id", "quality", "draw", "text_view", "meta_view", "words"])


def labelled_sample(rows: DataFrame, truth: DataFrame) -> tuple[pd.DataFrame, WordOdds] | None:
    """Views of about LABELLED labelled documents, in the order of their ids, and what their words say.

    Words are counted in Spark, by hash; a document comes to the driver as its views.
    """
    n = truth.count()
    drawn = truth.filter(common.hash_share("doc_id", 7) < LABELLED / max(n, LABELLED))
    taken = rows.withColumn("draw", F.xxhash64("text", "source", "lang", "n_chars")).join(common.broadcast_if_small(drawn), "doc_id")
    views = taken.mapInArrow(labelled_views, "doc_id long, quality int, draw long, text_view array<double>, meta_view array<int>, words array<int>")
    one = F.min_by(F.struct("quality", "text_view", "meta_view", "words"), "draw").alias("one")
    sample = common.checkpoint(views.groupBy("doc_id").agg(one).select("doc_id", "one.*"))
    counted = sample.select("quality", F.explode("words").alias("word")).groupBy("word", "quality").count().toPandas()  # at most two rows a hash of WORD_BITS
    counts = np.zeros((1 << WORD_BITS, 2), np.int32)
    counts[counted["word"], counted["quality"]] = counted["count"]
    sizes = {r.quality: r["count"] for r in sample.groupBy("quality").count().collect()}  # two rows
    if not sizes:
        return None
    words = WordOdds(np.array([sizes.get(0, 0), sizes.get(1, 0)]), counts)
    shared = sample.sparkSession.sparkContext.broadcast(words)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("words").to_numpy(zero_copy_only=False)
            says = [shared.value.say(h, label) for h, label in zip(hashes, batch.column("quality").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "quality", "text_view", "meta_view")] + [pa.array(says, pa.float64())], names=["doc_id", "quality", "text_view", "meta_view", "says"])

    found = sample.mapInArrow(said, "doc_id long, quality int, text_view array<double>, meta_view array<int>, says double").toPandas()
    return found.sort_values("doc_id"), words


def added(parts: pa.Table) -> pa.Table:
    """One row for a group of rows (part, sums), in the order of their parts, so that sums do not hang on the order of arrival."""
    rows = parts.sort_by("part")
    total = None
    for sums in rows.column("sums"):
        x = sums.values.to_numpy(zero_copy_only=False)
        total = x if total is None else total + x
    return pa.table({"part": pa.array([rows["team"][0].as_py()], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})


def tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of up to n rows (part, sums), part from 0 to n - 1, by teams of FAN_IN: no more rows than that reach a task or the driver."""
    while n > FAN_IN:
        parts = parts.withColumn("team", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("team").applyInArrow(added, "part long, sums array<double>")
        n = -(-n // FAN_IN)
    rows = sorted(parts.collect(), key=lambda r: r.part)
    return np.sum([np.array(r.sums) for r in rows], axis=0) if rows else None


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    truth = labels.filter("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").filter("text is not null")
    sample = labelled_sample(rows, truth)
    if sample is None:
        return None
    found, words = sample
    y = found["quality"].to_numpy(float)
    text = np.stack(found["text_view"].to_list())
    text[:, 0] = found["says"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, text, meta in view_batches(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(text)), named(meta)], names=["doc_id", "text_view", "meta_view"])

    left = rows.join(common.broadcast_if_small(truth.select("doc_id")), "doc_id", "left_anti")
    free = common.checkpoint(left.mapInArrow(views, VIEWS).select("text_view", "meta_view"))  # sixteen numbers a document
    tasks = free.rdd.getNumPartitions()

    def pool(job: Callable[[Views], np.ndarray]) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = job((np.stack(batch.column("text_view").to_numpy(zero_copy_only=False)), dense(batch.column("meta_view").to_numpy(zero_copy_only=False))))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

        total = tree_sum(free.mapInArrow(sums, "sums array<double>").withColumn("part", F.spark_partition_id().cast("long")), tasks)
        return job((np.zeros((0, TEXT_SIZE)), np.zeros((0, META_SIZE)))) if total is None else total

    return co_train((text, dense(found["meta_view"].to_list())), y, pool, words)


def dense(places) -> np.ndarray:
    out = np.zeros((len(places), META_SIZE))
    for row, at in zip(out, places, strict=True):
        row[at] = 1.0
    return out


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (probability of good quality), those of either view, and whether the document is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, every, text, meta in view_batches(batches, model and model.words):
            there = np.array([bool(x.strip()) for x in every])
            scores = model.score(text, meta) if model else (np.ones(len(every)),) * 3
            scores = [np.where(there, s, 0.0) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, scores), pa.array(there & (scores[0] >= THRESHOLD))], names=["doc_id", "score", "text_score", "meta_score", "kept"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, train(docs, labels))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
