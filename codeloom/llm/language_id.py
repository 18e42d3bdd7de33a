"""Language identification by mixture inference.

Character trigrams of labelled documents give each language a distribution over
2**18 hashed trigrams. For each document, expectation-maximisation estimates the
proportions of the languages from the likelihoods of its trigrams. The language
set is chosen by penalised likelihood: of the nested sets of its most present
languages, the one of the highest log likelihood less half a log of the number
of trigrams for each language (times a factor, for neighbouring trigrams are not
independent). The prediction is the largest language of that set; its proportion
is the score.

Texts that are null or have no letter (Unicode category L) are `und` with score 0, as are all texts
when there is no labelled row. Ties go to the language whose name sorts first.
Repeated rows are each scored; other columns pass by; an empty table gives an
empty result. Very long texts are expanded whole in the task that reads them. Only text and lang of labelled rows are learned from; lang, source
and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
#: Bound of the training sample: so many documents of each language, drawn by a hash of doc_id.
DOCS_PER_LANGUAGE = 2000
SMOOTH = 0.5
ROUNDS = 8
PENALTY = 3.0
#: Unicode letters (category L); digits and numbers in letters' shape are none.
LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and the hash of each trigram, letters in lower case, blanks alike."""
    points = [common.code_points(f"  {x.lower()} ") for x in texts]
    of = np.repeat(np.arange(len(points)), [max(len(p) - 2, 0) for p in points])
    every = np.concatenate(points)
    every = np.where(every <= 32, 32, every)
    h = (every[:-2] * np.uint32(0x9E3779B1)) ^ (every[1:-1] * np.uint32(0x85EBCA77) + (every[1:-1] << np.uint32(13))) ^ (every[2:] * np.uint32(0xC2B2AE3D) >> np.uint32(3))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    ends = np.cumsum([len(p) for p in points])
    inside = np.ones(len(every) - 2, bool)
    for k in (1, 2):  # none spans two texts
        inside[ends[:-1] - k] = False
    return of, h[inside].astype(np.int64)


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and a row of their probabilities for each hashed trigram."""
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > docs_per_language:
            share = F.when(F.col("lang") == lang, docs_per_language / n).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            of, h = trigrams(common.texts(batch))
            langs = np.array(batch.column("lang").to_pylist())[of]
            for lang in set(langs.tolist()):
                key, n = np.unique(h[langs == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int32)), pa.array(n)], names=["lang", "key", "n"])

    sample = labelled.filter(common.hash_share("doc_id", 11) < share).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()  # at most 2**18 rows a language
    langs = sorted(set(counts["lang"]))
    table = np.zeros((1 << BITS, len(langs)))
    table[counts["key"], counts["lang"].map(langs.index)] = counts["n"]
    kinds = max(1, len(counts["key"].unique()))
    return langs, ((table + SMOOTH) / (table.sum(0) + SMOOTH * 2 * kinds)).astype(np.float32)


def proportions(of: np.ndarray, h: np.ndarray, n_texts: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen language set of each text, and its log likelihood a trigram."""
    keys, n = np.unique(of << BITS | h, return_counts=True)
    doc, p, n = keys >> BITS, table[keys & ((1 << BITS) - 1)], n.astype(np.float32)
    k = table.shape[1]
    total = np.maximum(np.bincount(doc, weights=n, minlength=n_texts), 1)
    starts = np.searchsorted(doc, np.arange(n_texts))
    full = starts < len(doc)
    full &= np.append(starts[1:], len(doc)) > starts

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n_texts, *x.shape[1:]))
        if full.any():
            out[full] = np.add.reduceat(x, starts[full], axis=0, dtype=np.float64)
        return out

    def mixed(theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for r in range(rounds + 1):
            q = p * theta.astype(np.float32)[doc]
            s = np.maximum(q.sum(1), np.float32(1e-30))
            if r == rounds:
                return theta, sums(n * np.log(s))
            theta = sums(q * (n / s)[:, None]) / total[:, None]

    whole, whole_log = mixed(np.full((n_texts, k), 1 / k), ROUNDS)
    order = np.argsort(-whole, axis=1, kind="stable")
    single = sums(n[:, None] * np.log(p))
    best = single.argmax(1)
    theta, log = np.eye(k)[best], single[np.arange(n_texts), best]
    price = PENALTY / 2 * np.log(total + 1)
    worth = log - price
    for size in range(2, k + 1):
        # a set can only win where even the mixture of all languages would: with many languages most sizes end here
        open_ = whole_log - size * price > worth
        if not open_.any():
            break
        if size == k:
            t, x = whole, whole_log
        else:
            t = np.zeros_like(whole)
            np.put_along_axis(t, order[:, :size], np.take_along_axis(whole, order[:, :size], 1), 1)
            t, x = mixed(t / np.maximum(t.sum(1, keepdims=True), 1e-12), ROUNDS // 2)
        won = open_ & (x - size * price > worth)
        theta[won], log[won], worth[won] = t[won], x[won], (x - size * price)[won]
    return theta, log / total


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages (those of the chosen set with their proportions) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in common.slices(batches, limit=700_000):
            every = common.texts(batch)
            lettered = np.array([bool(LETTER.search(x)) for x in every])
            if not langs:
                lettered[:] = False
            if lettered.any():
                theta, _ = proportions(*trigrams(every), len(every), table)
                best = theta.argmax(1)
                score = np.where(lettered, np.clip(theta[np.arange(len(every)), best], 0, 1), 0)
            else:
                theta, best, score = np.zeros((len(every), len(langs))), np.zeros(len(every), int), np.zeros(len(every))
            pred = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            mix = [",".join(f"{langs[j]}:{t[j]:.3f}" for j in np.argsort(-t, kind="stable") if t[j] > 0) if ok else "" for t, ok in zip(theta, lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def held_out() -> F.Column:
    return common.id_crc("doc_id") % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
