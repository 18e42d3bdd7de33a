"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so the labelled tokens come from a first step: over a
bounded sample of labelled documents, each word and each word beginning gets the
log odds of its documents being toxic; in toxic documents, words that have strong
odds are the toxic tokens, all other tokens are clean. A chain of two states is
fitted to these tokens by the gradient of the likelihood: features of a word are
the word, its beginnings and ends and its shape, hashed to 2**18 weights; four
weights are of transitions and one of the start. Forward-backward gives each
token's marginal; a calibration turns the sum and the maximum of a document's
marginals into its score. It is fitted to a fifth of the sample, scored by a chain
that learned from the rest alone (where either has documents of one label only, by
the one that learned from all).
Spans are runs of tokens whose marginal is a half or more.

Labels of repeated or clashing rows count by their mean, a mean of a half as toxic.
Null and empty texts score what the calibration says of a document without toxic
tokens, as does every text when no label is known. Repeated rows are each scored;
very long texts are scored whole, in stretches that pass messages on; other columns
are ignored; an empty table gives an empty result. lang, source and doc_id are no
inputs of a score.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
#: Bounds of the training sample: so many toxic and so many clean documents, drawn by a hash of doc_id, none longer than this.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1500, 2500, 20_000
#: A word or beginning marks toxic tokens if so many toxic documents have it, with these log odds; in many of them it does by itself.
LEAST_DOCS, LEAST_ODDS, MANY_DOCS, MANY_SHARE = 3, 3.0, 10, 0.01
BEGINNINGS = (3, 4, 5, 6)
ROUNDS, RATE, CHAIN_RATE, DECAY = 25, 0.5, 0.05, 1e-6
#: Tokens of a stretch of a sequence; the stretches of all sequences are gone through side by side.
STRETCH = 128
CACHE = 200_000
STRIP = b".,;:!?\"'()[]{}*#%&$|<>-_"


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, its beginnings, ends and shape."""
    w = word.strip(STRIP).decode("utf-8", "ignore")
    names = [f"w{w}", f"l{min(len(w), 12)}", "b"]
    names += [f"p{w[:k]}" for k in BEGINNINGS if len(w) >= k]
    names += [f"s{w[-k:]}" for k in (2, 3, 4) if len(w) >= k]
    return [xxhash.xxh32_intdigest(n) >> (32 - BITS) for n in names]


def marks(word: bytes) -> list[str]:
    w = word.strip(STRIP).decode("utf-8", "ignore")
    return [f"w{w}"] + [f"p{w[:k]}" for k in BEGINNINGS if len(w) > k]


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature, of the toxic state against the clean one
    stay: np.ndarray  # (2, 2) weights of transitions
    start: float  # weight of the toxic state at the first token
    calibration: np.ndarray  # of 1, the sum and the maximum of marginals


def stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each stretch begins, its length, and its number within its sequence."""
    n = -(-lengths // STRETCH)
    of = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begins = np.repeat(np.cumsum(lengths) - lengths, n) + number * STRETCH
    return begins, np.minimum(STRETCH, lengths[of] - number * STRETCH), number


def messages(emission: np.ndarray, lengths: np.ndarray, stay: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of each token of sequences laid end to end, as odds of the toxic state, and the factors of transitions and tokens they were made with.

    First what each stretch makes of a message, as a 2 x 2 matrix; then messages go
    from stretch to stretch; then through all stretches at once.
    """
    t, e = np.exp(stay - stay.max()), np.exp(np.clip(emission, -40, 40))
    (t00, t01), (t10, t11) = t
    begins, sizes, number = stretches(lengths)
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    at_step = begins[order]
    into, back = np.full(len(begins), np.exp(start)), np.ones(len(begins))  # odds that a stretch gets from before and from behind
    if (number > 0).any():
        q00, q01, q10, q11 = np.ones(len(begins)), np.zeros(len(begins)), np.zeros(len(begins)), e[begins[order]]
        for k, n in enumerate(running[1:], 1):
            a, b, c, d, x = q00[:n], q01[:n], q10[:n], q11[:n], e[at_step[:n] + k]
            a, b, c, d = a * t00 + b * t10, (a * t01 + b * t11) * x, c * t00 + d * t10, (c * t01 + d * t11) * x
            total = a + b + c + d
            q00[:n], q01[:n], q10[:n], q11[:n] = a / total, b / total, c / total, d / total
        where = np.argsort(order)
        q00, q01, q10, q11 = q00[where], q01[where], q10[where], q11[where]
        for k in range(1, int(number.max()) + 1):
            at = np.flatnonzero(number == k)
            o = into[at - 1]
            o = (q01[at - 1] + o * q11[at - 1]) / (q00[at - 1] + o * q10[at - 1])
            into[at] = (t01 + o * t11) / (t00 + o * t10)
        for k in range(int(number.max()), 0, -1):
            at = np.flatnonzero(number == k)
            o = back[at]
            o = (q10[at] + q11[at] * o) / (q00[at] + q01[at] * o)
            back[at - 1] = (t10 + t11 * o) / (t00 + t01 * o)
    forward, backward = np.empty(len(emission)), np.empty(len(emission))
    o = into[order]
    for k, n in enumerate(running):
        at = at_step[:n] + k
        o = o[:n]
        if k:
            o = (t01 + o * t11) / (t00 + o * t10)
        o = o * e[at]
        forward[at] = o
    o = back[order]
    for k in range(len(running) - 1, -1, -1):
        n = running[k]
        later = running[k + 1] if k + 1 < len(running) else 0
        at = at_step[:n] + k
        if later:
            x = o[:later] * e[at[:later] + 1]
            o[:later] = (t10 + t11 * x) / (t00 + t01 * x)
        backward[at] = o[:n]
    return forward, backward, t, e


def marginals(emission: np.ndarray, lengths: np.ndarray, stay: np.ndarray, start: float) -> np.ndarray:
    """The probability of the toxic state of each token of sequences laid end to end."""
    forward, backward, *_ = messages(emission, lengths, stay, start)
    return 1 - 1 / (1 + forward * backward)


def expected(emission: np.ndarray, lengths: np.ndarray, stay: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of transitions between the states."""
    forward, backward, t, e = messages(emission, lengths, stay, start)
    inside = np.ones(len(emission), bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inside)
    before, after = forward[at - 1], backward[at] * e[at]
    pairs = [t[0, 0], t[0, 1] * after, t[1, 0] * before, t[1, 1] * before * after]
    total = sum(pairs)
    return 1 - 1 / (1 + forward * backward), np.array([np.sum(x / total) for x in pairs]).reshape(2, 2)


def collect_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most about TOXIC_DOCS and CLEAN_DOCS labelled texts."""
    truth = labels.filter("toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, TOXIC_DOCS / max(sizes.get(1, 0), TOXIC_DOCS)).otherwise(CLEAN_DOCS / max(sizes.get(0, 0), CLEAN_DOCS))
    drawn = truth.filter(common.hash_share("doc_id", 5) < share)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(common.broadcast_if_small(drawn), "doc_id").orderBy("doc_id", "text").limit(2 * (TOXIC_DOCS + CLEAN_DOCS)).collect()
    return sorted({r["text"]: r["toxic"] for r in rows}.items())  # a repeated text says nothing more


def thinned(sample: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Without near copies: texts of which two of six min-hashes were met before, for copies would pass for evidence."""
    met: set[tuple[int, int]] = set()
    kept = []
    for words, y in sample:
        h = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], np.uint64)
        h = common.mix64(h[2:] + h[1:-1] * np.uint64(3) + h[:-2] * np.uint64(7)) if len(h) > 2 else h
        least = [(k, int((h * np.uint64(2 * k + 1) ^ h >> np.uint64(k)).min())) for k in range(6)]
        if sum(x in met for x in least) < 2:
            kept.append((words, y))
        met.update(least)
    return kept


def strong_marks(sample: list[tuple[list[bytes], int]]) -> frozenset[str]:
    """Words and beginnings whose documents are toxic far more often than others.

    Those of many toxic documents count at once; of the others, each must explain
    some toxic documents that no mark before it does.
    """
    where: dict[str, list[int]] = {}
    clean: Counter = Counter()
    for k, (words, y) in enumerate(sample):
        found = set().union(*map(marks, set(words)))
        if y:
            for mark in found:
                where.setdefault(mark, []).append(k)
        else:
            clean.update(found)
    toxic = sum(y for _, y in sample)
    base = np.log(toxic + 1) - np.log(len(sample) - toxic + 1)
    where = {m: at for m, at in where.items() if len(at) >= LEAST_DOCS and np.log(len(at) + 0.5) - np.log(clean[m] + 0.5) - base >= LEAST_ODDS}
    strong = {m for m, at in where.items() if len(at) >= max(MANY_DOCS, MANY_SHARE * toxic)}
    explained = set().union(*(where[m] for m in strong))
    queue = [(-len(at), m) for m, at in where.items() if m not in strong]
    heapq.heapify(queue)
    while queue:
        n, mark = heapq.heappop(queue)
        now = -len(set(where[mark]) - explained)
        if -now < LEAST_DOCS:
            continue
        if now > n:
            heapq.heappush(queue, (now, mark))
        else:
            strong.add(mark)
            explained.update(where[mark])
    return frozenset(strong)


def fit(texts: list[tuple[str, int]]) -> Model:
    sample = [(tokens(x), y) for x, y in texts]
    if not any(y for _, y in sample) or all(y for _, y in sample):
        return Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), 0.0, np.array([-1.0, 0, 0]))
    aside = [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % 5 == 0 for x, _ in texts]
    learned = [d for d, held in zip(sample, aside, strict=True) if not held]
    held = [d for d, held in zip(sample, aside, strict=True) if held]
    final = weights, stay, start = fit_chain(sample)
    if len({y for _, y in learned}) < 2 or len({y for _, y in held}) < 2:
        held = sample
    else:
        weights, stay, start = fit_chain(learned)
    cache = {w: weights[features(w)].sum() for w in set().union(*(w for w, _ in held))}
    lengths = np.array([len(w) for w, _ in held])
    emission = np.fromiter((cache[w] for ws, _ in held for w in ws), float, int(lengths.sum()))
    x = summaries(marginals(emission, lengths, stay, start), lengths)
    truth = np.array([t for _, t in held], float)
    # logistic regression by Newton steps
    beta = np.zeros(x.shape[1])
    for _ in range(15):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (truth - q) - 0.5 * beta)
    return Model(*final, beta)


def fit_chain(sample: list[tuple[list[bytes], int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features, transitions and the start."""
    strong = strong_marks(thinned(sample))
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(w for w, _ in sample))))}
    toxic_word = np.array([any(m in strong for m in marks(w)) for w in vocabulary], bool)
    lists = [features(w) for w in vocabulary]
    flat, sizes = np.concatenate([[], *lists]).astype(np.int64), np.array([len(x) for x in lists], np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    used, column = np.unique(flat, return_inverse=True)
    lengths = np.array([len(w) for w, _ in sample])
    words = np.fromiter((vocabulary[w] for ws, _ in sample for w in ws), np.int64, int(lengths.sum()))
    of_toxic = np.repeat(np.array([y for _, y in sample], bool), lengths)
    y = (toxic_word[words] & of_toxic).astype(float)

    # labels less what the chain expects are the gradient of the likelihood, of every weight
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    inside = np.ones(len(y), bool)
    inside[begins] = False
    at = np.flatnonzero(inside)
    pairs = np.array([[np.sum((y[at - 1] == a) & (y[at] == b)) for b in (0, 1)] for a in (0, 1)], float)
    share = np.clip(y.mean(), 1e-4, 0.5) if len(y) else 0.5
    stay, start = np.zeros((2, 2)), 0.0
    w, squares = np.zeros(len(used)), np.zeros(len(used))
    chain_squares, start_squares = np.zeros((2, 2)), 0.0
    w_bias = np.log(share / (1 - share))
    for _ in range(ROUNDS):
        emission = np.bincount(owner, weights=w[column], minlength=len(lists)) + w_bias
        p, transitions = expected(emission[words], lengths, stay, start)
        by_word = np.bincount(words, weights=y - p, minlength=len(lists))
        gradient = np.bincount(column, weights=by_word[owner], minlength=len(used)) - DECAY * len(y) * w
        squares += gradient**2
        w += RATE * gradient / np.sqrt(squares + 1e-8)
        gradient = pairs - transitions - stay
        chain_squares += gradient**2
        stay = stay + CHAIN_RATE * gradient / np.sqrt(chain_squares + 1e-8)
        gradient = float(np.sum(y[begins] - p[begins])) - start
        start_squares += gradient**2
        start += CHAIN_RATE * gradient / np.sqrt(start_squares + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    weights[xxhash.xxh32_intdigest("b") >> (32 - BITS)] += w_bias
    return weights, stay, start


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each sequence: 1, the log of 1 and the sum of its marginals, their maximum."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    full = lengths > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[full]
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.2, p, 0), starts))
        out[full, 2] = np.maximum.reduceat(p, starts)
    return out


SCHEMA = "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def spans_of(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of runs of toxic tokens."""
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    found, at, k, n, wanted = [], 0, 0, len(text), set(hit.tolist())
    while at < n and k <= hit[-1]:
        while text[at] in " \t\n\r\x0b\x0c":
            at += 1
        end = at
        while end < n and text[end] not in " \t\n\r\x0b\x0c":
            end += 1
        if k in wanted:
            if found and k - 1 in wanted:
                found[-1]["end"] = end
            else:
                found.append({"start": at, "end": end})
        at, k = end, k + 1
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in common.slices(batches):
            every = common.texts(batch)
            split = [tokens(x) for x in every]
            lengths = np.array([len(x) for x in split])
            fresh = set().union(*split) - cache.keys()
            if len(cache) + len(fresh) > CACHE:
                cache.clear()
                fresh = set().union(*split)
            for w in fresh:
                cache[w] = float(model.weights[features(w)].sum())
            emission = np.concatenate([np.fromiter(map(cache.__getitem__, x), float, len(x)) for x in split])
            p = marginals(emission, lengths, model.stay, model.start)
            x = summaries(p, lengths) @ model.calibration
            parts = np.split(p, np.cumsum(lengths)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array([int((q >= 0.5).sum()) for q in parts], pa.int64()), pa.array([spans_of(t, q) for t, q in zip(every, parts, strict=True)], SPANS)], names=["doc_id", "score", "n_toxic", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    return common.id_crc("doc_id") % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter(~held_out())
    scored = score(docs, fit(collect_sample(docs, labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))).alias("offsets"))
