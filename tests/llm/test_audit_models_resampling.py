"""Filter audit, language-model scoring and resampling against brute force, and their odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import common, elias_fano, filter_audit, language_model, resampling, words

SCHEMA = "doc_id long, text string, lang string"
ODD = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "a b c a b c", "en"), (4, "a b c a b c", "en"), (None, "a b c", "de"), (5, "É é ÀB 中文 x9 9X \x1f \xa0 z", "fr"), (6, "one", "en"), (7, "A b C d " * 3000, "en")]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", common.F.lit("clash")).withColumn("key", common.F.lit(1))


def pieces_of(texts, between, limit, repeat=0):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return list(words.pieces(batch, between, repeat=repeat, limit=limit))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \n\té中.", max_size=30)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for between, pattern in ((words.BLANK, r"[^\x20\x09-\x0D]+"), (words.MARK, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        (piece,) = pieces_of(texts, between, 1 << 20)
        want = [(k, w) for k, t in enumerate(texts) for w in re.findall(pattern, (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        found = [(int(piece.row[k]), piece.word(k).decode()) for k in range(len(piece.start))]
        assert found == want
        keys = piece.keys()
        assert len(set(keys.tolist())) == len({w for _, w in want})
        assert all(int(key) == words.key_of(w.encode()) for key, (_, w) in zip(keys, want, strict=True))


def test_long_texts_are_cut_between_words():
    text = "ab cde f " * 50 + "x" * 70 + " y"
    for limit in (1, 7, 40, 1000):
        found = []
        parts = pieces_of([text], words.BLANK, limit, repeat=2)
        for k, part in enumerate(parts):
            assert bool(len(part.closed)) == (k == len(parts) - 1)
            n = int(part.repeated)
            assert [part.word(j) for j in range(n)] == found[len(found) - n :]
            found += [part.word(j) for j in range(n, len(part.start))]
        assert found == text.encode().split()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_sequences_hold_and_find_values(values, shift):
    values = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    held = elias_fano.Sequence(elias_fano.Sequence.dump(values, 1 << (64 - shift)))
    assert (held.values() == values).all()
    asked = np.unique(np.concatenate((values, values + np.uint64(1), values[:5] >> np.uint64(1))))
    place = {int(v): k for k, v in enumerate(values)}
    assert held.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


# Filter audit


def test_audit_of_odd_rows_and_hot_copies(spark):
    flags = {(r.doc_id, r.part): (r.A, r.B, r.C, r.D, r.E) for r in filter_audit.document_filters(odd(spark)).collect()}
    assert flags[1, ""] == (True, False, False, False, False)
    assert flags[2, "en"] == flags[3, "en"][:4] + (True,)  # empty like the null text of 1
    assert not flags[3, "en"][4]
    assert flags[4, "en"][:2] == (True, True) and not flags[4, "en"][4]
    assert not flags[5, "fr"][2] and not flags[None, "de"][4]
    copies = spark.createDataFrame([(k, "same" if k % 3 else f"own {k}", "en") for k in range(300)], SCHEMA)
    want = filter_audit.document_filters(copies).filter("E").count()
    assert want == 199
    assert filter_audit.document_filters(copies, hot_rows=100, broadcast=0).filter("E").count() == want
    assert filter_audit.document_filters(copies, hot_rows=1000, broadcast=0).filter("E").count() == want


def test_audit_counts_like_applying_filters_one_after_another(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k % 3}", *(bool(x) for x in rng.random(4) < 0.4)) for k in range(500)]
    flags = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, good boolean")
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(flags, "XYZ", ("good",)).collect()}
    assert len(found) == 3 * 6 * 3
    shapley = Counter()
    for (part, order, step), r in found.items():
        left = [x for x in rows if x[0] == part]
        for name in order[: step - 1]:
            left = [x for x in left if not x["XYZ".index(name) + 1]]
        k = "XYZ".index(order[step - 1]) + 1
        fails = [x for x in rows if x[0] == part and x[k]]
        removed = [x for x in left if x[k]]
        assert (r.kept, r.removed, r.redundant, r.good_lost) == (len(left) - len(removed), len(removed), len(fails) - len(removed), sum(x[4] for x in removed))
        assert r.unique_fails == sum(sum(x[1:4]) == 1 for x in fails)
        shapley[part, k] += len(removed)
    assert all(r.shapley == shapley[r.part, "XYZ".index(r.filter_order[r.step - 1]) + 1] for r in found.values())


def test_index_of_small_chunks_counts_alike(spark):
    rows = [(f"p{k % 5}", k % 2 == 0, k % 3 == 0) for k in range(1000)]
    flags = spark.createDataFrame(rows, "part string, X boolean, Y boolean")

    def counts(chunk):
        return sorted(map(tuple, filter_audit.subset_counts(filter_audit.index(flags, "XY", (), chunk=chunk), "XY", ()).collect()))

    assert counts(16) == counts(1 << 16)
    empty = filter_audit.audit(flags.limit(0), "XY", ())
    assert empty.count() == 0 and "unique_fails" in empty.columns


# Language model


def model_of(texts):
    """The model of language_model.py by dictionaries."""
    tokens = [[w.translate(LOWER) for w in (t or "").encode().split()] + [2] for t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for t in tokens:
        marked = [1, 1, *t]
        one.update(t)
        two.update(zip(marked[1:], marked[2:]))
        three.update(zip(marked, marked[1:], marked[2:]))
    behind = Counter(one)
    behind[1] = behind.pop(2, 0)
    q = lambda p: float(language_model.probability(language_model.quantised(np.array([p])))[0])
    a2 = {g: q((n - 0.75) / behind[g[0]]) for g, n in two.items() if n >= 2}
    a3 = {g: q((n - 0.75) / two[g[:2]]) for g, n in three.items() if n >= 2 and g[:2] != (1, 1)}
    b = defaultdict(float)
    for g, x in (a2 | a3).items():
        b[g[:-1]] += x
    left = {g: math.floor(min(max(1 - x, 0), 1) * 65535) / 65535 for g, x in b.items()}
    total, distinct = sum(one.values()), len(one)

    def score(text):
        out = base = known = 0
        t = [w.translate(LOWER) for w in (text or "").encode().split()] + [2]
        marked = [1, 1, *t]
        for u, v, w in zip(marked, marked[1:], marked[2:]):
            p1 = (one[w] + 1) / (total + distinct + 1)
            base += math.log10(p1)
            known += one[w] > 0
            out += math.log10(a3.get((u, v, w), 0) + left.get((u, v), 1) * (a2.get((v, w), 0) + left.get((v,), 1) * p1))
        return len(t), known, base, out

    return total, score


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def same_scores(docs, found, score, total):
    want = sorted((x, *score(t)) for x, t in docs)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found.collect())
    assert len(want) == len(got)
    for x, y in zip(want, got, strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)


def test_scores_are_those_of_brute_force_both_ways(spark, small, monkeypatch):
    docs = common.table(spark, small, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    train = docs.filter("doc_id % 3 > 0")
    total, score = model_of([t for x, t in rows if x % 3])
    model = language_model.train(train)
    assert model.tokens == total
    same_scores(rows, language_model.score(docs, model), score, total)
    sharded = language_model.train(train, shard_tokens=600, broadcast=0)  # hot contexts, no filter, many shards
    assert len(sharded.shards.hot) and sharded.shards.n > 10
    same_scores(rows, language_model.score(docs, sharded, broadcast=0), score, total)
    same_scores(rows, language_model.score(docs, sharded), score, total)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["a b a b a c", "a b c d", "b a b a b", "c c c a b"]
    model = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    tries = language_model.open_tries(language_model.collected(model.tries))
    left = {}
    for row in language_model.collected(model.vocabulary):
        opened = language_model.open_words(row)
        left |= dict(zip(opened["contexts"].values().tolist(), opened["left"].tolist(), strict=True))
    mass = Counter()
    for trie in tries.values():
        roots = trie.roots.values()
        for value, code in zip(trie.pairs.values(), trie.pair_code, strict=True):
            mass[int(roots[int(value) >> 24])] += language_model.probability(code)
        owner = Counter()
        for value, code in zip(trie.triples.values(), trie.triple_code, strict=True):
            owner[int(value) >> 24] += language_model.probability(code)
        for pair in range(trie.pairs.n):
            assert owner[pair] + trie.pair_left[pair] / 65535 == pytest.approx(1, abs=2e-5)
    assert mass and all(x + left[k] / 65535 == pytest.approx(1, abs=2e-5) for k, x in mass.items())


def test_scoring_odd_rows(spark, monkeypatch):
    docs = odd(spark)
    monkeypatch.setattr(words, "PIECE_BYTES", 4_000_000)
    model = language_model.train(docs)
    _, score = model_of([x[1] for x in ODD])
    found = language_model.score(docs, model).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[None].held_out is None
    assert by[7].score == pytest.approx(score(ODD[-1][1])[3], rel=1e-9)
    empty = language_model.train(docs.limit(0))
    assert (empty.tokens, empty.distinct) == (0, 0)
    none = {r.doc_id: r for r in language_model.score(docs, empty).collect()}
    assert none[6].n_known == 0 and none[6].score == 0
    assert language_model.score(docs.limit(0), model).count() == 0


def test_a_slice_takes_little_memory_beside_the_model():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 100_000) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 3_000_000
    words._POWERS.clear()
    tracemalloc.start()
    for t in language_model.read(iter([batch])):
        language_model.asks(language_model.Unit.of(t), language_model.Shards(4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000


def test_pieces_of_one_text_score_like_the_whole():
    text = " ".join(f"w{k % 7}" for k in range(400)) + " end"
    whole = pieces_of([text], words.BLANK, 1 << 20, 2)
    cut = pieces_of([text], words.BLANK, 64, 2)
    assert len(cut) > 5

    def grams(parts):
        out = Counter()
        for part in parts:
            t = language_model.tokens(part, 1)
            u = language_model.Unit.of(t)
            out.update(zip(u.keys[u.context].tolist(), u.keys[u.word].tolist(), (u.before >= 0).tolist(), (u.triple >= 0).tolist()))
        return out

    assert grams(whole) == grams(cut)


def test_units_and_asks_are_small_and_come_back(spark, small):
    """A unit's bytes, and what it asks of shards, are a few for each token, and hold all that finish reads."""
    docs = common.table(spark, small, "documents").select("text").toArrow().to_batches()
    parts = [(language_model.tokens(piece, batch.num_rows), k * 1000) for k, batch in enumerate(common.slices(iter(docs), limit=50_000)) for piece in words.pieces(batch, words.BLANK, repeat=2)]
    t = language_model.joined(parts)
    body = language_model.packed(t, int(t.row.max()) + 1)
    back = language_model.unpacked(body)
    assert all((getattr(t, x) == getattr(back, x)).all() for x in ("keys", "at", "row"))
    shards = language_model.Shards(3, np.sort(language_model.Unit.of(t).keys[:1] >> np.uint64(24)), np.array([9]))
    asked = language_model.asks(language_model.Unit.of(t), shards)
    dumped = {k: x.dump() for k, x in asked.items()}
    for k, x in asked.items():
        y = language_model.Ask.load(dumped[k])
        assert all((getattr(x, name) == getattr(y, name)).all() for name in ("words", "contexts", "pairs", "first", "last"))
    assert len(body) + sum(map(len, dumped.values())) < 16 * len(t.at)


def test_a_text_of_several_pieces_has_one_row_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(language_model, "UNIT_TOKENS", 700)
    docs = spark.createDataFrame([(1, "a b c d " * 2_000), (2, "a b a"), (3, None), (4, "b c d e " * 900)], "doc_id long, text string").coalesce(1)
    model = language_model.train(docs)
    by_join, plain = (sorted(map(tuple, language_model.score(docs, model, broadcast=n).collect())) for n in (0, 1 << 30))
    assert [x[0] for x in by_join] == [1, 2, 3, 4]
    assert all(x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9) for x, y in zip(by_join, plain, strict=True))


def test_model_tells_prose_from_its_shuffled_words(spark, small):
    docs = common.table(spark, small, "documents").select("doc_id", "text")
    model = language_model.train(docs.filter("doc_id % 2 = 0"))
    held = language_model.score(docs.filter("doc_id % 2 = 1"), model).agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]
    shuffled = docs.withColumn("text", common.F.expr("array_join(shuffle(split(text, '\\\\s+'), 7), ' ')"))
    plain, mixed = ({r.doc_id: r.score for r in language_model.score(d.filter("doc_id % 2 = 0"), model).collect()} for d in (docs, shuffled))
    assert sum(plain[k] > mixed[k] for k in plain) > 0.9 * len(plain)


# Resampling


def features_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def test_weights_of_odd_rows_are_those_of_brute_force(spark):
    target = spark.createDataFrame([(1, "a b c d"), (2, None)], "item_id long, text string")
    s, t = Counter(), Counter()
    for counter, texts in ((s, [x[1] for x in ODD]), (t, ["a b c d", None])):
        for text in texts:
            counter.update(zlib.crc32(g.encode()) % 10000 for g in features_of(text)[1])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000)))) for k in range(10000)]
    found = resampling.resample(odd(spark), target).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    for doc_id, text, _ in ODD:
        _, g = features_of(text)
        assert by[doc_id].n_features == len(g)
        assert by[doc_id].weight == (sum(gain[zlib.crc32(x.encode()) % 10000] for x in g) // len(g) if g else 0)
    assert by[None].score is None and by[None].rank is None
    assert [r.rank for r in found if r.rank] == []  # a quarter of one document
    assert resampling.resample(odd(spark).limit(0), target).count() == 0
    assert resampling.resample(odd(spark), target.limit(0)).count() == len(ODD)


def test_features_of_pieces_are_those_of_the_whole():
    text = "ab cd! ef ab,cd gh " * 40

    def buckets(limit):
        return Counter(b for p in pieces_of([text], words.MARK, limit, 1) for b in resampling.features(p)[0].tolist())

    assert buckets(50) == buckets(1 << 20) == Counter(zlib.crc32(g.encode()) % 10000 for g in features_of(text)[1])


def test_places_are_those_of_one_sort(spark):
    rows = spark.createDataFrame([(k, (k * 7919) % 101) for k in range(1000)], "id long, score long")
    found = resampling.in_order(rows, common.F.col("score").desc(), common.F.col("id")).collect()
    want = sorted(((k * 7919) % 101, k) for k in range(1000))
    order = [k for _, k in sorted(want, key=lambda x: (-x[0], x[1]))]
    assert [r.id for r in sorted(found, key=lambda r: r.place)] == order


@pytest.mark.parametrize(("query", "sql"), [(filter_audit.op11_filter_audit, filter_audit.OP11_SQL), (resampling.op13_importance_resampling, resampling.OP13_SQL)])
def test_queries_give_the_rows_of_sql(query, sql, spark, duck, small):
    df = query(spark, small)
    columns = sorted(df.columns)
    found = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert found == sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
