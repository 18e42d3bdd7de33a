"""The training-data operators: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest


from codeloom.llm import chat, common, decontamination, html_text, language_id, licenses, near_duplicates, packing, quality_classifier, quality_rules, toxicity
from codeloom.llm.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
LONG = " ".join(f"w{k % 977}" for k in range(40_000))
#: Null, empty, blank, odd and very long texts, repeated rows and rows with the same id; columns that clash with results.
ODD = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.5, True),
    (3, " \n\t ", "en", "a", 4, 0.5, True),
    (4, "one two three", "en", "a", 13, 0.5, True),
    (4, "one two three", "en", "a", 13, 0.5, True),
    (5, "12 34 %%% 😀".encode("utf-16", "surrogatepass").decode("utf-16"), None, "b", 11, 0.5, False),
    (6, LONG, "de", None, len(LONG), 0.5, False),
    (7, LONG + " end", "de", None, len(LONG), 0.5, False),
    (8, "same words here again and again\n" * 30, "fr", "c", 900, 0.5, False),
    (9, "same words here again and again\n" * 30, "fr", "c", 900, 0.5, False),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def result(spark, small):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, small).collect()
        return kept[name]

    return of


# language


def test_language_held_out_accuracy(spark, small, result):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = result("op1_language_id")
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_mixtures_are_told_apart():
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.full(1 << language_id.BITS, 0.01), 3).T.astype(np.float32) + 1e-9
    draws = [rng.choice(1 << language_id.BITS, n, p=(q := table[:, lang].astype(float)) / q.sum()) for lang, n in ((0, 700), (1, 300))]
    h = np.concatenate(draws)
    theta, _ = language_id.proportions(np.zeros(len(h), np.int64), h, 1, table)
    assert abs(theta[0, 0] - 0.7) < 0.05 and theta[0, 2] == 0


def test_language_of_odd_rows(spark, odd, empty):
    found = {r.doc_id: r for r in language_id.identify(odd, language_id.train(odd)).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == found[5].lang_pred == "und" and found[1].score == 0
    assert found[6].lang_pred == "de"
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}
    assert language_id.identify(empty, language_id.train(odd)).count() == 0


# packing


def unpacked(rows, capacity):
    """Pieces laid out by sequence are gapless and fit."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_all_documents(result, texts):
    rows = result("op2_best_fit_packing")
    encoder = packing.Encoder()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array([*encoder.exact.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert unpacked(rows, 2048) <= -(-total // 2048) + 1


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    sizes = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(30)}
    plan = packing.plan(sizes, 100)
    fill, count = {}, {}
    for length, rank, per, sequence, offset in sorted(plan.tolist()):
        following = min([r for n, r, *_ in plan.tolist() if n == length and r > rank], default=sizes[length])
        for k in range(following - rank):
            fill.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
            count[length] = count.get(length, 0) + 1
    assert count == sizes
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert sum(length > 33 for places in fill.values() for _, length in places) <= 2 * len(fill)


def test_special_strings_are_encoded_by_the_library():
    encoder = packing.Encoder()
    for text in ("a<|endoftext|>b", "naïve café", "日本語 text", "\x1c\x85 x", "tab\tnew\r\nline  "):
        assert encoder.encode(text) == encoder.exact.encode(text, add_special_tokens=False).ids


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert sum(r.doc_id == 4 for r in rows) == 2
    unpacked(rows, 2048)
    assert packing.pack(empty).count() == 0


# HTML

WEIGHTS = html_text.weights({("p 1", True): 1000, ("p 1", False): 50, ("link", False): 300, ("div 0", False): 200, ("div 1", False): 200, ("p", True): 50, ("/p", True): 50, ("li", False): 40, ("a", False): 60, ("tag", False): 200, ("tag", True): 100})
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain", "plain"),
        (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p><b>{WORDS}<br><p>x\n  y</p></article><footer>&copy; z</footer>", f"T & U\n{WORDS}\nx y"),
        (f"<div class='ad'>buy</div><div id=c><p>{WORDS}</p><script>if (a<b) '</p>'</script><aside>side</aside><p>{WORDS}</p></div><div class='comments'><p>I say {WORDS}</p></div>", f"{WORDS}\n{WORDS}"),
        (f"<main><p>{WORDS}</p><form><p>mail</p></form><table><tr><td>a</td><td>b</td></tr></table></main>", f"{WORDS}\na\nb"),
        (f"<article><p>{WORDS} cut &am", f"{WORDS} cut &am"),
        (f"<head><meta charset=utf-8><title>t</title><body><p>{WORDS}</p><a href='/cut", WORDS),
        (f"<article><p>a<em>b</em>c &lt;{WORDS}&gt;<!-- <p>no</p> --></p></article>", f"abc <{WORDS}>"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body class='overflow-hidden'><article class=\"overflow-hidden\"><p>{WORDS}</p></article>", WORDS),
        (f"<div aria-hidden='false' title='a hidden gem'><p>{WORDS} <a href='/the-hidden-cost'>the cost</a> {WORDS}</p></div>", f"{WORDS} the cost {WORDS}"),
        (f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {WORDS}</p></article>", f"{WORDS} x=2 {WORDS}"),
        (f"<div><p>{WORDS} <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> {WORDS}</p></div>", f"{WORDS} x=2 {WORDS}"),
        (f"<article><p hidden>a</p><p HIDDEN=''>b</p><p aria-hidden=true>c</p><p style='color:red; display : none'>d</p><p style=visibility:hidden>e</p><p>{WORDS}</p></article>", WORDS),
    ],
)
def test_only_hidden_elements_are_left_out(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # elements that close themselves or never end
        (f"<p>{WORDS}</p><svg class='i'/><p>{WORDS} b</p>", f"{WORDS}\n{WORDS} b"),
        (f"<p>{WORDS}</p><svg class='i'><p>{WORDS} b</p><svg><p>c {WORDS}</p>", f"{WORDS}\n{WORDS} b\nc {WORDS}"),
        (f"<p>{WORDS}</p><svg><text>no</text></svg><math/><p>{WORDS} b</p><script>var x = 1", f"{WORDS}\n{WORDS} b"),
        # loose names: part of the text inside it, cut at its edges, left out where they hold links
        (f"<div class='header'>The site</div><div><p>{WORDS}</p><div class='alert'><p>{WORDS} c</p></div><div class='related'><a href=x>one two three</a></div><p>{WORDS}</p><p>{WORDS}</p></div><div class='legal'>all rights reserved by them</div>", f"{WORDS}\n{WORDS} c\n{WORDS}\n{WORDS}"),
        (f"<article><p>{WORDS}</p><div class='legal'>a b c</div><div class='ad'>buy</div></article>", f"{WORDS}\na b c"),
        # markup that names little of what looks like content is not believed
        (f"<main><p>Menu here</p></main><div class='article-body'>{''.join(f'<p>{k} {WORDS}</p>' for k in range(9))}</div>", "\n".join(f"{k} {WORDS}" for k in range(9))),
        # no names at all
        (f"<div><a href=x>Home</a> <a href=y>News</a></div><div>Buy this</div><h1>{WORDS}</h1><p>{WORDS} <a href=z>link</a></p><div>Copyright by us</div>", f"{WORDS}\n{WORDS} link"),
    ],
)
def test_regions(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


def test_many_elements_that_never_end_are_read_in_linear_time():
    assert html_text.main_text("<svg><p>a b c</p>" * 30_000, WEIGHTS).count("\n") == 29_999


def without_names(page):
    """No article or main, no classes, and plain containers for menus and footers."""
    return re.sub(r"<(/?)(?:nav|footer|aside)", r"<\1div", re.sub(r"</?(?:article|main)>", "", re.sub(r' class="[^"]*"', "", page)))


def test_the_scan_finds_the_content_of_pages_that_name_none(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weight = html_text.learn(pages.filter("page_id % 2 = 0"))
    held = [r.html for r in pages.filter("page_id % 2 = 1 and html is not null").collect()]
    named = [html_text.main_text(x, weight) for x in held]
    bare = [html_text.main_text(without_names(x), weight) for x in held]
    assert sum(a == b for a, b in zip(named, bare)) / len(held) >= 0.95
    unscanned = [html_text.read(html_text.tokens(without_names(x))) for x in held]
    assert sum(a != b for a, b in zip(unscanned, bare)) / len(held) > 0.9  # the scan is what decides


def test_best_region_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(scores)
        assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_pages(spark, small, result):
    rows = {r.page_id: r for r in result("op3_html_extract")}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.split(r"</article>", page.html.split("<article>", 1)[1])[0]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert rows[page.page_id].text == "\n".join(filter(None, blocks)) and rows[page.page_id].n_chars == len(rows[page.page_id].text)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(pages, html_text.learn(pages)).collect()) == ["", "", "a"]
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0))).count() == 0


def test_very_long_and_broken_pages(spark):
    long = "<article>" + "".join(f"<p>{k} {WORDS}</p>" for k in range(40_000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", long, 0), (2, "u", "<div" * 1000, 0), (3, "u", "<p>" + WORDS + "<style>a", 0), (3, None, "<p title='x>" + WORDS, 0)], "page_id long, url string, html string, n_chars long")
    found = html_text.extract(pages, html_text.learn(pages)).collect()
    assert [r.text.count("\n") for r in found if r.page_id == 1] == [39_999]
    assert sorted(r.text for r in found if r.page_id == 3)[1] == WORDS and len(found) == 4


# quality classifier


def test_quality_agrees_with_labels(spark, small, result):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [r for r in result("op4_quality_classifier") if r.doc_id in truth]
    assert sum(r.kept == (truth[r.doc_id] == 1) for r in rows) / len(rows) > 0.93


def test_views_learn_from_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    a, b = (np.column_stack((y + rng.normal(0, 0.6, 3000), rng.normal(size=3000))) for _ in range(2))
    model = quality_classifier.co_train((a[:60], b[:60]), y[:60], (a[60:2000], b[60:2000]))
    score, text, meta = model.score(a[2000:], b[2000:])
    right = [((s >= 0.5) == y[2000:]).mean() for s in (score, text, meta)]
    assert right[0] > 0.85 and right[0] >= max(right[1:]) - 0.02


def test_every_unlabelled_document_is_learned_from(spark, monkeypatch):
    seen, given = [], quality_classifier.co_train

    def co_train(views, y, free, words):
        seen.append(free(lambda v: np.array([float(len(v[0])), float(v[1].sum())])).tolist() if callable(free) else [float(len(free[0])), float(free[1].sum())])
        return given(views, y, free, words)

    monkeypatch.setattr(quality_classifier, "co_train", co_train)
    docs = spark.createDataFrame([(k, f"some words number {k}" if k % 2 else "## || @@ %% 11", "en", "a", 20) for k in range(9000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(docs, labels) is not None
    assert seen == [[8900.0, 3 * 8900.0]]


def test_sums_by_tree(spark, monkeypatch):
    """However many tasks there are, teams of a few add up to the same model."""
    docs = spark.createDataFrame([(k, f"some words number {k}" if k % 2 else "## || @@ %% 11", "en", "a", 20) for k in range(900)] + [(7, "other words", "en", "a", 11)] * 3, "doc_id long, text string, lang string, source string, n_chars long").repartition(11)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    models = []
    for fan_in in (64, 2):
        monkeypatch.setattr(quality_classifier, "FAN_IN", fan_in)
        models.append(quality_classifier.train(docs, labels))
    assert models[0].words.n.tolist() == [50, 50]
    for part in ("text", "meta"):
        assert np.allclose(getattr(models[0], part).beta, getattr(models[1], part).beta, atol=1e-6)
    parts = spark.range(0, 9, 1, 9).selectExpr("id as part", "array(double(id), double(1)) as sums")
    assert quality_classifier.tree_sum(parts, 9).tolist() == [36.0, 9.0]
    assert quality_classifier.tree_sum(parts.filter("part < 0"), 9) is None


def test_quality_of_held_out_labels(spark):
    """Labels that the classifier did not learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    aside = {r.doc_id: r.quality for r in labels.filter("quality is not null and crc32(cast(doc_id as string)) % 3 = 0").collect()}
    rows = [r for r in quality_classifier.quality(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 0")).collect() if r.doc_id in aside]
    assert len(rows) > 100 and sum(r.kept == (aside[r.doc_id] == 1) for r in rows) / len(rows) > 0.9


def test_words_tell_quality(spark):
    """Texts alike in all but their words, of one source: only what the words say tells them apart."""
    rng = random.Random(6)
    good, bad = ([f"{a}{b}" for a in heads for b in ("ola", "emi", "uri", "ano")] for heads in (("bra", "dre", "fli"), ("gro", "kle", "pri")))
    rows = [(k, " ".join(rng.choices(good if k % 2 else bad, k=40)), "en", "a", 200) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    found = quality_classifier.quality(docs, labels).filter("doc_id >= 200").collect()
    assert sum(r.kept == (r.doc_id % 2 == 1) for r in found) > 195


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in quality_classifier.quality(odd, labels).collect()}
    assert found == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: True}
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, 0, 1), (6, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality(odd, labels).count() == len(ODD)
    assert quality_classifier.quality(empty, labels).count() == 0


# chat


def test_escapes_round_trip():
    rng = random.Random(1)
    parts = ["\\", "#", "###", "</turn>", "<", ": ", ":", "h", "e", "c", "\n", "é", " "]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 3))), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        assert [chat.parse_span(s.text) for s in chat.spans(turns, chat.default_template)] == turns


def test_long_conversations_render_in_windows():
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(200)]
    calls = []

    def template(given):
        calls.append(len(given))
        return chat.default_template(given)

    assert [chat.parse_span(s.text) for s in chat.spans(turns, template)] == turns
    assert max(calls) <= chat.WINDOW
    assert "".join(s.text for s in chat.spans(turns, chat.default_template)) == chat.default_template(turns)


def test_templates_that_rewrite_history_are_detected():
    def last_only(turns):
        return "".join(f"{r}: {x if k == len(turns) - 1 else '...'}\n" for k, (r, x) in enumerate(turns))

    assert [s.rewrites for s in chat.spans([("user", "abc"), ("assistant", "def")], last_only)] == [False, True]


def test_templates_beyond_a_window(spark):
    def numbered(turns):
        return "".join(f"{k} {r}: {x}\n" for k, (r, x) in enumerate(turns))

    def folded(turns):
        """Rewrites turn 1 once there are 30."""
        return "".join(f"0 {r}: {'...' if k == 1 and len(turns) >= 30 else x}\n" for k, (r, x) in enumerate(turns))

    turns = [("assistant" if k % 2 else "user", f"text {k}") for k in range(40)]
    rows = spark.createDataFrame([(1, k, *turn) for k, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    parse = lambda span: tuple(span.split(" ", 1)[1][:-1].split(": ", 1))
    found = chat.digests(rows, numbered, parse).first()
    assert (found.n_turns, found.rewrites, found.formatted_chars) == (40, False, len(numbered(turns)))
    assert found.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    output = numbered(turns)
    of = chat.format_turns(rows, numbered, parse).orderBy("turn_no").collect()
    assert len(of) == 40 and all(output[r.start : r.end] == r.formatted and not r.rewrites and r.role == turns[r.turn_no][0] for r in of)
    assert "".join(s.text for s in chat.spans(turns, numbered)) == output
    of = chat.format_turns(rows, folded, parse).orderBy("turn_no").collect()
    assert [r.turn_no for r in of if r.rewrites] == [29] and len(of) == 40 and of[-1].end == len(folded(turns))
    found = chat.digests(rows, folded, parse).first()
    assert (found.n_turns, found.rewrites, found.formatted_chars) == (40, True, len(folded(turns)))
    with pytest.raises(ValueError):
        list(chat.spans(turns, chat.turn_local(lambda given: numbered(given))))


def test_conversation_digests(spark, small, result):
    rows = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    found = {r.conv_id: r for r in result("op5_chat_format")}
    assert found.keys() == rows.keys()
    for conv_id, turns in rows.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        r = found[conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.default_template(turns)) and not r.rewrites


def test_odd_conversations(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, None, None, 1), (None, 2, "assistant", "x", 1)], "conv_id long, turn long, role string, text string, n_turns int")
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.digests(rows).collect()} == {(1, 2, 0), (None, 1, 1)}
    assert chat.format_turns(rows).filter("loss").count() == 1
    assert chat.digests(rows.limit(0)).count() == 0


# near duplicates


def shingles(text):
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(rows):
    """Brute force over all pairs."""
    sets = [(i, shingles(x or "")) for i, x in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def test_near_duplicates_of_all_documents(texts, result):
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in result("op6_jaccard_join")} == components(sorted(texts.items()))


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_around_the_threshold(spark, seed):
    """Families of edited copies of all sizes, many of them just above or below 0.8."""
    rng = random.Random(seed)
    rows = []
    for size in (5, 6, 8, 12, 20, 40, 90, 180, 400):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                k = rng.randrange(len(words))
                words[k : k + rng.choice((0, 1))] = [f"x{rng.randrange(10**6)}"] * rng.choice((0, 1, 1))
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(r) for r in found.collect()} == components(rows)


def test_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(near_duplicates.sketch(common.mix64(s)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_sketches_of_long_sets_tell_them_apart():
    """Of disjoint sets of any size no pair passes the bound, and folding keeps it."""
    rng = np.random.default_rng(3)
    for size in (600, 3000, 20_000):
        sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (size, size * 9 // 8)]
        x, y = near_duplicates.folded([near_duplicates.sketch(s) for s in sets])
        assert 9 * np.bitwise_count(x ^ y).sum() > sum(map(len, sets))
        near = np.concatenate((sets[0][size // 20 :], sets[1][: size // 20]))
        x, y = near_duplicates.folded([near_duplicates.sketch(sets[0]), near_duplicates.sketch(near)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(sets[0], near))


def test_a_family_of_long_texts_just_below_the_threshold(spark, monkeypatch):
    """They share most buckets; few pairs of them are compared in full."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(190):  # each changes five shingles: about 0.73 of two texts is common
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    sizes, given = [], near_duplicates.verify

    def verify(pairs, sets):
        sizes.append(pairs.count())
        return given(pairs, sets)

    monkeypatch.setattr(near_duplicates, "verify", verify)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == components(rows)
    assert sum(sizes) < 60 * 59 / 2 / 5


def test_blocks_of_large_buckets_see_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 3)
    s = near_duplicates.sketch(np.array([1, 2, 3], np.uint64))
    rows = spark.createDataFrame([(1, k, 0, k, 3, s) for k in range(8)], "key long, a long, role byte, root long, size long, sketch binary")
    pairs = near_duplicates.blocks(rows).mapInArrow(near_duplicates.near_by_sketch, "a long, b long")
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(8) for b in range(a + 1, 8)}


def test_near_duplicates_of_odd_rows(odd, empty):
    found = sorted((r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(odd).collect())
    assert found == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8)]
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in common.components(edges).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}


# licences


def test_license_places(texts, result):
    for r in result("op7_license_scan"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate({k: k + 32 for k in range(65, 91)}))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_templates(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "the mit\nlicense MIT License"),
        (4, "a licensed fisher and the public"),
        (5, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
        (6, None),
    ]
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "cc-by-nc-4.0" and found[1].n_base == 0
    assert found[2].labels == "gpl,gpl-3.0" and found[3].n_base == 2 and found[3].labels == "mit"
    assert found[4].labels == "" and found[4].score == 0
    assert found[5].labels == "apache,apache-2.0" and found[6].n_words == 0


def test_licence_labels_depend_on_the_file_alone(spark):
    every = ". ".join(t for t, *_ in licenses.TEMPLATES)
    rows = [(k, "Licensed under CC BY 4.0 by me" if k % 3 == 0 else "plain words of prose") for k in range(60)] + [(60, every), (61, "x " * 5000 + every.upper())]
    found = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k] for k in range(0, 60, 3)} == {"cc-by-4.0"} and {found[k] for k in range(60) if k % 3} == {""}
    labels = {label for _, label, _ in licenses.TEMPLATES} | set(licenses.BASE.values())
    assert set(found[60].split(",")) == set(found[61].split(",")) == labels


def test_licenses_of_odd_rows(odd, empty):
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(empty).count() == 0


# decontamination


def test_reparameterised_questions(spark):
    item = "a train with Anna Smith goes 120 km in 3 hours and back in 3 hours at what speed"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "five small words stand here")], "item_id long, text string")
    rows = [
        (1, f"so: {item}!"),
        (2, "a train with Peter Lee goes 75 miles in 5 minutes and back in 5 minutes at what speed"),
        (3, "a train with Peter Lee goes 75 miles in 5 minutes and back in 6 minutes at what speed"),
        (4, "a train is a clean thing that nobody has to fear in any way whatsoever"),
        (5, "look, five small words stand here."),
        (6, None),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert found.keys() >= {(1, 1), (2, 1), (5, 4)} and not {d for d, _ in found} & {4, 6}
    assert not found[1, 1].reparameterised and found[2, 1].reparameterised
    # 3 keeps only windows that don't see both of the clashing numbers
    assert (3, 1) not in found or found[3, 1].n_windows < found[2, 1].n_windows


def test_names_and_numbers_anywhere(spark):
    benchmark = spark.createDataFrame(
        [
            (10, "Tom has 12 apples and gives 5 to Eve"),
            (11, "solve 3 x + 5 y = 12 and 2 x - 4 y = 6"),
            (12, "the red box holds 3 of them. the red box holds 7 of them"),
            (13, "Every morning the old farmer walks slowly down to the quiet river bank"),
        ],
        "item_id long, text string",
    )
    rows = [
        (1, "Exercise: Tom has 12 apples and gives 5 to Eve.", {10: False}),
        (2, "Ann has 7 apples\nand gives 2 to Bob", {10: True}),
        (3, "TOM HAS 12 APPLES AND GIVES 5 TO EVE", {10: False}),
        (4, "Ann has 7 apples and gives 7 to Bob", {}),  # two values where the item has different ones
        (5, "now solve 7 x + 2 y = 9 and 5 x - 3 y = 8!", {11: True}),
        (6, "solve 7 x + 7 y = 9 and 5 x - 3 y = 8", {}),
        (7, "well: red box holds 7 of them the red box holds 9 of them and more", {12: True}),
        (8, "EVERY MORNING THE OLD FARMER WALKS SLOWLY DOWN TO THE QUIET RIVER BANK", {13: False}),
        (9, "the red box holds 7 of us", {}),
        (20, "one two three 12 apples 5 and nothing else", {}),
    ]
    found = {}
    for r in decontamination.decontaminate(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), benchmark).collect():
        found.setdefault(r.doc_id, {})[r.item_id] = r.reparameterised
    assert found == {k: want for k, _, want in rows if want}


FORMS = [
    "{a} buys {n} pencils for {m} cents each and sells them to {b} for {k} cents, what is the profit of {a}?",
    "If {a} walks {n} km in {m} hours, how far does the same person walk in {k} hours?",
    "{a} is {n} years old and {b} is {m} years older, how old are both of them together?",
    "A tank holds {n} litres and loses {m} litres every {k} minutes, when is it empty?",
    "The sum of {n} and {m} is divided by {k}, what remains?",
    "Let f(x) = {n} x + {m}, find f({k})",
]


def test_recall_of_reparameterised_questions(spark):
    """Of questions with other names and numbers at least nine in ten are found, and no other text."""
    rng = random.Random(8)
    names = "Anna Peter Maria Tom Eve Julia Omar Li Nadia Igor Ben Clara".split()

    def filled(form):
        a, b = rng.sample(names, 2)
        n, m, k = rng.sample(range(2, 999), 3)
        return form.format(a=a, b=b, n=n, m=m, k=k)

    items = [(k, filled(form)) for k, form in enumerate(FORMS)]
    plain = lambda n: " ".join(rng.choices("water stone light some many other paper under 17 Anna 250 km seldom".split(), k=n))
    rows = [(k, f"{plain(30)}. {filled(FORMS[k % len(FORMS)])} {plain(20)}") for k in range(120)] + [(1000 + k, plain(80)) for k in range(60)]
    found = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({(k, k % len(FORMS)) for k in range(120)} & found) >= 0.9 * 120
    assert not {d for d, _ in found if d >= 1000}


def test_short_items(spark, monkeypatch):
    """Also where the anchors are too many to be broadcast."""
    items = [(1, "Compute 2 + 2."), (2, "What is 15 percent of 240?"), (3, "Why?"), (4, "Name it"), (5, "...")]
    far = " ".join(f"w{chr(97 + k % 26)}x" for k in range(300))
    docs = [(1, f"{far} Compute 2 + 2. {far}"), (2, "Compute 2 + 3."), (3, f"so: what is 30 percent of 90? {far}"), (4, "why"), (5, "Why not"), (6, "name it!"), (7, "name it now"), (8, "...")]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    expected = {(1, 1, 300, False), (3, 2, 1, True), (4, 3, 0, False), (6, 4, 0, False)}
    for given in (common.broadcast_if_small, lambda df, rows=0: df):
        monkeypatch.setattr(common, "broadcast_if_small", given)
        found = decontamination.decontaminate(docs, benchmark).collect()
        assert {(r.doc_id, r.item_id, r.first_word, r.reparameterised) for r in found} == expected


def test_decontamination_finds_every_verbatim_item(spark, small, texts, result):
    found = {(r.doc_id, r.item_id) for r in result("op8_decontaminate")}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= found


def test_decontamination_of_odd_rows(spark, odd, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(odd, nothing).count() == 0
    items = spark.createDataFrame([(1, LONG, 0), (2, "one two three", 0), (3, "same words here again and again same words", 0), (3, "same words here again and again same words", 0), (4, None, 0), (5, "", 0)], "item_id long, text string, same int")
    assert decontamination.decontaminate(empty, items).count() == 0
    found = {(r.doc_id, r.item_id): (r.first_word, r.reparameterised) for r in decontamination.decontaminate(odd, items).collect()}
    assert found == {(4, 2): (0, False), (6, 1): (0, False), (7, 1): (0, False), (8, 3): (0, False), (9, 3): (0, False)}


# toxicity


@pytest.mark.parametrize("stretch", (128, 2))
def test_marginals_equal_brute_force(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    stay = rng.normal(size=(2, 2))
    lengths = np.array([3, 0, 7, 1, 4])
    e = rng.normal(size=15)
    got, at = toxicity.marginals(e, lengths, stay, 0.3), 0
    transitions = np.zeros((2, 2))
    for n in lengths:
        total, each, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + (0.3 * y[0] if n else 0) + sum(stay[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        np.testing.assert_allclose(got[at : at + n], each / total, atol=1e-9)
        transitions += pairs / total
        at += n
    p, found = toxicity.expected(e, lengths, stay, 0.3)
    np.testing.assert_allclose(p, got)
    np.testing.assert_allclose(found, transitions, atol=1e-9)


def test_toxicity_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in rows if truth[r.doc_id]]
    clean = [r.predicted for r in rows if not truth[r.doc_id]]
    assert sum(toxic) / len(toxic) >= 0.6 and sum(clean) / len(clean) <= 0.03


def test_toxic_words_are_learned():
    rng = random.Random(0)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "elo", "inta", "oru")]
    texts = []
    for k in range(400):
        text = [rng.choice(words) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(3):
                text[rng.randrange(60)] = "zorg" + rng.choice(("", "en", "ish", "ata"))
        texts.append((" ".join(text), int(k % 4 == 0)))
    model = toxicity.fit(texts[:300])
    split = [toxicity.tokens(t) for t, _ in texts[300:]]
    lengths = np.array([len(x) for x in split])
    p = toxicity.marginals(np.concatenate([[model.weights[toxicity.features(w)].sum() for w in x] for x in split]), lengths, model.stay, model.start)
    score = toxicity.summaries(p, lengths) @ model.calibration
    assert ((score >= 0) == np.array([y for _, y in texts[300:]])).mean() > 0.95
    text = "ba zorgen, da"
    q = toxicity.marginals(np.array([model.weights[toxicity.features(w)].sum() for w in toxicity.tokens(text)]), np.array([3]), model.stay, model.start)
    assert toxicity.spans_of(text, q) == [{"start": 3, "end": 10}]


def test_toxicity_rows(spark, small, result, texts):
    rows = result("op9_toxicity")
    assert {r.doc_id for r in rows} == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (8, 0, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.collect_sample(odd, labels))
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(odd, toxicity.fit([])).filter("score >= 0.5").count() == 0
    assert toxicity.score(empty, model).count() == 0


# quality rules


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit)


def test_counting_rules(texts, result):
    for r in result("op10_quality_rules"):
        want = rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def brute_grams(rows):
    """Counts of the highest order by fold and language."""
    found = {}
    for text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if words:
            x = quality_rules.START * (quality_rules.ORDER - 1) + " ".join(words) + quality_rules.END
            for k in range(len(x) - quality_rules.ORDER + 1):
                key = (quality_rules.fold_of(text), lang or "", x[k : k + quality_rules.ORDER])
                found[key] = found.get(key, 0) + 1
    return found


def test_ngrams_are_counted_exactly(spark, odd, monkeypatch):
    rng = random.Random(5)
    many = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30_000))  # more characters than an alphabet has
    rows = [(r[1], r[2]) for r in ODD] + [("a\tb  c\n", "en"), (many, "zh"), ("x" * 200_000, "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert {(r.fold, r.lang, r.gram): r.n for r in quality_rules.counted(docs).collect()} == brute_grams(rows)


def test_probabilities_of_every_context_sum_to_one(spark):
    rows = [(f"{a} {b} abba {a}{b}", "x") for a in ("ab", "ba", "abc", "c") for b in ("cab", "a", "bb")] * 2
    table = quality_rules.model_table(common.checkpoint(quality_rules.counted(spark.createDataFrame(rows, "text string, lang string")))).toPandas()
    for _, model in table.groupby("fold"):
        p = {r.gram: np.exp(r.log) for r in model[~model.back].itertuples()}
        back = {r.gram: np.exp(r.log) for r in model[model.back].itertuples()}
        symbols = [g for g in p if len(g) == 1]

        def of(gram):
            return p.get(gram) or (back.get(gram[:-1], 1.0) * of(gram[1:]) if len(gram) > 1 else 0.0)

        assert abs(sum(map(of, symbols)) + back[""] - 1) < 1e-9
        for context in back:
            if context:
                total = sum(of(context + s) for s in symbols)
                unknown = back[""] * np.prod([back[context[k:]] for k in range(len(context))])
                assert abs(total + unknown - 1) < 1e-9


SLOTS = [[a + b for a in heads for b in tails] for heads, tails in ((("gre", "nar", "hid", "bro"), ("en", "row", "dal", "kish")), (("far", "doc", "sai", "tea"), ("mer", "tor", "lor", "cher")), (("see", "fol", "reme", "pai"), ("ths", "lows", "bers", "nts")), (("riv", "gard", "wind", "brid"), ("er", "un", "ow", "ge")))]


def prose(rng, n):
    """Sentences of a small grammar: the order of words says something."""
    out = []
    while len(out) < n:
        adjective, who, does, where = (rng.choice(x) for x in SLOTS)
        out += ["The", adjective, who, does, "the", rng.choice(SLOTS[0]), where + "."]
        out += rng.choices(("Later", "Perhaps", "Nobody", "knows", "why", "this", "happens", "every", "single", "morning"), k=rng.randint(0, 6))
    return out[:n]


def test_bands_reject_junk_and_keep_clean_texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(prose(rng, 80 + k % 50)), "en" if k % 4 else None) for k in range(400)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [(1000 + k, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(90)), "en") for k in range(4)]
    for k in range(4):  # letters of each word in another order
        junk.append((1010 + k, " ".join("".join(rng.sample(w, len(w))) for w in prose(rng, 90)), "en"))
    dull = [(1020, " ".join(f"{w} aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{'a' * (k % 53)}" for k, w in enumerate(prose(rng, 60))), "en")]
    copies = [(1030, dull[0][1].replace("farmer", "doctor"), "en")]
    words = prose(rng, 90)
    rng.shuffle(words)
    order = [(1040, " ".join(words), "en")]
    docs = spark.createDataFrame(rows + junk + order, "doc_id long, text string, lang string").repartition(4)
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(found[k].kept for k, *_ in rows)
    assert not any(found[k].kept or found[k].base_failed for k, *_ in junk)
    assert min(found[k].perplexity for k, *_ in junk) > found[1].upper
    assert found[1040].perplexity > 1.2 * max(found[k].perplexity for k in range(400) if k % 4)  # words in another order
    joined = {r.doc_id: r for r in quality_rules.quality_rules(docs, broadcast=0).collect()}
    assert all(joined[k].kept == r.kept and joined[k].perplexity == pytest.approx(r.perplexity, rel=1e-6) for k, r in found.items())


@pytest.mark.parametrize("percent", [5, 40])
def test_bands_hold_however_much_junk_there_is(spark, percent):
    """At least 95 % of scrambled texts are rejected and 99 % of others kept, of each of two languages."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang in ('en', 'fr') and length(text) < 20000").select("doc_id", "text", "lang").collect()
    rng = random.Random(percent)

    def scrambled(text, share):
        return " ".join("".join(rng.sample(w, len(w))) if rng.random() < share else w for w in (text or "").split())

    every = [("clean", r) for r in docs] + [("junk", r) for r in docs if r.doc_id % 100 < percent]
    rows = [(k, r.text if kind == "clean" else scrambled(r.text, 1 if k % 2 else 0.6), r.lang) for k, (kind, r) in enumerate(every)]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("not base_failed").collect()
    for lang in ("en", "fr"):
        kept = {kind: [r.kept for r in found if every[r.doc_id][0] == kind and every[r.doc_id][1].lang == lang] for kind in ("clean", "junk")}
        assert (sum(kept["junk"]) <= 0.05 * len(kept["junk"]) and sum(kept["clean"]) >= 0.99 * len(kept["clean"])), (lang, sum(kept["junk"]), len(kept["junk"]), sum(kept["clean"]), len(kept["clean"]))


def test_too_predictable_texts_are_rejected(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(prose(rng, 100)), "en") for k in range(200)]
    stamp = "a" * 400
    rows += [(500 + k, " ".join(f"{w} {stamp[: rng.randrange(150, 400)]}" for w in prose(rng, 30 + k)), "en") for k in range(6)]
    found = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].kept for k in range(200))
    assert all(not found[k].kept and not found[k].base_failed and found[k].perplexity < found[k].lower for k in range(500, 506))


@pytest.mark.parametrize(("name", "sql"), [("op10_quality_rules", quality_rules.BASE_SQL), ("op7_license_scan", licenses.BASE_SQL)])
def test_base_columns_equal_sql(duck, result, name, sql):
    found = duck.sql(sql)
    assert {tuple(r[c] for c in found.columns) for r in result(name)} == {tuple(row) for row in found.fetchall()}


def test_rules_of_odd_rows(odd, empty):
    found = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert found[1].n_words == 0 and not found[1].kept and found[1].perplexity is None
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in found.items()} == {r[0]: rules(r[1] or "") for r in ODD}
    assert found[8].base_failed and found[8].n_dup_lines == 29
    assert quality_rules.quality_rules(empty).count() == 0


def test_rows_without_an_id(spark, odd):
    """They are scored, packed and scanned like others, and linked as exact copies only."""
    docs = odd.union(spark.createDataFrame([(None, "same words here again and again\n" * 30, None, None, None, None, None), (None, None, None, None, None, None, None)], DOCS))
    n = docs.count()
    labels = spark.createDataFrame([(4, 1, 1), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert language_id.identify(docs, language_id.train(docs)).count() == n
    assert packing.pack(docs).filter("piece = 0").count() == n
    assert quality_classifier.quality(docs, labels).count() == n
    assert licenses.license_scan(docs).count() == n
    assert toxicity.score(docs, toxicity.fit(toxicity.collect_sample(docs, labels))).count() == n
    assert quality_rules.quality_rules(docs).count() == n
    assert sorted((r.component_id or 0) for r in near_duplicates.near_duplicates(docs).filter("doc_id is null").collect()) == [0, 8]
    found = decontamination.decontaminate(docs, spark.createDataFrame([(None, "same words here again and again"), (1, None)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in found) == [(8, None, False), (9, None, False)]
