"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a row of tokens: words and tags. Words score positive where they look
like content and tags negative; words that look like boilerplate score negative
too. What a word looks like is the kind of block it stands in (paragraph, heading,
list item, cell, other), how long that block is, and whether it is in a link; a
container named like a header, legal note or the like makes it less. The weights
are log odds of each kind inside and outside the content, from labelled pages:
those whose markup names their content (one article or main element, or a
microdata article body) label themselves. A linear scan finds the contiguous
region of the highest total, on every page, and takes the blocks at its ends whole;
where nothing scores positive the region is all of the page. Markup that names the content is
evidence, not a verdict: its words score more, and words outside it less, unless it
has less than NAMED_SHARE of what scores on the page.

Inside the region, containers that are never main text (menus, forms, comments,
adverts and the like; loosely named ones only where most of their words are links)
are left out, and the rest is read block by block. `br` ends a block. Characters
outside all tags count as words.

Null and empty pages give an empty text. Repeated rows are each read; other
columns are ignored; an empty table gives an empty result; very long pages are
read whole. Of two regions with the same total the first is taken. Elements that
are not closed end with their container, raw text that is not closed with the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample, drawn by a hash of page_id.
SAMPLE_PAGES = 2000

#: Elements whose content is no text of the page; those of the second group may close themselves, and are plain tags if they never end.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "select", "title", "xmp", "noembed", "noframes")
FOREIGN = frozenset(("svg", "canvas", "object", "template", "noscript", "select"))
BOILERPLATE = frozenset("nav header footer aside form menu dialog button label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input label button".split())
#: Elements of formulas: part of the line they stand in, and neither for nor against a region.
MATH = frozenset("math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mstyle mpadded mphantom menclose mfenced merror maction maligngroup malignmark semantics annotation annotation-xml".split())
#: Elements that an end tag of these closes.
CONTAINERS = frozenset("article main section div body html table ul ol dl td th tr li blockquote figure details".split()) | BOILERPLATE
#: Whole words of class, id and role that name what is never main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|pagination|pager|skip-?link)(?:$|[\s_-])"
    , re.I)
#: Those that say less: evidence against a region, and left out only where they hold little but links.
LOOSE = re.compile(
    r"(?:^|[\s_-])(?:banner|aside|footer|masthead|topbar|site-?header|page-?header|header|contentinfo|complementary|search|overlay|related|recommend\w*|tags|widget|toolbar|copyright|legal|disclaimer|alert|toast|respond)(?:$|[\s_-])"
    , re.I)
#: Containers of everything, named after what they also hold; headers of the text; and articles that are none.
WRAPPER = re.compile(r"wrap|container|layout|grid|(?:^|[\s_-])(?:has|with|no|page)-|(?:article|entry|post|content|story)[_-]?_?header", re.I)
ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|promo\w*|ads?|advert\w*|sponsor\w*)(?:$|[\s_-])", re.I)
#: Kinds of blocks by their tag; all others are "div".
BLOCKS = {**dict.fromkeys("p blockquote pre figcaption".split(), "p"), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "h"), **dict.fromkeys("li dt dd".split(), "li"), **dict.fromkeys("td th".split(), "cell")}
#: Words of a block from which on it counts as longer, and before any page was seen the share of content in blocks of each length.
LENGTHS = (3, 10, 25)
PRIOR = {"p": (0.55, 0.6, 0.7, 0.8), "h": (0.55, 0.6, 0.7, 0.7), "li": (0.45, 0.5, 0.65, 0.75), "cell": (0.45, 0.5, 0.65, 0.75), "div": (0.4, 0.45, 0.6, 0.75)}
LINK_PRIOR, LOOSE_PRIOR, TAG_PRIOR, PRIOR_WEIGHT = 0.3, 0.2, 0.45, 20.0
#: What words in a named content element score more, those outside it less, and from which share of all that scores it is believed.
NAMED, NAMED_SHARE = 2.0, 0.3
#: Tags without it need not be read for attributes that hide.
HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
HIDING_STYLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
ANY_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
@cache
def token_pattern(raw: tuple[str, ...] = RAW) -> re.Pattern[str]:
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
        r"|<(?P<raw>" + "|".join(raw) + r")(?=[\s/>])(?P<raw_rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:(?P<raw_end></(?P=raw)\s*>)|\Z)"
        r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
        r"|<[!?/][^>]*(?:>|\Z)"
        r"|<[a-z][^>]*(?:>|\Z)"  # a quote that is not closed
        r"|(?P<text>[^<]+|<)",
        re.I | re.S,
    )


@dataclass(slots=True)
class Token:
    kind: str  # of words, the kind of block; of tags, the tag
    text: str | None  # of words
    out: bool  # in a container that is never main text
    block: int
    content: bool  # in an element that names the content
    words: int = 0
    link: bool = False
    box: int = -1  # the outermost loosely named container


def named(rest: str) -> tuple[str, str]:
    """Class, id and role of a tag; its itemprop."""
    names, prop = [], ""
    for m in ATTRIBUTE.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "itemprop":
            prop = value
        elif m[1].lower() != "aria-label":
            names.append(value)
    return " ".join(names), prop


def hidden(rest: str) -> bool:
    """Whether an attribute of the tag hides it: hidden itself, aria-hidden that is true, or a style."""
    if not HIDDEN.search(rest):
        return False
    for m in ANY_ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and HIDING_STYLE.search(value):
            return True
    return False


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    stack: list[tuple[str, bool, bool, str, bool, int]] = []  # tag, left out, names the content, kind of block, link, loosely named container
    opened: Counter = Counter()  # tags on the stack
    block = boxes = at = 0
    raws, pattern = RAW, token_pattern()
    while m := pattern.match(page, at):
        at = m.end()
        text = m["text"]
        left_out, content, kind, link, box = stack[-1][1:] if stack else (False, False, "div", False, -1)
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            out.append(Token(kind, text, left_out, block, content, len(text.split()), link, box))
            continue
        raw = m["raw"]
        if raw is not None:
            raw = raw.lower()
            if raw in FOREIGN and (m["raw_rest"].endswith("/") or not m["raw_end"]):  # closes itself, or never ends: what follows is text of the page
                at = m.end("raw_rest") + 1
                if not m["raw_end"]:  # nor will any other of its kind end
                    raws = tuple(x for x in raws if x != raw)
                    pattern = token_pattern(raws)
                continue
            block += raw in ("textarea", "select", "iframe", "object")
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in MATH:
            block += 1
        if m["end"]:
            if opened[tag]:
                k = last(stack, tag)
                if tag in CONTAINERS or not any(t in CONTAINERS and t != tag for t, *_ in stack[k + 1 :]):
                    left_out, content, _, _, box = stack[k][1:]
                    opened.subtract(t for t, *_ in stack[k:])
                    del stack[k:]
            out.append(Token(f"/{tag}", None, left_out, block, content, box=box))
            continue
        rest = m["rest"]
        names, prop = named(rest) if "=" in rest else ("", "")
        if tag in ("article", "main") or prop.lower() == "articlebody" or names == "main":
            content = True
        elif tag in BOILERPLATE and not (tag == "header" and content):
            left_out = True
        if names and tag not in ("html", "body"):
            if tag in ("article", "main"):
                left_out = left_out or bool(ASIDE_ARTICLE.search(names))
            elif not WRAPPER.search(names):
                if NAMES.search(names):
                    left_out = True
                elif box < 0 and LOOSE.search(names):
                    box, boxes = boxes, boxes + 1
        if rest and hidden(rest):
            left_out = True
        out.append(Token(tag, None, left_out, block, content, box=box))
        if tag not in VOID and not rest.endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next one begins
                stack.pop()
                opened["p"] -= 1
            if tag in BLOCKS:
                kind = BLOCKS[tag]
            elif tag not in INLINE and tag not in MATH:
                kind = "div"
            stack.append((tag, left_out, content, kind, link or tag == "a", box))
            opened[tag] += 1
    return out if boxes == 0 else without_link_boxes(out, boxes)


def without_link_boxes(found: list[Token], boxes: int) -> list[Token]:
    """Leaves loosely named containers out that hold more words in links than others."""
    balance = [0] * boxes
    for t in found:
        if t.box >= 0 and not t.out:
            balance[t.box] += t.words if t.link else -t.words
    for t in found:
        if t.box >= 0 and balance[t.box] > 0:
            t.out = True
    return found


def last(stack: list[tuple], tag: str) -> int:
    return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)


def labelled(found: list[Token]) -> bool:
    """One contiguous stretch of the page is named as its content."""
    return sum(a.content and not b.content for a, b in zip(found, [*found[1:], Token("", None, False, 0, False)])) == 1


def kinds(found: list[Token]) -> list[str]:
    """What each token is weighed as: a tag, or the words of a kind of block and length, in a link or not."""
    lengths: dict[int, int] = {}
    for t in found:
        if t.words:
            lengths[t.block] = lengths.get(t.block, 0) + t.words
    return [t.kind if t.text is None else "link" if t.link else f"{t.kind} {sum(lengths.get(t.block, 0) >= n for n in LENGTHS)}" for t in found]


def weights(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log odds of each kind in content, with a prior: of tags between -1 and -0.05, of loosely named containers -0.2 at the most, of words between -2 and 2."""

    def odds(kind: str, prior: float) -> float:
        inside, outside = (counts.get((kind, side), 0) + PRIOR_WEIGHT * share for side, share in ((True, prior), (False, 1 - prior)))
        return log(inside / outside)

    found = {k: min(max(odds(k, TAG_PRIOR), -1.0), -0.05) for k, _ in counts if k not in ("link", "loose") and " " not in k}
    found["tag"] = odds("tag", TAG_PRIOR)  # any other
    found["loose"] = max(min(odds("loose", LOOSE_PRIOR), -0.2), -2.0)
    words = {"link": LINK_PRIOR} | {f"{kind} {k}": p for kind, shares in PRIOR.items() for k, p in enumerate(shares)}
    return found | {k: min(max(odds(k, p), -2.0), 2.0) for k, p in words.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the highest total, empty where none is positive."""
    best = total = 0.0
    begin = where = stop = 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, where, stop = total, begin, k + 1
    return where, stop


def read(found: list[Token]) -> str:
    blocks: dict[int, list[str]] = {}
    for t in found:
        if t.text is not None and not t.out:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def scored(found: list[Token], weight: dict[str, float]) -> list[float]:
    """What each token adds to a region. Left-out words, their tags and those of formulas add nothing."""
    by_looks = []
    for t, kind in zip(found, kinds(found), strict=True):
        if t.out or t.text is None and t.kind.removeprefix("/") in MATH:
            by_looks.append(0.0)
        elif t.text is None:
            by_looks.append(weight.get(kind, weight["tag"]))
        else:
            by_looks.append(t.words * (weight[kind] if t.box < 0 else min(weight[kind], 0.0) + weight["loose"]))
    named_part = sum(max(s, 0.0) for s, t in zip(by_looks, found, strict=True) if t.content)
    total = sum(max(s, 0.0) for s in by_looks)
    if not any(t.content and t.words and not t.out for t in found) or named_part < NAMED_SHARE * total:
        return by_looks
    # in an element that names the content no word counts against it, nor does a tag split it
    return [s if t.out else max(s, -0.01) if t.text is None and t.content else s if t.text is None else max(s + NAMED * t.words, 0.5 * t.words) if t.content else s - NAMED * t.words for s, t in zip(by_looks, found, strict=True)]


def main_text(page: str, weight: dict[str, float]) -> str:
    found = tokens(page)
    a, b = best_region(scored(found, weight))
    if a == b:
        return read(found)
    first, final = found[a].block, found[b - 1].block  # no block is cut
    while a > 0 and found[a - 1].block == first:
        a -= 1
    while b < len(found) and found[b].block == final:
        b += 1
    return read(found[a:b])


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    total = pages.count()
    drawn = pages.select("page_id", "html").filter(F.col("html").isNotNull() & (common.hash_share("page_id", 3) < min(1.0, sample / max(total, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in common.slices(batches, "html"):
            for page in common.texts(batch, "html"):
                found = tokens(page)
                if labelled(found):
                    for t, kind in zip(found, kinds(found), strict=True):
                        n, inside = (1, t.content and not t.out) if t.text is None else (t.words, t.content and not t.out)
                        if t.text is None:
                            counter["tag", inside] += n
                        counter[kind, inside] += n
                        if t.box >= 0 and t.words:
                            counter["loose", inside] += n
        rows = [(k, c, n) for (k, c), n in counter.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.bool_()), pa.array([x[2] for x in rows], pa.int64())], names=["kind", "content", "n"])

    counted = drawn.mapInArrow(count, "kind string, content boolean, n long").groupBy("kind", "content").sum("n").collect()  # a row for each name of a tag in the sample
    return weights({(k, c): n for k, c, n in counted})


def extract(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            found = [main_text(x, weight) for x in common.texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))


#: What the tables' pages come to by their own markup: the blocks of the one article, and the references that stand in it.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS inside FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(inside, '</?(p|h1|br)>', chr(1), 'g'), '<[^>]*>?', '', 'g'), chr(1)) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""
