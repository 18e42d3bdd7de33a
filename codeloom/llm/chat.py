"""Chat formatting by incremental black-box rendering.

A template is any function of a list of turns that returns text. The operator
renders successive prefixes of a conversation and compares consecutive outputs:
what a turn adds behind the output so far is its span. Where an output does not
begin with the one before, the template rewrote history; the conversation is
flagged and its spans come from the longest common prefix instead.

A template may look at any turn, so every prefix is rendered whole, at a cost that
grows with the square of a conversation. Only for a template declared turn-local
(`turn_local`), as the one of this module is, which marks turns one by one, are
prefixes rendered in windows, to keep long conversations linear: each window
starts with the last `overlap` turns before it, and what the first new turn adds
is checked to be what the same turn adds in the window before. A declared
template that fails this is an error.

Rows of a conversation meet by conv_id, sorted by (turn, role, text). With a
turn-local template they are streamed: a task holds one window and the running
digests, never a conversation; with others it holds the turns of one.
Null texts and roles count as empty. Repeated rows are turns of their own, a null
conv_id is a conversation of its own, other columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns that are rendered together, and of them those repeated from the window before.
WINDOW, OVERLAP = 16, 2
OPEN, CLOSE = "### ", " </turn>"
#: Control strings inside a text or role, and what stands for them; a backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
ASSISTANT = "assistant"


def turn_local(template: Template) -> Template:
    """Declares that what a turn adds to the template's output depends on that turn alone."""
    template.turn_local = True
    return template


def escape(text: str) -> str:
    for plain, coded in ESCAPES:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    back = {coded[1]: plain for plain, coded in ESCAPES}
    head, *parts = text.split("\\")
    out, parts = [head], iter(parts)
    for part in parts:
        if part:
            out.append(back[part[0]] + part[1:])
        else:  # two backslashes: the next part is plain
            out.append("\\" + next(parts, ""))
    return "".join(out)


@turn_local
def default_template(turns: list[Turn]) -> str:
    """`### role: text </turn>` a line, each role capitalised as it comes."""
    return "".join(f"{OPEN}{escape(role)}: {escape(text)}{CLOSE}\n" for role, text in turns)


def parse_span(span: str) -> Turn:
    """The turn that a span of the default template holds."""
    role, _, text = span[len(OPEN) : -len(CLOSE) - 1].partition(": ")
    return unescape(role), unescape(text)


@dataclass
class Span:
    text: str
    start: int  # in the output that ends with it
    rewrites: bool = False


def added(before: str, after: str, start: int = 0) -> Span:
    """What a prefix adds to the output of the one before, of which `start` characters more stand before both."""
    rewrites = not after.startswith(before)
    same = len(commonprefix([before, after])) if rewrites else len(before)
    return Span(after[same:], start + same, rewrites)


def prefixes(turns: Iterable[Turn], template: Template) -> Iterator[Span]:
    """What each turn adds to the output, every prefix rendered whole."""
    kept: list[Turn] = []
    before = ""
    for turn in turns:
        kept.append(turn)
        after = template(kept)
        yield added(before, after)
        before = after


def spans(turns: Iterable[Turn], template: Template, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[Span]:
    """What each turn adds to the output of a turn-local template, by windows. If windows differ, whole prefixes from there on; an error if the template was declared turn-local."""
    declared = getattr(template, "turn_local", False)
    every: list[Turn] = []  # all turns so far, of an undeclared template only
    kept: list[Turn] = []
    before, last, start = "", None, 0
    turns = iter(turns)
    for turn in turns:
        if len(kept) >= window:
            end = start + len(before)
            kept = kept[-overlap:]
            shorter, before = template(kept[:-1]), template(kept)
            if not before.startswith(shorter) or before[len(shorter) :] != last:
                if declared:
                    raise ValueError("a template declared turn-local renders a turn differently in another window")
                yield from islice(prefixes(chain(every, (turn,), turns), template), len(every), None)
                return
            start = end - len(before)
        kept.append(turn)
        if not declared:
            every.append(turn)
        after = template(kept)
        span = added(before, after, start)
        last, before = span.text, after
        yield span


def rendered(turns: Iterable[Turn], template: Template) -> Iterator[Span]:
    """By windows where the template is declared turn-local, else by whole prefixes."""
    return (spans if getattr(template, "turn_local", False) else prefixes)(turns, template)


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
TURN_SCHEMA = "conv_id long, turn_no long, start long, end long, role string, loss boolean, rewrites boolean, formatted string"


def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    for batch in common.slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def by_conversation(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_turns(conversations: DataFrame, template: Template = default_template, parse: Callable[[str], Turn] = parse_span) -> DataFrame:
    """A row for each turn: its span in the conversation's output and whether loss falls on it. The span of a turn that rewrites history begins where the outputs differ and takes the place of what stood there; it has no role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, rows in groupby(sorted_rows(batches), key=lambda r: r[0]):
            out = []
            for k, span in enumerate(rendered(((role, text) for _, role, text in rows), template)):
                role = "" if span.rewrites else parse(span.text)[0]
                out.append((conv_id, k, span.start, span.start + len(span.text), role, role == ASSISTANT, span.rewrites, span.text))
                if len(out) == WINDOW:
                    yield turn_batch(out)
                    out = []
            if out:
                yield turn_batch(out)

    return by_conversation(conversations).mapInArrow(run, TURN_SCHEMA)


def turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(),) * 4 + (pa.string(), pa.bool_(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in TURN_SCHEMA.split(", ")])


def digests(conversations: DataFrame, template: Template = default_template, parse: Callable[[str], Turn] = parse_span) -> DataFrame:
    """A row for each conversation, from what is read back from its output. Turns that rewrite history count as turns but cannot be read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, rows in groupby(sorted_rows(batches), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            rewrites, turns, loss = False, hashlib.sha256(), hashlib.sha256()
            for span in rendered(((role, text) for _, role, text in rows), template):
                chars = span.start + len(span.text)
                n += 1
                if span.rewrites:
                    rewrites = True
                    continue
                role, text = parse(span.text)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == ASSISTANT:
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites))
            if len(out) == 1000:
                yield digest_batch(out)
                out = []
        if out:
            yield digest_batch(out)

    return by_conversation(conversations).mapInArrow(run, SCHEMA)


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


#: The conversation that op5 adds to the table.
EXTRA = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")))


def _length(column: str) -> str:
    for plain, coded in ESCAPES:
        column = f"replace({column}, '{plain}', '{coded}')"
    return f"length({column})"


OP5_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum({len(OPEN) + 2 + len(CLOSE) + 1} + {_length('role')} + {_length('text')}) AS BIGINT) AS formatted_chars, false AS rewrites
FROM t GROUP BY conv_id"""
