"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a row of tokens: words, and typed slots for numbers and for units
behind a digit. A template has two forms. In the first the slots are numbers and
units, and all words count in lower case, so that a copy matches whatever its case.
In the second every capitalised word is a slot for a name too, wherever it stands,
so that a question whose names were changed keeps its template.

Windows of ten tokens of the benchmark's items, and all of an item at once where it
is shorter or has windows with few words besides slots, meet those of all documents
by a hash of form, template and slots. Two lists of values stand in a consistent
one-to-one relation if and only if they repeat themselves at the same places; so
where a window has enough words besides its slots (six, or of a whole item four,
three where names are no slots), the hash takes in which slots have equal values,
and else the values themselves.
Every place of an item counts. A document's windows are hashed where a token is the
anchor of some window of the benchmark, its longest word.

Items of fewer than three tokens are found where they are all of a document, and
longer ones at any place. Null and empty texts and those without tokens have no windows.
Rows with one doc_id are one document, rows without one are not reported; rows
without an item_id are one item; other columns are ignored; very long texts are one
row; an empty table on either side gives an empty result. Of equally long words the
first is the anchor; of equal windows of an item the first place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a window, and of the least item that is looked for inside documents; shorter ones must be all of a document.
WINDOW, LEAST_INSIDE = 10, 3
#: Words besides slots from which on values may differ: in a window, in a whole item with and without names as slots.
LEAST_LITERALS, LEAST_IN_ITEM, LEAST_IN_PLAIN_ITEM = 6, 4, 3
#: Items of more tokens than that are no windows as a whole.
LONGEST_ITEM = 60
#: Units, longest first where one begins another.
UNITS = "kilometers kilometres kilometer kilometre km centimeters centimetres cm millimeters mm meters metres meter metre m miles mile mph feet foot ft inches inch kilograms kilogram kg milligrams mg grams gram g pounds pound lbs lb ounces ounce oz liters litres liter litre ml l gallons gallon hours hour hrs h minutes minute min seconds second sec s days day weeks week months month years year dollars dollar cents euros euro usd eur percent degrees kwh kw w volts v amps hz gb mb kb".split()
NUMBER, NAME, UNIT, STOP = "", "", "", ""
MARKS = NUMBER + NAME + UNIT + STOP

#: (pattern, replacement with $ for groups); a fourth mark ends a value.
STEPS = [
    (rf"(\d) ?((?i:{'|'.join(UNITS)})|%)([^\p{{L}}\p{{M}}\d]|$)", f"$1 {UNIT}$2{STOP}$3"),
    (r"(\d+([.,:/]\d+)*)", f" {NUMBER}$1{STOP} "),
]
TOKEN = rf"[{NUMBER}{UNIT}][^{STOP}]*{STOP}|[\p{{L}}\p{{M}}]+"
CAPITALISED = r"^\p{Lu}[\p{L}\p{M}]"


def tokens(text: Column) -> Column:
    """Words as they are written, and values behind the mark of their type."""
    out = F.translate(text, MARKS, "    ")
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0))


def is_slot(token: Column, names: Column) -> Column:
    """Whether a token is a slot in a form of the template: with names or without."""
    return F.substring(token, 1, 1).isin(NUMBER, UNIT) | names & token.rlike(CAPITALISED)


def template(window: Column, names: Column) -> Column:
    mark = F.substring  # of a number or unit its first character
    return F.transform(window, lambda t: F.when(mark(t, 1, 1).isin(NUMBER, UNIT), mark(t, 1, 1)).when(names & t.rlike(CAPITALISED), F.lit(NAME)).otherwise(F.lower(t)))


def values(window: Column, names: Column) -> Column:
    return F.transform(F.filter(window, lambda t: is_slot(t, names)), F.lower)


def with_hash(df: DataFrame) -> DataFrame:
    """Adds to rows (window, names, least) the hashes of what must agree, and of the values."""
    df = df.withColumn("values", values(F.col("window"), F.col("names")))
    pattern = F.transform("values", lambda v: F.array_position("values", v))
    free = F.size("window") - F.size("values") >= F.col("least")
    agreed = F.when(free, F.xxhash64(pattern)).otherwise(F.xxhash64("values"))
    return df.withColumn("hash", F.xxhash64("names", template(F.col("window"), F.col("names")), free, agreed)).withColumn("value_hash", F.xxhash64("values"))


def windows(benchmark: DataFrame) -> DataFrame:
    """(hash, width, least, names, item_id, item_at, value_hashes, anchor, shift) of the benchmark's windows."""
    cut = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens")).filter("n > 0")
    forms = cut.withColumn("names", F.explode(F.array(F.lit(False), F.lit(True))))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))
    # windows are cut before they are dealt out, so that no row holds a long item beside each
    every_window = F.transform(starts, lambda k: F.slice("tokens", k + 1, F.least(F.col("n"), F.lit(WINDOW))))
    short = F.when(F.col("n") <= LONGEST_ITEM, F.col("tokens"))
    places = forms.select("item_id", "names", "n", short.alias("item"), F.posexplode(every_window).alias("item_at", "window"))
    in_item = F.when(F.col("names"), LEAST_IN_ITEM).otherwise(LEAST_IN_PLAIN_ITEM)
    places = places.withColumn("least", F.when(F.col("n") > WINDOW, LEAST_LITERALS).otherwise(in_item))
    dense = F.col("n").between(WINDOW + 1, LONGEST_ITEM) & (F.size("window") - F.size(values(F.col("window"), F.col("names"))) < LEAST_LITERALS)
    whole = places.filter(dense).select("item_id", "names", "item").distinct().select("item_id", "names", F.lit(0).alias("item_at"), F.col("item").alias("window"), in_item.alias("least"))
    every = places.select("item_id", "names", "item_at", "window", "least").union(whole)
    # a window without a capitalised word has one form
    every = every.filter(~F.col("names") | F.exists("window", lambda t: t.rlike(CAPITALISED)))
    lengths = F.transform(template(F.col("window"), F.col("names")), lambda w: F.when(w == NAME, 0).otherwise(F.length(w)))
    every = with_hash(every).withColumn("lengths", lengths).filter(F.array_max("lengths") > 0)
    every = every.withColumn("shift", (F.array_position("lengths", F.array_max("lengths")) - 1).cast("int")).withColumn("width", F.size("window"))
    every = every.withColumn("anchor", anchor(F.get("window", F.col("shift"))))
    return every.groupBy("hash", "width", "least", "names", "item_id").agg(F.min("item_at").alias("item_at"), F.collect_set("value_hash").alias("value_hashes"), F.min("anchor").alias("anchor"), F.min("shift").alias("shift"))


def anchor(token: Column) -> Column:
    return F.lower(F.when(F.substring(token, 1, 1).isin(NUMBER, UNIT), F.substring(token, 1, 1)).otherwise(token))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, at, item_id, item_at, same): windows of documents with the template of one of the benchmark's and consistent values, and whether the values are the same."""
    asked = common.checkpoint(windows(benchmark.select("item_id", "text")))
    anchors = asked.select("anchor", "shift", "width", "least", "names").distinct()
    # outer: the filter that an inner one implies would be pushed below and compute the tokens twice
    cut = docs.select("doc_id", tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    cut = cut.select("doc_id", "n", "tokens", F.posexplode_outer("tokens").alias("place", "token")).withColumn("first", F.lit(0))
    few = common.broadcast_if_small(anchors)
    if few is anchors:  # the join moves rows: beside each token then goes what can be in a window with it, not the whole text
        first = F.greatest(F.col("place") - (LONGEST_ITEM - 1), F.lit(0))
        cut = cut.withColumn("first", first).withColumn("tokens", F.slice("tokens", F.col("first") + 1, 2 * LONGEST_ITEM))
    cut = cut.withColumn("anchor", F.coalesce(anchor(F.col("token")), F.lit(""))).drop("token")
    met = cut.join(few, "anchor").withColumn("at", F.col("place") - F.col("shift"))
    met = met.filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("n")))
    met = met.filter((F.col("width") >= LEAST_INSIDE) | (F.col("width") == F.col("n")))
    met = with_hash(met.select("doc_id", "at", "width", "least", "names", F.slice("tokens", F.col("at") - F.col("first") + 1, F.col("width")).alias("window")))
    met = met.select("doc_id", "at", "width", "least", "names", "hash", "value_hash")
    both = met.join(common.broadcast_if_small(asked.select("hash", "width", "least", "names", "item_id", "item_at", "value_hashes"), 100_000), ["hash", "width", "least", "names"])
    return both.select("doc_id", "at", "item_id", "item_at", F.array_contains("value_hashes", F.col("value_hash")).alias("same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item of which it holds a window: how many distinct windows, the first place, and whether values were changed."""
    return (
        hits(docs, benchmark)
        .filter("doc_id is not null")
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("item_at").alias("n_windows"), F.min("at").cast("long").alias("first_word"), (~F.bool_and("same")).alias("reparameterised"))
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    """All windows of all documents; values are compared pair by pair, not by their pattern."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = f"translate(text, '{MARKS}', '    ')"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    slot = f"x[1] IN ('{NUMBER}', '{UNIT}') OR (names AND regexp_matches(x, {quoted(CAPITALISED)}))"
    shape = f"list_transform(w, lambda x: CASE WHEN x[1] IN ('{NUMBER}', '{UNIT}') THEN x[1] WHEN names AND regexp_matches(x, {quoted(CAPITALISED)}) THEN '{NAME}' ELSE lower(x) END)"

    in_item = f"CASE WHEN names THEN {LEAST_IN_ITEM} ELSE {LEAST_IN_PLAIN_ITEM} END"

    def side(table: str, key: str) -> str:
        return f"SELECT {key}, toks, len(toks) AS n, names FROM (SELECT {key}, regexp_extract_all({text}, {quoted(TOKEN)}) AS toks FROM {table} WHERE text IS NOT NULL) CROSS JOIN (VALUES (false), (true)) f(names)"

    def told(rows: str) -> str:
        return f"SELECT *, {shape} AS shape, list_transform(list_filter(w, lambda x: ({slot})), lambda x: lower(x)) AS vals FROM ({rows})"

    return f"""
WITH d AS ({side('documents', 'doc_id')}), i AS ({side('benchmark', 'item_id')}),
iw AS ({told(f"SELECT *, toks[pos + 1 : pos + width] AS w FROM (SELECT item_id, toks, names, n, least(n, {WINDOW}) AS width, CASE WHEN n > {WINDOW} THEN {LEAST_LITERALS} ELSE {in_item} END AS least_words, unnest(range(0, greatest(n - {WINDOW}, 0) + 1)) AS pos FROM i WHERE n > 0)")}),
whole AS ({told(f"SELECT DISTINCT item_id, toks, names, n, n AS width, {in_item} AS least_words, 0::BIGINT AS pos, toks AS w FROM iw WHERE n BETWEEN {WINDOW + 1} AND {LONGEST_ITEM} AND width - len(vals) < {LEAST_LITERALS}")}),
every AS (SELECT item_id, names, width, least_words, pos, shape, vals, w FROM iw UNION ALL SELECT item_id, names, width, least_words, pos, shape, vals, w FROM whole),
item AS (SELECT * FROM every WHERE (NOT names OR len(list_filter(w, lambda x: regexp_matches(x, {quoted(CAPITALISED)}))) > 0) AND len(list_filter(shape, lambda x: x <> '{NAME}')) > 0),
dw AS ({told(f"SELECT doc_id, names, width, pos, toks[pos + 1 : pos + width] AS w FROM (SELECT doc_id, names, toks, n, width, unnest(range(0, n - width + 1)) AS pos FROM d JOIN (SELECT DISTINCT width, names FROM item) USING (names) WHERE n = width OR n > width AND width >= {LEAST_INSIDE})")}),
hit AS (SELECT dw.doc_id, item.item_id, dw.pos AS place, item.pos AS item_at, item.shape, item.names, item.least_words, dw.vals AS x, item.vals AS y, width - len(item.vals) >= least_words AS free,
 len(list_distinct(list_transform(range(1, len(item.vals) + 1), lambda k: dw.vals[k] || '|' || item.vals[k]))) AS pairs FROM dw JOIN item USING (shape, width, names)),
ok AS (SELECT *, CASE WHEN free THEN list_transform(y, lambda v: list_position(y, v)::VARCHAR) ELSE y END AS agreed FROM hit WHERE CASE WHEN free THEN len(list_distinct(x)) = pairs AND len(list_distinct(y)) = pairs ELSE x = y END),
placed AS (SELECT doc_id, item_id, place, names, least_words, shape, agreed, min(item_at) AS item_at, bool_or(x = y) AS same FROM ok GROUP BY ALL)
SELECT doc_id, item_id, count(DISTINCT item_at) AS n_windows, min(place)::BIGINT AS first_word, NOT bool_and(same) AS reparameterised FROM placed WHERE doc_id IS NOT NULL GROUP BY doc_id, item_id"""


OP8_SQL = _oracle()
