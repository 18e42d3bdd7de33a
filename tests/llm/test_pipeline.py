"""Each stage of the pipeline works on what the one before kept."""

import re
import string
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        now = docs.count()
        assert now <= before, name
        before = now
    assert docs.select("doc_id").distinct().count() == before > 0
    packed = corpus_pipeline.run(spark, small)
    assert packed.select("doc_id").distinct().count() == before
    again = corpus_pipeline.deduplicate(spark, docs, small)
    assert again.count() == before
    docs.unpersist()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def test_kept_of_near_duplicates_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, small).select("doc_id").collect())
    assert kept == sorted(d for d in sets if root[d] == d) and len(kept) < len(sets)


def test_kept_of_contaminated_by_sql(spark, small):
    from codeloom.llm.decontamination import OP8_SQL

    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    dropped = {d for (d,) in duck.execute(f"SELECT DISTINCT doc_id FROM ({OP8_SQL})").fetchall()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, small).select("doc_id").collect()}
    assert dropped and kept == {r.doc_id for r in docs.select("doc_id").collect()} - dropped


def test_repeated_rows_and_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).select(*corpus_pipeline.COLUMNS)
    twice = docs.union(docs).withColumn("component_id", F.lit(1))
    once = corpus_pipeline.deduplicate(spark, twice, small)
    assert once.count() == once.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


LONG = " ".join(f"w{k % 977}" for k in range(30_000))
GOOD = "the farmer walks to the river and the doctor sits by the window while it rains in the old town . "
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n ", "en", "a", 3), (4, GOOD * 3, "en", "a", 300), (4, GOOD * 3, "en", "a", 300), (5, GOOD * 3, None, "b", 300), (6, LONG, "de", None, len(LONG)),
    (7, LONG + " end", "de", None, len(LONG) + 4), (8, "12 %% 34", "fr", "c", 8), (None, GOOD + "once more", "en", "a", 100),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "kept", "component_id", "lang_pred", "item_id", "piece"):  # clashing with what operators return
        rows = rows.withColumn(name, F.lit(1))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the farmer walks to the river and the doctor sits by the window"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def kept(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect())


def test_odd_rows_in_each_stage(spark, odd, tables):
    stages = dict(corpus_pipeline.STAGES)
    found = stages["quality"](spark, odd, tables)
    assert found.columns == corpus_pipeline.COLUMNS
    assert not {1, 2, 3} & {d for _, d in kept(found)} and (True, 0) in kept(found) and sum(d == 4 for _, d in kept(found)) in (0, 2)
    found = stages["language"](spark, odd, tables)
    assert found.columns == corpus_pipeline.COLUMNS
    assert not {1, 2, 3} & {d for _, d in kept(found)} and {(False, 4), (False, 5), (False, 6), (False, 7), (True, 0)} <= set(kept(found))
    found = stages["deduplicate"](spark, odd, tables)
    assert found.columns == corpus_pipeline.COLUMNS
    assert kept(found) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (False, 8), (True, 0)]
    found = stages["decontaminate"](spark, odd, tables)
    assert found.columns == corpus_pipeline.COLUMNS
    assert kept(found) == [(False, 1), (False, 2), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]
    packed = stages["pack"](spark, odd, tables).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD)
    assert sum(r.length for r in packed if r.doc_id in (1, 2)) == 2
