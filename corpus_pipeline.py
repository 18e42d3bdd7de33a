"""A training corpus from `documents`: five stages, each on all that the one before kept.

What becomes of odd rows, stage by stage. Null, empty and blank texts: quality and
language reject them; the later stages keep such a row, as a document of its own
without words, and pack it as one token. Null metadata are values like others. Rows
with one doc_id share the verdict of a stage on any of them, and deduplication keeps
one row of them; rows without a doc_id are never rejected, for a verdict names its
document by that id. Very long texts are read whole in every stage. Of a group of
near duplicates the smallest doc_id stays; a probability of exactly a half is good
quality, a share of exactly LEAST_LANGUAGE is kept. Columns of other names, clashing
or not, are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common, decontamination, language_id, near_duplicates, packing, quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose largest language has a smaller share than this is rejected.
LEAST_LANGUAGE = 0.3


def keep(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the rejected ones."""
    return docs.join(common.broadcast_if_small(rejected.select("doc_id").distinct()), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier rejects."""
    verdicts = common.checkpoint(quality_classifier.quality(docs, common.table(spark, sf_dir, "labels")))
    return keep(docs, verdicts.filter(~F.col("kept")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language. It learns from those that op1 learns from."""
    found = common.checkpoint(language_id.identify(docs, language_id.train(docs.filter(~language_id.held_out()))))
    return keep(docs, found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id, and one row of each doc_id."""
    found = common.checkpoint(near_duplicates.near_duplicates(docs))
    left = keep(docs, found.filter("component_id <> doc_id"))
    repeated = common.broadcast_if_small(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return left.join(repeated, "doc_id", "left_anti").union(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return keep(docs, common.checkpoint(decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("pack", pack)]

#: Co-training and language models have no SQL; tests hold deduplication against brute force, decontamination against its SQL; op4 and op1 are held against labels they did not learn from.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
