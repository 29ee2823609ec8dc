"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, packing.

Every stage is a function of (spark, docs, sf_dir); ``docs`` is what the stage
before kept, with the columns of ``documents`` (others are left behind, whatever
their names).  What a stage decides travels as (doc_id, a hash of the row), never
with the text; the texts are read again to be kept or left.  ``run`` writes each
stage's result as Parquet in the shared folder, gives it to the next, and drops
what a stage no longer needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, neardup, packing, quality, rules
from graphloom.llm.common import content, materialise, release, scratch, small, table

#: Names of dropped rows are broadcast up to so many (16 bytes each); beyond, texts are shuffled to meet them.
ID_ROWS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NAME = "_content"


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*_columns(docs), content(_columns(docs)).alias(NAME))


def _without(named: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``named`` whose equal in (doc_id, NAME) was not judged to be kept; equal rows are judged alike."""
    gone = materialise(judged.filter("NOT kept").select(F.col("doc_id").alias("_doc"), F.col(NAME).alias("_own")).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col(NAME) == F.col("_own"))
    left = named.join(small(gone, ID_ROWS), same, "left_anti").drop(NAME)
    left.graphloom_gone = gone
    return left


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier keeps.

    Null and empty texts are judged as texts without words; very long ones are
    read whole; repeated rows are judged each; ties at the threshold stay.
    """
    with scratch(spark) as held:
        named = _named(docs)
        left = _without(named, quality.judge(named, table(spark, sf_dir, "labels"), ["doc_id", NAME]))
        held.keep(left.graphloom_gone)
    return left


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every risk-controlled threshold.

    Null, empty and blank texts fail the base rule; very long ones are measured
    whole; repeated rows are judged each; a statistic equal to its cutoff passes.
    """
    with scratch(spark) as held:
        named = _named(docs)
        left = _without(named, rules.judge(named, table(spark, sf_dir, "labels"), keep=["doc_id", "lang", NAME]))
        held.keep(left.graphloom_gone)
    return left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of least doc_id (repeated rows of it once).

    Null and empty texts are alike with nothing and stay, as do rows without doc_id.
    """
    rows = docs.select(*_columns(docs))
    with scratch(spark) as held:
        found = neardup.near_duplicates(rows).filter(~F.col("kept")).select("doc_id").distinct()
        gone = held.keep(materialise(found, "gone"))
        left = rows.join(small(gone, ID_ROWS), "doc_id", "left_anti")
        again = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 AND doc_id IS NOT NULL").select("doc_id")
        again = held.keep(materialise(again, "again"))
    if not again.limit(1).count():
        return left
    known = small(again, ID_ROWS)
    once = left.join(known, "doc_id", "left_anti")
    return once.unionByName(left.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, as whole copies; a copy is cut only where whole ones miss a source's target by more than 1%.

    Copies carry their document's doc_id.  Null and blank texts have no words, so they are taken 0 times.
    """
    return mixing.expand(docs.select(*_columns(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbered power-of-two sequences of all copies with their token ids; ``copy`` tells copies of a document apart.

    Null and empty texts are the end id alone; very long ones are many sequences.
    """
    return packing.sequences(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hashes and a tokenizer have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables written on the way only the last stage's result is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as held:
            docs = held.keep(materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        if hasattr(before, "graphloom_path"):
            release(before)
    return docs
