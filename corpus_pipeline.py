"""Corpus preparation end to end: five stages, each written to the shared folder and read back as the next one's input.

All but the last return the columns of ``documents``. Null texts and texts without a word are scored
by the bias alone, are no near copies of each other and hold no passage; documents with a null id are kept whole; rows
of one id are one document to near-duplicate search, whose copies stay or go together. Empty tables stay empty, and
extra columns of any name go through all stages but the last.
Decisions take effect: rejected documents and near copies go, repeated passages are cut, rows are put in mixed order,
and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.llm import mixing, near_dup, packing, quality, suffix_dedup
from nestwright.llm.queries import LEAST_QUALITY, table, tokenizer_path
from nestwright.llm.work import Workspace, fresh


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs.columns, "score")
    return quality.score(docs, model, keep=tuple(docs.columns), name=name).where(F.col(f"`{name}`") >= LEAST_QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies."""
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources at their target weights."""
    return mixing.mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Order MinHash, a trained classifier and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    mark = Workspace.mark()
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
        Workspace.drop_since(mark)  # what the stage's operators left in the shared folder
        work.release()
    return docs
