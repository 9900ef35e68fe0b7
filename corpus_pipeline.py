"""The training-corpus pipeline: toxicity filter, quality filter, near-duplicate removal, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  Every stage
reads its input as a table, so none repeats the work of those before it, and a lost executor costs a reread.

Defined results: null and empty texts are scored like empty ones, are one near-duplicate class, and are packed as an end id alone;
repeated rows are kept or rejected alike, and one of each class stays; null ids are kept; without both labels a filter keeps all
documents (scores 0 and 0.5 are on the keeping side); extra columns are kept by all stages but the last; an empty table gives no piece.
The order within shards of the last stage follows the table that the stage before wrote, which a lost task rereads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import minhash, packing, pii, quality, toxicity
from paperloom.llm.common import discard, materialize, table
from paperloom.session import importable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model doesn't reject; it learns from the labels of training rows among ``docs``."""
    return toxicity.keep_clean(docs, toxicity.fit(importable(spark), docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its cut; it learns from the labels of training rows among ``docs``."""
    return quality.keep_good(docs, quality.fit(importable(spark), docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    importable(spark)
    return minhash.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and credentials."""
    importable(spark)
    return pii.replace_text(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences, with their ids."""
    import public_tokenizers

    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("near_dedup", drop_near_copies),
    ("pii_surrogates", replace_private),
    ("packing", pack),
]

#: SQL can express none of the classifiers, so the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
