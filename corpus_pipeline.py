"""The corpus pipeline: quality, toxicity, exact and near dedup, packing.

Each stage takes what the one before it kept; all but the last return the columns of documents. In all of them a null
text counts as an empty one, very long texts are read whole, columns that a stage doesn't name pass through whatever
their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import common, exact_dedup, jaccard_join, packing, quality_net, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network predicts good. Empty texts have a score like others; ties and repeated rows stay or go together."""
    return quality_net.keep_good(docs, quality_net.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon predicts clean. Empty texts have the curve's base score; ties and repeated rows stay or go together."""
    return toxicity.keep_clean(docs, toxicity.learn(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, empty ones included, the document with the largest doc_id; of repeated rows of that doc_id one. A null doc_id is the smallest."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word n-grams the one with the smallest doc_id, of repeated rows one; those without words all stay."""
    return jaccard_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; an empty text is the end id alone, repeated rows have places of their own."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row_no")


STAGES = [("quality", quality), ("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]

#: Learned scores and token merges aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents, each stage written to the shared folder and read again."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
