"""A corpus pipeline over ``documents``: five stages, each an operator of the llm subpackage.

1. language: documents whose language is rejected (no letter, or a narrow margin) go.
2. near_duplicates: of each component of the n-gram Jaccard join over five words at 0.8, one document stays.
3. privacy: personal data and the terms that give it away are replaced.
4. mixture: sources are mixed to their target weights; a document occurs once for each pass over it, with the
   words that the pass takes.
5. packing: what is left is packed into sequences.

A stage reads what its predecessor kept and returns the columns of documents; the last returns pieces of
sequences. ``run`` materialises each stage in the shared checkpoint folder, since a stage reads its input more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modalis.llm import common, jaccard, langid, mixing, packing, privacy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in an identified language; rows with equal doc_id and text share one decision."""
    d = docs.select(*COLUMNS)
    dictionaries = langid.train(langid.training_rows(d))
    return langid.kept(d, dictionaries)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.sanitised(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("privacy", privacy_stage),
    ("mixture", mixture),
    ("packing", packing_stage),
]

#: Compression, graph components and bin packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
