"""Corpus pipeline over ``documents``: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the runner writes a stage's
result as Parquet in the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm import near_copies, op2_language, op7_substring, op9_quality
from keepstone.llm.common import Scratch, table
from keepstone.llm.op10_packing import pack_documents
from keepstone.llm.queries import tokenizer_path

#: A text whose language is less probable than this over its positions is rejected, as is one without letters.
LEAST_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with letters whose language is told with some certainty. Learns from the rows that carry a language.

    Null texts and texts without a letter go. Where no row carries a language, nothing can be told and every text with
    letters stays. Repeated rows are judged alike. Columns of any name are passed through.
    """
    model = op2_language.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.col("text").rlike(op2_language.LETTER))
    judged = op2_language.predict(docs, model, docs.columns, prefix="_ks_")
    kept = (F.col("_ks_lang_pred") != op2_language.UNDETERMINED) & (F.col("_ks_score") >= LEAST_LANGUAGE)
    return judged.where(kept).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the classifier, trained on the labels, takes for label 1.

    Null and empty texts are judged as empty ones. Where there are no labels, every row stays; where there is one label
    only, it holds for all rows. Columns of any name are passed through.
    """
    model = op9_quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    judged = op9_quality.score(docs, model, docs.columns, prefix="_ks_")
    return judged.where("_ks_predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that 5-word Jaccard similarities of 0.8 or more link: the least id.

    SimHash with pivot distances finds candidates first, an exact join of shingles what it misses; all are verified. A
    null id comes behind all others, and null and blank texts are copies of each other. Different texts that share an
    id are documents of their own; of rows that repeat id and text one stays. Columns of any name are passed through.
    """
    return near_copies.drop_near_copies(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove runs of 50 words or more that stand in an earlier document.

    A text that loses words becomes its kept words, one blank apart, and gets a new length; a text that keeps none is
    dropped. All other rows are returned as they are, those with a null text or id among them.
    """
    return op7_substring.cut_repeats(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences of 2048. A null text is its end id alone; no row is dropped."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Learned stages can't be told in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
