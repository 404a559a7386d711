"""Documents to packed training sequences: good text, one of each near copy, no repeated passages, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it back, so a lost executor costs one stage.

Null and empty texts, null ids and repeated rows pass through as each operator's docstring says; very long texts are scored, compared, cut
and packed whole; ties go to the smaller doc_id; empty tables give empty results; extra columns, whatever their names, are kept up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from permeon.llm import kneser, minhash, packing, suffix
from permeon.llm._encode import public_path
from permeon.llm._session import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under a model of trusted text is above their language's threshold."""
    return kneser.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id has."""
    return suffix.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(docs, public_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("packed", packed)]

#: Perplexities, suffix arrays and packing are beyond SQL; the tests hold run() against its stages called one by one, not against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
