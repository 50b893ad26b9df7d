"""A corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, then pieces.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, those that clash included; columns are taken by
name, the first of that name. Empty tables go through as empty tables, very long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postella.llm.common import ship_package
from postella.llm.decontaminate import keep_clean
from postella.llm.quality import keep_good
from postella.llm.sentencepiece_codec import encode
from postella.llm.set_dedup import keep_one_similar
from postella.llm.suffix_dedup import cut_repeats
from postella.sources.shared import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits or the trees reject go, so those with a null or empty text; of rows that repeat an
    id each is judged by its own text. A score just at the limit stays."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five words are similar by 0.8 or more, directly or by way of others, the one of the least
    id stays, of ties the least hash of the text. Null, empty and wordless texts are alike; a null id stays only alone."""
    ship_package(spark)
    return keep_one_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in a document of smaller id are cut out; a document of which only white space
    is left goes. A null id sorts first; a null text stays as it is; equal ids don't match each other."""
    ship_package(spark)
    return cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 words in a row of a benchmark item, or whose words are items' by a twentieth or more, go.
    A null or empty text has no hits and stays; repeated rows are judged alike."""
    ship_package(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless) of every row; a null text has null pieces, repeated rows equal ones."""
    ship_package(spark)
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_codec", sentencepiece_codec),
]

#: Fingerprints, trees and sampled pieces can't be put in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each makes is written to the folder that all machines share."""
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
