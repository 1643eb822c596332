"""A corpus pipeline of five stages; each works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, langid, line_dedup, sentencepiece_ops, simhash
from ledgerloom.llm.common import new_path, remove, small_batches, tidy_shuffles
from ledgerloom.llm.queries import table, vocabulary


def _prepared(spark: SparkSession) -> None:
    small_batches(spark)
    tidy_shuffles(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no learned language go: without a letter, or clearly likelier as trigrams at random."""
    _prepared(spark)
    return langid.keep_identified(docs, langid.learned_from(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have are taken out of the texts."""
    _prepared(spark)
    return line_dedup.without_common_lines(docs, min_docs=10, min_chars=1)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8."""
    _prepared(spark)
    return simhash.one_of_each_group(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    _prepared(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=13, one_in=20)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    _prepared(spark)
    return sentencepiece_ops.piece_digest(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The first stage's model can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written as Parquet and read again; a stage's folder is deleted
    when the next one is written. The result reads the last folder."""
    docs, folder, last = table(spark, sf_dir, "documents"), new_path(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
