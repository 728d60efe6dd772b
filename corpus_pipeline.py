"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. run() writes each stage's rows and reads them again, so a lost executor never costs more than one stage.

ORACLE_SQL is None: the near-dedup components and the sentence spans and BPE merges are beyond SQL; tests hold the
stages against plain versions.

Defined results are those of the operators; besides, of rows that are equal in doc_id and text the near-dedup keeps one, a
text of which nothing is left stays as an empty text, and n_chars (if documents has it) follows the text. Columns of documents
may have any names but those with __ before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import byte_bpe, common, mixing, near_dup, quality, spans

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, quality.labels_of(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.kept_rows(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spans.deduplicated(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.spark_digests(docs, *byte_bpe.vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
        common.dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
