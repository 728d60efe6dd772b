"""File drops as streams: the stateless transforms run on whatever arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import citations


def sentence_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Sentences of documents in parquet files that are dropped into a folder."""
    docs = spark.readStream.schema(schema).parquet(path)
    return citations.sentences(docs.select("doc_id", "text"))
