"""Manifests: status roll-ups, file counts, result JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(steps: DataFrame, by: str) -> DataFrame:
    """success if all steps are, error if none is, else partial processing."""
    ok = F.col("status") == "success"
    return steps.groupBy(by).agg(F.when(F.bool_and(ok), "success").when(F.bool_or(ok), "partial processing").otherwise("error").alias("status"), F.count("*").alias("steps"), F.sort_array(F.collect_set(F.when(~ok, F.col("detail")))).alias("errors"))


def extension_counts(files: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """filename's folder, complete: exactly the wanted number of files of each extension and no other."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    counted = files.select("folder", ext.alias("ext")).groupBy("folder")
    checks = [F.count_if(F.col("ext") == e) == n for e, n in wanted.items()]
    whole = F.count_if(~F.col("ext").isin(*wanted)) == 0
    for c in checks:
        whole = whole & c
    return counted.agg(whole.alias("complete"), F.count("*").alias("files"))


def citation_json(cites: DataFrame) -> DataFrame:
    """doc_id, json: the records of a document as one object, in order of cit_no (K1)."""
    record = F.struct("SECTION", "CITATION", "REFERENCE")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("cit_no", "cit_id", record.alias("record")))), lambda x: F.struct(x["cit_id"], x["record"]))
    return cites.groupBy("doc_id").agg(F.to_json(F.map_from_entries(entries)).alias("json"))
