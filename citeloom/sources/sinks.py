"""Results as files: citation, target and aligned JSON, manifests, reports, responses, zip bundles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _objects(rows: DataFrame, value: Column, by: str = "doc_id") -> DataFrame:
    """One JSON object a document: cit_id -> value, in order of cit_no."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("cit_no", "cit_id", value.alias("v")))), lambda x: F.struct(x["cit_id"], x["v"]))
    return rows.groupBy(by).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def target_json(cites: DataFrame) -> DataFrame:
    """doc_id, json: the target of each citation that has one (K2)."""
    return _objects(cites.filter("target IS NOT NULL"), F.col("target"))


def aligned_json(cites: DataFrame, aligned: DataFrame) -> DataFrame:
    """doc_id, json: the records with ALIGNED SECTION, the canonical titles of their section in order (K3); aligned: doc_id, section, title."""
    titles = aligned.groupBy("doc_id", F.col("section").alias("SECTION")).agg(F.array_sort(F.collect_set("title")).alias("ALIGNED SECTION"))
    rows = cites.join(titles, ["doc_id", "SECTION"], "left").withColumn("ALIGNED SECTION", F.coalesce("ALIGNED SECTION", F.array().cast("array<string>")))
    return _objects(rows, F.struct("SECTION", "CITATION", "REFERENCE", "`ALIGNED SECTION`"))


def write_json(rows: DataFrame, path: str) -> None:
    """Manifests and reports, a JSON object a line."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def response(result: Column, manifest: Column, error: Column) -> Column:
    """JSON of a request: {result, manifest}, or {error, manifest} if there is an error."""
    return F.when(error.isNull(), F.to_json(F.struct(result.alias("result"), manifest.alias("manifest")))).otherwise(F.to_json(F.struct(error.alias("error"), manifest.alias("manifest"))))


def result_name(path: Column) -> Column:
    """a/b.json as a/b_result.json (K9)."""
    return F.concat(F.regexp_replace(path, r"(?i)\.json$", ""), F.lit("_result.json"))


def bundled(files: DataFrame, by: str = "bundle") -> DataFrame:
    """bundle, zip: a zip archive of each bundle's files (bundle, rel_path, content), names in order (K7-K9). A bundle is one
    request's results, made in one task."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rel_path")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "zip": [zipped(zip(pdf["rel_path"], pdf["content"]))]})

    kind = files.schema[by].dataType.simpleString()
    return files.select(by, "rel_path", F.col("content").cast("binary").alias("content")).groupBy(by).applyInPandas(pack, f"{by} {kind}, zip binary")


def zipped(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A zip archive; the same files give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def comparison(delta: DataFrame) -> DataFrame:
    """file, line: a report of corrected metrics in words (K13); delta: operators.corpus.corrected_metrics."""
    of = lambda m: F.format_string(f"{m} %.4f -> %.4f (%+.4f)", f"{m}_before", f"{m}_after", f"{m}_delta")
    return delta.select("file", F.concat_ws("; ", F.concat(F.coalesce(F.col("file").cast("string"), F.lit("all")), F.lit(": ")), *map(of, ("precision", "recall", "f1"))).alias("line"))
