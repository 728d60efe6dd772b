"""The extractor as one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import alignment, citations, manifest
from citeloom.sources import archives, jats, sinks, tei


def run(spark: SparkSession, paths: str | list[str], out: str | None = None, kind: str = "tei", align: bool = False, aligner: Callable[[DataFrame], DataFrame] = alignment.aligned) -> tuple[DataFrame, DataFrame]:
    """Citation records of the articles (TEI or JATS files) below the paths, and a manifest row for each file.

    With out, the records' JSON goes to out/citations (with the aligned sections if align) and the manifest to out/manifest.
    """
    if kind not in ("tei", "jats"):
        raise ValueError(f"kind must be tei or jats, not {kind!r}")
    found = [archives.files(spark, p, ("xml",)) for p in ([paths] if isinstance(paths, str) else paths)]
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    articles = files.filter("status = 'wanted'").select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("xml"))
    errors = None
    if kind == "jats":
        rewritten = jats.converted(articles)
        articles, errors = rewritten.filter("error IS NULL").select("doc_id", "xml"), rewritten.filter("error IS NOT NULL").select("doc_id", "error")
    units, refs, bad = tei.shredded(articles)
    errors = bad if errors is None else errors.unionByName(bad)
    cites = citations.from_tei(units, refs)
    skipped = files.filter("status <> 'wanted'").select(F.col("path").alias("filename"), F.lit("error").alias("status"), F.lit("unsupported file type").alias("error"))
    done = files.filter("status = 'wanted'").select(F.col("path").alias("filename")).join(errors.withColumnRenamed("doc_id", "filename"), "filename", "left")
    listing = done.select("filename", F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"), "error").unionByName(skipped)
    if out is not None:
        texts = manifest.citation_json(cites)
        if align:
            sections = cites.filter("SECTION IS NOT NULL").groupBy("doc_id", F.col("SECTION").alias("section")).agg(F.min("cit_no").alias("section_no"))
            texts = sinks.aligned_json(cites, aligner(sections))
        texts.write.mode("overwrite").parquet(f"{out}/citations")
        sinks.write_json(listing, f"{out}/manifest")
    return cites, listing
