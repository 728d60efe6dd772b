"""Link lists, file names from URLs, versions, ranges: what a corpus is collected with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos (of the first time), href of each distinct link of a page."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.groupBy("page_id", "href").agg(F.min("pos").cast("long").alias("pos"))


def file_name(url: Column) -> Column:
    """The path of a URL with _ for / and .xml after it."""
    return F.concat(F.translate(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"^/+|/+$", ""), "/", "_"), F.lit(".xml"))


def latest_versions(files: DataFrame, path: str = "path") -> DataFrame:
    """base, path, version of the latest <base>_v<N>_xml.xml."""
    pattern = r"^(.*)_v(\d+)_xml\.xml$"
    found = files.filter(F.col(path).rlike(pattern)).select(F.regexp_extract(path, pattern, 1).alias("base"), F.regexp_extract(path, pattern, 2).cast("long").alias("version"), F.col(path).alias("path"))
    return found.groupBy("base").agg(F.max_by("path", "version").alias("path"), F.max("version").alias("version"))


def between(start: Column, end: Column) -> Column:
    """The numbers that a reference range leaves out: [1]-[4] gives 2 and 3."""
    return F.when(end - start > 1, F.sequence(start + 1, end - 1)).otherwise(F.array().cast("array<bigint>"))
