"""What a corpus and its runs are kept in order with: file pairing, page cuts, payloads, counters, corrected metrics."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_pdfs(paths: Iterable[str]) -> list[str]:
    """The paths in order; ValueError if there are none or one isn't a PDF by its name, whatever its case."""
    out = sorted(paths)
    wrong = [p for p in out if not p.lower().endswith(".pdf")]
    if wrong or not out:
        raise ValueError(f"not a PDF: {wrong[0]}" if wrong else "no file")
    return out


def inline_pairs(spark: SparkSession, payload: str | list) -> DataFrame:
    """pos, SECTION, CITATION of a list of pairs, or of its literal as text."""
    pairs = ast.literal_eval(payload) if isinstance(payload, str) else payload
    if not isinstance(pairs, (list, tuple)) or any(not isinstance(p, (list, tuple)) or len(p) != 2 for p in pairs):
        raise ValueError("a list of [section, citation] pairs is expected")
    return spark.createDataFrame([(i, *map(str, p)) for i, p in enumerate(pairs)], "pos long, SECTION string, CITATION string")


def strict(entries: DataFrame, error: str = "error") -> DataFrame:
    """entries, failing at the first that has an error."""
    return entries.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("invalid entry: "), F.col(error)))).otherwise(F.col(error))).filter(F.col(error).isNull())


def review_cut(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no from 0, text) before the first one but page 0 that says "open peer review" (F10)."""
    says = F.contains(F.lower("text"), F.lit("open peer review")) & (F.col("page_no") > 0)
    cut = pages.groupBy("doc_id").agg(F.min(F.when(says, F.col("page_no"))).alias("__cut"))
    return pages.join(cut, "doc_id").filter("__cut IS NULL OR page_no < __cut").drop("__cut")


def pages_kept(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages in the order of their ranges (doc_id, pos, pages as "a-b" inclusive or "a", from 0), with place."""
    ends = F.split("pages", "-")
    number = F.explode(F.sequence(F.trim(ends[0]).cast("long"), F.trim(F.element_at(ends, -1)).cast("long")))
    wanted = ranges.select("doc_id", "pos", number.alias("page_no"))
    return pages.join(wanted, ["doc_id", "page_no"]).withColumnRenamed("pos", "place")


def pending(inputs: DataFrame, done: DataFrame, key: str = "name", force: bool = False) -> DataFrame:
    """Inputs without an output yet; all of them if forced."""
    return inputs if force else inputs.join(done.select(key).distinct(), key, "left_anti")


def paired(left: DataFrame, right: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Both sides by key, and the left ones that have no partner."""
    return left.join(right, key), left.join(right.select(key).distinct(), key, "left_anti")


def restricted(truth: DataFrame, pred: DataFrame, key: str = "file") -> DataFrame:
    """Truths of files that have predictions."""
    return truth.join(pred.select(key).distinct(), key, "left_semi")


def stem(path: str):
    """A file's name without folder and last extension, as key."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")


def with_results(originals: DataFrame, results: DataFrame, key: str = "cit_id") -> DataFrame:
    """Results beside their originals; every result must have one."""
    out = results.join(originals.withColumn("__there", F.lit(True)), key, "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no original of "), F.col(key).cast("string")))).otherwise(True)
    return out.withColumn("__there", there).filter("__there").drop("__there")


def run_counts(steps: DataFrame) -> DataFrame:
    """status, n of a run's steps."""
    return steps.groupBy("status").agg(F.count("*").alias("n"))


def corrected_metrics(metrics: DataFrame, corrected: DataFrame) -> DataFrame:
    """metrics (file, matches, total_pred, total_gt) with what page correction adds (file, pred_id, gt_id): unrounded precision,
    recall and F1 before and after, and their differences, by file and, with file null, in all (A3, A4)."""
    more = corrected.groupBy("file").agg(F.countDistinct("pred_id").alias("added"))
    rows = metrics.filter("file IS NOT NULL").select("file", "matches", "total_pred", "total_gt").join(more, "file", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    sums = rows.rollup("file").agg(*[F.sum(c).alias(c) for c in ("matches", "total_pred", "total_gt", "added")])
    out = sums
    for name, hits in (("before", F.col("matches")), ("after", F.col("matches") + F.col("added"))):
        p = F.when(F.col("total_pred") > 0, hits / F.col("total_pred")).otherwise(0.0)
        r = F.when(F.col("total_gt") > 0, hits / F.col("total_gt")).otherwise(0.0)
        out = out.withColumns({f"precision_{name}": p, f"recall_{name}": r, f"f1_{name}": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)})
    return out.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in ("precision", "recall", "f1")})


def abbreviated(text, names: tuple[str, ...] | list[str]):
    """Whether a text's last word is one of the names."""
    return F.coalesce(F.element_at(F.split(F.trim(text), " "), -1).isin(*names), F.lit(False))
