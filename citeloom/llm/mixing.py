"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every row has a 60-bit hash of its doc_id. A source with target t and size s gives each row floor(t / s) times,
and once more if its hash lies below the source's cut. The cut comes from histograms: sizes summed by source and the
leading 12 bits find the bucket in which the budget runs out; only that bucket is split by its next 12 bits, and so
on. Nothing is sorted but histograms of at most 4096 buckets a source, and a source with a third of all rows costs no
more than any other, since sums are formed before the shuffle.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows with equal doc_id
(null too) share a hash and so are taken together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, LEVELS = 12, 5


def row_hash(doc_id: str = "doc_id") -> Column:
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash().alias("h"))


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, ... share all sizes; no target above cap times its source's size.

    The excess goes to the others by weight until none is above, so target = min(cap * size, level * weight): sources
    are ordered by cap * size / weight and the level is found at the first that isn't cut off.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / weight_left)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.least(cap * F.col("source_size"), F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", F.coalesce(target, cap * F.col("source_size")).cast("double").alias("target"))


def cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with copies (whole passes) and cut: rows with a hash below it are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    written = state = common.written(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-state")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        near = sizes.select(F.col("source").alias("s"), "size", F.shiftright("h", shift).alias("bucket"))
        if level:
            at = state.select(F.col("source").alias("a"), "prefix")
            near = near.join(at, F.col("s").eqNullSafe(F.col("a")) & (F.shiftright("bucket", BITS) == F.col("prefix"))).drop("a", "prefix")
        bars = near.groupBy("s", "bucket").agg(F.sum("size").alias("size"))
        up_to = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        bars = bars.withColumn("up_to", up_to).join(state.select(F.col("source").alias("a"), "rest", "below"), F.col("s").eqNullSafe(F.col("a")))
        end = F.col("below") + F.col("up_to") >= F.col("rest")
        # the first bucket at whose end the rest is reached; every source has one, as its rest is under its size
        found = bars.filter(end).groupBy("s").agg(F.min_by(F.struct("bucket", "size", (F.col("below") + F.col("up_to") - F.col("size")).alias("start")), "bucket").alias("f"))
        state = state.drop("prefix", "below").join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        state = state.select("source", "source_size", "target", "copies", "rest", F.col("f.bucket").alias("prefix"), F.coalesce("f.start", F.lit(0)).alias("below"), F.col("f.size").alias("last"))
        before, state = written, common.written(state, "mix-state")  # a row a source; read more than once by the next level
        written = state
        common.dropped(before)
    nearer = F.col("below") + F.col("last") - F.col("rest") < F.col("rest") - F.col("below")
    cut = F.when(F.col("rest") <= 0, 0).otherwise(F.coalesce(F.col("prefix") + F.when(nearer, 1).otherwise(0), F.lit(0)))
    return state.select("source", "source_size", "target", "copies", cut.cast("long").alias("cut"))


def mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    sizes = common.written(sized(docs), "mix-sizes")
    plan = cuts(sizes, source_targets(sizes, cap)).withColumnRenamed("source", "plan_source")
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    copies = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with the columns of docs."""
    sizes = common.written(sized(docs), "mix-sizes")
    plan = cuts(sizes, source_targets(sizes, cap)).select(F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("cut").alias("__cut"))
    common.dropped(sizes)
    rows = docs.withColumn("__h", row_hash()).join(plan, docs["source"].eqNullSafe(F.col("__source")))
    times = (F.col("__copies") + (F.col("__h") < F.col("__cut")).cast("long")).cast("int")
    rows = rows.withColumn("__n", times).filter("__n > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir)).select("doc_id", "size", "source_size", F.col("target"), "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * weight), 3.0::DOUBLE * source_size)::DOUBLE AS target
  FROM l),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
u AS (SELECT g.source, g.h, g.size, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS up_to, target - copies * source_size AS rest
      FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source),
b AS (SELECT source, min(h) AS h, arg_min(up_to, h) AS up_to, arg_min(size, h) AS size, any_value(rest) AS rest FROM u WHERE up_to >= rest GROUP BY source),
k AS (SELECT source, CASE WHEN rest <= 0 THEN 0 WHEN up_to - rest < rest - (up_to - size) THEN h + 1 ELSE h END AS cut FROM b)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.copies + CASE WHEN d.h < coalesce(k.cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
