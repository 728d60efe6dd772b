"""Quality rules and the hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed one- and two-word features are counted: the raw corpus (every document) and the trusted
target (documents labelled good). Languages and sources have other shares of the labels than of the corpus, so a raw
document counts with the weight that gives its language and source together their share of the target: like is compared
with like, and what the target has nothing of is judged by features it shares with others only. A document's score is the mean over its features of log p_target - log p_raw; it is
kept if no base rule fails and the score reaches a fixed threshold, so equal texts always get equal verdicts. The counts
are sums by bucket with at most BUCKETS rows; the ratio table is that long, whatever the corpus, and goes into the
plan as a constant.

The ids of the trusted target are a bounded sample of the labels (the `target_docs` good ones with the smallest hash,
toxic ones left out), so that marking them needs no shuffle of texts. All other counts cover every document. There are
no more weights than target documents.

Defined results: a null text has no words, fails the base rules and scores 0; repeated doc_ids are judged one row at a
time (each counts as target if its id is in the sample); without labels or without target features all scores are 0, so
the base rules alone decide; an empty table gives no rows; other columns are ignored (names with __ before are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 16384
TARGET_DOCS = 20_000
OWN = BUCKETS
WEIGHT = 1 << 32
THRESHOLD = -0.06
SYMBOLS = "#*$%&|<>"


def base(docs: DataFrame) -> DataFrame:
    """docs with the base columns, each with __ before its name, and __words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", common.words_of("text"))
    chars = F.length(F.translate(text, common.BLANKS, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    blank = F.lit(common.BLANKS.replace("\n", ""))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.trim(x, blank) != ""))
    out = out.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": chars.cast("long"),
        "__n_symbols": symbols.cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__lines")
    # Windows of three words, each as one long: the leading bits of its hash, then its position in the bits that __n_words needs.
    out = out.withColumn("__low", F.expr("cast(pow(2, ceil(log2(__n_words + 1))) as bigint) - 1"))
    out = out.withColumn("__spots", F.expr("""
        CASE WHEN __n_words < 4 THEN cast(array() AS array<bigint>)
             ELSE sort_array(transform(sequence(0, cast(__n_words AS int) - 3),
                                       i -> (xxhash64(__words[i], __words[i + 1], __words[i + 2]) & ~__low) | i)) END"""))
    # A window occurs twice if its neighbour in this order has the same hash; then the starts, in text order.
    out = out.withColumn("__twice", F.expr("""
        sort_array(transform(filter(__spots, (x, j) ->
            (j > 0 AND (get(__spots, j - 1) & ~__low) = (x & ~__low)) OR coalesce((get(__spots, j + 1) & ~__low) = (x & ~__low), false)),
            x -> x & __low))""")).drop("__spots", "__low")
    covered = F.expr("""
        aggregate(__twice, named_struct('n', 0L, 'end', 0L),
                  (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.end), 'end', p + 3), a -> a.n)""")
    out = out.withColumn("__n_repeat_words", covered).drop("__twice")
    return out.withColumn("__base_failed", (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words")))


def features(words: str = "__words") -> Column:
    """Hash buckets of all words and all pairs of neighbours."""
    return F.expr(f"""
        concat(transform({words}, x -> cast(pmod(xxhash64(x), {BUCKETS}) AS int)),
               CASE WHEN size({words}) < 2 THEN cast(array() AS array<int>)
                    ELSE transform(sequence(0, size({words}) - 2), i -> cast(pmod(xxhash64({words}[i], {words}[i + 1]), {BUCKETS}) AS int)) END)""")


def target_ids(labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """At most target_docs ids that labels call good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return good.orderBy(F.xxhash64("__id"), "__id").limit(target_docs)


def ratios(docs: DataFrame, labels: DataFrame | None, target_docs: int = TARGET_DOCS) -> list[float]:
    """log p_target - log p_raw by bucket, add-one smoothed; all 0 without target features. Raw features are weighted by
    stratum, so that both sides have the same sum: a source of a language with OWN target features, or all others of that
    language (lang and source if docs has them; null is like an empty name)."""
    if labels is None:
        return [0.0] * BUCKETS
    key = lambda *names: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names if c in docs.columns], F.lit(0))
    marked = docs.select("doc_id", key("lang").alias("l"), key("lang", "source").alias("s"), common.words_of("text").alias("__words"))
    # target_docs bounds what is broadcast: one long each
    marked = marked.join(F.broadcast(target_ids(labels, target_docs).withColumn("__t", F.lit(1))), F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select("l", "s", F.coalesce("__t", F.lit(0)).alias("t"), "__words")
    n = F.greatest(2 * F.size("__words").cast("long") - 1, F.lit(0))
    sums = lambda raw, target: (F.sum(raw).alias("raw"), F.sum(target).alias("target"))
    shares = marked.groupBy("l", "s").agg(*sums(n, n * F.col("t"))).withColumn("own", F.when(F.col("target") >= OWN, F.col("s")))
    # no more rows with target features than target documents; whole numbers, so that sums don't depend on the order
    shares = shares.groupBy("l", "own").agg(*sums("raw", "target")).filter("target > 0")
    weights = common.written(shares.select("l", "own", F.round(F.col("target") / F.col("raw") * WEIGHT).cast("long").alias("w")), "weights")
    own = weights.filter("own IS NOT NULL").select(F.col("own").alias("s"), F.col("w").alias("ws"))
    rest = weights.filter("own IS NULL").select("l", F.col("w").alias("wl"))
    marked = marked.join(F.broadcast(own), "s", "left").join(F.broadcast(rest), "l", "left").withColumn("w", F.coalesce("ws", "wl")).filter("w IS NOT NULL")
    seen = marked.select("t", "w", F.explode(features()).alias("b"))
    counts = seen.groupBy("b").agg((F.sum("w") / WEIGHT).alias("raw"), F.sum("t").alias("target"))
    # both sums are the same, so the ratio of counts is that of probabilities
    rows = counts.select("b", F.log((F.col("target") + 1) / (F.col("raw") + 1)).alias("r")).collect()  # BUCKETS rows at most
    out = [0.0] * BUCKETS
    for b, r in rows:
        out[b] = r
    return out


def marked(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """docs with the base columns, llr (per feature) and kept, each with __ before its name."""
    numbers = ",".join(f"{x:.9g}" for x in ratios(docs, labels, target_docs))
    weights = F.split(F.lit(numbers), ",").cast("array<double>")  # folded to a constant
    out = base(docs).withColumn("__features", features()).withColumn("__weights", weights)
    total = F.expr("aggregate(__features, 0D, (a, b) -> a + __weights[b])")
    out = out.withColumn("__llr", F.when(F.size("__features") > 0, F.round(total / F.size("__features"), 9)).otherwise(0.0))
    # always true, but not deterministic to the optimizer: a later filter on kept stays above instead of repeating all of this
    above = F.spark_partition_id() >= 0
    out = out.withColumn("__kept", ~F.col("__base_failed") & (F.col("__llr") >= threshold) & above)
    return out.drop("__features", "__weights", "__words")


def judged(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """docs with the base columns, llr and kept, in place of columns of docs that have these names."""
    rest = [c for c in docs.columns if c not in ADDED]
    return marked(docs, labels, threshold, target_docs).select(*rest, *[F.col(f"__{c}").alias(c) for c in ADDED])


def kept_rows(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """The kept rows of docs as they are."""
    return marked(docs, labels, threshold, target_docs).filter("__kept").select(*docs.columns)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels")


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return judged(docs, labels_of(spark, sf_dir)).select("doc_id", *ADDED)
