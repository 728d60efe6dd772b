"""Classifier: entry validation, ids, contexts, scores, meta-classifier, labels, result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed


def entry_error(entry: Column) -> Column:
    """null for a valid entry (a JSON object with SECTION and CITATION), else which rule it breaks."""
    fields = F.from_json(entry, "map<string,string>")
    return (
        F.when(entry.isNull() | ~F.ltrim(entry).startswith("{") | fields.isNull(), "not an object")
        .when(F.size(F.map_keys(fields)) < 2, "missing keys")
        .when(~F.map_contains_key(fields, "SECTION") | ~F.map_contains_key(fields, "CITATION"), "missing SECTION or CITATION")
        .when(F.coalesce(F.element_at(fields, "CITATION"), F.lit("")) == "", "empty CITATION")
    )


def validated(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, cit_id, SECTION, CITATION, extras) of valid entries, and the manifest rows of the others."""
    marked = entries.withColumn("error", entry_error(F.col("entry")))
    fields = F.from_json("entry", "map<string,string>")
    good = marked.filter("error IS NULL").select("file", "cit_id", F.element_at(fields, "SECTION").alias("SECTION"), F.element_at(fields, "CITATION").alias("CITATION"), F.map_filter(fields, lambda k, v: ~k.isin("SECTION", "CITATION")).alias("extras"))
    bad = marked.filter("error IS NOT NULL").select("file", F.lit("Data Loading").alias("phase"), "cit_id", F.lit("error").alias("status"), F.col("error").alias("detail"))
    return good, bad


def with_ids(pairs: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Empty citations go, then ids 0.. in order."""
    kept = pairs.filter(F.coalesce("CITATION", F.lit("")) != "")
    return kept.withColumn("cit_id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


#: words that speak for a label in the default scorer, which needs no model weights
CUES = {"met": "method|approach|use|using|algorithm|procedure", "bkg": "background|previous|known|review|history|study", "res": "result|show|found|conclude|evidence|confirm"}


def cue_scores(context: Column) -> Column:
    """Six scores, two families by three labels: logistic in the number of cue words (the stand-in for L1, L2)."""
    low = F.lower(context)
    counts = [F.regexp_count(low, F.lit(cues)).cast("double") for cues in CUES.values()]
    return F.array(*[1.0 / (1.0 + F.exp(F.lit(2.0) - slope * c)) for slope in (2.0, 1.5) for c in counts])


def confidences(scores: Column) -> Column:
    """Three confidences that sum to 1 (method, background, result): the families' mean, to the fourth power, normalised."""
    raised = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.pow((F.get(scores, i) + F.get(scores, i + 3)) / 2, F.lit(4.0)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def label(probabilities: Column, threshold: float = fixed.CONFIDENCE) -> Column:
    """The label of the first greatest probability, if that reaches the threshold."""
    names = F.array(*[F.lit(x) for x in fixed.LABELS])
    best = F.array_max(probabilities)
    return F.when(best >= threshold, F.element_at(names, F.array_position(probabilities, best).cast("int"))).otherwise(fixed.UNRELIABLE)


def result_rows(rows: DataFrame) -> DataFrame:
    """rows (SECTION, CITATION, scores, probabilities, extras) in the fixed twelve columns, extras kept."""
    values = [F.col("SECTION"), F.col("CITATION"), *[F.col("scores")[i] for i in range(6)], *[F.col("probabilities")[i] for i in range(3)], label(F.col("probabilities"))]
    rest = [c for c in rows.columns if c not in ("SECTION", "CITATION", "scores", "probabilities")]
    return rows.select(*rest, *[v.alias(n) for v, n in zip(values, fixed.RESULT_COLUMNS)])


class MetaClassifier:
    """6-128-64-32-3 dense network: SELU, GELU, batch norm with stored moments, softmax (L3). weights: name -> array (L4)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k.removeprefix("module."): np.asarray(v, float) for k, v in weights.items()}

    @classmethod
    def load(cls, path: str) -> MetaClassifier:
        with np.load(path) as f:
            return cls(dict(f))

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        x = scores
        for i, act in enumerate((selu, gelu, gelu), 1):
            x = act(x @ self.w[f"fc{i}.weight"].T + self.w[f"fc{i}.bias"])
            if f"bn{i}.weight" in self.w:
                x = (x - self.w[f"bn{i}.running_mean"]) / np.sqrt(self.w[f"bn{i}.running_var"] + 1e-5) * self.w[f"bn{i}.weight"] + self.w[f"bn{i}.bias"]
        x = x @ self.w["fc4.weight"].T + self.w["fc4.bias"]
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def selu(x: np.ndarray) -> np.ndarray:
    return 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0)))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + np.vectorize(math.erf)(x / math.sqrt(2))) / 2


def meta_probabilities(model: MetaClassifier):
    @F.pandas_udf("array<double>")
    def run(scores: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.stack(scores.to_numpy())))) if len(scores) else scores

    return run
