"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text's subwords are the byte n-grams (2 to 4 bytes, lower case, everything but letters read as one blank) of its UTF-8
form, hashed into BUCKETS rows of an embedding table; their average goes through a linear softmax. The model is trained
on the driver on a bounded sample of labelled rows: at most about DOCS_PER_LANG documents of each language, chosen by
a hash of doc_id among the training rows. A part of the sample is held back to fit the temperature of the softmax and the
score under which a prediction counts as rejected (all but REJECT of the right ones there score more).

For prediction the embeddings and the softmax collapse into one table (BUCKETS x languages), which is what executors
get: its size depends on the languages only.

Defined results: lang_pred is `und` with score 0 for a text that is null or has no letter, and for every text if no
labelled row is there to learn from; rows with a null doc_id are never held out; repeated rows are predicted one by one;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
DOCS_PER_LANG, EPOCHS, RATE, REJECT = 500, 5, 2.0, 0.005
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def subwords(text: str) -> np.ndarray | None:
    """Hashed n-grams of a text; None without letters."""
    if not LETTER.search(text):
        return None
    raw = np.frombuffer(f" {OTHER.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    out = []
    code = raw
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ raw[n - 1 :]
        if n in GRAMS:
            out.append((code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17))
    return np.concatenate(out)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, subwords, their shares) of about per_lang rows of each language at most."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: per_lang / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not share:
        return []
    kept = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)

    def features(cols):
        for d, lang, text in zip(cols["doc_id"], cols["lang"], cols["text"]):
            got = subwords(text)
            if got is not None:
                at, n = np.unique(got, return_counts=True)
                yield d, lang, at.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()

    sample = rows.filter(chance < kept).select("doc_id", "lang", "text")
    found = common.mapped(sample, "doc_id long, lang string, at binary, share binary", features).collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], bytes(r["at"])))
    return [(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in found]


class Model:
    """langs, table (BUCKETS x langs: embeddings times weights), bias, temperature, threshold."""

    def __init__(self, langs, table, bias, temperature, threshold):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def predict(self, text: str | None) -> tuple[str, float]:
        got = subwords(text) if text and self.langs else None
        if got is None:
            return "und", 0.0
        p = softmax((self.table[got].mean(0) + self.bias) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x.astype(np.float64) - x.max())
    return e / e.sum()


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    langs = sorted({lang for lang, _, _ in sample})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    back = order[: len(sample) // 5]
    learn = order[len(sample) // 5 :]
    table = rng.normal(0, 1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, total = 0, epochs * max(1, len(learn))
    for _ in range(epochs):
        for i in rng.permutation(learn):
            lang, at, share = sample[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ table[at]
            off = softmax(hidden @ weights + bias).astype(np.float32)
            off[langs.index(lang)] -= 1
            back_to = weights @ off
            weights -= rate * np.outer(hidden, off)
            bias -= rate * 0.1 * off
            table[at] -= rate * share[:, None] * back_to
    flat = table @ weights
    scores = [(langs.index(sample[i][0]), sample[i][2] @ flat[sample[i][1]] + bias) for i in back]
    temperature, threshold = 1.0, 0.0
    if scores:
        loss = lambda t: -sum(np.log(max(softmax(x / t)[y], 1e-12)) for y, x in scores)
        temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        right = [softmax(x / temperature).max() for y, x in scores if x.argmax() == y]
        threshold = float(np.quantile(right, REJECT)) if right else 0.0
    return Model(langs, flat, bias, temperature, threshold)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected (score under the calibrated threshold) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def rows(cols):
        model = sent.value
        for d, text in zip(cols["doc_id"], cols["text"]):
            lang, score = model.predict(text)
            yield d, lang, score, lang == "und" or score < model.threshold

    return common.mapped(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, rejected boolean", rows)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir)
    out = identified(docs, train(training_sample(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
