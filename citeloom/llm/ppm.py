"""Language-model scoring by prediction by partial matching over bytes.

The model is the byte-context trie of depth ORDER over all training texts with a count at every node. A symbol's
probability starts at the longest context; a context that was never seen is skipped; one that was, but without the symbol,
gives an escape (method C: distinct / (total + distinct)), and symbols seen there are excluded from all shorter contexts. At
the end stands a uniform choice of the bytes that no context has. A text is coded with START bytes before and an END
byte after it (0xFE and 0xFF, which UTF-8 never has), so a document's log10 probability is its (pretrained) code length.

With all counts kept, the symbols of a context also follow each of its suffixes. So exclusion needs only three numbers
of a context: its total, its distinct symbols, and the count of those symbols in the next shorter context.

Scale: the trie grows with the corpus and is never in one place. Documents are read as blocks of about BLOCK bytes; a
block asks for each of its distinct strings (context and symbol) and words once. Requests are dealt into BUCKETS by the last
three bytes of the context, so that every bucket has all orders from 3 up by itself; orders below 3 have at most 2^24
nodes, a proven bound, and go to all tasks. Counts are merged by (bucket, salt) of at most SALT blocks, then by bucket; answers
are computed by (bucket, salt) too and go back to their block. A request or answer holds packed arrays, not rows.

Defined results: a null or empty text is the end token alone; repeated rows are scored (and counted) one by one; a null
doc_id is never held out; with no training text every byte costs log10(256); a text of any length is whole in one block; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fingerprint import mixed
from .language_id import held_out

ORDER, LOW = 5, 2
START, END = b"\xfe", b"\xff"
BLOCK, BUCKETS, SALT = 8 << 20, 256, 512
BYTE = np.uint64(8)


def mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


def squeeze(x: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def expand(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def ascending(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8"), dtype=np.uint64)


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every byte and end of the texts as one number each; how many each text has."""
    raw = np.frombuffer(b"".join(START * ORDER + t + END for t in texts), np.uint8).astype(np.uint64)
    n = np.array([len(t) + 1 for t in texts])
    code = raw[: len(raw) - ORDER].copy()
    for i in range(1, ORDER + 1):
        code <<= BYTE
        code |= raw[i : len(raw) - ORDER + i]
    starts = np.cumsum(n + ORDER) - n - ORDER
    keep = np.zeros(len(raw) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + n, -1)
    return code[np.cumsum(keep)[: len(code)].astype(bool)], n


def bucket_of(codes: np.ndarray) -> np.ndarray:
    return (mixed((codes >> BYTE) & np.uint64(0xFFFFFF)) % np.uint64(BUCKETS)).astype(np.int64)


def word_bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def words_by_bucket(words) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(BUCKETS)]
    for w in sorted(words):
        out[word_bucket(w)].append(w)
    return out


def tokens_of(text: str) -> list[str]:
    """Words in lower case, then the end token (empty, which no word is)."""
    return [*common.WORDS.findall(common.lowered(text)), ""]


REQUESTS = "block long, bucket int, codes binary, counts binary, words binary, word_counts binary, doc_ids array<long>, held array<boolean>, lengths array<long>, payload binary"


def requests(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """A row (bucket -1) with the texts of each block, and its requests and training counts by bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(REQUESTS))

    def block_rows(block: int, held: list[tuple]) -> pa.RecordBatch:
        texts = [t.encode() for _, _, t in held]
        codes, n = strings(texts)
        train = np.repeat(np.array([not h for _, h, _ in held], np.uint64), n)
        keys, times = np.unique(codes << np.uint64(1) | train, return_counts=True)
        plain = keys >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
        counts = np.add.reduceat(times * (keys & np.uint64(1)).astype(np.int64), first).astype("<u4")
        codes = plain[first]
        known: Counter[str] = Counter()
        seen: set[str] = set()
        for _, h, t in held:
            got = tokens_of(t)
            seen.update(got)
            if not h:
                known.update(got)
        where = bucket_of(codes)
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(BUCKETS + 1))
        cols: list[list] = [[block], [-1], [None], [None], [None], [None], [[d for d, _, _ in held]], [[h for _, h, _ in held]], [[len(t) for t in texts]], [zstandard.compress(b"".join(texts), 1)]]
        for b, words in enumerate(words_by_bucket(seen)):
            at = order[ends[b] : ends[b + 1]]
            if len(at) or words:
                row = (block, b, ascending(codes[at]), squeeze(counts[at]), zstandard.compress("\n".join(words).encode(), 1) if words else None, squeeze(np.array([known[w] for w in words], "<u4")), None, None, None, None)
                for c, v in zip(cols, row):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                cols = whole.slice(at, 256).to_pydict()
                for row in zip(cols["doc_id"], cols["held"], cols["text"]):
                    held.append(row)
                    size += len(row[2]) + ORDER
                    if size >= block_bytes:
                        yield block_rows(block, held)
                        block, held, size = block + 1, [], 0
        if held:
            yield block_rows(block, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 7, 2).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, REQUESTS)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts."""
    if not len(codes):
        return codes.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts.astype(np.int64), first)


def split_words(data: bytes | None) -> list[str]:
    return [] if data is None else zstandard.decompress(data).decode().split("\n")


COUNTS = "bucket int, codes binary, counts binary, words binary, word_counts binary"


def merge_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of training counts of all rows of a bucket."""
    codes = [from_ascending(x) for x in pdf["codes"]]
    counts = [expand(x, f"<u{w}") for x, w in zip(pdf["counts"], pdf["width"])]
    total, times = summed(np.concatenate(codes), np.concatenate(counts))
    total, times = total[times > 0], times[times > 0]
    words: Counter[str] = Counter()
    for data, n, w in zip(pdf["words"], pdf["word_counts"], pdf["width"]):
        words.update(dict(zip(split_words(data), expand(n, f"<u{w}").tolist())))
    names = sorted(w for w, n in words.items() if n)
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "codes": [ascending(total)], "counts": [squeeze(times.astype("<u8"))], "words": [zstandard.compress("\n".join(names).encode(), 1) if names else None], "word_counts": [squeeze(np.array([words[w] for w in names], "<u8"))]})


class Level:
    """All nodes of one order: codes with counts, and of each context its total, distinct and covered count below."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, below: Level | None):
        self.codes, self.counts = codes, counts
        contexts = codes >> BYTE
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(codes) else np.zeros(0, int)
        self.contexts = contexts[first]
        self.total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        self.distinct = np.diff(np.r_[first, len(codes)])
        self.covered = None
        if below is not None:
            under = below.count(codes)
            self.covered = np.add.reduceat(under, first) if len(first) else under[:0]

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the nodes at the end of these (longer) codes."""
        return found(self.codes, self.counts, codes & mask(self.order))

    order = 0


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def levels(codes: np.ndarray, counts: np.ndarray, low_codes: np.ndarray, low_counts: np.ndarray) -> list[Level]:
    """Orders 0 to ORDER; those up to LOW from the low nodes, the others from the full ones."""
    out: list[Level] = []
    for order in range(ORDER + 1):
        c, n = (low_codes, low_counts) if order <= LOW else (codes, counts)
        kind = type(f"Level{order}", (Level,), {"order": order})
        out.append(kind(*summed(c & mask(order), n), out[-1] if out else None))
    return out


def log_probabilities(wanted: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of each code's symbol after its context."""
    out = np.zeros(len(wanted))
    still = np.ones(len(wanted), bool)
    gone_n, gone_d = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for level in reversed(trie):
        context = (wanted & mask(level.order)) >> BYTE
        if not len(level.contexts):
            continue
        at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
        seen = still & (level.contexts[at] == context)
        total, distinct = level.total[at] - gone_n, level.distinct[at] - gone_d
        own = level.count(wanted)
        hit = seen & (own > 0)
        out[hit] += np.log10(own[hit] / (total[hit] + distinct[hit]))
        escape = seen & (own == 0) & (distinct > 0)
        out[escape] += np.log10(distinct[escape] / (total[escape] + distinct[escape]))
        still &= ~hit
        if level.covered is not None:
            gone_n = np.where(seen, level.covered[at], 0)
        gone_d = np.where(seen, level.distinct[at], 0)
    out[still] -= np.log10(256 - gone_d[still])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    asked = common.written(requests(docs, block_bytes), "ppm-requests")
    blocks = asked.filter("bucket = -1").select("block", "doc_ids", "held", "lengths", "payload")
    salts = common.pieces(blocks.count(), SALT)
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    parts = asked.filter("bucket >= 0").select("block", "bucket", salt, "codes", "counts", "words", "word_counts")
    first = parts.drop("block").withColumn("width", F.lit(4)).groupBy("bucket", "salt").applyInPandas(merge_counts, COUNTS)
    model = common.written(first.withColumn("width", F.lit(8)).groupBy("bucket").applyInPandas(merge_counts, COUNTS), "ppm-model")

    def low(cols):
        for codes, counts, words, n in zip(cols["codes"], cols["counts"], cols["words"], cols["word_counts"]):
            for c, k in zip(*summed(from_ascending(codes) & mask(LOW), expand(counts, "<u8"))):
                yield int(c), int(k)
            yield -1, len(split_words(words))
            yield -2, int(expand(n, "<u8").sum())

    nodes = common.mapped(model.drop("bucket"), "code long, n long", low, 1).groupBy("code").agg(F.sum("n").alias("n")).collect()  # 2^24 nodes at most, and two sums
    sums = {r["code"]: r["n"] for r in nodes}
    distinct, train = sums.pop(-1, 0), sums.pop(-2, 0)
    low_codes = np.array(sorted(sums), np.uint64)
    sent = spark.sparkContext.broadcast((low_codes, np.array([sums[int(c)] for c in low_codes], np.int64)))

    def answer(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"block": [], "bucket": [], "values": [], "known": []})
        codes, counts, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for c, n, w, k in zip(counted["codes"], counted["counts"], counted["words"], counted["word_counts"]):
            codes, counts = from_ascending(c), expand(n, "<u8").astype(np.int64)
            names = dict(zip(split_words(w), expand(k, "<u8").tolist()))
        each = [from_ascending(x) for x in asked["codes"]]
        wanted = np.unique(np.concatenate(each))
        values = log_probabilities(wanted, levels(codes, counts, *sent.value))
        return pd.DataFrame({
            "block": asked["block"], "bucket": asked["bucket"],
            "values": [values[np.searchsorted(wanted, x)].astype("<f4").tobytes() for x in each],
            "known": [squeeze(np.array([names.get(x, 0) for x in split_words(w)], "<u8")) for w in asked["words"]],
        })

    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = parts.select("block", "bucket", "salt", "codes", "words").groupBy("bucket", "salt").cogroup(spread.groupBy("bucket", "salt")).applyInPandas(answer, "block long, bucket int, values binary, known binary")
    scale = math.log10(train + distinct + 1)

    def finish(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        data, texts, at = zstandard.decompress(row["payload"]), [], 0
        for n in row["lengths"]:
            texts.append(data[at : at + n])
            at += n
        answers = answers.sort_values("bucket")
        codes, n = strings(texts)
        distinct_codes, back = np.unique(codes, return_inverse=True)
        values = np.empty(len(distinct_codes))
        values[np.argsort(bucket_of(distinct_codes), kind="stable")] = np.frombuffer(b"".join(answers["values"]), "<f4")
        scores = np.add.reduceat(values[back], np.cumsum(n) - n)
        tokens = [tokens_of(t.decode()) for t in texts]
        by_bucket = words_by_bucket({w for t in tokens for w in t})
        counts: dict[str, int] = {}
        for b, known in zip(answers["bucket"], answers["known"]):
            counts.update(zip(by_bucket[b], expand(known, "<u8").tolist()))
        logs = {w: math.log10(c + 1) for w, c in counts.items()}
        each = [np.fromiter(map(logs.__getitem__, t), np.float64, len(t)) for t in tokens]
        return pd.DataFrame({
            "doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held"]),
            "n_tokens": [len(t) for t in tokens], "n_known": [np.count_nonzero(x) for x in each], "train_tokens": train,
            "base_score": [x.sum() - len(x) * scale for x in each], "score": scores,
        })

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, SCORES)


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir))
