"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once; the leading bits of the hash choose one of BINS bins, which keeps its least
hash. An empty bin is filled from the first non-empty bin of a fixed sequence of pseudo-random bins of its own, the same
for all documents (optimal densification), so equal sets give equal bins. Of each bin the low BITS bits are stored. Two
unrelated bins agree in them with chance 2^-BITS, so likeness = (share of equal bins - 2^-BITS) / (1 - 2^-BITS), at
least 0.

near_duplicates of neighbours: documents are dealt out in ranges of doc_id and streamed in order, each beside the next;
the first rows of a range are also sent to the end of the one before, and the first of all to the end of the last.

Defined results: a text of one to four words has one shingle, the whole sequence; a null or wordless text has an empty
fingerprint, of likeness 1 to another empty one and 0 to others; null doc_ids come first, rows of equal doc_id in the
order of their texts' hashes; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, BINS, BITS, TRIES = 5, 512, 4, 4096
RANGE_BYTES, MOST_RANGES = 4 << 20, 20_000
MEMO = 300_000
#: Odd multipliers, one for each word of a shingle.
FACTORS = np.array([xxhash.xxh64_intdigest(b"word", i) | 1 for i in range(SHINGLE)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > MEMO:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[str], size: int = SHINGLE, factors: np.ndarray = FACTORS) -> np.ndarray:
    """64-bit hashes of all runs of `size` words; of the whole sequence if it is shorter; none of no words."""
    w, n = word_hashes(words), len(words)
    k = min(n, size)
    if not n:
        return np.zeros(0, np.uint64)
    total = w[: n - k + 1] * factors[0] + np.uint64(k)
    for i in range(1, k):
        total += w[i : n - k + 1 + i] * factors[i]
    return mixed(total)


@functools.cache
def _borrow() -> list[np.ndarray]:
    """Row i, column j: the bin that bin i looks at in its j-th try; the columns in batches that grow."""
    i = np.arange(BINS, dtype=np.uint64)[:, None]
    j = np.arange(TRIES, dtype=np.uint64)
    tries = (mixed(mixed(i + np.uint64(1)) + j * np.uint64(0xA0761D6478BD642F)) % np.uint64(BINS)).astype(np.int16)
    ends = [0, 4, 16, 64, 256, 1024, TRIES]
    return [np.ascontiguousarray(tries[:, a:b]) for a, b in zip(ends, ends[1:])]


def bins(words: list[str]) -> np.ndarray | None:
    """The low bits of all bins, or None of no words."""
    hashes = np.sort(shingle_hashes(words))
    if not len(hashes):
        return None
    shift = np.uint64(64 - BINS.bit_length() + 1)
    which = (hashes >> shift).astype(np.int64)
    first = np.ones(len(which), bool)
    first[1:] = which[1:] != which[:-1]
    full = np.zeros(BINS, bool)
    full[which[first]] = True
    least = np.zeros(BINS, np.uint64)
    least[which[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    for tries in _borrow():
        if not len(empty):
            break
        look = tries[empty]
        hit = full[look]
        row = hit.argmax(1)
        at = np.arange(len(empty))
        found = hit[at, row]
        least[empty[found]] = least[look[at, row][found]]
        empty = empty[~found]
    if len(empty):  # no try met a full bin: take the next full one, around the end
        at = np.flatnonzero(full)
        least[empty] = least[at[np.searchsorted(at, empty) % len(at)]]
    # bits of hash and bin together: bins that borrowed one hash agree by chance independently of each other
    return (mixed(least + np.arange(BINS, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None) -> str:
    if values is None:
        return ""
    return (values[0::2] | values[1::2] << 4).astype(np.uint8).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    both = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([both & 15, both >> 4], 1).reshape(-1)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The estimated share of common shingles, corrected for bins that agree by chance."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def rows(cols):
        for d, text in zip(cols["doc_id"], cols["text"]):
            yield d, packed(bins(common.WORDS.findall(text or "")))

    return common.mapped(docs.select("doc_id", "text"), "doc_id long, fingerprint string", rows)


def beside_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (span, extra, doc_id, text), partitioned by span and sorted; in each span the rows follow each other, and
    after the last one stands, with extra > 0, what follows it in the next span."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = min(common.pieces(common.total_bytes(docs), range_bytes), MOST_RANGES)  # a range is streamed, whatever its size
    found = docs.agg(F.min("k"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()
    least, splits = found[0], np.array(sorted({x for x in (found[1] or []) if n > 1 and x > found[0]}), np.int64)
    last = len(splits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            span = np.searchsorted(splits, k, "right")
            parts = [(np.arange(len(k)), span, 0)]
            if last:  # the rows at a split begin its span: copies go to the end of the one before
                at = np.flatnonzero(np.isin(k, splits))
                parts.append((at, span[at] - 1, 1))
            at = np.flatnonzero(k == least)
            parts.append((at, np.full(len(at), last), 2))
            for rows, to, extra in parts:
                if len(rows):
                    got = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(rows), extra), pa.int32()), got.column("doc_id"), got.column("k"), got.column("text")], names=["span", "extra", "doc_id", "k", "text"])

    dealt = docs.mapInArrow(deal, "span int, extra int, doc_id long, k long, text string").withColumn("tie", F.xxhash64("text"))
    return dealt.repartitionById(n, "span").sortWithinPartitions("span", "extra", "k", "tie").select("span", "extra", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text, of the text whose second half gives way to the next one's beginning, and their likeness."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def row(doc_id, text, own, after, beside):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = bins(common.WORDS.findall(edited))
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(other), likeness(own, other), likeness(own, beside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: span, doc_id, text, bins
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                cols = whole.slice(at, 256).to_pydict()
                got = []
                for span, extra, doc_id, text in zip(cols["span"], cols["extra"], cols["doc_id"], cols["text"]):
                    if held and held[0] != span:
                        held = None
                    if extra and not held:
                        continue
                    own = bins(common.WORDS.findall(text))
                    if held:
                        got.append(row(*held[1:], text, own))
                    held = None if extra else (span, doc_id, text, own)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), out.types)], schema=out)

    return beside_next(docs, range_bytes).mapInArrow(run, SCHEMA)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(common.table(spark, sf_dir))
