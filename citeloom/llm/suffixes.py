"""Removal of byte strings of a threshold length that occur elsewhere, by most-significant-digit passes over suffixes.

A window is a string of THRESHOLD bytes inside one document, that is a suffix cut at the threshold depth. Ordering all
of them would move every byte many times, so the passes compare ever longer leading pieces and only groups that are
still equal go on; groups that are equal through the threshold depth are exactly the repeated windows.

Pass 1 takes the suffixes that winnowing picks: of any WINDOW = THRESHOLD - PIECE + 1 neighbouring pieces of PIECE bytes the
one with the least hash is an anchor, so equal windows have equal anchors at equal places. Anchors whose piece occurs once
drop out, with all windows that have them. Pass 2 compares the whole stretch of windows that an anchor stands for: where
it occurs again as a whole, all of its windows are repeated. Pass 3 compares, for anchors that occur with different
stretches, window by window through the threshold depth; of equal stretches one stands for all. Digits are compared by
hashes: 64 bits of the piece, and 64 more of the stretch or window.

Groups are counted before the shuffle and joined back as one row against many, so a piece in a third of all documents
makes no large task. Tables between passes are written to the shared folder.

Defined results: a null text is empty, and a text shorter than the threshold is kept; overlapping matches count; repeated rows
match each other; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fingerprint import mixed

THRESHOLD, PIECE = 200, 100
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
CODES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]


@functools.lru_cache(4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, i < n."""
    up = np.full(n, BASES[which], np.uint64)
    down = np.full(n, pow(BASES[which], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any stretch of a byte string in constant time."""

    def __init__(self, raw: np.ndarray):
        n = 1 << max(12, len(raw).bit_length())
        self.sums, self.down = [], []
        for which in range(2):
            up, down = _powers(which, n)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(CODES[which][raw] * up[: len(raw)], out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def hashes(self, which: int, start, end) -> np.ndarray:
        return mixed((self.sums[which][end] - self.sums[which][start]) * self.down[which][start])


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    got, have = keys, 1
    while have * 2 <= width:
        got = np.minimum(got[:-have], got[have:])
        have *= 2
    rest = width - have
    return np.minimum(got[:-rest], got[rest:]) if rest else got


def anchors(raw: np.ndarray, rolling: Rolling, threshold: int = THRESHOLD, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of each anchor: its place, and the first and last start of the windows that it stands for."""
    n = len(raw)
    at = np.arange(n - piece + 1)
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = rolling.hashes(0, at, at + piece) & ~low | (low - at.astype(np.uint64))  # of equal hashes the last
    own = (low - (least_of(keys, threshold - piece + 1) & low)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[first[1:] - 1, len(own) - 1]
    return own[first], first, last


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def anchor_rows(keyed: DataFrame, threshold: int, piece: int) -> DataFrame:
    """g, x (hashes of an anchor's piece and stretch), d, tie, lo, hi (its windows' starts)."""

    def rows(cols):
        for d, tie, text in zip(cols["d"], cols["tie"], cols["text"]):
            raw = _bytes(text)
            if len(raw) < threshold:
                continue
            rolling = Rolling(raw)
            at, lo, hi = anchors(raw, rolling, threshold, piece)
            g = rolling.hashes(0, at, at + piece)
            # where the piece lies in the stretch is part of the stretch's name
            x = mixed(rolling.hashes(1, lo, hi + threshold) + (at - lo).astype(np.uint64) * np.uint64(BASES[0]))
            for row in zip(_signed(g), _signed(x), lo.tolist(), hi.tolist()):
                yield row[0], row[1], d, tie, row[2], row[3]

    return common.mapped(keyed, "g long, x long, d long, tie long, lo int, hi int", rows, 64)


def window_rows(texts: DataFrame, threshold: int) -> DataFrame:
    """g (their anchor's piece), h, d, tie, s, alone of the windows in the given stretches; texts: d, tie, text, stretches."""

    def rows(cols):
        for d, tie, text, stretches in zip(cols["d"], cols["tie"], cols["text"], cols["stretches"]):
            rolling = Rolling(_bytes(text))
            for part in stretches:
                s = np.arange(part["lo"], part["hi"] + 1)
                for h, at in zip(_signed(rolling.hashes(1, s, s + threshold)), s.tolist()):
                    yield part["g"], h, d, tie, at, part["alone"]

    return common.mapped(texts, "g long, h long, d long, tie long, s int, alone boolean", rows, 16)


def repeated(docs: DataFrame, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """d, tie, spans (array of start, end): what to remove, by document; spans may overlap."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tie"), "text").filter("text IS NOT NULL")
    found = common.written(anchor_rows(keyed, threshold, piece), "anchors")
    again = common.written(found.groupBy("g").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("g").alias("k")), "pieces")
    left = common.written(found.join(again, F.col("g") == F.col("k")).drop("k"), "anchors-again")
    common.dropped(found)
    # stretches; `one` is a place where it stands
    kinds = left.groupBy("g", "x").agg(F.count("*").alias("times"), F.min(F.struct("d", "tie", "lo", "hi")).alias("one"))
    kinds = common.written(kinds.withColumnsRenamed({"g": "kg", "x": "kx"}), "stretches")
    whole = left.join(kinds.filter("times > 1").select("kg", "kx"), (F.col("g") == F.col("kg")) & (F.col("x") == F.col("kx")))
    whole = whole.select("d", "tie", F.col("lo").alias("s"), (F.col("hi") + threshold).alias("e"))
    several = common.written(kinds.groupBy("kg").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("kg").alias("several")), "pieces-several")
    open_ = kinds.join(several, F.col("kg") == F.col("several")).select("one.*", F.col("kg").alias("g"), (F.col("times") == 1).alias("alone"))
    open_ = common.written(open_.groupBy("d", "tie").agg(F.collect_set(F.struct("g", "lo", "hi", "alone")).alias("stretches")), "open").withColumnsRenamed({"d": "od", "tie": "ot"})
    texts = keyed.join(open_, F.col("d").eqNullSafe(F.col("od")) & (F.col("tie") == F.col("ot"))).select("d", "tie", "text", "stretches").dropDuplicates(["d", "tie"])
    windows = common.written(window_rows(texts, threshold), "windows")
    same = common.written(windows.groupBy("g", "h").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("g").alias("k1"), F.col("h").alias("k2")), "windows-again")
    single = windows.filter("alone").join(same, (F.col("g") == F.col("k1")) & (F.col("h") == F.col("k2"))).select("d", "tie", "s", (F.col("s") + threshold).alias("e"))
    out = common.written(whole.unionByName(single).groupBy("d", "tie").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "suffix-spans")
    for used in (left, kinds, windows, same):
        common.dropped(used)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def removed(docs: DataFrame, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end of the maximal removed runs), kept (bytes) of each row."""
    gone = repeated(docs, threshold, piece).withColumnsRenamed({"d": "gd", "tie": "gt"})
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tie"), "text")
    both = keyed.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("tie") == F.col("gt")), "left").select("d", "text", "spans")

    def rows(cols):
        for d, text, spans in zip(cols["d"], cols["text"], cols["spans"]):
            raw = (text or "").encode()
            runs = merged([(x["s"], x["e"]) for x in spans or ()])
            ends = [0, *(e for _, e in runs)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(raw)]))
            yield d, len(raw), [{"s": s, "e": e} for s, e in runs], kept

    return common.mapped(both, "doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary", rows, 64)


def digests(out: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(removed(common.table(spark, sf_dir)))
