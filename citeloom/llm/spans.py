"""Substring dedup by sliding sentence spans.

A sentence here is a clause: it ends after one of `. ! ? , ; :` or the like of another script before white space, after an
ideographic or fullwidth mark, or at a line feed; the white space after it belongs to it. One of more than MOST words is
cut after each MOST of them, so that a passage without marks, or joined to other text at its ends, has whole sentences too.
At every sentence a run begins: RUN sentences, and more while they have fewer than RUN_WORDS words in all (short ones in a
row repeat by chance). Where words aren't set apart (more than LONG characters each), CHARS
characters count as one. Runs are hashed to 128 bits over their
sentences without outer white space, and joined globally; of each repeated run the first by (doc_id, hash of the text,
place) stays, and every sentence that any other one covers goes. So what of a repeat lies in a sentence that is other text
in part stays, up to MOST words at each end.

First the 64-bit hashes of runs are counted, so that what is shuffled of a run that doesn't repeat is that hash alone: of the
others all but a few are left out by a bitmap of the repeated hashes, and the 128 bits decide over what stays. Sums and firsts
of runs are formed before the shuffle, and written; the join back is one against many, so a run that a third of all documents
share is split by AQE's skew join.

Defined results: a null text stays null, an empty one empty; a text with no run is kept whole; rows with equal doc_id and
text count as one document, all copies get the same result; null doc_ids come first; an empty table gives no rows; other
columns pass through untouched.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near_dup

RUN, RUN_WORDS, MOST, LONG, CHARS = 3, 24, 12, 24, 3
BREAK = re.compile(r"(?<=[.!?,;:\u037e\u0589\u060c\u061b\u061f\u06d4\u0964\u0965\u104b\u1362-\u1366\u17d4])\s+|(?<=[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61\uff64])\s*|\n\s*")
PART = re.compile(rf"(?:\S+\s*){{1,{MOST}}}")
DENSE = re.compile(rf"\S{{1,{MOST * CHARS}}}\s*")


def words_in(part: str) -> int:
    """The words of a part of a text; one for CHARS characters if words aren't set apart (more than LONG characters each)."""
    n = len(part.split())
    return n if len(part) <= n * LONG else len(part) // CHARS


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; together they are the whole text."""
    out, at = [], 0

    def add(a: int, b: int) -> None:
        if b - a > 2 * MOST and words_in(text[a:b]) > MOST:
            cut = PART if len(text[a:b].split()) * LONG >= b - a else DENSE
            if text[a].isspace():  # white space at the text's beginning
                a0, a = a, a + len(text[a:b]) - len(text[a:b].lstrip())
                parts = [(m.start(), m.end()) for m in cut.finditer(text, a, b)]
                parts[0] = (a0, parts[0][1])
                out.extend(parts)
            else:
                out.extend((m.start(), m.end()) for m in cut.finditer(text, a, b))
        else:
            out.append((a, b))

    for m in BREAK.finditer(text):
        end = m.end()
        if not text[at:end].isspace() and end > at:
            add(at, end)
            at = end
    if at < len(text):
        if not out or not text[at:].isspace():
            add(at, len(text))
        else:
            out[-1] = (out[-1][0], len(text))
    return out


def runs(text: str, run: int = RUN, run_words: int = RUN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of each run of a text."""
    parts = [text[a:b].strip() for a, b in sentences(text)]
    sizes = [words_in(p) for p in parts]
    names = [xxhash.xxh3_128_digest(p) for p in parts]
    out, end, words = [], 0, 0
    for at in range(len(parts)):
        while end < len(parts) and (end - at < run or words < run_words):
            words += sizes[end]
            end += 1
        if end - at >= run and words >= run_words:
            out.append((at, end - at, xxhash.xxh3_128_digest(b"".join(names[at:end]))))
        words -= sizes[at]
    return out


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences of these (first, number) runs, and how many went."""
    gone = {i for at, n in covered for i in range(at, at + n)}
    return "".join(text[a:b] for i, (a, b) in enumerate(sentences(text)) if i not in gone), len(gone)


def repeated(docs: DataFrame, run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """d, tie, covered (array of at, n): the runs to remove, by document; a written table."""

    def rows(cols):
        for d, tie, text in zip(cols["d"], cols["tie"], cols["text"]):
            for at, n, h in runs(text, run, run_words):
                yield h, d, tie, at, n

    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tie"), "text").filter("text IS NOT NULL")
    found = common.written(common.mapped(keyed, "h binary, d long, tie long, at int, n int", rows), "spans")
    key = F.xxhash64("h").alias("key")
    twice = common.written(found.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1").select("key"), "spans-twice")
    likely = near_dup.maybe_in(found.select("*", key), twice).drop("key")
    firsts = likely.groupBy("h").agg(F.count("*").alias("times"), F.min(F.struct("d", "tie", "at")).alias("first")).filter("times > 1")
    firsts = common.written(firsts.select(F.col("h").alias("fh"), "first"), "spans-first")
    others = likely.join(firsts, F.col("h") == F.col("fh")).filter(~F.struct("d", "tie", "at").eqNullSafe(F.col("first")))
    # runs of equal rows (same doc_id and text) meet here; a set of them is wanted
    out = common.written(others.groupBy("d", "tie").agg(F.collect_set(F.struct("at", "n")).alias("covered")), "spans-gone")
    common.dropped(found, twice, firsts)
    return out


def deduplicated(docs: DataFrame, run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text cut, plus __removed (sentences removed)."""
    gone = repeated(docs, run, run_words).withColumnsRenamed({"d": "__d", "tie": "__tie", "covered": "__covered"})
    both = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__tie")), "left").drop("__d", "__tie")

    def cut(cols):
        for *rest, text, covered in zip(*cols.values()):
            yield (*rest, *(without(text, [(c["at"], c["n"]) for c in covered]) if covered and text is not None else (text, 0)))

    other = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other)
    out = common.mapped(both.select(*other, "text", "__covered"), f"{kinds}{', ' if kinds else ''}text string, __removed int", cut, 64)
    return out.select(*docs.columns, "__removed")


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(common.table(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.col("__removed").cast("long").alias("n_removed"), kept.alias("kept_sha256"))
