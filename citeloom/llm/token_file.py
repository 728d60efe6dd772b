"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Ids are renumbered by how often the corpus has them (rank 0 is the most frequent), so that most fit one byte. A value
takes one to four bytes, little-endian; two bits of a control byte hold that length, four values a control byte, and
control bytes and data bytes are kept apart. Decoding looks up the four lengths of each control byte in a table of 256
rows, and the lengths give a mask through which the data bytes are put in place.

A file set is a folder with `vocab` (rank, id: at most a row for each id of the tokenizer) and `shards`: rows (shard,
segment, offset, doc_ids, lengths, control, data). Shards ascend in doc_id; rows of one doc_id stand in the order of
their texts' hashes; null doc_ids stand first. Both are written and read by Spark, so the folder can be anywhere that
Spark can reach, and a task that is run again writes the same bytes.

Defined results: null and empty texts are the end id alone; repeated rows are written one by one; a document of any
length stays in one segment; an empty table gives an empty file set and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = 0
SEGMENT_IDS, SHARD_IDS, SLICE = 1 << 18, 1 << 22, 1024
#: Lengths less one of the four values of each control byte, and for each such length the bytes that are there.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)
THERE = np.arange(4) <= np.arange(4)[:, None]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[THERE[codes[: len(values)]]]
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    there = THERE[LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]]
    out = np.zeros((n, 4), np.uint8)
    out[there] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


#: A unit is white space and what follows it, up to the next white space or to such a mark behind a letter. Byte-level
#: pretokenizers cut there too: whatever they match ends at both, and what begins there looks no further back.
MARKS = ".,;:!?"
#: White space outside ASCII, and what only some libraries take for it: texts with these are encoded whole.
UNSURE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Units that a byte-level pretokenizer leaves whole.
WHOLE = re.compile("\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
MEMO, MEMO_CHARS = 200_000, 64
BLANK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The characters that byte-level vocabularies write bytes with: printable ones as they are, the others from 256 on.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
OTHERS = [b for b in range(256) if b not in PRINTED]
AS_CHARS = "".join(chr(b if b in PRINTED else 256 + OTHERS.index(b)) for b in range(256))


class _Memo(dict):
    """The ids of units by the library; two generations of at most about MEMO units."""

    def __init__(self, library, wide: str):
        self.library, self.merged, self.packed = library, library.model.tokenize, "<%d" + {2: "H", 4: "I"}[np.dtype(wide).itemsize]
        self.before: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.get(unit)
        if ids is None:
            if WHOLE(unit):
                plain = unit if unit[0] != " " else AS_CHARS[32] + unit[1:]  # other ASCII characters here stand for themselves
                found = [t.id for t in self.merged(plain if unit.isascii() else unit.encode().decode("latin-1").translate(AS_CHARS))]
            else:
                found = self.library.encode(unit, add_special_tokens=False).ids
            ids = struct.pack(self.packed % len(found), *found)
        if len(unit) <= MEMO_CHARS:
            self[unit] = ids
        return ids

    def bounded(self) -> None:
        if len(self) > MEMO:
            self.before = dict(self)
            self.clear()


class Encoder:
    """The tokenizer of a file; where that can't change the ids, it encodes each unit of the texts once and keeps them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = narrowest(self.library.get_vocab_size())
        state = json.loads(self.library.to_str())
        pre, added = state["pre_tokenizer"] or {}, state["added_tokens"]
        self.by_unit = state["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_unit &= state["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        inside = "".join(t["content"] for t in added)
        self.mark = np.zeros(256, bool)
        self.mark[[ord(m) for m in MARKS if m not in inside]] = True
        self.memo = _Memo(self.library, self.wide)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian numbers of the narrowest type."""
        if not self.by_unit:
            return [np.array(e.ids, self.wide).tobytes() for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[-1] == ends[0]:
            return [b""] * len(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        blank = BLANK[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        letter = LETTER[raw]
        letter[1:] |= (raw[:-1] >= 0xC4) & (raw[:-1] <= 0xC9) | (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[1:-1] |= self.mark[raw[1:]] & letter[:-1]
        for i in np.flatnonzero(pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False)):
            cut[ends[i] + 1 : ends[i + 1]] = False
        cut[ends] = True
        at = np.flatnonzero(cut)
        units = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        coded = pa.array([*map(self.memo.__getitem__, units.dictionary.to_pylist())], pa.large_binary()).take(units.indices)
        self.memo.bounded()
        size = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1]
        data, to = coded.buffers()[2].to_pybytes(), size[np.searchsorted(at, ends)].tolist()
        return [data[a:b] for a, b in zip(to, to[1:])]


def narrowest(vocabulary: int) -> str:
    """The type of ids below this number while they are on their way to the files."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tie (hash of the text), n, ids (of the narrowest type, the end id last) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], encode.wide).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                ids = [x + end for x in encode(part.column("text"))]
                n = pa.array([len(x) // len(end) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), n, pa.array(ids, pa.binary())], names=["doc_id", "tie", "n", "ids"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, tie long, n long, ids binary")


def frequency_ranks(tokens: DataFrame, wide: str) -> list[int]:
    """The ids by falling count, then by id: at most as many as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                add = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 64).to_pylist()), wide))
                if len(add) > len(seen):
                    seen = np.pad(seen, (0, len(add) - len(seen)))
                seen[: len(add)] += add
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["id", "count"])

    counts = tokens.select("ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    return [i for i, _ in sorted(counts.collect(), key=lambda r: (-r[1], r[0]))]


def write(docs: DataFrame, path: str, out_dir: str) -> None:
    """Tokenizes docs by the tokenizer file at path and writes the file set."""
    spark = docs.sparkSession
    tokens = common.written(tokenized(docs, path), "token-ids")
    wide = encoder(path).wide
    width = np.dtype(wide).itemsize
    order = frequency_ranks(tokens, wide)
    ranks = np.zeros(max(order, default=0) + 1, "<u4")
    ranks[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(ranks)  # four bytes for each id of the vocabulary
    total = tokens.agg(F.sum("n")).first()[0] or 0
    key = docs.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, offset = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, offset, held, size
            values = np.frombuffer(b"".join(ids for _, ids in held), wide)
            control, data = pack(sent.value[values])
            row = {"shard": [shard], "segment": [segment], "offset": [offset], "doc_ids": [[d for d, _ in held]], "lengths": [[len(ids) // width for _, ids in held]], "control": [control], "data": [data]}
            segment, offset, held, size = segment + 1, offset + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=[*row])

        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            for d, ids in zip(batch.column("doc_id"), batch.column("ids")):
                held.append((d.as_py(), ids.as_py()))
                size += len(held[-1][1]) // width
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    n = common.pieces(total, SHARD_IDS)
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "ids")
    with common.shuffles_removed(spark):
        ordered.mapInArrow(shards, f"shard int, segment int, offset long, doc_ids array<{key}>, lengths array<long>, control binary, data binary").write.parquet(f"{out_dir}/shards")
    common.dropped(tokens)
    spark.createDataFrame([*enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{out_dir}/vocab")


def read(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, ids (little-endian bytes, the end id last) of each document of a file set."""
    vocab = spark.read.parquet(f"{out_dir}/vocab").orderBy("rank").collect()  # at most the tokenizer's vocabulary
    ids = spark.sparkContext.broadcast(np.array([r["id"] for r in vocab], "<u4"))
    rows = spark.read.parquet(f"{out_dir}/shards")
    sums = rows.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    starts, at = {}, 0
    for shard, n in sorted(sums.collect()):  # a pair for each shard
        starts[shard], at = at, at + n
    sent = spark.sparkContext.broadcast(starts)
    key = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(cols):
        for shard, offset, doc_ids, lengths, control, data in zip(*(cols[c] for c in ("shard", "offset", "doc_ids", "lengths", "control", "data"))):
            values = ids.value[unpack(control, data, sum(lengths))]
            first = sent.value[shard] + offset
            at = 0
            for d, n in zip(doc_ids, lengths):
                yield d, first + at, values[at : at + n].tobytes()
                at += n

    return common.mapped(rows, f"doc_id {key}, start long, ids binary", documents, 1)


def digests(documents: DataFrame) -> DataFrame:
    def rows(cols):
        for d, start, ids in zip(cols["doc_id"], cols["start"], cols["ids"]):
            yield d, start, len(ids) // 4, zlib.crc32(ids)

    key = documents.schema["doc_id"].dataType.simpleString()
    return common.mapped(documents, f"doc_id {key}, start long, n_tokens long, ids_crc32 long", rows)


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = common.scratch_path(spark, "token-file")
    write(common.table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), out_dir)
    return digests(read(spark, out_dir))
