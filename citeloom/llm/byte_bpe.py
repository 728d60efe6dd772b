"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece's bytes are read as Latin-1, so that a pyahocorasick automaton over the vocabulary finds, in one pass, the
longest token at every position. The encoder goes from left to right with longest tokens first. Two neighbours may
stand together only if merging their joint bytes gives just these two; this is memoised. Where nothing fits it takes
the next shorter token, or marks the position as dead and steps back, so each position is tried at most once for
each token that starts there: linear time, and the ids are those of the exact merges by rank.

Defined results: null and empty texts give no ids (and the SHA-256 of nothing); a null doc_id stays null; repeated rows
are encoded one by one; texts may have any length (pieces are memoised only up to 64 characters, and the memo is
emptied at a fixed size); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from . import common

MEMO, MEMO_CHARS, NEVER = 200_000, 64, 1 << 60


class ByteBpe:
    """A vocabulary of ranks; every byte is a token and ranks below every merged one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids, self.pieces = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        order = sorted(self.tokens)
        if not all(bytes([b]) in ranks for b in range(256)) or any(self.size[i] > 1 for i in order[:256]):
            raise ValueError("every byte must be a token that ranks below all merged ones")
        self.names = {i: str(i) for i in order}
        self.joined: dict[tuple[int, int], int] = {}
        self.head: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i in order:
            token = self.tokens[i]
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            for k in range(1, len(token)):  # the merge that makes this token, by lower ranks only
                left, right = ranks.get(token[:k], NEVER), ranks.get(token[k:], NEVER)
                if max(left, right) < i and self._stand(left, right):
                    self.joined[left, right], self.head[i], self.tail[i] = i, left, right
                    break
        self.automaton.make_automaton()
        self.fits = functools.lru_cache(1 << 18)(self._stand)
        self.memo = _Memo(self)

    def _stand(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right ends in these two tokens.

        Merges are undone from the latest back. Each time, the two tokens that meet at the border would have been
        joined if their merge came before the one that was undone last (of equal merges the left one comes first).
        """
        before = NEVER
        while True:
            if self.joined.get((left, right), NEVER) < before:
                return False
            if left > right:
                if self.size[left] == 1:
                    return True
                before, left = left, self.tail[left]
            else:
                if self.size[right] == 1:
                    return True
                before, right = right + 1, self.head[right]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [0] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends ascend, so the longest stays
        dead, path, at, token = bytearray(n + 1), [], 0, longest[0] if n else -1
        while at < n:
            end = at + size[token]
            if not dead[end] and (not path or fits(path[-1], token)):
                path.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                token = shorter[token]
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.memo.__getitem__, self.pieces.findall(text))))
        if len(self.memo) > MEMO:
            self.memo.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.bpe.merge(piece.encode())
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


@functools.lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """A rank file of lines "base64 rank"; read once in each worker."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def spark_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""

    def rows(cols):
        bpe = load(path, pattern)
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            ids = bpe.encode(text or "")
            named = " ".join(map(bpe.names.__getitem__, ids))
            yield doc_id, len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return common.mapped(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def spark_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def rows(cols):
        bpe = load(path, pattern)
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            yield doc_id, bpe.encode(text or "")

    return common.mapped(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", rows, 64)


def spark_decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of each row of spark_encode()."""

    def rows(cols):
        bpe = load(path, pattern)
        for doc_id, got in zip(cols["doc_id"], cols["ids"]):
            yield doc_id, bpe.decode(got or [])

    return common.mapped(ids.select("doc_id", "ids"), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary", rows, 64)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return spark_digests(common.table(spark, sf_dir), *vocabulary())
