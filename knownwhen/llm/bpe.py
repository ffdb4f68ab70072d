"""Byte-level BPE encoding and decoding.

Pieces of text (matches of the vocabulary's pattern) are encoded independently. All vocabulary entries that occur in a
piece are found by one pass of an Aho-Corasick automaton (bytes read as Latin-1 characters). The encoder walks from the
start, takes the longest entry, and backtracks to a shorter one, or to before the last token, whenever two neighbours
could not stand beside each other in a merged text. Compatibility of two tokens is decided by undoing their merges
in reverse order and is memoised; no position is tried twice, so the walk is linear in the piece. The result equals
merging the lowest-ranked pair again and again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, slices

LONG_TEXT = 1 << 20  # code points; longer texts are split lazily


class Vocabulary:
    """Tables made from a rank file: automaton, shorter prefixes, merges and their inverse."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.shorter: dict[int, int] = {}  # a token's longest proper prefix that is a token
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (prefix := ranks.get(token[:n])) is not None:
                    self.shorter[rank] = prefix
                    break
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        for rank, token in enumerate(self.bytes):
            if not token:
                continue
            self.parts[rank] = (rank, rank)
            left = self.shorter.get(rank)
            while left is not None:
                right = ranks.get(token[len(self.bytes[left]):])
                if right is not None and left < rank and right < rank and self._fits(left, right):
                    self.merged[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
                left = self.shorter.get(left)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens as they are when they stand side by side."""
        limit, merged, parts = 1 << 62, self.merged, self.parts
        while True:
            if merged.get((left, right), 1 << 62) < limit:
                return False
            if left > right:  # the left one was merged later: undo it
                limit = left
                left = parts[left][1]
                if left == limit:
                    limit = right + 1
                    right = parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = parts[right][0]
                if right + 1 == limit:
                    limit = left
                    left = parts[left][1]
                    if left == limit:
                        return True

    def fits(self, left: int, right: int) -> bool:
        known = self.fits_memo.get((left, right))
        if known is None:
            if len(self.fits_memo) > 300_000:
                self.fits_memo.clear()
            known = self.fits_memo[left, right] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # later ends are longer entries
        token, pos, tokens, size = longest[0], 0, [], len(piece)
        dead = bytearray(size + 1)  # positions from which the rest has been found impossible
        texts, shorter = self.bytes, self.shorter
        while True:
            last = tokens[-1] if tokens else None
            while token is not None:
                end = pos + len(texts[token])
                if not dead[end] and (last is None or self.fits(last, token)):
                    break
                token = shorter.get(token)
            if token is not None:
                tokens.append(token)
                if end == size:
                    return tokens
                pos, token = end, longest[end]
            else:
                if last is None:
                    raise ValueError(f"the vocabulary cannot spell {piece[:40]!r}")
                dead[pos] = 1
                tokens.pop()
                pos -= len(texts[last])
                token = last

    @property
    def memo(self) -> "Memo":
        if "_memo" not in self.__dict__:
            self._memo = Memo(self)
        return self._memo

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; no ids for None."""
        if not text:
            return b""
        memo = self.memo
        if len(text) <= LONG_TEXT:
            return b"".join(map(memo.__getitem__, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        out = bytearray()
        while some := list(islice(found, 65_536)):
            out += b"".join(map(memo.__getitem__, some))
        return bytes(out)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


class Memo(dict):
    """Piece -> ids, for short pieces; emptied when full, so its memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """-> (``id``, n_tokens long, ids binary): the tokens of each whole text, as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens. Rows stay as they are, repeated or null ids included; other columns of the input
    are not read. ``path`` is the rank file, present on each executor; special tokens are ordinary text.
    """
    schema = df.select(F.col(id)).schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for piece, texts in slices(batches, 1):
            ids = [vocab.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id, "n_tokens", "ids"])

    return df.select(F.col(id), F.col(text).cast("string").alias("__text")).transform(arrow_map, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to ``df``: the bytes of its id sequences; empty for null. A column of that name is replaced."""
    kept = [c for c in df.columns if c != "decoded"]
    schema = df.select(*kept).schema.add("decoded", "binary")
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for piece, ids in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([vocab.decode(x) for x in ids], pa.binary())], [*kept, "decoded"])

    return df.select(*kept).transform(arrow_map, run, schema)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``encode`` and ``decode`` of each text -> (``id``, n_tokens, ids_sha256, decoded_sha256).

    Both directions run in one pass over the rows, so that ids leave the Python worker as digests alone.
    """
    schema = df.select(F.col(id)).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for piece, texts in slices(batches, 1):
            n, a, b = [], [], []
            for t in texts:
                ids = vocab.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema.names)

    return df.select(F.col(id), F.col(text).cast("string").alias("__text")).transform(arrow_map, run, schema)


@query("op10_byte_bpe")
def op10(t):
    import public_tokenizers

    return digests(t("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
