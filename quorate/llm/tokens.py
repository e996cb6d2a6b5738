"""Encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

The encoding of every prefix of a piece ends in exactly one token.  That token is the one among the tokens that are
suffixes of the prefix whose own front is the last token of the encoding before it: the pair must be *compatible*,
that is, encoding their joined bytes gives back these two tokens.  Suffix tokens come from an automaton over the
vocabulary, compatibility from undoing merges; following the back pointers from the end emits the ids.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import spread

#: Folder of the vocabulary files; a parameter everywhere below.
FOLDER = os.environ.get("QUORATE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"

#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces remembered per Python worker, and the longest piece worth remembering.
REMEMBERED, LONGEST = 200_000, 64


class Encoder:
    """Ids of byte strings under one vocabulary of ranked tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.split = {i: (i, i) for b, i in ranks.items() if len(b) == 1}
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._last_merge(token, rank)
                self.split[rank] = (left, right)
                self.pairs[left, right] = rank
        # Automaton over the reversed tokens: walking back from a position meets every token that ends there.
        self.back: dict[int, dict] = {}
        for token, rank in ranks.items():
            node = self.back
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.known: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that merging by rank leaves before ``token`` itself is formed."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank else 1 << 60)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, put together, encode to just these two.

        Undoing the later merge of the two again and again shows every pair that met at their border while they were
        formed.  Had such a pair a merge that comes before the ones still to be undone, it would have been taken.
        """
        limit = 1 << 60
        while True:
            met = self.pairs.get((left, right))
            if met is not None and met < limit:
                return False
            # Of equal merges the left one is made first, so the right token is the later one then.
            if left > right:
                inner = self.split[left][1]
                if inner != left:
                    limit, left = left, inner
                    continue
                outer = self.split[right][0]
                if outer == right:
                    return True
                limit, right = right + 1, outer
            else:
                outer = self.split[right][0]
                if outer != right:
                    limit, right = right + 1, outer
                    continue
                inner = self.split[left][1]
                if inner == left:
                    return True
                limit, left = left, inner

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = [-1] * (len(data) + 1)
        start = [0] * (len(data) + 1)
        fits: dict[tuple[int, int], bool] = {}
        for end in range(1, len(data) + 1):
            node, at, found = self.back, end, []
            while at > 0 and (node := node.get(data[at - 1])) is not None:
                at -= 1
                token = node.get(-1)
                if token is not None:
                    found.append((at, token))
            for at, token in reversed(found):  # the longest first
                if at:
                    pair = (last[at], token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.compatible(*pair)
                    if not ok:
                        continue
                last[end], start[end] = token, at
                break
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end = start[end]
        return tuple(reversed(ids))

    def text(self, text: str) -> list[int]:
        """Ids of a text; names of special tokens are ordinary text."""
        known, out = self.known, []
        for piece in _PIECES.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "replace"))
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        return len(self.text(text))


_PIECES = regex.compile(PATTERN)


@functools.cache
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file; one per Python process."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row; null and empty texts have the empty array.

    Without a shuffle where there are files enough: each task encodes its own rows, batch by batch, and remembers pieces it has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, vocabulary)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = np.zeros(batch.num_rows + 1, np.int32)
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = bpe.text(value) if value else []
                flat.append(np.asarray(ids, np.int32))
                ends[i + 1] = ends[i] + len(ids)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` of each row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, vocabulary)
        for batch in batches:
            n = [bpe.count(value) if value else 0 for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["key", "n"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, n long").select(F.col("key").alias(key), F.col("n").alias("n_tokens"))


def decode(ids: list[int], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> str:
    """Text of a list of ids."""
    bpe = encoder(folder, vocabulary)
    return b"".join(bpe.bytes[i] for i in ids).decode("utf-8", "replace")
