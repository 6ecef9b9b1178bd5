"""Byte-level BPE as a tree reduction: encode halves, join neighbours at their boundary.

Two levels use the same idea.  A text is halved down to leaves, which are cut into pre-tokens;
joining two segments cuts a window around the boundary anew and grows it until its pre-tokens
meet those of the right segment: the pattern looks at most ``LOOK`` characters beyond a match
and never back, so matches that end ``LOOK`` before a segment's end, and all matches after a
common start, are those of the whole text.  A long pre-token is halved the same way; joining
merges the bytes of the last tokens on the left and the first on the right anew, and the window
doubles until both pairs across its edges are stable (merging their bytes alone gives the same
two tokens).  A sequence is the encoding of its bytes exactly if all neighbours are stable, so
tokens outside the window cannot change.  Decoding concatenates the bytes of halves up the tree.

Defined cases: null text counts as empty and has no ids; null ids decode to null; ids that the
vocabulary lacks raise; extra columns are passed on, and columns named like an output column are
replaced; empty in, empty out.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from civicscope.llm.frames import append, column, whole_text

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 4096, 256, 2048
LOOK = 3
#: Letters of texts for which the plain pattern below equals public_tokenizers.PATTERN.
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER = re.compile(rf"[^\t\n\r -~{_LATIN}]")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)


def cut(text: str) -> list[str]:
    """Pre-tokens of one leaf or window."""
    return (_FULL if _OTHER.search(text) else _FAST).findall(text)


def _join_cuts(left: list[str], right: list[str]) -> list[str]:
    """Pre-tokens of two neighbouring segments together."""
    if not left or not right:
        return left or right
    p, tail = len(left), 0
    while p and tail < LOOK:  # matches that end less than LOOK before the boundary may change
        p -= 1
        tail += len(left[p])
    before = "".join(left[p:])
    reach = 64
    while True:
        taken, size = 0, 0
        while taken < len(right) and size < reach:
            size += len(right[taken])
            taken += 1
        window = before + "".join(right[:taken])
        pieces = cut(window)
        if taken == len(right):
            return left[:p] + pieces
        starts, at = {}, len(before)
        for k in range(taken):
            starts[at] = k
            at += len(right[k])
        at = 0
        for k, piece in enumerate(pieces):
            if at in starts and at <= len(window) - LOOK and at >= len(before):
                return left[:p] + pieces[:k] + right[starts[at] :]
            at += len(piece)
        reach *= 4


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a whole text, by halves."""
    if len(text) <= LEAF_CHARS:
        return cut(text)
    middle = len(text) // 2
    return _join_cuts(pretokens(text[:middle]), pretokens(text[middle:]))


class _Known(dict):
    """Little-endian ids of pre-tokens seen before; others are encoded when asked for."""

    def __init__(self, bpe: TreeBpe, kept: int):
        super().__init__()
        self.bpe, self.kept = bpe, kept

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.piece(word.encode()), "<i4").tobytes()
        if len(word) < 64:
            if len(self) > self.kept:
                self.clear()
            self[word] = ids
        return ids


class TreeBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str, kept: int = 500_000):
        self.path, self.kept = path, kept
        self._ranks: dict[bytes, int] | None = None

    def __reduce__(self):
        return (TreeBpe, (self.path, self.kept))

    def _load(self) -> None:
        if self._ranks is None:
            with open(self.path, "rb") as lines:
                self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.tokens = [b""] * (max(self._ranks.values()) + 1)
            for token, rank in self._ranks.items():
                self.tokens[rank] = token
            self._stable: dict[tuple[int, int], bool] = {}
            self._known = _Known(self, self.kept)

    def _merge(self, data: bytes) -> list[int]:
        """Merges of a short run of bytes, lowest rank first, leftmost among equals."""
        ranks = self._ranks
        if len(data) > 40:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for a longer run, with a heap of possible merges."""
        ranks, n = self._ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here, 0 if none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop or middle >= stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                rank = ranks.get(data[i : end[stop]])
                if rank is not None:
                    heappush(heap, (rank, i, end[stop]))
            if before[i] >= 0:
                rank = ranks.get(data[before[i] : stop])
                if rank is not None:
                    heappush(heap, (rank, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > 200_000:
                self._stable.clear()
            known = self._stable[a, b] = self._merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings together."""
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self._merge(b"".join(self.tokens[t] for t in left[a:] + right[:b]))
            if (not a or self.stable(left[a - 1], middle[0])) and (b == len(right) or self.stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        middle = len(data) // 2
        return self.join(self._tree(data[:middle]), self._tree(data[middle:]))

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token is that token."""
        self._load()
        rank = self._ranks.get(data)
        return [rank] if rank is not None else self._tree(data)

    def ids(self, text: str) -> bytes:
        """Little-endian ids of a whole text."""
        self._load()
        return b"".join(map(self._known.__getitem__, pretokens(text)))

    def text(self, ids: list[int]) -> bytes:
        """Bytes of ids, halves concatenated up the tree."""
        self._load()
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.text(ids[:middle]) + self.text(ids[middle:])


def encode(docs: DataFrame, ranks: str, text: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of each whole text."""
    bpe = TreeBpe(ranks)

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = [bpe.ids(t) for t in whole_text(column(batch, text)).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))]

    return append(docs, text, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], made)


def decode(df: DataFrame, ranks: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes that its ids stand for."""
    bpe = TreeBpe(ranks)

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if ids is None else bpe.text(ids) for ids in _lists(column(batch, ids_col))], pa.binary())]

    return append(df, ids_col, [T.StructField(bytes_col, T.BinaryType())], made)


def _lists(array: pa.Array):
    """Python lists of a list array, null as None."""
    values = array.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(array.offsets.to_numpy())
    missing = array.is_null().to_numpy(zero_copy_only=False)
    n = np.where(missing, 0, n)
    ends = np.cumsum(n)
    for a, b, none in zip((ends - n).tolist(), ends.tolist(), missing.tolist()):
        if none:
            yield None
        else:
            ids = values[a:b].tolist()
            if ids and min(ids) < 0:
                raise IndexError("negative id")
            yield ids
