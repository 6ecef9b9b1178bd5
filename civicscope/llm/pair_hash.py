"""Minimal perfect hash of a set of integer keys, with the keys for verification.

Keys that fall alone on a place of a bit table are settled by it; the others go on to the next,
smaller table.  A key's index is the number of set bits before its own, so n keys get the numbers
0 to n - 1.  Stored are the tables, as packed bits, and the key at each index: a key that was not
in the set is told by comparison.
"""

from __future__ import annotations

import numpy as np

#: Places of a table per key that is still open.
ROOM = 2.0

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-spread bits of each key; a bijection for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PairHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, keys: np.ndarray | None = None):
        self.sizes, self.words, self.keys = sizes, words, keys
        self._starts = np.concatenate([[0], np.cumsum((sizes + 63) // 64)])
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PairHash:
        """The function of distinct keys."""
        rest, sizes, tables = np.asarray(keys, np.int64), [], []
        while len(rest):
            size = max(64, int(ROOM * len(rest)))
            place = (mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            tables.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone[place]]
        found = cls(np.array(sizes, np.int64), np.concatenate([*tables, np.zeros(0, "<u8")]).astype("<u8"))
        found.keys = np.zeros(len(keys), np.int64)
        found.keys[found._index(np.asarray(keys, np.int64))] = keys
        return found

    def _index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; some index or -1 for keys outside the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            place = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self._starts[level] + (place >> 6), (place & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            low = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_[here]] = self._before[word[here]] + np.bitwise_count(low)
            open_ = open_[~here]
            if not len(open_):
                break
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for keys outside the set."""
        at = self._index(np.asarray(keys, np.int64))
        known = at >= 0
        known[known] = self.keys[at[known]] == np.asarray(keys)[known]
        return np.where(known, at, -1)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), self.words.astype("<u8").tobytes(), self.keys.astype("<i8").tobytes()

    @classmethod
    def load(cls, sizes: bytes, words: bytes, keys: bytes) -> PairHash:
        return cls(np.frombuffer(sizes, "<i8"), np.frombuffer(words, "<u8"), np.frombuffer(keys, "<i8"))
