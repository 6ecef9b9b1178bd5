"""Ids of whole texts by the tokenizers library, each distinct piece between spaces encoded once.

Pre-tokenisation never joins text across a space with other text on both sides, so pieces can be
encoded on their own.  Where white space stands next to a space and the vocabulary keeps it, the
whole text goes through the tokenizer instead.

Where the vocabulary keeps spaces, pieces are cut further into units, and a Python worker keeps
the ids of the units of its earlier tasks.  New units go through the tokenizer as one text, cut
again by the bytes of each token; should a token reach over a cut, they are encoded one by one.
"""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from civicscope.llm.frames import spread, whole_text

#: White space beside a space.
_BESIDE = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_LINE = "\n"
#: Ends of a piece that form a pre-token of their own after letters.
_TAIL = ".,!?%&$*#|;:"
_SHOWN = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
#: Pieces without white space but a space at the front and single line ends between other text.
_REGULAR = rf"^ ?{_SHOWN}(\n{_SHOWN})*$"
_CUT = "\x1f"  # no regular piece holds it
_BEFORE_TAIL = rf"([A-Za-z0-9\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}])([{_TAIL}]+)({_CUT}|$)"
#: Units joined to one text for the tokenizer.
_JOINED = 1024


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class PieceEncoder:
    """Encodes Arrow arrays of texts; ``keeps_space``: a space belongs to the piece after it."""

    def __init__(self, path: str, keeps_space: bool, kept: int = 600_000):
        self.path, self.keeps_space, self.kept = path, keeps_space, kept
        self._seen: dict[str, bytes] = {}
        self._tokenizer = None
        self._shown: dict[int, str] = {}
        self._sizes = None
        self._forget()

    def __reduce__(self):
        return (_of_process if self.keeps_space else PieceEncoder, (self.path, self.keeps_space, self.kept))

    def _load(self) -> Tokenizer:
        if self._tokenizer is None:
            if self.keeps_space:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = True
        return self._tokenizer

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._load().encode_batch(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Little-endian ids of each piece."""
        seen, out, strip = self._seen, [], _TAIL
        if len(seen) > self.kept:
            seen.clear()
        for piece in pieces:
            ids = seen.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else self._load().normalizer.normalize_str(piece)
                core = shown.rstrip(strip)
                if len(piece) < 64 and core.isalpha():
                    ids = self._word(core)
                    if len(core) < len(shown):
                        ids += self._word(shown[len(core) :])
                elif _LINE in piece:
                    ids = b"".join(self._ids(piece.split(_LINE)))
                else:
                    ids = self._general(piece)
            out.append(ids)
        return out

    def _word(self, word: str) -> bytes:
        """Ids of one normalised pre-token: letters or punctuation."""
        ids = self._seen.get(word)
        if ids is None:
            shown = word.lower() if word.isascii() else word.encode().decode("latin-1").translate(self._bytes())
            ids = _packed([t.id for t in self._load().model.tokenize(shown)])
            self._seen[word] = ids
        return ids

    def _bytes(self) -> dict[int, str]:
        """The visible character that byte-level vocabularies write for each byte."""
        if not self._shown:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            self._shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        return self._shown

    def _general(self, piece: str) -> bytes:
        ids = self._seen.get(piece)
        if ids is None:
            ids = self.whole([piece])[0].astype("<u4").tobytes()
            if len(piece) < 64:
                self._seen[piece] = ids
        return ids

    def _forget(self) -> None:
        """Known units, where each one's ids start and how many they are, and the ids."""
        self._units, self._starts, self._lengths, self._table = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        coded = [e.ids for e in self._load().encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return lengths, np.fromiter((i for ids in coded for i in ids), np.uint32, int(lengths.sum()))

    def _after_space(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of units that begin with their only space, and all ids: many are encoded as one text."""
        if self._sizes is None:
            vocabulary = self._load().get_vocab()
            self._sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for shown, id in vocabulary.items():
                self._sizes[id] = len(shown)  # one character a byte
        cuts = pa.array([*range(0, len(units), _JOINED), len(units)], pa.int32())
        _, ids = self._fast(pc.binary_join(pa.ListArray.from_arrays(cuts, units), "").to_pylist())
        ends = np.cumsum(self._sizes[ids])
        wanted = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64))
        at = np.searchsorted(ends, wanted)
        if len(ends) != at[-1] + 1 or (ends[at] != wanted).any():  # a token reaches over a space
            return self._fast(units.to_pylist())
        return np.diff(at, prepend=-1), ids

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Places of new units among the known ones."""
        spaced, known = pc.starts_with(units, " "), len(self._units)
        for part, encoded in ((units.filter(spaced), self._after_space), (units.filter(pc.invert(spaced)), lambda x: self._fast(x.to_pylist()))):
            if len(part):
                lengths, ids = encoded(part)
                self._starts = np.append(self._starts, len(self._table) + np.cumsum(lengths) - lengths)
                self._lengths = np.append(self._lengths, lengths)
                self._table = np.append(self._table, ids)
                self._units = pa.concat_arrays([self._units, part])
        places = np.empty(len(units), np.int64)
        first = spaced.to_numpy(zero_copy_only=False)
        places[first], places[~first] = np.split(known + np.arange(len(units)), [int(first.sum())])
        return places

    def _regular(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each regular piece, and all ids.

        Around a line end, and between a letter or digit and the punctuation at an end, no pre-token goes on.
        """
        cut = pc.replace_substring_regex(pc.replace_substring(pieces, _LINE, _CUT + _LINE + _CUT), _BEFORE_TAIL, rf"\1{_CUT}\2\3")
        lists = pc.split_pattern(cut, _CUT)
        coded = lists.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, self._units)
        if len(self._units) + at.null_count > self.kept:
            self._forget()
            at = pc.index_in(coded.dictionary, self._units)
        new = at.is_null()
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        places[new.to_numpy(zero_copy_only=False)] = self._learn(coded.dictionary.filter(new))
        index = places[coded.indices.to_numpy()]
        per = self._lengths[index]
        ends = np.concatenate([[0], np.cumsum(per)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.diff(ends), self._table[spread(self._starts[index], per)]

    def _spaced(self, plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids, of texts without white space beside a space."""
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten()
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded, own = words.dictionary_encode(), words.take(pa.array(at[:-1])).dictionary_encode()  # a split text has one piece at least
        index = coded.indices.to_numpy().astype(np.int64)
        index[at[:-1]] = len(coded.dictionary) + own.indices.to_numpy()
        pieces = pa.concat_arrays([pc.binary_join_element_wise(" ", coded.dictionary, ""), own.dictionary])
        easy = pc.match_substring_regex(pieces, _REGULAR)
        lengths = np.zeros(len(pieces), np.int64)
        where = easy.to_numpy(zero_copy_only=False)
        lengths[where], ids = self._regular(pieces.filter(easy))
        lengths[~where], others = self._fast(pieces.filter(pc.invert(easy)).to_pylist())
        starts = np.zeros(len(pieces), np.int64)
        starts[where] = np.cumsum(lengths[where]) - lengths[where]
        starts[~where] = len(ids) + np.cumsum(lengths[~where]) - lengths[~where]
        per = lengths[index]
        flat = np.concatenate([ids, others])[spread(starts[index], per)]
        return np.concatenate([[0], np.cumsum(per)])[at], flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids."""
        texts = whole_text(texts)
        if not self.keeps_space:
            return self._split(texts)
        odd = pc.match_substring_regex(texts, _BESIDE).to_numpy(zero_copy_only=False)
        ends, flat = self._spaced(texts.filter(pa.array(~odd)) if odd.any() else texts)
        if not odd.any():
            return ends, flat
        rest = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
        easy = iter(zip(ends[:-1], ends[1:]))
        rows = [next(rest) if o else flat[slice(*next(easy))] for o in odd]
        return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where a space is no part of any id."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        parts = self._ids(pieces)
        lengths = np.fromiter((len(p) >> 2 for p in parts), np.int64, len(parts))
        table = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(lengths) - lengths
        per = lengths[index]
        flat = table[spread(starts[index], per)] if len(per) else np.zeros(0, "<u4")
        return np.concatenate([[0], np.cumsum(per)])[at], flat


@lru_cache(maxsize=4)
def _of_process(path: str, keeps_space: bool, kept: int) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs, one after another."""
    return PieceEncoder(path, keeps_space, kept)
