"""Quality by a generalised additive model with pairwise interactions.

Features describe the surface of a text (symbols, capitals, table bars, repetition, lengths).
Each feature is cut into quantile bins.  Training goes round the features in cycles, each step
a shallow tree on one feature's bins fitted to the current gradients and added to that feature's
table of contributions; then the pairs with the strongest remaining structure get two-way tables
the same way.  A score is a sum of table entries, looked up for whole Arrow batches.

Defined cases: a null or empty text has all features 0 and is scored as that; null labels are not
used; repeated label rows count once (largest label); with no usable labels, or one class only,
every score is the smoothed share of label 1; an empty table gives an empty result; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from civicscope.llm.frames import append, chunks, column, slices, sums, whole_text
from civicscope.llm.toxicity import labelled_sample

FEATURES = [
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "symbols", "bars", "shouts",
    "symbol_words", "capital_words", "digit_words", "distinct_words", "distinct_pairs", "top_word", "distinct_lines",
    "line_words", "plain_words", "long_words", "sentence_ends",
]
MAX_LABELLED = 12_000
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]")


def _word_facts(word: str) -> tuple[int, ...]:
    letters = sum(map(str.isalpha, word))
    capitals = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    symbols = len(_SYMBOL.findall(word))
    return (
        len(word), letters, capitals, digits, symbols, word.count("|"), word.count("!"),
        int(symbols >= 2), int(capitals > 1 and capitals == letters), int(digits > 0), int(0 < letters <= 3 and not symbols),
        int(len(word) > 14), int(word.endswith((".", "?", "!"))),
    )


class Features:
    """Feature matrix of Arrow batches of texts."""

    def __init__(self):
        self._seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()

    def _facts(self, words: list[str]) -> np.ndarray:
        if len(self._seen) > 150_000:
            self._seen.clear()
        seen, out = self._seen, []
        for w in words:
            f = seen.get(w)
            if f is None:
                f = _word_facts(w)
                if len(w) < 64:
                    seen[w] = f
            out.append(f)
        return np.array(out, np.float64).reshape(len(out), 13)

    def matrix(self, texts: pa.Array) -> np.ndarray:
        texts = whole_text(texts)
        offsets, index, words = chunks(texts)
        facts = self._facts(words)
        n = len(offsets) - 1
        real = facts[index, 0] > 0 if len(words) else np.zeros(0, bool)
        n_words = sums(real, offsets)
        per_word = np.maximum(n_words, 1)
        total = [sums(facts[index, k], offsets) for k in range(13)] if len(words) else [np.zeros(n)] * 13
        chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 0).astype(float)
        per_char = np.maximum(total[0], 1)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        base = np.int64(len(words) + 1)
        kinds, counts = np.unique(doc[real] * base + index[real], return_counts=True)
        owner = (kinds // base).astype(np.int64)
        distinct = np.bincount(owner, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, owner, counts)
        both = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
        pair = _distinct_pairs(doc, index, both, base, n)
        lines = pc.split_pattern(texts, "\n")
        line_at = lines.offsets.to_numpy().astype(np.int64)
        line_at = line_at - line_at[0]
        n_lines = np.diff(line_at)
        coded = lines.flatten().dictionary_encode()
        line_doc = np.repeat(np.arange(n), n_lines)
        line_kinds = np.unique(line_doc * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy())
        distinct_lines = np.bincount(line_kinds // np.int64(len(coded.dictionary) + 1), minlength=n)
        out = [
            np.log1p(chars), np.log1p(n_words), total[0] / per_word, total[1] / per_char, total[2] / per_char, total[3] / per_char,
            total[4] / per_char, total[5] / per_word, total[6] / per_word, total[7] / per_word, total[8] / per_word, total[9] / per_word,
            distinct / per_word, pair / np.maximum(np.bincount(doc[both], minlength=n), 1), top / per_word,
            distinct_lines / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1), total[10] / per_word, total[11] / per_word, total[12] / per_word,
        ]
        x = np.stack(out, axis=1)
        x[n_words == 0] = 0
        return x


def _distinct_pairs(doc: np.ndarray, index: np.ndarray, both: np.ndarray, base: np.int64, n: int) -> np.ndarray:
    """How many distinct neighbouring word pairs each text has."""
    if not len(both):
        return np.zeros(n)
    first, second = index[both], index[both + 1]
    mixed = (doc[both] * base + first) * np.int64(-7046029254386353131) + second * np.int64(0x2545F4914F6CDD1D)
    order = np.lexsort((mixed, doc[both]))
    d, m = doc[both][order], mixed[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
    return np.bincount(d[fresh], minlength=n)


@dataclass
class AdditiveModel:
    """Bin edges and tables of contributions; a score is a sum of looked-up entries."""

    constant: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _step(g: np.ndarray, h: np.ndarray, least: float, ridge: float, depth: int) -> np.ndarray:
    """A tree over ordered bins: up to 2**depth ranges, each with its Newton step."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if left and b - a > 1:
            gl, hl = gs[:-1], hs[:-1]
            gr, hr = gs[-1] - gl, hs[-1] - hl
            gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge), -1.0)
            at = int(gain.argmax())
            if gain[at] > _gain(gs[-1], hs[-1], ridge) + 1e-9:
                grow(a, a + at + 1, left - 1)
                grow(a + at + 1, b, left - 1)
                return
        out[a:b] = -gs[-1] / (hs[-1] + ridge)

    grow(0, len(g), depth)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of two cuts, one along each feature of a pair (four cells), and its gain."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    g1, h1 = gs[:-1, :-1], hs[:-1, :-1]
    g2, h2 = gs[:-1, -1:] - g1, hs[:-1, -1:] - h1
    g3, h3 = gs[-1:, :-1] - g1, hs[-1:, :-1] - h1
    g4, h4 = gs[-1, -1] - g1 - g2 - g3, hs[-1, -1] - h1 - h2 - h3
    gain = sum(_gain(a, b, ridge) for a, b in ((g1, h1), (g2, h2), (g3, h3), (g4, h4)))
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        cell = h[rows, cols].sum()
        if cell >= least:
            out[rows, cols] = -g[rows, cols].sum() / (cell + ridge)
    return out, float(gain[i, j] - _gain(gs[-1, -1], hs[-1, -1], ridge))


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, cycles: int = 120, pair_cycles: int = 40, n_pairs: int = 6, rate: float = 0.15, depth: int = 2, least: float = 1.0, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of shallow trees into tables: single features first, then the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    f = x.shape[1]
    cuts = lambda col, k: np.unique(np.quantile(col, np.arange(1, k) / k)) if len(col) else np.zeros(0)
    edges, coarse = [cuts(x[:, k], bins) for k in range(f)], [cuts(x[:, k], coarse_bins) for k in range(f)]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if not 0 < y.sum() < len(y):
        return model
    code = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(f)]
    odds = np.full(len(y), model.constant)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(cycles):
        for k in range(f):
            g, h = slopes()
            n = len(edges[k]) + 1
            step = rate * _step(np.bincount(code[k], g, n), np.bincount(code[k], h, n), least, ridge, depth)
            model.tables[k] += step
            odds += step[code[k]]
    low = [np.searchsorted(coarse[k], x[:, k], side="right") for k in range(f)]

    def cells(a, b, v):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(low[a] * shape[1] + low[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    strength = sorted(((-_pair_step(cells(a, b, g), cells(a, b, h), least, ridge)[1], a, b) for a in range(f) for b in range(a + 1, f)))
    model.pairs = [(a, b) for s, a, b in strength[:n_pairs] if s < 0]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_step(cells(a, b, g), cells(a, b, h), least, ridge)[0]
            table += step
            odds += step[low[a], low[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on at most ``max_labelled`` training rows; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label, id, text, max_labelled)
    features = Features()

    def measure(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features.matrix(column(batch, "text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([flat, column(batch, "label")], names=["x", "label"])

    rows = sample.mapInArrow(measure, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_additive(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that each text is good."""
    features = Features()
    made = lambda batch: [pa.array(model.scores(features.matrix(column(batch, text))), pa.float64())]
    return append(docs, text, [T.StructField(score_col, T.DoubleType())], made)
