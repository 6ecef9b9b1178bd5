"""Toxicity by weak supervision.

Many voters, stems and patterns, look at a text.  Stems are mined from labelled training rows:
word beginnings whose presence goes with the label beyond chance, corrected for the number of
stems looked at.  A generative label model (two latent classes, fitted by expectation
maximisation on the votes alone) estimates how often each voter fires in either class; voters
whose votes still correlate inside the classes are grouped, and a group shares one vote.  Its
posteriors train a logistic regression over the votes, which scores every text.

Defined cases: a null or empty text has no votes and gets the score of that; a null label row is
not used; repeated label rows count once (largest label); without both classes among the labels
only the fixed lexicon votes, with fixed rates; an empty table gives an empty result; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicscope.llm.frames import append, chunks, column, held_out, reach, slices, stored

#: Words that vote without having been mined.
LEXICON = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown"]
#: Lengths of the word beginnings that are looked at, besides whole words.
STEM_LENGTHS = (4, 5, 6, 7, 8)
PATTERNS = ["two stems", "five hits", "one hit in 50 words", "shouted hit"]
MAX_LABELLED = 12_000
MAX_STEMS = 400
_WORD = re.compile(r"[^\W_]+")


def _stems(chunk: str) -> set[str]:
    found = set()
    for word in _WORD.findall(chunk.lower()):
        found.add(word + "$")
        found.update(word[:n] for n in STEM_LENGTHS if len(word) >= n)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` training rows (id, text, label), chosen by a hash of the id; never a held-out one."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(id)).groupBy(id).agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64(id), id).limit(max_labelled)
    return stored(docs.select(id, text).join(F.broadcast(chosen), id).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col("label").cast("int").alias("label")))


def mine_stems(sample: DataFrame, max_stems: int = MAX_STEMS) -> list[str]:
    """Stems that go with label 1 beyond chance, strongest first."""
    reach(sample.sparkSession)

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, index, words = chunks(column(batch, "text"))
                label = column(batch, "label").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                pairs = np.unique(index * batch.num_rows + doc)
                ends = np.searchsorted(pairs // batch.num_rows, np.arange(len(words) + 1))
                where: dict[str, list] = {}
                for k, word in enumerate(words):
                    for stem in _stems(word):
                        where.setdefault(stem, []).append(pairs[ends[k] : ends[k + 1]] % batch.num_rows)
                names, bad, good = [], [], []
                for stem, parts in where.items():
                    rows = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
                    names.append(stem)
                    bad.append(int(label[rows].sum()))
                    good.append(len(rows) - bad[-1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["stem", "bad", "good"])

    size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    total, bad = size["n"], size["bad"] or 0
    if not bad or bad == total:
        return []
    every = stored(sample.mapInArrow(count, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    looked_at = every.count()
    counted = every.filter(F.col("bad") >= 4).withColumn("n", F.col("bad") + F.col("good"))
    base = bad / total
    share = F.col("bad") / F.col("n")
    gain = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    kept = counted.filter((share >= 0.9) & (gain >= float(np.log(looked_at) + 3))).orderBy(gain.desc(), "stem").limit(max_stems)
    return [r["stem"] for r in kept.select("stem").collect()]


class Voters:
    """Votes of stems and patterns on Arrow batches of texts."""

    def __init__(self, stems: list[str]):
        self.stems = list(dict.fromkeys([w + "$" for w in LEXICON] + stems))
        self.size = len(self.stems) + len(PATTERNS)
        self._place = {s: i for i, s in enumerate(self.stems)}
        self._seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.stems

    def __setstate__(self, stems):
        self.__init__(stems)

    def _hits(self, chunk: str) -> tuple[int, ...]:
        found = self._seen.get(chunk)
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            found = self._seen[chunk] = tuple(sorted(self._place[s] for s in _stems(chunk) if s in self._place))
        return found

    def votes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter) pairs, each once, ordered by row."""
        offsets, index, words = chunks(texts)
        hits = [self._hits(w) for w in words]
        any_hit = np.array([bool(h) for h in hits])
        at = np.flatnonzero(any_hit[index]) if len(words) else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, at, side="right") - 1
        word = index[at]
        many = np.array([len(h) for h in hits], np.int64)[word] if len(at) else np.zeros(0, np.int64)
        flat = np.array([v for w in word.tolist() for v in hits[w]], np.int64)
        stem_pairs = np.unique(np.repeat(row, many) * self.size + flat)
        n_rows = len(offsets) - 1
        n_hits = np.bincount(row, minlength=n_rows)
        n_words = np.diff(offsets)
        shouted = np.array([w.isupper() for w in words])[word] if len(at) else np.zeros(0, bool)
        kinds = np.bincount(np.unique(row * (len(words) + 1) + word) // (len(words) + 1), minlength=n_rows) if len(at) else n_hits
        first = len(self.stems)
        flags = [kinds >= 2, n_hits >= 5, (n_hits > 0) & (n_hits * 50 >= n_words), np.bincount(row[shouted], minlength=n_rows) > 0]
        extra = [np.flatnonzero(f) * self.size + first + k for k, f in enumerate(flags)]
        pairs = np.unique(np.concatenate([stem_pairs, *extra]))
        return pairs // self.size, pairs % self.size


@dataclass
class LabelModel:
    """Rates at which voters fire in either class, and the weight each keeps beside its correlates."""

    prior: float
    fires: np.ndarray  # voters x 2: in clean, in toxic texts
    share: np.ndarray  # 1 / size of the group of correlated voters
    groups: np.ndarray
    history: list = field(default_factory=list)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.share * np.log(self.fires[:, 1] / self.fires[:, 0]))
        odds = odds + (1 - votes) @ (self.share * np.log((1 - self.fires[:, 1]) / (1 - self.fires[:, 0])))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 12, correlated: float = 0.6) -> LabelModel:
    """Expectation maximisation over 0/1 votes (texts x voters); groups follow residual correlations."""
    n, m = votes.shape
    prior = float(np.clip(prior, 0.01, 0.6))
    model = LabelModel(prior, np.tile([0.005, 0.2], (m, 1)), np.ones(m), np.arange(m))
    for step in range(rounds):
        p = model.posterior(votes)
        toxic, clean = p.sum(), (1 - p).sum()
        fires = np.stack([((1 - p) @ votes + 0.02) / (clean + 4), (p @ votes + 0.5) / (toxic + 4)], axis=1)
        fires = np.clip(fires, 1e-4, 0.99)
        fires[:, 1] = np.maximum(fires[:, 1], fires[:, 0])  # no voter speaks for clean texts
        model.fires = fires
        if step in (3, 7):
            rest = votes - np.outer(p, fires[:, 1]) - np.outer(1 - p, fires[:, 0])
            scale = np.sqrt((rest**2).sum(0)) + 1e-9
            together = (rest.T @ rest) / np.outer(scale, scale) > correlated
            groups = np.arange(m)
            for _ in range(m):  # smallest index reachable through correlations
                lower = np.where(together, groups[None, :], m).min(1)
                lower = np.minimum(lower, groups)
                if (lower == groups).all():
                    break
                groups = lower
            model.groups, model.share = groups, 1 / np.bincount(groups, minlength=m)[groups]
        model.history.append(float(p.mean()))
    return model


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last weight is the constant."""
    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, voter = self.voters.votes(texts)
        odds = self.weights[-1] + np.bincount(row, self.weights[voter], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Mine voters, fit the label model on their votes and the classifier on its posteriors.

    What reaches the driver is bounded by ``max_labelled`` rows of votes and ``max_stems`` stems.
    """
    sample = labelled_sample(docs, labels, label, id, text, max_labelled)
    voters = Voters(mine_stems(sample))

    def vote(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                row, voter = voters.votes(column(batch, "text"))
                cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(voter, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, column(batch, "label")], names=["votes", "label"])

    rows = sample.mapInArrow(vote, "votes array<int>, label int").collect()
    votes = np.zeros((len(rows), voters.size))
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = 1
    share = float(np.mean([r["label"] for r in rows])) if rows else 0.0
    if not 0 < share < 1:
        weights = np.zeros(voters.size + 1)
        weights[: len(LEXICON)], weights[-1] = 4.0, -3.0
        return ToxicityModel(voters, weights)
    model = fit_label_model(votes, share)
    return ToxicityModel(voters, fit_linear(votes, model.posterior(votes)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the toxicity of each text, 0 to 1."""
    made = lambda batch: [pa.array(model.scores(column(batch, text)), pa.float64())]
    return append(docs, text, [T.StructField(score_col, T.DoubleType())], made)
