"""Alignment of two tokenizers: which token ids of one stand for which of the other.

A text is cut before a space or line end that follows other text: both vocabularies have token
ends there (a byte-level pattern begins a new pre-token, and no piece holds a space or line end
after another character), so each distinct chunk is encoded and aligned once and a document is
the sequence of its chunks.  Byte offsets where tokens of both end cut them into groups; a link
is a pair of occurrences, one of each tokenizer, in the same group.

First pass: tasks count in how many of their documents each id pair is linked.  The distinct
pairs are dealt into shards of bounded size; each gets a minimal perfect hash.  The tasks' counts
become dense vectors indexed by that hash and are summed as a tree, ``FAN`` vectors at a time.
Second pass: documents are aligned again and their chunks' pairs looked up in the shards, whose
keys are verified.  Shards are files in the shared folder, of which a task holds ``OPEN`` at a
time, so nothing that grows with the pairs is broadcast; the highest count of each id of the
first vocabulary is one number per id.

Defined cases: null and empty texts, and texts whose tokens' bytes do not give the text again,
have no tokens (zeros and an empty digest) and count nowhere; null ids and repeated rows come
back one row each, every row counts as a document; very long texts are read whole; ties for an
id's highest count all count; only the id and the text are read, so other columns may have any
names; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicscope.llm.frames import column, reach, slices, spread, stored, whole_text
from civicscope.llm.pair_hash import PairHash, mixed
from civicscope.operators.relations import shared_folder

#: Pairs of a shard, about; rows of one leaf of the tree of sums, about; vectors summed at once.
SHARD, LEAF, FAN = 1 << 17, 1 << 18, 16
#: Shards that a task keeps open.
OPEN = 64
#: Chunks that a worker remembers; distinct pairs a task holds before it passes them on.
KEPT, HELD = 350_000, 1_500_000
#: Chunks that are encoded as one text; chunks that are encoded and aligned at once.
JOINED, LEARNT = 64, 8192
#: Text bytes aligned at once.
SLICE = 2 << 20
#: Shards are picked by so many bits of the mixed pair.
SLOTS = 1 << 16

#: White space as either side may see it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: White space beside a space or line end: such texts are cut by ``_CUT`` instead of a plain split.
_BESIDE = rf"{_SPACE}[ \n]|[ \n]{_SPACE}"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def slot(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, 63) >> np.uint64(48)).astype(np.int32)


class Aligner:
    """Aligned chunks, remembered; one per worker process and pair of vocabularies."""

    _own: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def get(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls._own:
            cls._own = {(a, b): cls(a, b)}
        return cls._own[a, b]

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁][▁ \n]|\n", p) for p in pieces):
            raise ValueError("a piece goes over a space or line end")
        spoken = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes = [pa.array([bytes(shown[c] for c in e) if all(c in shown for c in e) else e.encode() for e in entries], pa.binary()), pa.array(spoken, pa.binary())]
        self.lengths = [pc.binary_length(x).to_numpy().astype(np.int64) for x in self.bytes]
        self.names = [pa.array([str(k) for k in range(n)]) for n in (len(entries), len(pieces))]
        self.width = len(pieces)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.numbers = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes agree
        self.shown = pa.array([], pa.string())
        self.ends, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per tokenizer the number of ids of each text and all ids; which texts both give again in bytes."""
        one = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        skip = len(self.b.encode("."))
        two = [x[skip:] for x in self.b.encode(["." + t for t in texts], num_threads=1)]
        found = [(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(chain.from_iterable(x), np.int64)) for x in (one, two)]
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(texts), bool)
        for (n, ids), lengths in zip(found, self.lengths):
            run = np.concatenate([[0], np.cumsum(lengths[ids])])
            ends = np.cumsum(n)
            good &= run[ends] - run[ends - n] == sizes
        whole = np.frombuffer(b"".join(r for r, g in zip(raw, good.tolist()) if g), np.uint8)
        left = np.flatnonzero(good)  # their tokens have as many bytes as they
        bounds = np.cumsum(sizes[left])
        for (n, ids), table in zip(found, self.bytes):
            taken = table.take(pa.array(ids[np.repeat(good, n)])).buffers()[2]
            spoken = np.frombuffer(taken, np.uint8)[: len(whole)] if taken else np.zeros(0, np.uint8)
            good[left[np.searchsorted(bounds, np.flatnonzero(spoken != whole), side="right")]] = False
        return found, good

    def _tokens(self, chunks: list[str]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
        """The chunks in another order, whether the bytes of each agree, and the ids of all that do, of both tokenizers.

        Chunks that end in text are encoded ``JOINED`` at a time, as their joints are token ends.
        """
        joint = [c for c in chunks if not c[-1].isspace()]
        groups = [joint[k : k + JOINED] for k in range(0, len(joint), JOINED)]
        found, good = self._encoded(["".join(g) for g in groups])
        ordered = [c for g, ok in zip(groups, good.tolist()) if ok for c in g]
        ids = [x[np.repeat(good, n)] for n, x in found]
        alone = [c for c in chunks if c[-1].isspace()] + [c for g, ok in zip(groups, good.tolist()) if not ok for c in g]
        agree = np.ones(len(ordered) + len(alone), bool)
        if alone:
            found, good = self._encoded(alone)
            agree[len(ordered) :] = good
            ids = [np.concatenate([old, x[np.repeat(good, n)]]) for old, (n, x) in zip(ids, found)]
        return ordered + alone, agree, ids

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks that are not known yet, ``LEARNT`` at a time: the tokenizers' own objects take far more room than what is kept."""
        if not chunks:
            return
        made = [self._aligned(chunks[k : k + LEARNT]) for k in range(0, len(chunks), LEARNT)]
        names, numbers, shown, bounds, keys, times = zip(*made)
        base = len(self.place)
        self.place.update(zip(chain.from_iterable(names), range(base, base + len(chunks))))
        self.numbers = np.concatenate([self.numbers, *numbers], axis=1)
        self.shown = pa.concat_arrays([self.shown, *shown])
        starts = self.ends[-1] + np.cumsum([0, *map(len, keys)])
        self.ends = np.concatenate([self.ends, *[b + s for b, s in zip(bounds, starts.tolist())]])
        self.pairs, self.times = np.concatenate([self.pairs, *keys]), np.concatenate([self.times, *times])

    def _aligned(self, chunks: list[str]) -> tuple[list[str], np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The chunks in another order, their numbers and groups as text, where the pairs of each end, all pairs and their times."""
        new, good, ids = self._tokens(chunks)
        count = len(new)
        sizes = np.fromiter((len(c.encode()) for c in new), np.int64, count) * good
        last = np.cumsum(sizes)  # where each chunk ends; one whose bytes differ has no room
        ends = [np.cumsum(lengths[x]) for x, lengths in zip(ids, self.lengths)]
        owner = [np.searchsorted(last, e) for e in ends]
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        if not np.isin(last[good], cuts).all():
            raise ValueError("a token goes over the end of a chunk")
        group = [np.searchsorted(cuts, e) for e in ends]
        n_in = [np.bincount(g, minlength=len(cuts)) for g in group]
        of = np.searchsorted(last, cuts)  # a group ends inside its chunk or with it
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), names.take(pa.array(x))) for k, names, x in zip(n_in, self.names, ids)]
        shown = pc.binary_join_element_wise(*[pc.binary_join(x, ",") for x in lists], "|")
        per = np.bincount(of, minlength=count)
        chunk_shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), shown), ";")
        # Distinct ids of each group with their times, then all pairs of these.
        (ga, ia, ta), (gb, ib, tb) = (self._counted(g, x) for g, x in zip(group, ids))
        na, nb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        at_b = np.cumsum(nb) - nb
        left = np.repeat(np.arange(len(ga)), nb[ga])
        right = spread(at_b[ga], nb[ga])
        keys, times = ia[left] * self.width + ib[right], ta[left] * tb[right]
        chunk = of[ga[left]]  # in order of chunks, as groups are
        bounds = np.cumsum(np.bincount(chunk, minlength=count))
        links = np.bincount(of, weights=(n_in[0] * n_in[1]).astype(np.float64), minlength=count).astype(np.int64)
        numbers = np.stack([*[np.bincount(o, minlength=count) for o in owner], per, links, good])
        return new, numbers, chunk_shown, bounds, keys, times

    @staticmethod
    def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, times = np.unique((group << 24) + ids, return_counts=True)
        return both >> 24, both & 0xFFFFFF, times

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the texts' chunks, the chunks' numbers, and which texts have tokens."""
        texts = whole_text(texts)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        led = pc.binary_join_element_wise("", texts, " ")
        odd = pc.match_substring_regex(led, _BESIDE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(led.filter(pa.array(~odd)), "\n", " \n"), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        plain = [p if p[:1] == "\n" else " " + p for p in pieces]
        rare = [_CUT.split(t) for t in led.filter(pa.array(odd)).to_pylist()]
        distinct = list(dict.fromkeys(chain(plain, chain.from_iterable(rare))))
        if len(self.place) > KEPT or len(distinct) > KEPT:
            self.forget()
        self.learn([c for c in distinct if c not in self.place])
        number = self.place
        table = np.fromiter((number[c] for c in plain), np.int64, len(plain))
        n = np.zeros(len(texts), np.int64)
        n[~odd] = np.diff(at) - 1  # what stands before the leading space is no chunk
        n[odd] = [len(r) for r in rare]
        offsets = np.concatenate([[0], np.cumsum(n)])
        index = np.zeros(int(offsets[-1]), np.int64)
        easy = np.flatnonzero(~odd)
        index[spread(offsets[easy], n[easy])] = table[codes[spread(at[:-1] - at[0] + 1, n[easy])]]
        hard = np.flatnonzero(odd)
        index[spread(offsets[hard], n[hard])] = np.fromiter((number[c] for c in chain.from_iterable(rare)), np.int64)
        bad = np.concatenate([[0], np.cumsum(self.numbers[4][index] == 0)])
        return offsets, index, ~empty & (bad[offsets[1:]] == bad[offsets[:-1]])

    def pairs_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct pairs of each chunk's groups, and their places."""
        n = self.ends[chunks + 1] - self.ends[chunks]
        return n, spread(self.ends[chunks], n)


def _counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pair_documents(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(task, slot, pair, n): in how many documents of a task an id pair is linked."""
    reach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task = Aligner.get(a, b), TaskContext.get().partitionId()
        span = len(aligner.names[0]) * aligner.width
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            keys, n = _counts(parts)
            made = pa.Table.from_arrays([pa.array(np.full(len(keys), task, np.int32)), pa.array(slot(keys)), pa.array(keys), pa.array(n)], names=["task", "slot", "pair", "n"])
            yield from made.to_batches(max_chunksize=100_000)

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                offsets, index, good = aligner.documents(column(batch, "text"))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                keep = good[doc]
                seen = np.unique(doc[keep] * len(aligner.place) + index[keep])
                doc, chunk = np.divmod(seen, max(1, len(aligner.place)))
                n, at = aligner.pairs_of(chunk)
                held = np.unique(np.repeat(doc, n) * span + aligner.pairs[at]) % span
                parts.append(np.unique(held, return_counts=True))
                if sum(len(p[0]) for p in parts) > 2 * HELD:
                    parts = [_counts(parts)]
                    if len(parts[0][0]) > HELD:
                        yield from emit()
                        parts = []
        if parts:
            yield from emit()

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "task int, slot int, pair long, n long")


def _vector(n: np.ndarray) -> bytes:
    return n.astype("<i8").tobytes()


def pair_table(partial: DataFrame) -> DataFrame:
    """(shard, shards, sizes, words, keys, counts) of all pairs: hash functions and dense counts."""
    rows = partial.count()
    pairs = stored(partial.select("slot", "pair").distinct())
    bits = min(16, max(0, math.ceil(math.log2(max(1, pairs.count() / SHARD)))))
    shard = F.shiftright("slot", 16 - bits)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = PairHash.of(frame["pair"].to_numpy())
        sizes, words, keys = made.dump()
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "sizes": [sizes], "words": [words], "keys": [keys]})

    shape = "shard int, sizes binary, words binary, keys binary"
    functions = stored(pairs.select(shard.alias("shard"), "pair").groupBy("shard").applyInPandas(build, shape))

    branches = max(1, math.ceil(rows / (LEAF << bits)))
    leaves = partial.select(shard.alias("shard"), (F.col("task") % branches).alias("branch"), "pair", "n")
    copies = functions.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))

    def leaf(counts: pd.DataFrame, function: pd.DataFrame) -> pd.DataFrame:
        if not len(counts):
            return pd.DataFrame({"shard": [], "branch": [], "counts": []})
        own = function.iloc[0]
        made = PairHash.load(own["sizes"], own["words"], own["keys"])
        total = np.zeros(len(made.keys), np.int64)
        np.add.at(total, made.index(counts["pair"].to_numpy()), counts["n"].to_numpy())
        return pd.DataFrame({"shard": [own["shard"]], "branch": [own["branch"]], "counts": [_vector(total)]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in frame["counts"])
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "branch": frame["branch"].iloc[:1], "counts": [_vector(total)]})

    vectors = leaves.groupBy("shard", "branch").cogroup(copies.groupBy("shard", "branch")).applyInPandas(leaf, "shard int, branch int, counts binary")
    while branches > 1:
        branches = -(-branches // FAN)
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy("shard", "branch").applyInPandas(summed, "shard int, branch int, counts binary")
    return functions.join(vectors.drop("branch"), "shard").withColumn("shards", F.lit(1 << bits))


class Shards:
    """Counts of pairs from the files of ``pair_table``, a bounded number of shards at a time."""

    def __init__(self, folder: str):
        store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        parts = ds.partitioning(pa.schema([("shard", pa.int32())]), flavor="hive")
        self.files = ds.dataset(root, filesystem=store, format="parquet", partitioning=parts)
        self.open: OrderedDict[int, tuple[PairHash, np.ndarray]] = OrderedDict()
        self.shift = None

    def _shard(self, k: int) -> tuple[PairHash, np.ndarray]:
        if k not in self.open:
            row = self.files.to_table(columns=["sizes", "words", "keys", "counts"], filter=ds.field("shard") == k).to_pylist()[0]
            if len(self.open) >= OPEN:
                self.open.popitem(last=False)
            self.open[k] = PairHash.load(row["sizes"], row["words"], row["keys"]), np.frombuffer(row["counts"], "<i8")
        self.open.move_to_end(k)
        return self.open[k]

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return np.zeros(0, np.int64)
        if self.shift is None:
            shards = self.files.head(1, columns=["shards"])["shards"][0].as_py()
            self.shift = 16 - (shards.bit_length() - 1)
        distinct, back = np.unique(pairs, return_inverse=True)
        out, shard = np.zeros(len(distinct), np.int64), slot(distinct) >> self.shift
        for k in np.unique(shard).tolist():
            mine = shard == k
            function, counts = self._shard(k)
            at = function.index(distinct[mine])
            if (at < 0).any():
                raise ValueError("a linked pair is not in the table")
            out[mine] = counts[at]
        return out[back]


def align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: tokens of both, groups, links, links to an id's most frequent partner, sum of counts.

    ``a`` is the file of a byte-level BPE (tokenizers), ``b`` a sentencepiece model that adds the
    leading space itself.  ``with_groups`` adds the groups as text, 'a1,a2|b1;a3|b2,b3'.
    """
    spark = reach(docs.sparkSession)
    table = pair_table(stored(pair_documents(docs, a, b, text)))
    folder = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    table.write.partitionBy("shard").parquet(folder)
    sharded = spark.read.parquet(folder) if has_files(spark, folder) else None
    width = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    best = highest(sharded, width, max(Tokenizer.from_file(a).get_vocab().values()) + 1)
    kind = docs.schema[id].dataType.simpleString()
    extra = ["groups"] if with_groups else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, shards, known = Aligner.get(a, b), None, np.zeros((2, 0), np.int64)
        generation = None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                offsets, index, good = aligner.documents(column(batch, "text"))
                if generation is not aligner.place:  # the worker's chunks have been numbered anew
                    generation, known = aligner.place, np.full((2, 0), -1, np.int64)
                if known.shape[1] < len(aligner.place):
                    known = np.concatenate([known, np.full((2, len(aligner.place) - known.shape[1]), -1, np.int64)], axis=1)
                used = index[np.repeat(good, np.diff(offsets))]
                fresh = np.unique(used[known[0][used] < 0])
                if len(fresh):
                    shards = shards or Shards(folder)
                    n, at = aligner.pairs_of(fresh)
                    pairs, times = aligner.pairs[at], aligner.times[at]
                    counts = shards.counts(pairs)
                    bounds = np.concatenate([[0], np.cumsum(n)])
                    for row, values in enumerate((times * (counts == best[pairs // width]), times * counts)):
                        run_ = np.concatenate([[0], np.cumsum(values)])
                        known[row][fresh] = run_[bounds[1:]] - run_[bounds[:-1]]
                sums = []
                for values in [*aligner.numbers[:4], *known]:
                    run_ = np.concatenate([[0], np.cumsum(values[index])])
                    sums.append(np.where(good, run_[offsets[1:]] - run_[offsets[:-1]], 0))
                shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), aligner.shown.take(pa.array(index))), ";")
                digests = [hashlib.sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(shown.cast(pa.binary()), good.tolist())]
                columns = [column(batch, "id"), *[pa.array(x) for x in sums], pa.array(digests, pa.string())]
                if with_groups:
                    columns.append(pc.if_else(pa.array(good), shown, ""))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *extra])

    shape = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    out = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, shape)
    return out.withColumnRenamed("id", id)


def has_files(spark, folder: str) -> bool:
    """Whether any shard was written; without linked pairs the folder has no part to read a schema from."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path").limit(1).count() > 0


def highest(table: DataFrame | None, width: int, size: int) -> np.ndarray:
    """The highest count of each id of the first vocabulary: ``size`` numbers, whatever the data."""
    best = np.zeros(size, np.int64)
    if table is None:
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(column(batch, "keys"), column(batch, "counts")):
                ids, n = np.frombuffer(keys.as_buffer(), "<i8") // width, np.frombuffer(counts.as_buffer(), "<i8")
                own, back = np.unique(ids, return_inverse=True)
                top = np.zeros(len(own), np.int64)
                np.maximum.at(top, back, n)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(top)], names=["id", "n"])

    for row in table.select("keys", "counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.max("n").alias("n")).collect():
        best[row["id"]] = row["n"]
    return best
