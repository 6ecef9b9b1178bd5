"""Near duplicates by order MinHash, verified by banded alignment.

A text is its words (lower case, letters and digits); its k-mers are runs of five words, each
labelled with how often it occurred before in the text, so that all are different.  One sketch
takes the k-mers with the smallest hashes and keeps them in text order; texts that agree in one
of ``SKETCHES`` sketches are candidates.  Texts with the same words are one candidate only.

Similarity is aligned k-mers over all k-mers: a pair's k-mers are aligned inside a band (the
longest common subsequence, no further off the diagonal than the allowed number of unaligned
k-mers), and matched / (n1 + n2 - matched) must reach ``THRESHOLD``.  Labels play no part in it:
a repeated k-mer may be aligned with any occurrence.  The chain of labelled k-mers is never
longer and is looked at first, since it is cheap.

Inside a group of candidates, pairs already in one class are not compared again, others are first
compared by length, then by the number of common k-mers, which bounds the aligned number; both
are exact, whatever the size of the group.
Groups with the same members are handled once; a group too large for one task is cut into
blocks, and every pair of blocks is compared, so no candidate pair is left out.

A pair of similarity 0.8 shares no sketch with probability about 0.36**12 = 5e-6.

Defined cases: null text counts as empty; texts without words are alike only if equal; texts of
fewer than five words have one k-mer, all their words; rows that share an id share a class; rows
with a null id are not compared, each comes back with a null class; extra columns play no part;
empty in, empty out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicscope.llm.frames import chunks, column, reach, slices, spread, stored, whole_text
from civicscope.llm.graph import components

K = 5
THRESHOLD = 0.8
SKETCHES = 12
MINIMA = 2
#: A block of a group holds about so many texts and words at most.
BLOCK_TEXTS, BLOCK_WORDS = 2048, 4_000_000
#: K-mers of a text that are aligned at a time.
ROWS = 1024
_WORD = re.compile(r"[^\W_]+")
_SEEDS = np.array([xxhash.xxh64_intdigest(b"sketch", seed=i) for i in range(256)], np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that scatters them (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of Arrow batches of texts."""

    def __init__(self):
        self._seen: dict[str, bytes] = {}

    def __reduce__(self):
        return (Words, ())

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's words and the 32-bit hash of each word."""
        offsets, index, found = chunks(texts)
        if len(self._seen) > 300_000:
            self._seen.clear()
        seen, parts = self._seen, []
        for chunk in found:
            h = seen.get(chunk)
            if h is None:
                h = b"".join(xxhash.xxh32_digest(w)[::-1] for w in _WORD.findall(chunk.lower()))
                if len(chunk) < 64:
                    seen[chunk] = h
            parts.append(h)
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        blob = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(lengths) - lengths
        per = lengths[index]
        flat = blob[spread(starts[index], per)] if len(per) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(per)])[offsets], flat


def kmers(words: np.ndarray, offsets: np.ndarray, k: int = K, labelled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's k-mers, in text order; occurrence-labelled unless told not to."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = spread(offsets[:-1], counts)
    last = np.repeat(offsets[1:], counts) - 1
    value = np.repeat(np.minimum(n, k), counts).astype(np.uint64)
    for j in range(k):
        word = words[np.minimum(at + j, last)].astype(np.uint64)
        value = np.where(at + j <= last, mix(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    if not labelled:
        return ends, value
    doc = np.repeat(np.arange(len(n)), counts)
    apart = mix(value + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(apart, kind="stable")
    same = apart[order]
    new = np.ones(len(same), bool)
    new[1:] = same[1:] != same[:-1]
    run = np.flatnonzero(new)
    label = np.zeros(len(same), np.uint64)
    label[order] = (np.arange(len(same)) - np.repeat(run, np.diff(np.append(run, len(same))))).astype(np.uint64)
    return ends, mix(value + label * np.uint64(0xA0761D6478BD642F))


def sketches(keys: np.ndarray, offsets: np.ndarray, n: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """n sketches per text; the rows of texts without k-mers are 0."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, n), np.int64)
    if not len(full):
        return out
    starts, counts = offsets[full], np.diff(offsets)[full]
    for s in range(n):
        value = mix(keys ^ _SEEDS[s])
        places = []
        for _ in range(minima):
            low = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(low, counts))
            owner = np.searchsorted(starts, hit, side="right") - 1
            first = np.ones(len(owner), bool)
            first[1:] = owner[1:] != owner[:-1]
            places.append(hit[first])
            value[hit[first]] = _TOP
        places = np.sort(np.stack(places), axis=0)
        sketch = np.full(len(full), _SEEDS[s])
        for row in places:
            sketch = mix(sketch * np.uint64(0x9E3779B97F4A7C15) + keys[row])
        out[full, s] = sketch.view(np.int64)
    return out


def prepared(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, digest, n_words, keys): digest is equal for texts of the same words."""
    maker = Words()
    reach(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = whole_text(column(batch, "text"))
                offsets, words = maker.hashes(texts)
                raw = texts.to_pylist()
                digest = [
                    hashlib.md5(words[a:b].tobytes() if b > a else b"text" + raw[i].encode()).digest()
                    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                ]
                at, keys = kmers(words, offsets)
                sketch = sketches(keys, at)
                counts = np.where(np.diff(at) > 0, SKETCHES, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(sketch[np.diff(at) > 0].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(digest, pa.binary()), pa.array(np.diff(offsets), pa.int64()), lists], names=["id", "digest", "n_words", "keys"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, digest binary, n_words long, keys array<long>")


def common_subsequence(a: np.ndarray, b: np.ndarray, below: int, above: int) -> int:
    """Length of the longest common subsequence with matches at i - below <= j <= i + above only.

    Bit-parallel: a zero at j says that b[j] lengthens the subsequence.  Rows are taken ``ROWS`` at
    a time, with the columns that the band reaches; those before have no matches any more, those
    behind had none yet, so neither changes.
    """
    bits = np.ones(len(b), bool)
    for top in range(0, len(a), ROWS):
        rows = a[top : top + ROWS]
        lo, hi = max(0, top - below), min(len(b), top + len(rows) + above)
        if lo >= hi:
            continue
        names, row_of = np.unique(rows, return_inverse=True)
        place = np.searchsorted(names, b[lo:hi])
        place[names[np.minimum(place, len(names) - 1)] != b[lo:hi]] = len(names)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(names) + 1)).tolist()
        masks: list[int] = []
        for x, y in zip(cuts, cuts[1:]):
            if y - x == 1:
                masks.append(1 << int(order[x]))
            else:
                hit = np.zeros(hi - lo, bool)
                hit[order[x:y]] = True
                masks.append(int.from_bytes(np.packbits(hit, bitorder="little").tobytes(), "little"))
        full = (1 << (hi - lo)) - 1
        v = int.from_bytes(np.packbits(bits[lo:hi], bitorder="little").tobytes(), "little")
        window = (1 << (below + above + 1)) - 1
        for i, r in enumerate(row_of.tolist(), top):
            mask = masks[r]
            if not mask:
                continue
            left = i - below - lo  # first column of the row's band
            u = v & mask & (window << left if left >= 0 else window >> -left)
            if u:
                v = ((v + u) | (v - u)) & full
        bits[lo:hi] = np.unpackbits(np.frombuffer(v.to_bytes((hi - lo + 7) // 8, "little"), np.uint8), count=hi - lo, bitorder="little").astype(bool)
    return int(len(b) - bits.sum())


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two texts' k-mers, in text order, align to at least the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return False
    need = threshold / (1 + threshold) * (n + m)
    if np.array_equal(a, b):
        return True
    # so many k-mers of a and of b may stay unaligned, so a match is no further off the diagonal
    below, above = int(n - need + 1e-9), int(m - need + 1e-9)
    if below < 0 or above < 0:
        return False
    if len(np.unique(a)) < n or len(np.unique(b)) < m:
        return common_subsequence(a, b, below, above) >= need - 1e-9
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(both) < need - 1e-9:
        return False
    near = (i - j <= below) & (j - i <= above)
    i, j = i[near], j[near]
    order = np.argsort(i)
    j = j[order]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []  # longest increasing chain
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        return len(tails) >= need - 1e-9
    return len(j) >= need - 1e-9


def linked(words: np.ndarray, offsets: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what is similar in a block; between different sides if there are two.

    A text is compared with all texts before it that are not in its class yet, at once: by
    length and by the number of common k-mers; what is left is aligned.  Common k-mers are counted
    in the lists of texts of the own k-mers, or in those of the other texts if these are fewer.
    """
    ends, keys = kmers(words, offsets)
    sizes, n = np.diff(ends), len(offsets) - 1
    names = np.unique(keys, return_inverse=True)[1]

    def similar(i: int, j: int) -> bool:
        if aligned(keys[ends[i] : ends[i + 1]], keys[ends[j] : ends[j + 1]], threshold):
            return True
        bare = [kmers(words[offsets[x] : offsets[x + 1]], np.array([0, offsets[x + 1] - offsets[x]]), labelled=False)[1] for x in (i, j)]
        return any(len(np.unique(x)) < len(x) for x in bare) and aligned(*bare, threshold)

    order = np.argsort(names, kind="stable")
    holder = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]  # texts by k-mer, ascending
    per_name = np.bincount(names)
    starts = np.cumsum(per_name) - per_name
    before = np.empty(len(names), np.int32)  # texts before its own that hold a k-mer
    before[order] = np.arange(len(names)) - np.repeat(starts, per_name)
    del order
    cross = len(set(side.tolist())) > 1
    owner, marked, links = np.arange(n), np.zeros(int(names.max()) + 1, np.int32), []
    for i in range(1, n):
        fit = (owner[:i] != owner[i]) & (np.minimum(sizes[:i], sizes[i]) >= threshold * np.maximum(sizes[:i], sizes[i]))
        if cross:
            fit &= side[:i] != side[i]
        others = np.flatnonzero(fit)
        if not len(others):
            continue
        own = names[ends[i] : ends[i + 1]]
        per, shared = sizes[others], before[ends[i] : ends[i + 1]]
        if shared.sum() <= per.sum():
            common = np.bincount(holder[spread(starts[own], shared)], minlength=i)[others]
        else:
            marked[own] = 1
            common = np.add.reduceat(marked[names[spread(ends[others], per)]], np.cumsum(per) - per)
            marked[own] = 0
        enough = common >= threshold / (1 + threshold) * (per + sizes[i]) - 1e-9
        for j in others[enough][np.argsort(-common[enough], kind="stable")].tolist():
            if owner[i] != owner[j] and similar(i, j):
                low, high = sorted((owner[i], owner[j]))
                owner[owner == high] = low
                links.append((i, j))
    return links


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id): class_id is the smallest id among the near duplicates of a text, itself included.

    One row per id, and one per row with a null id: such rows are not compared and have no class.
    """
    spark = reach(docs.sparkSession)
    ready = stored(prepared(docs, id, text))
    kind = ready.schema["id"].dataType.simpleString()
    same = ready.filter("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n_words", "keys")).alias("r"))
    firsts = same.select("digest", F.col("r.id").alias("rep"), F.col("r.n_words").alias("n_words"), F.col("r.keys").alias("keys"))
    placed = firsts.select("rep", "n_words", F.explode("keys").alias("key"))
    groups = placed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_words").alias("words"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    groups = groups.filter("size > 1").groupBy("size", "words", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_TEXTS, F.col("words") / BLOCK_WORDS)).cast("int")
    members = stored(placed.join(groups.select("key", blocks.alias("blocks")), "key").select("key", "rep", "blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    members = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "rep", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    maker = Words()

    def contents(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, words = maker.hashes(column(batch, "text"))
                parts = [words[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(parts, pa.binary())], names=["rep", "content"])

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        reps, content = block.column("rep").combine_chunks(), block.column("content")
        words = np.frombuffer(b"".join(content.to_pylist()), "<u4")
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(content).to_numpy() // 4)]).astype(np.int64)
        links = linked(words, offsets, block.column("side").to_numpy(), threshold)
        take = lambda k: reps.take(pa.array([x[k] for x in links], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    wanted = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(members.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    worded = wanted.mapInArrow(contents, f"rep {kind}, content binary")
    edges = members.join(worded.hint("merge"), "rep").select("key", "lo", "hi", "rep", "side", "content").groupBy("key", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")
    classes = components(edges)
    named = firsts.select("digest", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    # min over rows that share an id but not their words
    out = ready.select("id", "digest").filter("id IS NOT NULL").join(named, "digest").groupBy("id").agg(F.min("class_id").alias("class_id"))
    nulls = ready.filter("id IS NULL").select("id", F.lit(None).cast(kind).alias("class_id"))
    return out.unionByName(nulls).select(F.col("id").alias(id), "class_id")
