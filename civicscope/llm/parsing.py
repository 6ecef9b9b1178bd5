"""Fingerprints by locally consistent parsing.

A text is a sequence of code points, the names of level 0.  A level turns runs of one name into
one name each, so that neighbours differ, then tosses deterministic coins: a position's label is
the lowest bit in which its name differs from its left neighbour's, with the value of that bit.
Four tosses leave six labels, of which neighbours still differ; positions with a local maximum
begin a phrase, and a phrase's name, a hash of its names, is a symbol of the next level.  What a
phrase is depends only on few symbols around it, so equal substrings have equal phrases inside,
wherever they stand.

The fingerprint holds, for level ``TOP`` and, where a text has few phrases there, the levels
below, the ``KEPT`` smallest hashes of its distinct phrases.  Likeness of two fingerprints is
the share of phrases in common (Dice), estimated from the smallest hashes of the union on the
highest level where both have enough.  Equal texts have equal fingerprints; the standard error
of the estimate is at most 0.05.

Defined cases: null text counts as empty, its fingerprint is empty, likeness to another empty one
is 1 and to any other 0; a document alone in its table is its own next one; rows of one id
are ordered by text; rows with a null id have no place in the order and an empty next text;
extra columns play no part; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicscope.llm.frames import reach, slices, whole_text
from civicscope.llm.order_minhash import mix

TOP, LEVELS = 3, (3, 2, 1)
KEPT = 128
ENOUGH, FEW = 32, 8
#: Documents of a bucket of the order, and the largest number of buckets.
BUCKET, MOST_BUCKETS = 1000, 1 << 16
_SLICE = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One deterministic coin toss; ``first`` marks positions without a left neighbour."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    differ = names ^ left
    low = differ & (~differ + np.array(1, names.dtype))
    place = np.bitwise_count(low - np.array(1, names.dtype))
    return (place * 2 + ((names & low) != 0)).astype(np.uint8)


def next_level(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of every text, from the names one level below (64-bit)."""
    n = len(names)
    if not n:
        return names, offsets
    full = np.diff(offsets) > 0
    first = np.zeros(n, bool)
    first[offsets[:-1][full]] = True
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    starts = np.flatnonzero(new)
    if len(starts) < n:
        length = np.diff(np.append(starts, n)).astype(np.uint64)
        names = names[starts]
        long = length > 1
        names[long] = mix(names[long] + length[long] * np.uint64(0xD6E8FEB86659FD93))
        first = first[starts]
        offsets = np.searchsorted(starts, offsets)
        n = len(names)
    labels = toss(names, first)
    for _ in range(3):
        labels = toss(labels, first)
    before = np.zeros(n, np.uint8)
    before[1:] = labels[:-1]
    after = np.zeros(n, np.uint8)
    after[:-1] = labels[1:]
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    before[first] = 255
    after[last] = 255
    starts = np.flatnonzero(first | ((labels > before) & (labels > after)))
    within = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    mixed = mix(names + (within + 1).astype(np.uint64) * _STEP)
    return mix(np.add.reduceat(mixed, starts)), np.searchsorted(starts, offsets)


def phrases(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names and offsets of the levels 1 to TOP."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    names, levels = data.astype(np.uint64), []
    for _ in range(TOP):
        names, offsets = next_level(names, offsets)
        levels.append((names, offsets))
    return levels


def fingerprints(texts: list[str]) -> list[str]:
    """One string per text: levels from TOP down, each its smallest hashes in hexadecimal."""
    levels = phrases(texts)
    out: list[list[str]] = [[] for _ in texts]
    done = [False] * len(texts)
    for level in LEVELS:
        names, offsets = levels[level - 1]
        if level == TOP or not all(done):
            hashes = (mix(names ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(">u4")
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if a < b and not done[i]:
                    own = np.unique(hashes[a:b])
                    out[i].append(f"{level}:" + own[:KEPT].tobytes().hex())
                    done[i] = len(own) >= ENOUGH
    return [";".join(parts) for parts in out]


def _read(fingerprint: str) -> dict[str, np.ndarray]:
    return {p[0]: np.frombuffer(bytes.fromhex(p[2:]), ">u4") for p in fingerprint.split(";") if p}


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _read(a), _read(b)
    common = [str(k) for k in LEVELS if str(k) in x and str(k) in y]
    level = next((k for k in common if min(len(x[k]), len(y[k])) >= FEW), common[-1])
    p, q = x[level], y[level]
    union = np.union1d(p, q)
    if len(p) >= KEPT or len(q) >= KEPT:  # beyond the smaller maximum a full sketch says nothing
        limit = min(int(s[-1]) for s in (p, q) if len(s) >= KEPT)
        union = union[union <= limit]
    both = np.intersect1d(p, q, assume_unique=True)
    share = np.isin(union, both, assume_unique=True).sum() / max(len(union), 1)
    return float(2 * share / (1 + share))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(bucket, id, text, ghost) partitioned by buckets of ascending ids and sorted inside.

    The first document of the next bucket stands once more, as a ghost, at a bucket's end; the
    last bucket ends with the first document of all.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    known = docs.filter("id IS NOT NULL")
    n = known.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET)))
    cuts = known.approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.1 / buckets) if buckets > 1 else [0.0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placer = Bucketizer(splits=splits, inputCol="_value", outputCol="bucket")
    placed = placer.transform(known.withColumn("_value", F.col("id").cast("double"))).drop("_value")
    heads = sorted((r["bucket"], r["id"]) for r in placed.groupBy("bucket").agg(F.min("id").alias("id")).collect())
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    ghosts = spark.createDataFrame([(heads[k][1], heads[k - 1][0]) for k in range(len(heads))], f"id {kind}, bucket double")
    ghost_rows = known.join(F.broadcast(ghosts), "id").select("bucket", "id", "text", F.lit(1).alias("ghost"))
    alone = docs.filter("id IS NULL").select((-1 - F.pmod(F.xxhash64("text"), F.lit(1024))).cast("double").alias("bucket"), "id", "text", F.lit(0).alias("ghost"))
    rows = placed.select("bucket", "id", "text", F.lit(0).alias("ghost")).unionByName(ghost_rows).unionByName(alone)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ghost", "id", "text")


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one, and their likeness."""
    reach(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last row, whose next one has not come

        def rows(part: list[tuple]) -> pa.RecordBatch:
            """part: (id, text, next text, own print, next print)"""
            changed = [edited(p[1], p[2]) for p in part]
            after = fingerprints(changed)
            columns = [
                pa.array([p[0] for p in part]).cast(schema_id), pa.array([len(p[1]) for p in part], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array([p[3] for p in part], pa.string()), pa.array(after, pa.string()),
                pa.array([likeness(p[3], a) for p, a in zip(part, after)], pa.float64()),
                pa.array([likeness(p[3], p[4]) for p in part], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        schema_id = None
        for whole in batches:
            schema_id = whole.schema.field("id").type
            for batch in slices(whole, "text", _SLICE):
                texts = whole_text(batch.column(2)).to_pylist()
                prints = fingerprints(texts)
                some = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), prints))
                part = []
                for row in some:
                    if waiting is not None and not waiting[3]:
                        follows = waiting[0] == row[0] and row[0] >= 0
                        part.append((waiting[1], waiting[2], row[2] if follows else "", waiting[4], row[4] if follows else ""))
                    waiting = row
                if part:
                    yield rows(part)
        if waiting is not None and not waiting[3]:
            yield rows([(waiting[1], waiting[2], "", waiting[4], "")])

    schema = f"`{id}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id, text).select("bucket", "id", "text", "ghost").mapInArrow(run, schema)
