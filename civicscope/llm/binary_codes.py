"""Near duplicates among embeddings by randomised-rotation binary codes.

A unit vector is rotated at random; the signs of the result are its code, and the inner product
of code and vector is stored as correction factor.  The inner product of one vector's code with
another rotated vector, divided by the factor, estimates the vectors' own inner product without
bias; its error is at most ``sqrt(1 - f*f) / f * EPS / sqrt(dim - 1)`` but for a chance of about
1e-6 (EPS = 5).  Only pairs whose upper bound reaches the threshold are computed in full.

Pairs are looked for in buckets of equal sign patterns: ``tables`` of ``bits`` signs each, from
several rotations.  Bits follow the size of the largest label, tables follow the bits, so that a
pair right at the threshold shares no bucket with a chance of ``MISS`` at most.  A pair that
meets in several tables is counted in the first of them.  Equal vectors are one vector with a
multiplicity.  Buckets too large for one task are cut into blocks, and all pairs of blocks are
compared.

Defined cases: a vector that is null, zero or holds a null or non-finite component, or has a null
label, links with nothing (n_links 0, its own component); so does a row with a null id, whose
component is null and which is not kept; rows of one id are vectors of their own; vectors of
different length never link; extra columns play no part; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicscope.llm.frames import column, reach, stored
from civicscope.llm.graph import components

THRESHOLD = 0.93
EPS = 5.0
MISS = 1e-4
#: Vectors of a block.
BLOCK = 2048
#: Random vectors that a bucket holds on average.
CROWD = 16


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, always the same for its number."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_count(bits: int, threshold: float) -> int:
    """Tables after which a pair at the threshold has been missed with chance MISS."""
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def _rows(lists: pa.Array) -> list[np.ndarray | None]:
    """Vectors in single precision; None where one can't link."""
    out = []
    for v in lists:
        x = None if not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _digests(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = _rows(column(batch, "vector"))
            known = column(batch, "label").is_valid().to_pylist()
            named = column(batch, "id").is_valid().to_pylist()
            digest = [hashlib.md5(x.tobytes()).digest() if x is not None and k and n else None for x, k, n in zip(rows, known, named)]
            dims = [0 if x is None else len(x) for x in rows]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), pa.array(dims, pa.int32()), pa.array(digest, pa.binary()), column(batch, "vector")], names=["id", "label", "dim", "digest", "vector"])

    some = df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in some.schema.fields}
    return some.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, dim int, digest binary, vector {kinds['vector']}")


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """The columns and: code (signs of the first rotation), factor, keys (one per table)."""

    def run(batches):
        for batch in batches:
            rows = _rows(column(batch, "vector"))
            keys = np.zeros((len(rows), tables), np.int64)
            codes, factors = [b""] * len(rows), np.zeros(len(rows))
            dims = np.array([len(x) for x in rows])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([rows[i] for i in at]).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned = [x @ rotation(dim, r) for r in range(-(-tables * bits // dim))]
                signs = np.concatenate([t > 0 for t in turned], axis=1)
                weights = 1 << np.arange(bits)
                for t in range(tables):
                    keys[at, t] = signs[:, t * bits : (t + 1) * bits] @ weights
                factors[at] = np.abs(turned[0]).sum(1) / math.sqrt(dim)
                for i, row in zip(at.tolist(), np.packbits(signs[:, :dim], axis=1)):
                    codes[i] = row.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int32()))
            old = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*old, pa.array(codes, pa.binary()), pa.array(factors), lists], names=[*batch.schema.names, "code", "factor", "keys"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, kinds + ", code binary, factor double, keys array<int>")


def linked(x: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; x: unit vectors, codes: their signs as -1 and 1."""
    n, dim = x.shape
    turned = (x @ rotation(dim, 0)).astype(np.float32)
    estimate = (codes.astype(np.float32) @ turned.T) / (math.sqrt(dim) * factors)[:, None]
    error = np.sqrt(np.maximum(1 - factors**2, 0)) / factors * EPS / math.sqrt(max(dim - 1, 1))
    out = np.zeros((n, n), bool)
    i, j = np.nonzero(np.triu(estimate + error[:, None] + 1e-5 >= threshold, 1))
    for a in range(0, len(i), 200_000):
        p, q = i[a : a + 200_000], j[a : a + 200_000]
        out[p, q] = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
    return out | out.T


def _smallest(links: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches."""
    lowest = np.arange(len(links))
    while True:
        best = np.minimum(lowest, np.where(links, lowest[None, :], len(links)).min(1))
        if (best == lowest).all():
            return best
        lowest = best


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    reach(df.sparkSession)
    all_rows = stored(_digests(df, id, vector, label))
    kinds = {f.name: f.dataType.simpleString() for f in all_rows.schema.fields}
    good = all_rows.filter("digest IS NOT NULL")
    same = good.groupBy("label", "dim", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    same = stored(same)
    most = same.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits = int(min(24, max(4, round(math.log2(max(most, 1) / CROWD)) if most > CROWD else 4)))
    tables = table_count(bits, threshold)
    ready = stored(coded(same, bits, tables))
    keyed = ready.select("label", "dim", "rep", F.posexplode("keys").alias("t", "key"))
    group = ["label", "dim", "t", "key"]
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = keyed.join(sizes.drop("size"), group).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(*group, "rep", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        t, dim = block.column("t")[0].as_py(), block.column("dim")[0].as_py()
        x = np.stack(_rows(block.column("vector").combine_chunks())).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        packed = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        codes = np.unpackbits(packed, axis=1, count=dim).astype(np.int8) * 2 - 1
        links = linked(x, codes, block.column("factor").to_numpy(), threshold)
        if pc.min_max(block.column("side"))["min"] != pc.min_max(block.column("side"))["max"]:
            side = block.column("side").to_numpy()
            links &= side[:, None] != side[None, :]
        low = _smallest(links)
        keys = block.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        fresh = links.copy()
        for earlier in range(t):
            if not fresh.any():
                break
            fresh &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
        count = fresh @ block.column("copies").to_numpy()
        some = np.flatnonzero((count > 0) | (low < np.arange(len(x))))
        reps = block.column("rep")
        return pa.table({"a": reps.take(pa.array(some)), "b": reps.take(pa.array(low[some])), "n": pa.array(count[some].astype(np.int64))})

    payload = ready.select("rep", "copies", "vector", "code", "factor", "keys")
    found = stored(members.join(payload, "rep").groupBy(*group, "lo", "hi").applyInArrow(compare, f"a {kinds['id']}, b {kinds['id']}, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    classes = components(found.filter("a <> b"))
    named = same.select("label", "dim", "digest", "rep", "copies").join(counts, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = all_rows.select("id", "label", "dim", "digest").join(named, ["label", "dim", "digest"], "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
