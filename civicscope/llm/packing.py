"""Best-two-fit packing of documents into sequences of fixed capacity.

Documents become ids and a closing id; only what is longer than a sequence is cut into pieces.
Pieces of a partition are packed in blocks: a bin is filled greedily with the largest pieces
that fit, then its smallest piece is replaced by the two unpacked pieces that fill the widened
gap best, if they fill it better.  Bins left with more than ``SLACK`` of free space give their
pieces to a second round over all partitions, so that partitions cost no sequences.

Defined cases: null text counts as empty (one piece of the closing id alone); rows with null or
repeated ids are packed like any other; extra columns are passed on, and columns named like an
output column are replaced; empty in, empty out.  Lengths must be 1 to the capacity.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicscope.llm.frames import column, reach, slices, spread, stored
from civicscope.llm.tokens import PieceEncoder

CAPACITY = 2048
#: Pieces that are packed together at most.
BLOCK = 200_000
#: Free space beyond which a bin is packed again with those of other partitions.
SLACK = 1 / 128


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True, kept: int = 600_000) -> DataFrame:
    """Every piece of every document: the other columns, piece, start, length, ids_crc32 and (if wanted) ids.

    ``kept`` bounds the words whose ids a task remembers; it changes memory and time, no result.
    """
    reach(docs.sparkSession)
    encoder = PieceEncoder(tokenizer, keeps_space=False, kept=kept)
    new = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    taken = {f.name for f in new} | {text}
    keep = [f for f in docs.schema.fields if f.name not in taken]
    names = [f.name for f in keep] + [f.name for f in new]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 12 << 20):
                offsets, ids = encoder.encode(column(batch, text))
                n = np.diff(offsets) + 1
                ends = np.cumsum(n)
                full = np.full(int(ends[-1]), end_id, "<u4")
                full[spread(ends - n, n - 1)] = ids
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                number = spread(np.zeros(len(n), np.int64), count)
                start = number * capacity
                length = np.minimum(capacity, n[row] - start)
                at = (ends - n)[row] + start
                raw = full.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                old = [column(batch, f.name).take(pa.array(row)) for f in keep]
                out = [pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(old + out, names=names)

    return docs.select(*[f"`{f.name}`" for f in keep], text).mapInArrow(run, T.StructType(keep + new))


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers; each bin holds at most the capacity."""
    stock: dict[int, list[int]] = {}
    for row in np.argsort(lengths, kind="stable")[::-1].tolist():
        stock.setdefault(int(lengths[row]), []).append(row)
    sizes = sorted(stock)

    def take(size: int) -> int:
        row = stock[size].pop()
        if not stock[size]:
            del stock[size]
            del sizes[bisect_right(sizes, size) - 1]
        return row

    def put(size: int, row: int) -> None:
        if size not in stock:
            stock[size] = []
            insort(sizes, size)
        stock[size].append(row)

    bins = []
    while sizes:
        rows, held, gap = [], [], capacity
        while sizes and gap >= sizes[0]:
            size = sizes[bisect_right(sizes, gap) - 1]
            rows.append(take(size))
            held.append(size)
            gap -= size
        if gap and sizes:
            small = held[-1]
            room = gap + small
            some = np.array(sizes[: bisect_right(sizes, room - sizes[0])], np.int64)
            if len(some):
                mate = np.searchsorted(some, room - some, side="right") - 1
                fits = mate >= 0
                sums = np.where(fits, some + some[mate], 0)
                for i in np.where((mate == np.arange(len(some))) & fits)[0].tolist():  # the same size twice
                    if len(stock[int(some[i])]) < 2:
                        sums[i] = some[i] + some[i - 1] if i else 0
                        mate[i] = i - 1
                best = int(sums.argmax())
                if sums[best] > small:
                    back = rows.pop()
                    rows += [take(int(some[best])), take(int(some[mate[best]]))]
                    put(small, back)
        bins.append(rows)
    return bins


def _packed(df: DataFrame, length: str, capacity: int, round_no: int) -> DataFrame:
    """One round: sequence_id, offset, and how much of the sequence is filled."""
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_filled", T.LongType())]
    keep = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in keep] + [f.name for f in new]

    def run(batches):
        from pyspark import TaskContext

        first = (round_no << 62) | (TaskContext.get().partitionId() << 36)
        made, waiting, rows = 0, [], 0

        def pack(batch: pa.Table):
            nonlocal made
            lengths = batch.column(length).to_numpy()
            sequence = np.zeros(len(lengths), np.int64)
            offset = np.zeros(len(lengths), np.int64)
            filled = np.zeros(len(lengths), np.int64)
            full = lengths >= capacity
            n_full = int(full.sum())
            sequence[full] = first + made + np.arange(n_full)
            filled[full] = capacity
            made += n_full
            rest = np.flatnonzero(~full)
            for members in best_two_fit(lengths[rest], capacity):
                at = rest[members]
                ends = np.cumsum(lengths[at])
                sequence[at], offset[at], filled[at] = first + made, ends - lengths[at], ends[-1]
                made += 1
            table = pa.table([batch.column(f.name) for f in keep] + [pa.array(sequence), pa.array(offset), pa.array(filled)], names=names)
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK:
                yield from pack(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            yield from pack(pa.Table.from_batches(waiting))

    return df.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, T.StructType(keep + new))


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All rows of ``df`` with sequence_id and offset; a sequence has no gaps."""
    reach(df.sparkSession)
    first = stored(_packed(df, length, capacity, 0))
    loose = F.col("_filled") < int(capacity * (1 - SLACK))
    left = first.filter(loose)
    again = left.select(*[f"`{c}`" for c in first.columns if c not in ("sequence_id", "offset", "_filled")]).repartition(max(1, -(-left.count() // BLOCK)))
    return first.filter(~loose).unionByName(stored(_packed(again, length, capacity, 1))).drop("_filled")
