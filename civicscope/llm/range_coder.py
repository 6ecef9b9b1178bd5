"""Token files: ids packed by an adaptive context-mixing range coder.

A file holds documents in ascending id order: a head (magic, counts), the ids and lengths of its
documents (Arrow), how often each token id occurs, an index of blocks, and the blocks.  A block
is ``BLOCK`` tokens, starts with an empty model, and carries a checksum of its ids, so blocks
decode independently of each other; many are coded side by side, one lane of an array each.

Before each token three predictions meet.  Order 2 and order 1 remember which id last followed
the last two ids and the last id, and how often in a row they were right; order 0 is the file's
frequency of an id.  The chance that the favoured id comes is a mix of the three in the logistic
domain, with weights that follow the errors; what remains goes to order 1's id if it is another
one, then to all ids by frequency.  The result is one interval of the token for a 64-bit range
coder with carries, which writes 32 bits as soon as the range is shorter than 2**32.  All arithmetic is in integers, so that any machine reads what another has written.

Defined cases: null text counts as empty and becomes the end id alone; null ids come first; rows
with equal ids are ordered by text and all kept; no documents give no files and an empty result;
extra columns play no part.  A damaged block raises an error that names it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicscope.llm.frames import column, reach, slices, stored
from civicscope.llm.tokens import PieceEncoder

MAGIC = b"IDMIX002"
BLOCK = 2048
#: Tokens after which a file is closed.
FILE_TOKENS = 1 << 23
#: Blocks coded side by side at most.
LANES = 4096
#: Text bytes whose ids are looked up at once, and steps between turns of a matrix.
_SLICE, _TURN = 12 << 20, 64
_ORDER0_BITS, _SLOTS2, _SLOTS1 = 20, 2048, 1024
_MOST = 15  # of a prediction's run

# stretch(p) = ln(p / (1 - p)) in 1/256, and its inverse in 1/4096
_P = np.arange(1, 4096)
_STRETCH = np.zeros(4096, np.int32)
_STRETCH[1:] = np.rint(256 * np.log(_P / (4096 - _P)))
_STRETCH[0] = _STRETCH[1]
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 8, 4000).astype(np.int32)


def _number(kind: type):
    """Makes constants: arrays without a dimension cost less than numbers in a call on few thousand values."""
    return lambda value: np.array(value, kind)


_I, _U, _H = _number(np.int32), _number(np.uint64), _number(np.uint16)
_0, _4, _10, _12, _16, _ID, _STEP, _AGAIN = (_I(x) for x in (0, 4, 10, 12, 16, 0xFFFF, 0x10000, _MOST - 1))
_ONE, _CERTAIN, _HALF_SQUASH, _ALL = (_I(x) for x in (4096, 4095, 2048, 1 << 24))
_B_LEAST, _B_RANGE = _I(8), _I(3584 - 8)
_FACTOR2, _FACTOR1, _3, _MASK2, _MASK1 = (_H(x) for x in (30011, 40503, 3, _SLOTS2 - 1, _SLOTS1 - 1))
_U1, _U20, _U24, _U32, _LOW32 = (_U(x) for x in (1, 20, 24, 32, 0xFFFFFFFF))
_LEAST, _FULL = _U(1 << 32), np.uint64(0xFFFFFFFFFFFFFFFF)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Shares of 2**20 for ids 0 to the largest one; every id that occurs has one at least."""
    counts = np.bincount(ids)
    total, whole = int(counts.sum()), 1 << _ORDER0_BITS
    kinds = int((counts > 0).sum())
    share = np.where(counts > 0, 1 + counts * (whole - kinds) // max(total, 1), 0)
    share[int(counts.argmax())] += whole - int(share.sum())
    return share.astype(np.int64)


class Mixer:
    """The model of all lanes; the same calls in the same order when writing and reading.

    A table entry holds an id and, above its 16 bits, how often in a row it was right; 0 is no id yet.
    All arrays are made once, and each step writes into them.
    """

    def __init__(self, lanes: int, shares: np.ndarray):
        lane = np.arange(lanes)
        self.lane2, self.lane1, self.lane16, self.lane32 = lane * _SLOTS2, lane * _SLOTS1, lane * 16, lane * 32
        self.order0 = _STRETCH[np.minimum(shares >> (_ORDER0_BITS - 12), 4095)]
        self.places = ((np.cumsum(shares) - shares).astype(np.uint64) << _U32) | shares.astype(np.uint64)
        self.table2 = np.zeros(lanes * _SLOTS2, np.int32)
        self.table1 = np.zeros(lanes * _SLOTS1, np.int32)
        self.chance2 = np.tile(_I([1 << 9] + [1 << 11] * 15), lanes)  # that order 2's id comes, by its run
        self.chance1 = np.tile(_I([8] * 2 + [1 << 11] * 30), lanes)  # by order 1's run and agreement
        self.chance_b = np.tile(_I([8] + [1 << 10] * 15), lanes)  # that order 1's other id comes
        self.w2, self.w1, self.w0 = (np.full(lanes, w, np.int32) for w in (20_000, 20_000, 4_000))
        self.last, self.before, self.h, self.g = (np.zeros(lanes, np.uint16) for _ in range(4))
        self.at2, self.at1, self.c2, self.c1, self.cb, self.wide = (np.zeros(lanes, np.int64) for _ in range(6))
        self.e2, self.e1, self.r2, self.r1, self.own2, self.first, self.second, self.now = (np.zeros(lanes, np.int32) for _ in range(8))
        self.q2, self.q1, self.qb, self.s2, self.s1, self.s0, self.p, self.a, self.both, self.rest, self.x, self.y = (np.zeros(lanes, np.int32) for _ in range(12))
        self.other, self.is_a, self.right, self.is_b, self.by0, self.mask = (np.zeros(lanes, bool) for _ in range(6))
        self.unit, self.unit0, self.start, self.z = (np.zeros(lanes, np.uint64) for _ in range(4))

    def predict(self) -> None:
        """Favoured and second id; of 2**24: the favoured one's size a, the size of both, the rest for all ids by frequency.

        The second id has no size where it is the favoured one.
        """
        m, x, y, h, wide = self, self.x, self.y, self.h, self.wide
        np.multiply(m.last, _FACTOR1, h)
        np.multiply(m.before, _FACTOR2, m.g)
        np.add(h, m.g, h)
        np.right_shift(h, _3, h)
        np.bitwise_and(h, _MASK2, h)
        np.add(m.lane2, h, m.at2)
        np.bitwise_and(m.last, _MASK1, h)
        np.add(m.lane1, h, m.at1)
        m.table2.take(m.at2, None, m.e2, "clip")
        m.table1.take(m.at1, None, m.e1, "clip")
        np.right_shift(m.e2, _16, m.r2)
        np.right_shift(m.e1, _16, m.r1)
        np.bitwise_and(m.e2, _ID, m.own2)
        np.bitwise_and(m.e1, _ID, m.second)
        np.equal(m.e2, _0, m.mask)
        np.multiply(m.second, m.mask, x)
        np.bitwise_or(m.own2, x, m.first)
        np.not_equal(m.second, m.first, m.other)
        np.add(m.lane16, m.r2, m.c2)
        np.add(m.lane16, m.r1, m.cb)
        np.add(m.r1, m.r1, x)
        np.add(x, m.other, x)
        np.add(m.lane32, x, m.c1)
        m.chance2.take(m.c2, None, m.q2, "clip")
        m.chance1.take(m.c1, None, m.q1, "clip")
        m.chance_b.take(m.cb, None, m.qb, "clip")
        for table, key, out in ((_STRETCH, m.q2, m.s2), (_STRETCH, m.q1, m.s1), (m.order0, m.first, m.s0)):
            wide[:] = key
            table.take(wide, None, out, "clip")
        np.multiply(m.w2, m.s2, x)
        np.multiply(m.w1, m.s1, y)
        np.add(x, y, x)
        np.multiply(m.w0, m.s0, y)
        np.add(x, y, x)
        np.right_shift(x, _16, x)
        np.add(x, _HALF_SQUASH, x)
        wide[:] = x
        _SQUASH.take(wide, None, m.p, "clip")
        np.left_shift(m.p, _12, m.a)
        np.multiply(m.qb, m.other, y)
        np.subtract(_ONE, m.p, x)
        np.multiply(x, y, y)
        np.add(m.a, y, m.both)
        np.subtract(_ALL, m.both, m.rest)

    def interval(self, size: np.ndarray) -> None:
        """Start of the interval of the ids ``now``, and its size in place of the size of the range.

        ``unit`` is the size over 2**24, ``unit0`` what a share of 2**20 of the rest has.
        """
        m, x, y = self, self.x, self.y
        np.greater(m.right, m.is_a, m.is_b)
        np.equal(m.is_a, m.is_b, m.by0)
        m.wide[:] = m.now
        m.places.take(m.wide, None, m.z, "clip")
        np.multiply(m.unit0, m.by0, m.unit0)
        np.multiply(m.a, m.is_b, x)
        np.multiply(m.both, m.by0, y)
        np.add(x, y, x)
        m.start[:] = x.view(np.uint32)
        np.multiply(m.start, m.unit, m.start)
        np.subtract(m.both, m.a, x)
        np.multiply(x, m.is_b, x)
        np.multiply(m.a, m.is_a, y)
        np.add(x, y, x)
        size[:] = x.view(np.uint32)
        np.multiply(size, m.unit, size)
        np.bitwise_and(m.z, _LOW32, m.unit)
        np.multiply(m.unit, m.unit0, m.unit)
        np.add(size, m.unit, size)
        np.right_shift(m.z, _U32, m.z)
        np.multiply(m.z, m.unit0, m.z)
        np.add(m.start, m.z, m.start)

    def shares(self, size: np.ndarray) -> None:
        """Unit of a range and of its rest."""
        np.right_shift(size, _U24, self.unit)
        self.unit0[:] = self.rest.view(np.uint32)
        np.multiply(self.unit0, self.unit, self.unit0)
        np.right_shift(self.unit0, _U20, self.unit0)

    def update(self, ids: np.ndarray) -> None:
        m, x, y, goal = self, self.x, self.y, self.both
        np.multiply(m.is_a, _CERTAIN, goal)
        np.subtract(goal, m.p, x)
        for weight, s in ((m.w2, m.s2), (m.w1, m.s1), (m.w0, m.s0)):
            np.multiply(s, x, y)
            np.right_shift(y, _10, y)
            np.add(weight, y, weight)
        for chance, at, q in ((m.chance2, m.c2, m.q2), (m.chance1, m.c1, m.q1)):
            np.subtract(goal, q, y)
            np.right_shift(y, _4, y)
            np.add(q, y, y)
            chance[at] = y
        np.multiply(m.right, _B_RANGE, y)
        np.add(y, _B_LEAST, y)
        np.subtract(y, m.qb, y)
        np.right_shift(y, _4, y)
        np.greater(m.other, m.is_a, m.mask)  # tried
        np.multiply(y, m.mask, y)
        np.add(y, m.qb, y)
        m.chance_b[m.cb] = y
        np.add(m.now, _STEP, x)  # the id after a run of one
        for table, at, own, run in ((m.table2, m.at2, m.own2, m.r2), (m.table1, m.at1, m.second, m.r1)):
            np.equal(own, m.now, m.mask)
            np.minimum(run, _AGAIN, y)
            np.multiply(y, m.mask, y)
            np.left_shift(y, _16, y)
            np.add(x, y, y)
            table[at] = y
        m.before, m.last = m.last, ids


def encode_blocks(ids: np.ndarray, shares: np.ndarray) -> list[bytes]:
    """Codes of blocks; ids: lanes x BLOCK."""
    lanes, steps = ids.shape
    model = Mixer(lanes, shares)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    room = steps + 4  # a step settles 32 bits at most
    out, at = np.zeros(lanes * room, "<u4"), np.arange(lanes) * room
    first, mask = at.copy(), np.zeros(lanes, bool)
    for t in range(steps):
        if t % _TURN == 0:
            columns = np.ascontiguousarray(ids[:, t : t + _TURN].T)
        now = columns[t % _TURN]
        model.now[:] = now
        model.predict()
        np.equal(model.now, model.first, model.is_a)
        np.equal(model.now, model.second, model.right)
        model.shares(size)
        model.interval(size)
        np.add(low, model.start, low)
        np.less(low, model.start, mask)
        _carry(out, at, mask.nonzero()[0])
        np.less(size, _LEAST, mask)
        go = mask.nonzero()[0]
        settled, place, width = low[go], at[go], size[go]
        out[place] = settled >> _U32
        place += 1
        settled <<= _U32
        width <<= _U32
        at[go], low[go], size[go] = place, settled, width
        model.update(now)
    for part in (low >> _U32, low & _LOW32):
        out[at] = part
        at += 1
    return [out[a:b].tobytes() for a, b in zip(first.tolist(), at.tolist())]


def _carry(out: np.ndarray, at: np.ndarray, lanes: np.ndarray) -> None:
    """Add one to what the lanes have written."""
    place = at[lanes] - 1
    while len(place):
        more = out[place] + np.uint32(1)
        out[place] = more
        place = place[more == 0] - 1


def decode_blocks(codes: list[bytes], shares: np.ndarray, steps: int = BLOCK) -> np.ndarray:
    """Ids of blocks: lanes x BLOCK."""
    lanes = len(codes)
    lengths = np.array([len(c) // 4 for c in codes])
    data = np.frombuffer(b"".join(codes) + bytes(8), "<u4")
    at = np.cumsum(lengths) - lengths
    model = Mixer(lanes, shares)
    slots = np.repeat(np.arange(len(shares), dtype=np.uint16), shares)
    size = np.full(lanes, _FULL)
    code = (data.take(at, mode="clip").astype(np.uint64) << _U32) | data.take(at + 1, mode="clip")  # less the range's start
    at += 2
    out, turned = np.zeros((lanes, steps), np.uint16), np.zeros((_TURN, lanes), np.uint16)
    c, d = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    slot, mask = np.zeros(lanes, np.uint16), np.zeros(lanes, bool)
    for t in range(steps):
        model.predict()
        model.shares(size)
        c[:] = model.a.view(np.uint32)
        np.multiply(c, model.unit, c)
        np.less(code, c, model.is_a)
        c[:] = model.both.view(np.uint32)
        np.multiply(c, model.unit, c)
        np.less(code, c, model.right)
        np.subtract(code, c, c)
        np.maximum(model.unit0, _U1, d)  # a damaged block must not divide by 0
        np.floor_divide(c, d, c)
        slots.take(c.view(np.int64), None, slot, "clip")
        np.greater(model.right, model.is_a, model.is_b)
        np.logical_not(model.right, mask)
        np.multiply(model.first, model.is_a, model.x)
        np.multiply(model.second, model.is_b, model.y)
        np.add(model.x, model.y, model.x)
        np.multiply(slot, mask, slot)
        np.add(model.x, slot, model.now)
        now = turned[t % _TURN]
        now[:] = model.now
        np.equal(model.now, model.first, model.is_a)
        np.equal(model.now, model.second, model.right)
        model.interval(size)
        np.subtract(code, model.start, code)
        np.less(size, _LEAST, mask)
        go = mask.nonzero()[0]
        value, place, width = code[go], at[go], size[go]
        value <<= _U32
        value |= data.take(place, mode="clip")
        place += 1
        width <<= _U32
        code[go], at[go], size[go] = value, place, width
        model.update(now)
        if t % _TURN == _TURN - 1 or t == steps - 1:
            a = t - t % _TURN
            out[:, a : t + 1] = turned[: t + 1 - a].T
            model.before, model.last = model.before.copy(), model.last.copy()  # their rows are written again
    return out


def dump(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a file."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65535 do not fit this format")
    head = io.BytesIO()
    table = pa.record_batch([keys, pa.array(lengths, pa.int64())], names=["key", "length"])
    with pa.ipc.new_stream(head, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    shares = frequencies(ids)
    seen = np.flatnonzero(shares)
    counts = zlib.compress(np.diff(seen, prepend=0).astype("<u2").tobytes() + shares[seen].astype("<u4").tobytes())
    blocks = -(-len(ids) // BLOCK)
    full = np.full(blocks * BLOCK, int(shares.argmax()), np.uint16)
    full[: len(ids)] = ids
    full = full.reshape(blocks, BLOCK)
    codes = [c for a in range(0, blocks, LANES) for c in encode_blocks(full[a : a + LANES], shares)]
    sums = [zlib.crc32(row.astype("<u4").tobytes()) for row in full]
    index = np.array([[len(c), s] for c, s in zip(codes, sums)], "<u4").tobytes()
    front = head.getvalue()
    return b"".join([MAGIC, struct.pack("<QIIII", len(ids), len(front), len(counts), len(seen), blocks), front, counts, index, *codes])


def load(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, n_front, n_counts, kinds, blocks = struct.unpack_from("<QIIII", data, 8)
    at = 8 + struct.calcsize("<QIIII")
    table = pa.ipc.open_stream(data[at : at + n_front]).read_all().combine_chunks()
    at += n_front
    counts = zlib.decompress(data[at : at + n_counts])
    at += n_counts
    seen = np.cumsum(np.frombuffer(counts[: 2 * kinds], "<u2").astype(np.int64))
    shares = np.zeros(int(seen[-1]) + 1, np.int64)
    shares[seen] = np.frombuffer(counts[2 * kinds :], "<u4")
    index = np.frombuffer(data[at : at + 8 * blocks], "<u4").reshape(blocks, 2).astype(np.int64)
    at += 8 * blocks
    ends = at + np.cumsum(index[:, 0])
    codes = [data[b - w : b] for b, w in zip(ends.tolist(), index[:, 0].tolist())]
    parts = []
    for a in range(0, blocks, LANES):
        rows = decode_blocks(codes[a : a + LANES], shares)
        for k, row in enumerate(rows):
            if zlib.crc32(row.astype("<u4").tobytes()) != index[a + k, 1]:
                raise ValueError(f"block {a + k} does not have its checksum")
        parts.append(rows.reshape(-1))
    return table.column("key").combine_chunks(), table.column("length").to_numpy(), np.concatenate(parts)[:n]


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold a number of bytes: repeated words are looked up once for all."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_files(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write token files in ascending order of id; (file, n_docs, n_tokens, n_bytes) of each.

    A task writes under a name of its own attempt and then moves the file to its final name, so
    a repeated task replaces what a lost one has written.
    """
    spark = reach(docs.sparkSession)
    store, root = _place(folder)
    store.create_dir(root, recursive=True)  # no documents are an empty folder
    encoder = PieceEncoder(tokenizer, keeps_space=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _place(folder)
        keys, lengths, parts, held, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, lengths, parts, held, number
            ids = np.concatenate(parts)
            n = np.concatenate(lengths)
            data = dump(pa.concat_arrays(keys), n, ids)
            name = f"part-{task.partitionId():06d}-{number:06d}.ids"
            own = f"{root}/_{name}-{task.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")
            keys, lengths, parts, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "n_docs", "n_tokens", "n_bytes"])

        for whole in _gathered(batches, _SLICE):
            for batch in slices(whole, "text", _SLICE):
                offsets, ids = encoder.encode(column(batch, "text"))
                n = np.diff(offsets) + 1
                ends = np.cumsum(n)
                full = np.full(int(ends[-1]), end_id, np.uint16)
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids above 65535 do not fit this format")
                inside = np.ones(len(full), bool)
                inside[ends - 1] = False
                full[inside] = ids
                a = 0
                while a < len(n):  # documents stay whole
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + file_tokens - held, side="right")))
                    b = min(b, len(n))
                    keys.append(column(batch, "id").slice(a, b - a))
                    lengths.append(n[a:b])
                    parts.append(full[ends[a] - n[a] : ends[b - 1]])
                    held += int(ends[b - 1] - ends[a] + n[a])
                    a = b
                    if held >= file_tokens or a < len(n):
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return stored(ordered.mapInArrow(run, "file string, n_docs long, n_tokens long, n_bytes long"))


def read_files(spark: SparkSession, folder: str, kind: str = "bigint", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if wanted, ids) of every document in the files."""
    reach(spark)
    new = ["id", "part", "number", "start_in_file", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content")):
                keys, lengths, ids = load(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                part, number = (int(x) for x in path.rsplit("/", 1)[-1].split(".")[0].split("-")[1:])
                out = [keys, pa.array(np.full(len(keys), part), pa.int64()), pa.array(np.full(len(keys), number), pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield from pa.Table.from_arrays(out, names=new).to_batches(max_chunksize=20_000)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    docs = stored(files.mapInArrow(run, f"id {kind}, part long, number long, start_in_file long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids))
    sizes = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("tokens"))
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("_before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    starts = sizes.withColumn("_within", within).join(earlier, "part").select("part", "number", (F.col("_before") + F.col("_within")).alias("_first"))
    placed = docs.join(starts, ["part", "number"])
    return placed.select("id", (F.col("_first") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def new_folder(base: str) -> str:
    """A fresh subfolder name."""
    return f"{base.rstrip('/')}/ids-{uuid.uuid4().hex}"
