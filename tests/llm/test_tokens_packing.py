import pickle
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicscope.llm import packing, range_coder
from civicscope.llm.tokens import PieceEncoder

from .conftest import EDGES

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ENCODERS = {False: PieceEncoder(WORD, False), True: PieceEncoder(BYTE, True)}
texts = st.lists(st.text(st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 ab'sSllé中1²½ᾳΣςİ́́|<>.,!")), max_size=25), max_size=20)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans())
def test_pieces_encode_like_whole_texts(some, keeps_space):
    encoder = ENCODERS[keeps_space]
    offsets, ids = encoder.encode(pa.array(some, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [x.tolist() for x in encoder.whole(some)]


words = st.lists(st.sampled_from(["the", "Öl", "çon", "x", "12", "½", "ß", "Ж", "it's", "a's,", "...", "!?", ",", "$%", "-", "\n", "\n\n", "\x1f", "\x00", "\u0378", "×,", "é.", "Ǝ;", "<s>", " "]), max_size=6).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(words, max_size=12).map(" ".join), max_size=8), st.sampled_from([3, 50]))
def test_units_encode_like_whole_texts(some, kept):
    encoder = PieceEncoder(BYTE, True, kept)
    encoder._tokenizer = ENCODERS[True]._load()
    for part in (some, some[::2], some):  # known and forgotten units
        offsets, ids = encoder.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [x.tolist() for x in encoder.whole(part)]


def test_tokens_over_cuts_are_noticed():
    encoder = PieceEncoder(BYTE, True)
    encoder._load()
    encoder._sizes = np.full(100_000, 7)
    assert encoder.encode(pa.array(["one two three"]))[1].tolist() == encoder.whole(["one two three"])[0].tolist()


def test_tasks_of_a_worker_share_known_words(monkeypatch):
    one, other = (pickle.loads(pickle.dumps(PieceEncoder(BYTE, True))) for _ in range(2))
    want = one.whole(["words, known words\nto all"])[0].tolist()
    one.encode(pa.array(["words all known words, to words\nto"]))
    monkeypatch.setattr(other, "_load", None)  # nothing goes through the tokenizer again
    assert other.encode(pa.array(["words, known words\nto all"]))[1].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_two_fit_places_all_once(lengths):
    sizes = np.array(lengths, np.int64)
    bins = packing.best_two_fit(sizes, 20)
    assert sorted(r for b in bins for r in b) == list(range(len(lengths)))
    assert all(sizes[b].sum() <= 20 for b in bins)
    assert len(bins) <= -(-3 * -(-int(sizes.sum()) // 20) // 2) + 1


def test_two_small_pieces_replace_the_smallest():
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(len(b) for b in bins) == [1, 3]  # 6 + 2 + 2 instead of 6 + 3


def test_best_two_fit_reaches_the_optimum_of_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 10, 7)
        assert len(packing.best_two_fit(sizes, 10)) <= best(sizes.tolist(), 10) + 1


def best(sizes, capacity):
    if not sizes:
        return 0
    rest = sizes[1:]
    fits = [c for n in range(len(rest) + 1) for c in combinations(range(len(rest)), n) if sizes[0] + sum(rest[i] for i in c) <= capacity]
    return 1 + min(best([x for i, x in enumerate(rest) if i not in c], capacity) for c in fits)


def expected_pieces(tokenizer, rows, end, capacity):
    encoder = PieceEncoder(tokenizer, False)
    for doc, text in rows:
        ids = np.append(encoder.whole([text or ""])[0], end).astype("<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            yield doc, k // capacity, k, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())


def test_pieces_and_sequences(edges):
    cut = packing.pieces(edges, WORD)
    rows = packing.pack(cut).collect()
    assert set(rows[0].asDict()) == {"doc_id", "score", "n_dropped", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    got = sorted(((r.doc_id or -1), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows)
    assert got == sorted(expected_pieces(WORD, [(-1 if d is None else d, t) for d, t, *_ in EDGES], 0, 2048))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)


def test_partitions_cost_no_sequences(small):
    spread = packing.pieces(small.repartition(8).select("doc_id", "text"), WORD, with_ids=False)
    rows = packing.pack(spread).collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_nothing(edges):
    assert packing.pack(packing.pieces(edges.filter("false"), WORD)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.booleans())
def test_coder_round_trip(ids, wide):
    ids = np.array(ids, np.uint16) * (200 if wide else 1)
    data = range_coder.dump(pa.array([1]), np.array([len(ids)]), ids)
    assert np.array_equal(range_coder.load(data)[2], ids)


def test_coder_learns_and_detects_damage():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50_000, 64)
    ids = np.tile(phrase, 100).astype(np.uint16)
    data = range_coder.dump(pa.array([1]), np.array([len(ids)]), ids)
    noise = range_coder.dump(pa.array([1]), np.array([len(ids)]), rng.permutation(ids))
    assert len(data) < len(noise) / 2
    broken = bytearray(data)
    broken[-40] ^= 0x55
    with pytest.raises(ValueError, match="block"):
        range_coder.load(bytes(broken))


def test_carries_run_through():
    out = np.array([5, 0xFFFFFFFF, 0xFFFFFFFF, 9, 7, 0], np.uint32)
    range_coder._carry(out, np.array([3, 5]), np.array([0, 1]))
    assert out.tolist() == [6, 0, 0, 9, 8, 0]


def test_coder_round_trip_of_many_blocks():
    rng = np.random.default_rng(7)
    ids = np.where(rng.random((40, range_coder.BLOCK)) < 0.5, 7, rng.zipf(1.3, (40, range_coder.BLOCK)) % 50_000).astype(np.uint16)
    ids[:8] = 0
    ids[8:16] = rng.integers(0, 3, (8, range_coder.BLOCK))
    shares = range_coder.frequencies(ids.ravel())
    assert np.array_equal(range_coder.decode_blocks(range_coder.encode_blocks(ids, shares), shares), ids)


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 500, (5, range_coder.BLOCK)).astype(np.uint16)
    shares = range_coder.frequencies(ids.ravel())
    codes = range_coder.encode_blocks(ids, shares)
    assert np.array_equal(range_coder.decode_blocks([codes[3], codes[1]], shares), ids[[3, 1]])


def test_token_files(spark, edges, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = range_coder.write_files(edges, folder, BYTE, file_tokens=3000)
    back = range_coder.read_files(spark, folder).orderBy("start").collect()
    encoder = PieceEncoder(BYTE, True)
    rows = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc, text, *_ in rows:
        ids = np.append(encoder.whole([text or ""])[0], 2).astype("<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    assert [(r.id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in back] == want
    assert manifest.agg(F.sum("n_tokens")).first()[0] == at


def test_no_documents_no_files(spark, edges, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert range_coder.write_files(edges.filter("false"), folder, BYTE).count() == 0
    assert range_coder.read_files(spark, folder).count() == 0
