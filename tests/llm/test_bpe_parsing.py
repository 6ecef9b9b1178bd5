import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from civicscope.llm import bpe_tree, parsing

from .conftest import EDGES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
KNOWN = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=KNOWN, special_tokens={})
BITS = [*"   \n\t\r\x0b\x1c\x85\xa0 ab'sSllérevmd中1²½ᾳΣςİ́|<>''!!..", "the", "ing", "tion", "'re", "  ", "aaaa"]


@pytest.fixture(params=[(5, 4), (16, 8), (4096, 256)])
def leaves(request, monkeypatch):
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", request.param[0])
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", request.param[1])
    monkeypatch.setattr(bpe_tree, "LEAF_IDS", request.param[0])
    return bpe_tree.TreeBpe(RANKS)


def test_tree_equals_whole_text(leaves):
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(BITS), max_size=60).map("".join))
    def check(text):
        ids = np.frombuffer(leaves.ids(text), "<i4").tolist()
        assert ids == REFERENCE.encode_ordinary(text)
        assert leaves.text(ids) == text.encode()

    check()


def test_one_very_long_word():
    text = "ab" * 3000 + "a" * 5000
    bpe = bpe_tree.TreeBpe(RANKS)
    assert np.frombuffer(bpe.ids(text), "<i4").tolist() == REFERENCE.encode_ordinary(text)


def test_encode_and_decode_frames(edges):
    coded = bpe_tree.encode(edges, RANKS)
    assert coded.columns == ["doc_id", "text", "score", "length", "n_dropped", "ids"]
    for r in bpe_tree.decode(coded, RANKS).collect():
        assert r.ids == REFERENCE.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe_tree.encode(edges.filter("false"), RANKS).count() == 0


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [464]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe_tree.decode(df, RANKS).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and bytes(got[1]) == REFERENCE.decode_bytes([464])


@settings(max_examples=60, deadline=None)
@given(st.text("abcde ", min_size=300, max_size=600), st.text("abcde ", max_size=40), st.text("abcde ", max_size=40))
def test_substrings_share_their_interior(text, left, right):
    whole = parsing.phrases([left + text + right])[1][0].tolist()
    own = parsing.phrases([text])[1][0].tolist()
    inside = own[12:-12]  # away from the cut ends the same phrases come in the same order
    if inside:
        at = [i for i in range(len(whole) - len(inside) + 1) if whole[i : i + len(inside)] == inside]
        assert at


def test_neighbours_keep_different_labels():
    names = np.random.default_rng(0).integers(0, 50, 5000).astype(np.uint64)
    names = names[np.append(True, names[1:] != names[:-1])]
    first = np.zeros(len(names), bool)
    first[0] = True
    labels = parsing.toss(names, first)
    for _ in range(3):
        assert (labels[1:] != labels[:-1]).all()
        labels = parsing.toss(labels, first)
    assert labels.max() < 6


def test_likeness_follows_shared_text(small):
    texts = [r.text for r in small.select("text").collect() if len(r.text) > 2000][:40]
    for a, b in zip(texts, texts[1:]):
        if a != b:
            prints = parsing.fingerprints([a, a[: len(a) // 2] + b[: len(a) // 2], b, "xyz " + a])
            assert prints[0] == parsing.fingerprints([a])[0]
            assert 0.3 < parsing.likeness(prints[0], prints[1]) < 0.75
            assert parsing.likeness(prints[0], prints[3]) > 0.85
    assert parsing.likeness("", "") == 1 and parsing.likeness("", prints[0]) == 0


def test_estimate_against_all_phrases(small):
    texts = [r.text for r in small.select("text").collect()][:60]
    for a, b in zip(texts, texts[1:]):
        mixed = parsing.edited(a, b)
        p, q = (set(parsing.phrases([t])[2][0].tolist()) for t in (a, mixed))
        if min(len(p), len(q)) >= parsing.ENOUGH:
            exact = 2 * len(p & q) / (len(p) + len(q))
            assert abs(parsing.likeness(*parsing.fingerprints([a, mixed])) - exact) < 0.2


def test_fingerprint_edits(spark, edges, small):
    for docs in (edges, small.select("doc_id", "text")):
        rows = docs.select("doc_id", "text").collect()
        order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.text is not None, r.text or ""))
        want = [(r.doc_id, parsing.edited(r.text or "", n.text or "")) for r, n in zip(order, order[1:] + order[:1])]
        want += [(None, parsing.edited(r.text or "", "")) for r in rows if r.doc_id is None]
        got = parsing.fingerprint_edits(docs).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=key) == sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in want), key=key)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert parsing.fingerprint_edits(edges.filter("false")).count() == 0
    one = parsing.fingerprint_edits(edges.filter("doc_id = 4")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ono").hexdigest()
    assert len(EDGES) == edges.count()
