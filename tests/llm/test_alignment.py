"""Alignment of tokenizers against token-by-token versions."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civicscope.llm import alignment
from civicscope.llm.alignment import Aligner, align, pair_documents, pair_table
from civicscope.llm.pair_hash import PairHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
one = Tokenizer.from_file(A)
one.encode_special_tokens = True
two = sentencepiece.SentencePieceProcessor(model_file=B)
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_bytes = {chr(b): b for b in _plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _plain)}


def tokens(text):
    """(id, end) of both, or None."""
    if not text:
        return None
    ids = one.encode(" " + text, add_special_tokens=False).ids, two.encode([text], num_threads=1)[0]
    spoken = [[bytes(_bytes[c] for c in one.id_to_token(k)) for k in ids[0]], []]
    for k in ids[1]:
        p = two.id_to_piece(k)
        spoken[1].append(bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode())
    if any(b"".join(x) != (" " + text).encode() for x in spoken):
        return None
    return [list(zip(x, np.cumsum([len(p) for p in y]).tolist())) for x, y in zip(ids, spoken)]


def groups(text):
    found = tokens(text)
    if found is None:
        return []
    cuts = sorted({e for _, e in found[0]} & {e for _, e in found[1]})
    out, low = [], 0
    for cut in cuts:
        out.append([[k for k, e in side if low < e <= cut] for side in found])
        low = cut
    return out


def brute(rows):
    each = [(d, groups(t)) for d, t in rows]
    counts = Counter(p for _, gs in each for p in {(a, b) for x, y in gs for a in x for b in y})
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for d, gs in each:
        links = [(a, b) for x, y in gs for a in x for b in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, align(df, A, B).collect()), key=repr)


ODD = [
    (1, "a  b\n\n c\t d \n"), (2, " lead"), (3, "trail "), (4, "\n"), (5, " "), (6, "   "), (7, "x▁y has a mark"), (8, "中文字符 текст\nनमस्ते 👩‍👩‍👧 é"),
    (9, "<|endoftext|> <s> </s> <0x41> <unk>"), (10, "a\x1cb .\x85c  d　 e\x0b f"), (11, "word. word.\nword, \"word\" don't we'll 1234567 !!!???"),
    (12, "=" * 5000 + " " * 700 + "a" * 3000), (13, "\x00 \x01\n\x02"), (14, "word\r\nword\r\n"), (15, ""), (16, None), (None, "word word"), (11, "word. word.\nword, \"word\" don't we'll 1234567 !!!???"),
]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as slot", "text as n_a", "3 as `a.b`")
    assert got(df) == brute(ODD)


def test_documents(spark, small):
    assert got(small) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_edges(spark, edges):
    assert got(edges) == brute([(r.doc_id, r.text) for r in edges.collect()])
    assert got(edges.limit(0)) == []
    assert got(edges.filter("text is null or text = ''")) == brute([(2, ""), (3, None)])
    named = edges.selectExpr("doc_id as `my.id`", "text as `my text`")
    shown = align(named, A, B, "my.id", "my text", with_groups=True).collect()
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in shown)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,\n\t'1é中▁ \x1c\x85<|s>")), max_size=30))
def test_chunks_are_whole_texts(text):
    own = Aligner.get(A, B)
    offsets, index, good = own.documents(pa.array([text, "and another one", text]))
    want = groups(text)
    shown = ";".join(own.shown.take(pa.array(index[: offsets[1]])).to_pylist())
    assert bool(good[0]) == bool(want) and good[1]
    if want:
        assert shown == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(np.arange(n, dtype=np.int64) * 977 + 5)
    made = PairHash.load(*PairHash.of(keys).dump())
    assert sorted(made.index(keys).tolist()) == list(range(n))
    assert (made.index(keys + 1) == -1).all()


def test_table_of_many_shards_and_branches(spark, small, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 500)
    monkeypatch.setattr(alignment, "LEAF", 200)
    monkeypatch.setattr(alignment, "FAN", 2)
    partial = pair_documents(small.repartition(7), A, B).cache()
    want = {r.pair: r.n for r in partial.groupBy("pair").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    found = {}
    rows = pair_table(partial).collect()
    for r in rows:
        found |= dict(zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r["counts"], "<i8").tolist()))
    assert len(rows) > 4 and found == want
    assert got(small) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_new_chunks_are_encoded_a_bounded_number_at_a_time(monkeypatch):
    own, most = Aligner(A, B), []
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda texts: (most.append(sum(map(len, texts))), encoded(texts))[1])
    texts = ["w7x1 and w4999x5, then", *[" ".join(f"w{k}x{n}" for k in range(5000)) for n in range(6)]]
    offsets, index, good = own.documents(pa.array([*texts, "one  two"]))
    assert good.all() and len(most) > 4 and max(most) <= 9 * alignment.LEARNT
    for k in (0, len(texts)):
        want, at = groups([*texts, "one  two"][k]), index[offsets[k] : offsets[k + 1]]
        shown = ";".join(own.shown.take(pa.array(at)).to_pylist())
        assert shown == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
        n, places = own.pairs_of(at)
        linked = Counter()
        for pair, times in zip(own.pairs[places].tolist(), own.times[places].tolist()):
            linked[divmod(pair, own.width)] += times
        assert linked == Counter((a, b) for x, y in want for a in x for b in y)
