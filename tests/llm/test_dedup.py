import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicscope.llm import binary_codes, line_templates, order_minhash, queries
from civicscope.llm.graph import components

from .conftest import EDGES


def classes_of(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---------------------------------------------------------------- components


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    links += [tuple(x) for x in rng.integers(300, 400, (60, 2)).tolist()] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes_of(400, links)
    assert got == {i: want[i] for a, b in links for i in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- embeddings


def brute_vectors(rows, threshold):
    unit = []
    for v, x, label in rows:
        x = None if x is None or any(c is None or not math.isfinite(c) for c in x) else np.array(x, np.float32).astype(float)
        unit.append(None if x is None or label is None or v is None or not x.any() else x / np.linalg.norm(x))
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    count = Counter(i for link in links for i in link)
    up = classes_of(len(rows), links)
    groups = defaultdict(list)
    for i, r in enumerate(up):
        groups[r].append(rows[i][0])
    out = []
    for i, (v, _, _) in enumerate(rows):
        own = groups[up[i]]
        component = None if v is None else min(x for x in own if x is not None)
        out.append((v, count[i], component, v is not None and v == component))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(binary_codes, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = []
    for k in range(160):
        x = centres[k % 12] + rng.standard_normal(16) * (0.05 + 0.3 * (k % 3))
        rows.append((k, [float(c) for c in np.float32(x)], k % 2))
    rows += [(200 + k, rows[0][1], 0) for k in range(9)]  # copies
    rows += [(300, [c * 3 for c in rows[0][1]], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [None] + [1.0] * 15, 0)]
    rows += [(305, [float("nan")] * 16, 0), (306, [], 0), (307, rows[0][1][:8], 0), (None, rows[0][1], 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash")).withColumn("n", F.lit(1))
    got = binary_codes.near_vectors(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute_vectors(rows, 0.93), key=key)
    assert binary_codes.near_vectors(df.filter("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    dim, x = 64, rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ binary_codes.rotation(dim, 0)
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    factor = np.abs(turned).sum(1) / math.sqrt(dim)
    error = np.sign(turned) @ turned.T / (math.sqrt(dim) * factor)[:, None] - x @ x.T
    apart = error[~np.eye(400, dtype=bool)]
    assert abs(apart.mean()) < 0.002
    bound = np.sqrt(1 - factor**2) / factor * binary_codes.EPS / math.sqrt(dim - 1)
    assert (np.abs(error) <= bound[:, None]).all()
    assert np.mean(np.abs(apart) < 0.3 * bound.mean()) > 0.5


# ---------------------------------------------------------------- near copies of texts


def brute_classes(texts, threshold=0.8):
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    grams = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in words]

    def similar(i, j):
        if not words[i] or not words[j]:
            return (texts[i] or "") == (texts[j] or "") and not words[i] and not words[j]
        n, m = len(grams[i]), len(grams[j])
        row = [0] * (m + 1)  # longest common subsequence of five-word runs
        for a in grams[i]:
            last, row = row, [0]
            for k, b in enumerate(grams[j]):
                row.append(last[k] + 1 if a == b else max(row[-1], last[k + 1]))
        return row[-1] >= threshold * (n + m - row[-1]) - 1e-9

    return classes_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar(i, j)])


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        k = int(rng.integers(len(words)))
        words[k : k + 1] = [[], ["word%d" % rng.integers(99)], [words[k], "more"]][int(rng.integers(3))]
    return " ".join(words)


@pytest.mark.parametrize("block", [2048, 6])
def test_near_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK_TEXTS", block)
    rng = np.random.default_rng(7)
    bases = [" ".join("w%d" % k for k in rng.integers(0, 400, 120)) for _ in range(6)]
    texts = [varied(rng, bases[k % 6], int(rng.integers(0, 5))) for k in range(90)]
    texts += [texts[0], texts[0].upper() + "!", "", "", None, "!!!", "one two", "one  two", "one two three", bases[0] + " " + bases[1], bases[1] + " " + bases[0]]
    texts += ["same words " * 60, "same words " * 60 + "here", "same words " * 20]
    want = brute_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(5)
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(df).collect()}
    assert got == dict(enumerate(want))


def repetitive(rng):
    """Texts with a line or passage that recurs, each with edited copies: early recurrences gone, moved or changed."""
    some = lambda n: " ".join("w%d" % k for k in rng.integers(0, 9000, n))
    texts = []
    for n_parts, n_line, n_part in ((10, 12, 40), (8, 30, 30)):
        line, parts = some(n_line), [some(n_part) for _ in range(n_parts)]
        whole = [x for part in parts for x in (line, part)]
        texts += [" ".join(whole), " ".join(whole[1:]), " ".join(whole[:2] + whole[3:]), " ".join([line, *whole])]
        texts += [varied(rng, texts[-3], 1), " ".join(parts), " ".join([line] * n_parts + parts)]
    passage = some(60)
    return texts + [" ".join([passage] * 10 + [some(8)]), " ".join([some(8)] + [passage] * 10), " ".join([passage] * 5 + [some(4)] + [passage] * 5), " ".join([passage] * 7)]


def test_near_classes_of_repetitive_texts(spark):
    texts = repetitive(np.random.default_rng(5))
    want = brute_classes(texts)
    assert want[1] == want[0] and want[8] == want[7]  # a first recurring line is gone
    got = order_minhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_a_pair_is_found_in_a_group_of_any_size():
    rng = np.random.default_rng(8)
    first = [*range(44), 89247129, 895399600, 1070790102, 898401311, 426861224]  # 40 of 50 runs in common, but few of 128 minima
    second = [*range(44), 2090079912, 1662348516, 2003567748, 662623641, 1718655300]
    for more in (0, 20):
        words = np.array([first, second, *rng.integers(0, 2**31, (more, 49)).tolist()], np.uint32)
        assert order_minhash.linked(words.ravel(), np.arange(len(words) + 1) * 49, np.zeros(len(words), int), 0.8) == [(1, 0)]


def test_common_runs_are_counted_the_same_either_way():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**31, (4, 60))
    words = np.array([np.where(rng.random(60) < 0.01, 7, base[k % 4]) for k in range(80)], np.uint32)
    found = order_minhash.linked(words.ravel(), np.arange(81) * 60, np.zeros(80, int), 0.8)
    pairs = [(i, j) for i in range(80) for j in range(i) if order_minhash.linked(words[[j, i]].ravel(), np.array([0, 60, 120]), np.zeros(2, int), 0.8)]
    assert classes_of(80, found) == classes_of(80, pairs)


@pytest.mark.parametrize("rows", [1024, 3])
def test_alignment_of_repeated_runs_against_brute_force(monkeypatch, rows):
    monkeypatch.setattr(order_minhash, "ROWS", rows)
    rng = np.random.default_rng(6)
    found = Counter()
    for _ in range(500):
        kinds = int(rng.choice([1, 2, 5, 30]))
        a = rng.integers(0, kinds, int(rng.integers(1, 40))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(len(b) + 1))
            b[k : k + 1] = [[], [int(rng.integers(kinds))], [*b[k : k + 1], int(rng.integers(kinds))]][int(rng.integers(3))]
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(row[-1], last[k + 1]))
        want = bool(b) and row[-1] >= 0.8 * (len(a) + len(b) - row[-1]) - 1e-9
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == want
        found[want] += 1
    assert min(found[True], found[False]) > 50


def test_near_classes_of_edge_rows(spark, edges):
    got = [(r.doc_id, r.class_id) for r in order_minhash.near_classes(edges).collect()]
    assert sorted(got, key=lambda x: (x[0] is None, x[0] or 0)) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (6, 6), (7, 7), (None, None)]
    assert order_minhash.near_classes(edges.filter("false")).count() == 0


def test_every_row_with_a_null_id_comes_back(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "A b c d e f!")]
    got = order_minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id or 0, r.class_id or 0) for r in got)) == [(0, 0), (0, 0), (0, 0), (1, 1), (2, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 12), max_size=40))
def test_alignment_is_the_longest_common_subsequence(a, b):
    def labelled(x):
        seen = Counter()
        return [(v, seen.update([v]) or seen[v]) for v in x]

    p, q = labelled(a), labelled(b)
    row = [0] * (len(q) + 1)
    for v in p:
        last, row = row, [0]
        for k, w in enumerate(q):
            row.append(last[k] + 1 if v == w else max(row[-1], last[k + 1]))
    want = bool(p) and bool(q) and row[-1] >= 0.8 * (len(p) + len(q) - row[-1]) - 1e-9
    numbers = lambda x: np.array([v * 1000 + k for v, k in x], np.uint64)
    assert order_minhash.aligned(numbers(p), numbers(q)) == want


def test_sketches_keep_text_order():
    keys = np.arange(50, dtype=np.uint64)
    both = np.concatenate([keys, keys[::-1]])
    found = order_minhash.sketches(both, np.array([0, 50, 100]), 8)
    assert (found[0] != found[1]).all()
    assert (order_minhash.sketches(both[:50], np.array([0, 50]), 8) == found[0]).all()
    offsets, words = order_minhash.Words().hashes(pa.array(["a b c d e a b c d e a b c d e"]))
    assert len(set(order_minhash.kmers(words, offsets)[1].tolist())) == 11


# ---------------------------------------------------------------- lines


def brute_lines(rows, depth=4, similarity=0.8):
    def parse(line):
        tokens = [("<*>" if re.search("[0-9]", t) else t) for t in line.strip(" ").split(" ")]
        return tuple(tokens)

    unique = {(d, t) for d, t in rows if d is not None and t is not None}
    lines = [(d, t, k, parse(x)) for d, t in unique for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    counts = Counter(p for *_, p in lines)
    leaves = defaultdict(list)
    for p in counts:
        leaves[len(p), p[:depth]].append(p)
    key = {}
    for leaf, members in leaves.items():
        seeds = []
        for p in sorted(members, key=lambda p: (counts[p], " ".join(p).encode()), reverse=True):
            seed = next((s for s in seeds if sum(a == b for a, b in zip(p, s)) >= similarity * len(p)), None)
            if seed is None:
                seeds.append(seed := p)
            key[p] = leaf, seed
    where = defaultdict(set)
    for d, _, _, p in lines:
        where[key[p]].add(d)
    gone = {(d, t, k) for d, t, k, p in lines if len(where[key[p]]) > 1 and d > min(where[key[p]])}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, None, None))
            continue
        parts = t.split("\n")
        kept = [x for k, x in enumerate(parts) if (d, t, k) not in gone]
        out.append((d, "\n".join(kept), None if d is None else len(parts), None if d is None else len(parts) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or 0))


def test_lines_against_brute_force(spark, edges):
    rng = np.random.default_rng(11)
    kinds = ["page %d of nine hundred and more pages here", "All rights reserved.", "user %d logged in from host h%d at noon today", "  ", "", "a b c d %s f g h i j"]
    rows = []
    for d in range(60):
        some = [kinds[int(rng.integers(len(kinds)))] for _ in range(int(rng.integers(0, 6)))]
        some = [s.replace("%d", str(int(rng.integers(99)))).replace("%s", "xyz"[int(rng.integers(3))]) for s in some]
        rows.append((d // 2 * 2 if d % 10 == 0 else d, "\n".join(some + ["own %s line" % "".join(map(str, rng.integers(0, 9, 3)))[: d % 3]])))
    rows += [rows[3], (None, "All rights reserved."), (99, None), (98, ""), (97, "All rights reserved."), (96, "\n".join(["All rights reserved."] * 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit("clash"))
    out = line_templates.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert order(got) == order(brute_lines(rows))
    plain = [(r[0], r[1]) for r in EDGES]
    assert order([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring_lines(edges).collect()]) == order(brute_lines(plain))
    assert line_templates.drop_recurring_lines(df.filter("false")).count() == 0


def test_lines_of_several_groups_in_a_leaf(spark, monkeypatch):
    """Fifty variants beside an unrelated line that occurs twice; families of one leaf; rounds of few seeds."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    lead, rows = ["the", "same", "four", "words"], []
    odd = " ".join(lead + words[:16])
    rows += [(1000, odd), (1001, odd)]
    family = [" ".join(lead + words[20:27] + [words[100 + k]] + words[28:36]) for k in range(50)]
    rows += list(enumerate(family))
    single = [" ".join(lead + [words[int(i)] for i in rng.integers(0, 400, 16)]) for _ in range(30)]
    rows += [(2000 + k, x) for k, x in enumerate(single)] + [(3000, single[3] + "\nend")]
    for k in range(40):  # three families whose members vary in up to three places
        base = words[40 + 16 * (k % 3) : 56 + 16 * (k % 3)]
        for i in rng.integers(0, 16, 3):
            base[int(i)] = words[int(rng.integers(0, 400))]
        rows.append((4000 + k, " ".join(lead + base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_doc", "_text", "_hash", "_parts", "_gone", "a.b", "c`d", "leaf", "c0"):
        df = df.withColumn(name, F.lit("clash"))
    want = brute_lines(rows)
    assert sum(n for d, _, _, n in want if d < 50) == 49
    for seeds in (64, 3):
        monkeypatch.setattr(line_templates, "SEEDS", seeds)
        out = line_templates.drop_recurring_lines(df)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        assert order([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]) == order(want)
        assert out.filter("leaf = 'clash' and `a.b` = 'clash' and `c``d` = 'clash'").count() == len(rows)


@pytest.mark.parametrize("name", ["op9_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert order([tuple(r) for r in got]) == order(want.fetchall())
