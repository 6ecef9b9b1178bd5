import binascii

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civicscope.llm import preferences, quality, queries, toxicity
from civicscope.llm.frames import held_out


def test_held_out_is_crc32_of_the_id(spark):
    df = spark.range(200).select("id", held_out("id").alias("h"))
    assert all(r.h == (binascii.crc32(str(r.id).encode()) % 5 == 0) for r in df.collect())


def labelled_docs(spark, n=400):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels = [], []
    for d in range(n):
        some = list(rng.choice(words, 60))
        toxic, poor = d % 7 == 0, d % 5 == 0
        if toxic:
            some[7], some[30] = "zorbling" if d % 2 else "zorbful", "You"
        if poor:
            some = [w + "%%%" for w in some]
        rows.append((d, " ".join(some)))
        labels.append((d, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(docs, labels, scored, name, threshold, column):
    rows = scored.join(labels, "doc_id").filter(held_out("doc_id")).select(name, column).collect()
    return np.mean([(r[column] >= threshold) == (r[name] == 1) for r in rows])


def test_held_out_accuracy_of_both_classifiers(spark):
    docs, labels = labelled_docs(spark)
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("zorb") for s in model.voters.stems)
    assert accuracy(docs, labels, toxicity.score(docs, model), "toxic", 0.5, "score") > 0.97
    assert accuracy(docs, labels, quality.score(docs, quality.fit(docs, labels)), "quality", 0.3, "score") > 0.97


def test_no_label_of_a_held_out_row_is_used(spark):
    docs, labels = labelled_docs(spark, 200)
    flipped = labels.select("doc_id", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.voters.stems == b.voters.stems and np.allclose(a.weights, b.weights)


def test_significance_follows_the_number_of_stems(spark):
    def mined(n_bad, others):
        rows = [(k, "zorbling", 1) for k in range(n_bad)] + [(n_bad + k, " ".join(others[k::n_bad]), 0) for k in range(n_bad)]
        return toxicity.mine_stems(spark.createDataFrame(rows, "id long, text string, label int"))

    assert "zorbling$" in mined(12, ["one", "two"] * 12)  # 12 log 2 is enough for a handful of stems
    assert mined(20, [f"{k:06d}" for k in range(120_000)]) == []  # 20 log 2 is not for over 100,000


def test_real_labels_at_small_scale(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert accuracy(docs, labels, quality.score(docs, quality.fit(docs, labels)), "quality", 0.3, "score") > 0.9
    assert accuracy(docs, labels, toxicity.score(docs, toxicity.fit(docs, labels)), "toxic", 0.5, "score") > 0.9


def test_edge_rows_are_scored(spark, edges):
    docs, labels = labelled_docs(spark, 100)
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels, label=name)
        out = module.score(edges, model)
        assert out.columns == ["doc_id", "text", "length", "ids", "n_dropped", "score"]
        rows = out.collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
        assert module.score(edges.filter("false"), model).count() == 0
        assert all(0 <= r.score <= 1 for r in module.score(edges, module.fit(docs, labels.filter("false"), label=name)).collect())
        one_class = module.fit(docs, labels.withColumn(name, F.lit(1)), label=name)
        assert all(0 <= r.score <= 1 for r in module.score(edges, one_class).collect())
        clash = module.fit(edges, spark.createDataFrame([(1, None), (4, 1), (4, 0), (None, 1), (6, 0)], f"doc_id long, {name} int"), label=name)
        assert module.score(edges, clash).count() == 9


def test_label_model_finds_rates_and_groups():
    rng = np.random.default_rng(0)
    toxic = rng.random(4000) < 0.15
    votes = np.zeros((4000, 6))
    for k, (good, bad) in enumerate([(0.01, 0.6), (0.02, 0.5), (0.005, 0.7), (0.3, 0.3)]):
        votes[:, k] = rng.random(4000) < np.where(toxic, bad, good)
    votes[:, 4] = votes[:, 5] = votes[:, 2]  # three copies of one voter
    model = toxicity.fit_label_model(votes, 0.15)
    assert len(set(model.groups[[2, 4, 5]])) == 1 and np.allclose(model.share[[2, 4, 5]], 1 / 3)
    assert abs(model.fires[0, 1] - 0.6) < 0.1 and model.fires[0, 0] < 0.05
    assert np.mean((model.posterior(votes) > 0.5) == toxic) > 0.95


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = quality.fit_additive(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95
    by_hand = model.constant + sum(t[np.searchsorted(e, x[:, k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        by_hand = by_hand + t[np.searchsorted(model.coarse[a], x[:, a], side="right"), np.searchsorted(model.coarse[b], x[:, b], side="right")]
    assert np.allclose(by_hand, model.odds(x))


def test_features_do_not_depend_on_the_batch():
    texts = ["One two. THREE!! | a1", "", None, "x\nx\ny", "word " * 50]
    features = quality.Features()
    together = features.matrix(pa.array(texts))
    assert together.shape == (5, len(quality.FEATURES)) and not together[1].any() and not together[2].any()
    for i, t in enumerate(texts):
        assert np.allclose(quality.Features().matrix(pa.array([t], pa.string()))[0], together[i])


# ---------------------------------------------------------------- preferences


def brute_pairs(rows):
    sides = {}
    for pair, side, turn, role, text in rows:
        if pair is not None and side in ("chosen", "rejected"):
            sides.setdefault(pair, {"chosen": [], "rejected": []})[side].append((-1 if turn is None else turn, role or "none", text or "", role == "assistant"))
    out = {}
    for pair, both in sides.items():
        placed = {}
        for side, turns in both.items():
            turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
            seen, placed[side] = {}, {}
            for t in turns:
                k = seen.get(t[0], 0)
                seen[t[0]] = k + 1
                placed[side][t[0], k] = t[1:]
        places = sorted(set(placed["chosen"]) | set(placed["rejected"]))
        stop = next((p for p in places if placed["chosen"].get(p) != placed["rejected"].get(p)), None)
        for part, side in (("prompt", "chosen"), ("chosen", "chosen"), ("rejected", "rejected")):
            text, loss, n = "", [], 0
            for p in sorted(placed[side]):
                if (stop is None or p < stop) == (part == "prompt"):
                    role, said, learn = placed[side][p]
                    head = f"<|{role}|>\n"
                    if learn and part != "prompt":
                        loss.append((len(text) + len(head), len(text) + len(head) + len(said) + len("<|end|>")))
                    text += head + said + "<|end|>\n"
                    n += 1
            if n:
                out[pair, part] = (n, text, loss)
    return out


ROWS = [
    (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "hello"), (1, "chosen", 2, "user", "q"), (1, "chosen", 3, "assistant", "good"),
    (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "hello"), (1, "rejected", 2, "user", "q"), (1, "rejected", 3, "assistant", "bad"),
    (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
    (3, "chosen", 0, "user", "alone"), (3, "chosen", 1, "assistant", "x"),
    (4, "chosen", 0, None, None), (4, "rejected", 0, None, ""), (4, "rejected", 1, "assistant", None), (4, "chosen", None, "system", "é\U0001f600"),
    (5, "chosen", 0, "user", "b"), (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"), (5, "rejected", 0, "assistant", "a"),
    (None, "chosen", 0, "user", "x"), (6, None, 0, "user", "x"), (6, "other", 0, "user", "x"),
]


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "pair_id long, side string, turn int, role string, text string").withColumn("part", F.lit("clash")).withColumn("k", F.lit(1))
    rows = preferences.format_pairs(df).collect()
    assert {(r.pair_id, r.part): (r.n_turns, r.text, [(s.start, s.end) for s in r.loss]) for r in rows} == brute_pairs(ROWS)
    assert preferences.format_pairs(df.filter("false")).count() == 0


def test_a_huge_conversation_continues_in_chunks(spark):
    n = 3 * preferences.CHUNK + 5
    rows = [(1, s, k, "assistant", f"t{k}" if k < 100 or s == "chosen" else "other") for s in ("chosen", "rejected") for k in range(n)]
    got = preferences.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).orderBy("part", "chunk").collect()
    assert max(r.n_turns for r in got) <= preferences.CHUNK
    want = brute_pairs(rows)
    for part in ("prompt", "chosen", "rejected"):
        some = [r for r in got if r.part == part]
        assert "".join(r.text for r in some) == want[1, part][1] and [r.chunk for r in some] == list(range(len(some)))
        assert all(r.text[s.start : s.end].endswith("<|end|>") for r in some for s in r.loss)


def test_registered_pairs_have_prompts(spark):
    """Every pair of the query shares its first turns; its SQL gives the same rows."""
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op4_preference_pairs"](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(queries.ORACLE["op4_preference_pairs"])
    columns = [c[0] for c in want.description]
    rows = got.select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    parts = Counter(r["part"] for r in rows)
    pairs = len({r["pair_id"] for r in rows})
    assert parts["prompt"] == pairs and parts["rejected"] > 0.5 * pairs
