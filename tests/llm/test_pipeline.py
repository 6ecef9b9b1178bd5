"""The pipeline stage by stage against brute-force versions, on the smallest documents."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civicscope.llm import quality, toxicity

from .test_dedup import brute_classes, brute_lines, order
from .test_tokens_packing import expected_pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What every stage got and gave, written and read again as the check does."""
    root = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"file://{root}/{k}")
        result = spark.read.parquet(f"file://{root}/{k}")
        out.append((name, docs, result))
        docs = result
    return out


def test_stages_and_columns(spark, steps):
    assert [s[0] for s in steps] == ["toxicity", "quality", "line dedup", "near dedup", "packing"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(result.columns == columns for _, _, result in steps[:-1])


@pytest.mark.parametrize("place,module,label,keeps", [(0, toxicity, "toxic", lambda s: s < 0.5), (1, quality, "quality", lambda s: s >= 0.3)])
def test_classifiers_decide(spark, steps, place, module, label, keeps):
    _, docs, result = steps[place]
    model = module.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), label=label)
    rows = docs.collect()
    texts = pa.array([r.text for r in rows], pa.string())
    scores = model.scores(texts) if module is toxicity else model.scores(quality.Features().matrix(texts))
    assert sorted(result.collect()) == sorted(r for r, s in zip(rows, scores) if keeps(s))


def test_lines_go(steps):
    _, docs, result = steps[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(d, t) for d, t, *_ in brute_lines(rows)]
    got = [(r.doc_id, r.text) for r in result.collect()]
    assert order([(*r, 0) for r in got]) == order([(*r, 0) for r in want])
    assert result.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_each_class_stays(steps):
    _, docs, result = steps[3]
    rows = sorted(docs.collect())
    short = [r for r in rows if len(r.text) < 1500]  # the brute-force alignment is slow on long texts
    first = brute_classes([r.text for r in short])
    kept = {r.doc_id for r in result.collect()}
    own = {short[k].doc_id for k, c in enumerate(first) if c == k}
    assert {d for d in kept if d in {r.doc_id for r in short}} == own
    long = [r for r in rows if len(r.text) >= 1500]
    assert len({r.text for r in long}) >= sum(r.doc_id in kept for r in long)
    assert sorted(result.collect()) == [r for r in rows if r.doc_id in kept]


def test_all_is_packed(steps):
    _, docs, result = steps[4]
    rows = result.collect()
    want = expected_pieces(public_tokenizers.path("word_bpe_49k.json"), [(r.doc_id, r.text) for r in docs.collect()], 0, 2048)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(w[:5] for w in want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(names).collect()) == sorted(steps[-1][2].select(names).collect())


def test_no_text_is_lost_to_a_shared_id(spark):
    text = "a text of its own that stands nowhere else in the table and has enough words"
    rows = [(3, ""), (5, text), (5, None), (6, "some other words that are not like the first ones at all"), (7, text), (8, ""), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars", "'x' as class_id")
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((d, t) for d, t in rows if d not in (7, 8)), key=repr)


def test_stages_on_edges(spark, edges):
    """Nulls, empty and long texts, repeated rows and other columns go through every stage; an empty table too."""
    for docs in (edges.withColumn("n_chars", F.length("text").cast("long")), edges.limit(0).withColumn("n_chars", F.lit(0).cast("long"))):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.count() <= n
        packed = corpus_pipeline.pack(spark, docs, FOLDER)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
