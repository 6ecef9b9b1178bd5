"""Source divergence against a dense brute-force version."""

import re
from collections import Counter, defaultdict

import pytest

from civicscope.llm.divergence import BLOCK, divergence, document_terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top=50):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(lower))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=lambda s: s.encode())

        def shares(n):
            total = sum(n[t] for t in kept)
            return [1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s]
            terms = [(y - x, t.encode(), t) for t, x, y in zip(kept, p[s], q) if counts[lang, s][t] and x > y]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in divergence(df, **more).collect())


def test_terms_are_bytes_of_letters():
    assert document_terms("Éa ZZ\x00a1b_ x\tÀ".encode()) == Counter(["Éa".encode(), b"zz", b"a", b"b", " x".encode(), "À".encode()])


def test_documents(spark, small):
    rows = [(r.lang, r.source, r.text) for r in small.collect()]
    for least in (30, 4):
        assert got(small, min_docs=least) == brute(rows, least)


def test_edges(spark, edges):
    rows = [(None, r.score, r.text) for r in edges.collect()]
    df = edges.withColumnRenamed("score", "source").selectExpr("*", "cast(null as string) as lang", "1 as term", "2 as p", "3 as n")
    for least in (1, 2, 30):
        assert got(df, min_docs=least) == brute(rows, least)
    assert got(df.limit(0)) == []


def test_ties_hot_source_and_names_with_dots(spark):
    rows = [("x", "s1" if k % 3 else f"s{k}", "same words here " * (k % 4)) for k in range(60)] + [("y", None, None), ("y", "é", "A a À")]
    df = spark.createDataFrame(rows, "`a.b` string, source string, `text` string")
    assert got(df, lang="a.b", min_docs=2, top_terms=2) == brute(rows, 2, 2)


@pytest.mark.parametrize("n", [BLOCK + 40])
def test_more_sources_than_a_block(spark, n):
    rows = [("x", f"s{k}", " ".join(f"w{chr(97 + (k * j) % 23)}" for j in range(1, 2 + k % 9))) for k in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(df, min_docs=3) == brute(rows, 3)
