"""License scans against a naive version: all matches of all rules, all pairs of intervals."""

import re

import duckdb
import pytest

from civicscope.llm import queries
from civicscope.llm.license_rules import Rule, compiled, rules
from civicscope.llm.license_scan import WEIGHTS, detections, license_labels

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEXTS = [
    (1, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    (2, "CC-BY 4.0 and Creative Commons Attribution-NonCommercial 3.0; cc by-nc-sa 2.5"),
    (3, "GNU General Public License, version 3. All rights reserved. ALL  RIGHTS\tRESERVED all rights"),
    (4, "SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT"),
    (5, "Tous droits réservés. TOUS DROITS RÉSERVÉS. Kein mit license. İK cc\x00by"),
    (6, "all rights reserved cc by " * 3000),
    (7, "Lesser general public licence; the GNU Lesser General Public License v2 1"),
    (8, ""),
    (9, None),
    (None, "All rights reserved."),
    (3, "GNU General Public License, version 3. All rights reserved. ALL  RIGHTS\tRESERVED all rights"),
    (10, "accc by the by cc bye 中文cc by"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def spans(text):
    parts = words(text)
    shown = "".join(f" {w} " for w in parts)
    ends = {}
    at = 0
    for k, w in enumerate(parts):
        ends[at] = k
        at += len(w) + 2
    ends[at] = len(parts)
    return [(ends[m.start()], ends[m.end()], number, r) for number, r in enumerate(rules()) for m in re.finditer(r.regex, shown)]


def resolved(found):
    def held(x):
        a, z, n, r = x
        strength = (r.priority, z - a, -n)
        return any(b <= a and y >= z and (s.priority, y - b, -m) > strength for b, y, m, s in found if m != n or b != a)

    return [(x, not held(x)) for x in found]


def naive(doc, text):
    parts = words(text)
    found = resolved(spans(text))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(parts)) if parts[k : k + len(phrase.split())] == phrase.split()]
    kept = {r.label for (_, _, _, r), keep in found if keep or r.base}
    score = max((WEIGHTS[r.priority] for (_, _, _, r), keep in found if keep), default=0.0)
    at = [k for k, _ in places]
    return (doc, len(parts), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(kept)), score)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def notices(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "text as label", "1 as row", "2 as `a.b`", "text as words")


def test_rules_are_many_and_gated():
    assert len(rules()) > 300 and sum(r.base for r in rules()) == 3
    for r in rules():
        first = re.search(r"[^ ()?:|]+", r.regex)
        assert r.keyword and first
    assert compiled("a ~b ..2 c") == " (?:a) (?: (?:b) )?(?: [^ ]+ ){0,2}? (?:c) "


def test_every_match_holds_its_keyword(spark, notices):
    table = rules()
    for _, text in TEXTS[:5]:
        parts = words(text)
        for a, z, _, r in spans(text):
            assert any(w.startswith(r.keyword) for w in parts[a:z]), r
    assert {r.rule for r in detections(notices).collect()} <= set(range(len(table)))


def test_labels(notices):
    short = [(d, t) for d, t in TEXTS if d != 6]
    got = order(license_labels(notices.filter("doc_id <> 6 or doc_id is null")).collect())
    assert got == order(naive(d, t) for d, t in short)


def test_long_text(notices):
    (row,) = license_labels(notices.filter("doc_id = 6")).collect()
    assert tuple(row) == (6, 15_000, 6000, 0, 14_998, "cc-by,reserved", "cc-by,reserved", 0.5)


def test_detections(notices):
    got = order((r.start, r.end, r.rule, r.kept) for r in detections(notices.filter("doc_id in (1, 2, 4, 7)")).collect())
    assert got == order((a, z, n, keep) for d, t in TEXTS if d in (1, 2, 4, 7) for (a, z, n, _), keep in resolved(spans(t)))


def test_own_rules_and_empty(spark, notices, edges):
    own = [Rule("dog", 2, "lazy", compiled("lazy dog")), Rule("bank", 3, "old", compiled("old river bank"), True)]
    got = {(r.doc_id, r.n_base, r.labels) for r in license_labels(edges, signatures=own).collect() if r.labels}
    assert got == {(1, 1, "bank,dog"), (5, 1, "bank,dog")}
    assert license_labels(notices.limit(0)).collect() == []
    assert license_labels(edges).count() == edges.count()


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE["op13_license_scan"]).fetchall()
    assert order(license_labels(small).collect()) == order(want)
