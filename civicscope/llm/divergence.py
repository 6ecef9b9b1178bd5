"""How the sources of each language differ: smoothed term frequencies, exact integer distances.

A text is tokenised as bytes: one ``bytes.translate`` lowers A-Z and blanks every separator,
``bytes.split`` cuts, a ``Counter`` per document gives its frequencies, and tasks add these up
per (language, source) before anything is shuffled.  A language keeps the terms that enough of
its documents hold.  A group's share of a term is ``1 + scale * (n + s) div (N + s * V)``.

The distance of two sources sums over all kept terms, yet only occurring (source, term) cells
are touched.  With z the share of an absent term, T the sum of all shares of a source and m its
number of occurring terms,

    sum |p_a - p_b| = T_a + T_b - 2 * sum min(p_a, p_b)
    sum min(p_a, p_b) = M(a, z_b) + M(b, z_a) + H(a, b) + (V - m_a - m_b) * min(z_a, z_b)

M(a, z) sums min(p_a, z) over a's own terms: running totals over its distinct shares.  H corrects
the terms both hold; a task walks the cells of its terms in order and adds them to a table of two
blocks of at most ``BLOCK`` sources, so memory does not depend on the data.  A term that all
sources hold costs one step per pair of sources, which is the size of the answer.

Defined cases: null text, language and source count as ''; a group without terms has all its
shares equal; a language without kept terms gives distances 0 and no terms; repeated rows (and
rows with equal or null ids: ids are not read) are documents of their own; ties go by UTF-8
order; other columns, whatever their names, are not read; empty in, empty out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicscope.llm.frames import column, reach, stored
from civicscope.operators.relations import hot_keys, skew_join, top_n

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Sources whose pairs a task sums at once: the table has BLOCK * BLOCK numbers.
BLOCK = 256
#: Distinct (group, term) entries that a task holds before it passes them on.
HELD = 300_000
#: Pairs of cells compared at once.
PAIRS = 1 << 20

#: ASCII letters in lower case, bytes of other letters as they are, all else a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def document_terms(text: bytes) -> Counter:
    """Frequencies of the terms of one text."""
    return Counter(text.translate(TABLE).split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            size = len(n)
            if size:
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=50_000)
        groups.clear()

    for batch in batches:
        texts = column(batch, "text").cast(pa.binary())
        for lang, source, text in zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), texts):
            terms = document_terms(text.as_buffer().to_pybytes())
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(terms.keys())
            held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group."""
    reach(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    return read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * terms)) in longs, exact up to 9e13 occurrences."""
    step, rest = 100_000, SCALE // 100_000
    below = total + F.lit(smoothing) * terms
    wide = (n + F.lit(smoothing)) * F.lit(step)
    whole = F.call_function("div", wide, below)
    return F.lit(1) + whole * F.lit(rest) + F.call_function("div", (wide - whole * below) * F.lit(rest), below)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """H of the pairs of sources; rows come in order of (lang, a, b, term)."""
    now, total, names, tail = None, None, {}, None

    def emit() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total)
        if now is not None and len(at):
            i, j = np.divmod(at, 2 * BLOCK)
            ones = [pa.array([now[0]] * len(at)), pa.array([names[x] for x in i.tolist()]), pa.array([names[x] for x in j.tolist()]), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(ones, names=["lang", "source", "other", "h"])

    def add(place: np.ndarray, p: np.ndarray, z: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Runs of one term each."""
        crossed = now[1] != now[2]
        for size in np.unique(lengths).tolist():
            if size < 2:
                continue
            left, right = np.triu_indices(size, 1)
            runs = starts[lengths == size]
            step = max(1, PAIRS // len(left))
            for k in range(0, len(runs), step):
                i, j = runs[k : k + step, None] + left, runs[k : k + step, None] + right
                i, j = i.reshape(-1), j.reshape(-1)
                if crossed:  # pairs inside one block belong to the task of that block
                    apart = (place[i] < BLOCK) != (place[j] < BLOCK)
                    i, j = i[apart], j[apart]
                low = np.minimum(z[i], z[j])
                h = np.minimum(p[i], p[j]) - np.minimum(p[i], z[j]) - np.minimum(z[i], p[j]) + low
                np.add.at(total, np.minimum(place[i], place[j]) * 2 * BLOCK + np.maximum(place[i], place[j]), h)

    def walk(rows: pa.Table) -> None:
        if rows.num_rows:
            term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            place = rows["place"].to_numpy()
            for x, name in dict(zip(place.tolist(), rows["source"].to_pylist())).items():
                names[x] = name
            add(place, rows["p"].to_numpy(), rows["z"].to_numpy(), starts, np.diff(np.append(starts, len(term))))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if tail is not None:
            table = pa.concat_tables([tail, table])
        keys = list(zip(*[table[c].to_pylist() for c in ("lang", "a", "b")]))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a)
            if keys[a] != now:
                yield from emit()
                now, total, names = keys[a], np.zeros(4 * BLOCK * BLOCK, np.int64), {}
            if b == len(keys):  # the last term may go on in the next batch
                term = part["term"].to_pylist()
                stop = len(term)
                while stop and term[stop - 1] == term[-1]:
                    stop -= 1
                tail, part = part.slice(stop), part.slice(0, stop)
            walk(part)
    if tail is not None:
        walk(tail)
    yield from emit()


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source).

    ``part`` 'pair': item is every other source of the language, value the sum of share
    differences.  ``part`` 'term': the terms most over-represented against the language, at most
    ``top_terms`` of them (the report's length).
    """
    group = ["lang", "source"]
    counted = stored(term_counts(docs, text, lang, source))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= min_docs).drop("docs")
    cells = stored(counted.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    every = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    own = cells.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    groups = every.join(own, group, "left").join(langs, "lang", "left").fillna(0, ["total", "m", "terms", "lang_total"])
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"), smoothing)).otherwise(F.lit(0))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("z", absent).withColumn("number", number)
    groups = stored(groups.withColumn("blocks", F.floor(F.max("number").over(W.partitionBy("lang")) / BLOCK).cast("int") + 1))

    sized = skew_join(cells, groups, group, ["term"], hot_keys(cells, group))
    sized = sized.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), smoothing)).withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("terms"), smoothing))
    sized = stored(sized.select(*group, "term", "p", "q", "z", "number", "blocks"))

    over = sized.filter("p > q").select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = top_n(over, group, [F.col("value").desc(), F.col("item").asc()], top_terms, "rank")

    # M(a, z_b): the other sources' z placed among a's distinct shares.
    shares = sized.groupBy(*group, "p").agg(F.count("*").alias("k"))
    points = shares.select(*group, F.col("p").alias("at"), "k", (F.col("k") * F.col("p")).alias("kp"))
    sums = points.groupBy(*group).agg(F.sum("kp").alias("own"))
    a = groups.join(sums, group, "left").fillna(0, ["own"]).select(*group, "terms", "m", F.col("z").alias("z"), (F.col("own") + (F.col("terms") - F.col("m")) * F.col("z")).alias("sum"))
    b = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("at"))
    asked = a.join(b, "lang").filter(F.col("source") != F.col("other"))
    rows = points.unionByName(asked.withColumn("k", F.lit(0)).withColumn("kp", F.lit(0)), allowMissingColumns=True)
    until = W.partitionBy(*group).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("below", F.sum("k").over(until)).withColumn("below_sum", F.sum("kp").over(until)).filter(F.col("other").isNotNull())
    m = F.col("below_sum") + (F.col("m") - F.col("below")) * F.col("at")
    part = F.col("sum") - 2 * m - (F.col("terms") - 2 * F.col("m")) * F.least("z", "at")
    own_parts = placed.select("lang", "source", "other", part.alias("c"))

    here = F.floor(F.col("number") / BLOCK).cast("int")
    copies = sized.withColumn("block", here).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.withColumn("a", F.least("block", "with")).withColumn("b", F.greatest("block", "with"))
    second = F.when((F.col("block") == F.col("b")) & (F.col("a") != F.col("b")), BLOCK).otherwise(0)
    copies = copies.select("lang", "a", "b", "term", "source", "p", "z", (F.col("number") % BLOCK + second).cast("long").alias("place"))
    walked = copies.repartition("lang", "a", "b", "term").sortWithinPartitions("lang", "a", "b", "term")
    shared = walked.mapInArrow(_shared, "lang string, source string, other string, h long")

    both = own_parts.unionByName(shared.select("lang", "source", "other", (F.col("h") * -2).alias("c")))
    summed = both.groupBy("lang", F.least("source", "other").alias("x"), F.greatest("source", "other").alias("y")).agg(F.sum("c").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = summed.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.col("value").desc(), F.col("item").asc())))
    return pairs.unionByName(terms).select(*group, "part", "item", "value", F.col("rank").cast("int").alias("rank"))
