"""License and rights notices by ordered signature rules, in DataFrame operations only.

A text is read as words (digits, letters, all beyond ASCII), A-Z in lower case, and written with
every word between two spaces of its own, so a signature is a regular expression over whole
words.  One pass over a text finds which keywords begin a word of it; only rules with such a
keyword are tried.  A rule's matches are counted in words inside the row (gaps and sizes), texts
never leave it: what is shuffled are numbers of the matches.  There running sums give each match
its interval, and one ordered walk over a document's intervals resolves overlaps: a match goes
if another of a higher priority, or of the same priority and longer (same length: an earlier
rule), holds all of it.  Base rules keep all their places whatever holds them.

Defined cases: null text is the empty text and has no words; null ids and repeated rows come
back one row each; texts of any length are read whole; equal intervals go by rule order; only
the id and the text are read, so other columns may have any names; empty in, empty out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicscope.llm.frames import stored
from civicscope.llm.license_rules import Rule, rules

#: What stands between words, after lowering A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Score of the strongest kept match by its priority.
WEIGHTS = {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def worded(text: Column) -> Column:
    """' w0  w1  w2 ': each word between two spaces; without words the empty text."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    trimmed = F.trim(F.regexp_replace(lowered, BETWEEN, "  "))
    return F.when(trimmed == "", "").otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def n_words(words: Column) -> Column:
    """Words of a piece of ``worded`` text."""
    return F.shiftright(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))), 1)


def keyword_pattern(keywords: list[str]) -> str:
    """Finds all keywords that begin words; the longest of those that begin one word."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(keywords), key=lambda w: (-len(w), w)):
        by_first.setdefault(word[0], []).append(word[1:])
    return " ((?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items())) + "))"


def _literal(rows: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), F.lit(schema))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(words: Column, signatures: list[Rule]) -> Column:
    """Per rule that matches: its number, the words before, between and after its matches, the words of each."""
    by_keyword: dict[str, list[dict]] = {}
    for number, rule in enumerate(signatures):
        by_keyword.setdefault(rule.keyword, []).append({"rule": number, "regex": rule.regex})
    gated = _literal([{"keyword": k, "rules": r} for k, r in by_keyword.items()], "array<struct<keyword:string,rules:array<struct<rule:int,regex:string>>>>")
    pattern = F.lit(keyword_pattern(list(by_keyword)))

    def tried(present: Column) -> Column:
        groups = F.filter(gated, lambda g: F.exists(present, lambda p: F.startswith(p, g["keyword"])))
        return F.flatten(F.transform(groups, lambda g: g["rules"]))

    def found(words: Column) -> Column:
        def counted(rule: Column) -> Column:
            gaps = F.transform(F.split(words, rule["regex"], -1), n_words)
            sizes = F.transform(F.regexp_extract_all(words, rule["regex"], F.lit(0)), n_words)
            return F.struct(rule["rule"].alias("rule"), gaps.alias("gaps"), sizes.alias("sizes"))

        keywords = F.array_distinct(F.regexp_extract_all(words, pattern, F.lit(1)))
        return F.filter(F.transform(_bound(keywords, tried), counted), lambda m: F.size(m["sizes"]) > 0)

    return _bound(words, found)


def _scanned(docs: DataFrame, id: str, text: str, signatures: list[Rule]) -> DataFrame:
    """(row, id, n_words, hits), numbered and stored once: row tells repeated rows apart."""
    read = docs.select(F.col(f"`{id}`").alias("id"), worded(F.col(f"`{text}`")).alias("words"))
    return stored(read.select(F.monotonically_increasing_id().alias("row"), "id", n_words(F.col("words")).cast("long").alias("n_words"), matches(F.col("words"), signatures).alias("hits")))


def _resolved(scanned: DataFrame, signatures: list[Rule]) -> DataFrame:
    """One row per match: interval in words (end excluded), rule, label, priority, base, kept."""
    table = _literal([{"label": r.label, "priority": r.priority, "base": r.base} for r in signatures], "array<struct<label:string,priority:int,base:boolean>>")
    each = scanned.filter(F.size("hits") > 0).select("row", "id", F.explode("hits").alias("hit")).repartition("row")
    each = each.select("row", "id", F.col("hit.rule").alias("rule"), F.col("hit.gaps").alias("gaps"), F.posexplode("hit.sizes").alias("k", "size"))
    each = each.select("row", "id", "rule", "k", "size", F.get("gaps", F.col("k")).alias("gap"), F.get(table, F.col("rule")).alias("of"))
    order = W.partitionBy("row", "rule").orderBy("k")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = each.withColumn("end", end).select("row", "id", "rule", "of.label", "of.priority", "of.base", (F.col("end") - F.col("size")).alias("start"), "end")
    before = W.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in sorted(WEIGHTS)]
    placed = placed.withColumn("reach", F.array(*reach))
    held = F.element_at("reach", F.col("priority")) >= F.col("end")
    return placed.withColumn("kept", ~F.coalesce(held, F.lit(False))).drop("reach")


def detections(docs: DataFrame, id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """Every match of every rule with its words [start, end) and whether it is kept."""
    signatures = rules() if signatures is None else signatures
    return _resolved(_scanned(docs, id, text, signatures), signatures).withColumnRenamed("id", id)


def license_labels(docs: DataFrame, id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: words, places of the base rules, labels and a score from 0 to 1."""
    signatures = rules() if signatures is None else signatures
    scanned = _scanned(docs, id, text, signatures)
    weight = F.element_at(F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item]), F.col("priority"))
    at, label = F.when(F.col("base"), F.col("start")), F.col("label")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    summed = _resolved(scanned, signatures).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        joined(F.when(F.col("base"), label)).alias("base_labels"),
        joined(F.when(F.col("base") | F.col("kept"), label)).alias("labels"),
        F.max(F.when(F.col("kept"), weight)).alias("score"),
    )
    out = scanned.drop("hits").join(summed, "row", "left").fillna(0, ["n_base", "score"]).fillna("", ["base_labels", "labels"])
    return out.select(F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
