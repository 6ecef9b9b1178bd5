"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicscope.llm import alignment, binary_codes, bpe_tree, divergence, license_rules, license_scan, line_templates, order_minhash, packing, parsing, preferences, quality, range_coder, toxicity
from civicscope.llm.frames import held_out, reach
from civicscope.operators.relations import shared_folder

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{folder}/{name}.parquet")


@query
def op3_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


ORACLE["op9_line_dedup"] = """
WITH RECURSIVE raw AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (
  SELECT doc_id, pos, raw, regexp_replace(trim(raw, ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM raw),
parsed AS (
  SELECT *, len(string_split(line, ' ')) AS size, array_to_string(string_split(line, ' ')[1:4], ' ') AS head
  FROM lines WHERE line <> ''),
uniq AS (SELECT size, head, line, count(*) AS n FROM parsed GROUP BY ALL),
several AS (SELECT size, head FROM uniq GROUP BY ALL HAVING count(*) > 1),
taken AS (
  SELECT size, head, line, n, CAST(NULL AS VARCHAR) AS seed FROM uniq SEMI JOIN several USING (size, head)
  UNION ALL
  SELECT size, head, line, n, CASE WHEN len(list_filter(list_zip(string_split(line, ' '), string_split(top, ' ')), lambda z: z[1] = z[2])) >= 0.8 * size THEN top END
  FROM (SELECT size, head, line, n, first_value(line) OVER (PARTITION BY size, head ORDER BY n DESC, line DESC) AS top FROM taken WHERE seed IS NULL)),
agreed AS (SELECT size, head, line, seed FROM taken WHERE seed IS NOT NULL),
keyed AS (
  SELECT p.doc_id, p.pos, p.size, p.head, coalesce(a.seed, p.line) AS template
  FROM parsed p LEFT JOIN agreed a USING (size, head, line)),
firsts AS (SELECT size, head, template, min(doc_id) AS first FROM keyed GROUP BY ALL HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT k.doc_id, k.pos FROM keyed k JOIN firsts f USING (size, head, template) WHERE k.doc_id > f.first),
put AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN d.text ELSE p.text END AS text,
       CAST(p.n_lines AS INTEGER) AS n_lines, CAST(p.n_dropped AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN put p ON d.doc_id = p.doc_id
"""


@query
def op10_near_dedup(spark, folder):
    classes = order_minhash.near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op2_packing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(cut)


@query
def op6_bpe_tree(spark, folder):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_tree.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks).drop("text")
    back = bpe_tree.decode(coded, ranks)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_fingerprints(spark, folder):
    return parsing.fingerprint_edits(table(spark, folder, "documents"))


@query
def op5_token_files(spark, folder):
    target = range_coder.new_folder(shared_folder(spark))
    docs = table(spark, folder, "documents")
    range_coder.write_files(docs, target, public_tokenizers.path("byte_bpe_50k.json"))
    return range_coder.read_files(spark, target, docs.schema["doc_id"].dataType.simpleString(), with_ids=False).withColumnRenamed("id", "doc_id")


@query
def op1_embedding_dedup(spark, folder):
    return binary_codes.near_vectors(table(spark, folder, "embeddings"))


@query
def op4_preference_pairs(spark, folder):
    """Chosen is every conversation; rejected is the same up to a place, then the next conversation's turns from there on.

    The place is the turn number ``1 + h % 4`` with a multiplicative hash h of the conversation's id.
    """
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    at, turn = (F.col("pair_id") * 48271 % 2147483647) % 4 + 1, F.coalesce(F.col("turn"), F.lit(-1))
    said = [turn.alias("turn"), "role", "text"]
    own = talks.withColumn("pair_id", F.col("conv_id"))
    after = talks.withColumn("pair_id", F.col("conv_id") - 1).filter(turn >= at)
    after = after.join(talks.select(F.col("conv_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    chosen = own.select("pair_id", F.lit("chosen").alias("side"), *said)
    rejected = own.filter(turn < at).unionByName(after).select("pair_id", F.lit("rejected").alias("side"), *said)
    turns = chosen.unionByName(rejected)
    parts = preferences.format_pairs(turns)
    spans = F.array_join(F.transform("loss", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return parts.select("pair_id", "part", "chunk", "n_turns", "text", spans.alias("loss_spans"))


ORACLE["op4_preference_pairs"] = """
WITH talks AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'none') AS role, coalesce(role = 'assistant', false) AS learned, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, learned, text FROM talks
  UNION ALL SELECT conv_id, 'rejected', turn, role, learned, text FROM talks WHERE turn < (conv_id * 48271 % 2147483647) % 4 + 1
  UNION ALL SELECT conv_id - 1, 'rejected', turn, role, learned, text FROM talks
  WHERE turn >= ((conv_id - 1) * 48271 % 2147483647) % 4 + 1 AND conv_id - 1 IN (SELECT conv_id FROM talks)),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS k FROM turns),
differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(row(coalesce(c.turn, r.turn), coalesce(c.k, r.k))) AS place
  FROM (SELECT * FROM placed WHERE side = 'chosen') c
  FULL OUTER JOIN (SELECT * FROM placed WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.k = r.k
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
parted AS (
  SELECT p.*, d.place IS NULL OR row(p.turn, p.k) < d.place AS common FROM placed p LEFT JOIN differ d ON p.pair_id = d.pair_id),
shown AS (
  SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS part, greatest(turn, 0) // 512 AS ca, k // 512 AS cb, turn, k, learned AND NOT common AS learned,
         length(role) + 5 AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM parted WHERE NOT common OR side = 'chosen'),
spoken AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, part, ca, cb ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM shown)
SELECT pair_id, part, CAST(row_number() OVER (PARTITION BY pair_id, part ORDER BY ca, cb) - 1 AS INTEGER) AS chunk, count(*) AS n_turns,
       string_agg(shown, '' ORDER BY turn, k) AS text,
       coalesce(string_agg(CAST(CAST(before + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(before + length(shown) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn, k) FILTER (WHERE learned), '') AS loss_spans
FROM spoken GROUP BY pair_id, part, ca, cb
"""


@query
def op11_divergence(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))


ORACLE["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM cells GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_license_scan(spark, folder):
    return license_scan.license_labels(table(spark, folder, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({k}, {_quoted(r.label)}, {r.priority}, {_quoted(r.keyword)}, {_quoted(r.regex)}, {r.base})" for k, r in enumerate(license_rules.rules()))

ORACLE["op13_license_scan"] = (
    f"WITH rules(rule, label, priority, keyword, regex, base) AS (VALUES {_RULES}),"
    + r"""
docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
put AS (SELECT doc, list_aggregate(list_transform(words, lambda w: ' ' || w || ' '), 'string_agg', '') AS words FROM docs),
hits AS (
  SELECT doc, rule, string_split_regex(words, regex) AS gaps, regexp_extract_all(words, regex) AS found
  FROM put JOIN rules ON contains(words, ' ' || keyword) AND regexp_matches(words, regex)),
spans AS (
  SELECT doc, rule, generate_subscripts(found, 1) AS k, unnest(found) AS found, unnest(gaps[1:len(found)]) AS gap FROM hits),
sized AS (
  SELECT doc, rule, k, (length(found) - length(replace(found, ' ', ''))) // 2 AS size,
         (length(gap) - length(replace(gap, ' ', ''))) // 2 AS gap FROM spans),
placed AS (
  SELECT doc, rule, k, label, priority, base,
         CAST(sum(gap + size) OVER (PARTITION BY doc, rule ORDER BY k) AS BIGINT) - size AS a,
         CAST(sum(gap + size) OVER (PARTITION BY doc, rule ORDER BY k) AS BIGINT) AS z
  FROM sized JOIN rules USING (rule)),
resolved AS (
  SELECT *, NOT EXISTS (
    SELECT 1 FROM placed o WHERE o.doc = p.doc AND o.a <= p.a AND o.z >= p.z
      AND (o.priority > p.priority OR o.priority = p.priority AND (o.z - o.a > p.z - p.a OR o.z - o.a = p.z - p.a AND o.rule < p.rule))) AS kept
  FROM placed p),
summed AS (
  SELECT doc, count(*) FILTER (WHERE base) AS n_base, min(a) FILTER (WHERE base) AS first_word, max(a) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR kept) AS labels,
         max(priority / 4) FILTER (WHERE kept) AS score
  FROM resolved GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN summed USING (doc)
"""
)


@query
def op12_alignment(spark, folder):
    docs = table(spark, folder, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
