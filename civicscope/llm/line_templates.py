"""Line deduplication by a log-template tree, in DataFrame operations only.

A line is parsed to a leaf of a tree of fixed depth: its number of tokens, then its leading
tokens; tokens are what stands between spaces, and one that holds a digit is a variable field.
A leaf holds several groups, each with a template: its lines are taken in order (most frequent
first, ties: largest text), and a line joins the first group whose seed its tokens agree with in
at least ``similarity`` of all positions, else it seeds a group of its own.  Positions where the
members of a group differ are variable.  A template that occurs in several documents is dropped
from all but the first of them (smallest id), where all its lines stay.

The groups are found in rounds over all leaves at once.  A round lets the next ``SEEDS`` open
lines of each leaf decide among themselves which of them are seeds, which is what taking them in
order would give, and compares every open line with these.  What no seed took stays open for the
next round, until no leaf has two open lines; each round is settled.  A leaf of k lines of which
no two agree takes k / SEEDS rounds.

Written or shuffled are: keys of all lines (two hashes and the place), the text of distinct
lines in leaves with several, and once the documents for putting them together.  Lines in other
leaves are kept out of the text shuffle by a set of ``BITS`` hash values, which bounds its size.
Hot lines are counted before they are shuffled, lines of a crowded leaf are dealt over tasks.

Defined cases: null text stays null and has no lines; blank lines are kept and never counted;
rows with a null id are passed on as they are and not counted; repeated rows (same id and text)
are one document and each comes back; a document may come back with an empty text; texts of any
length are read whole; extra columns, whatever their names, are passed on, and columns named like
an output column are replaced; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.llm.frames import stored
from civicscope.operators.relations import hot_keys, skew_join, top_n

DEPTH = 4
SIMILARITY = 0.8
FIELD = "<*>"
#: A token with a digit, as a pattern.
VARIABLE = "[^ ]*[0-9][^ ]*"
#: Lines of a leaf that one round takes in order.
SEEDS = 64
#: Size of the set of leaf hashes that is broadcast.
BITS = 1 << 20


def masked(line: Column) -> Column:
    """The line with FIELD in place of tokens that hold a digit, without spaces at its ends."""
    line = F.trim(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)


def document_lines(docs: DataFrame, id: str, text: str, depth: int) -> DataFrame:
    """(_doc, _text, pos, line, leaf, own) per line; leaf and own are null for blank lines."""
    known = docs.filter(F.col(id).isNotNull() & F.col(text).isNotNull())
    lines = known.select(F.col(id).alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    lines = lines.select("_doc", "_text", "pos", masked(F.col("raw")).alias("line"))
    n_tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    full = F.col("line") != ""
    return lines.select(
        "_doc", "_text", "pos", "line",
        F.when(full, F.xxhash64(n_tokens, F.substring_index("line", " ", depth))).alias("leaf"),
        F.when(full, F.xxhash64("line")).alias("own"),
    )


def line_templates(lines: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """(leaf, own, template) of the lines that belong to a group; the template is the hash of its seed."""
    several = stored(keys.filter(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("leaf"))
    bit = F.col("leaf").bitwiseAND(F.lit(BITS - 1))
    marked = lines.filter(F.col("leaf").isNotNull()).withColumn("bit", bit).join(F.broadcast(several.select(bit.alias("bit")).distinct()), "bit", "left_semi")
    counted = marked.groupBy("leaf", "own", "line").agg(F.count("*").alias("n"))
    distinct = stored(counted.join(several, "leaf", "left_semi"))
    found, todo = None, distinct
    while True:
        seeds = leaf_seeds(todo, similarity)
        tried = skew_join(todo.select("leaf", "own", "line", "n"), seeds, ["leaf"], ["own"], hot_keys(todo, ["leaf"]))
        hits = F.transform("seeds", lambda seed: agree(F.split("line", " ", -1), seed, similarity))
        first = F.array_position(hits, True).cast("int")
        round_ = stored(tried.select("leaf", "own", "line", "n", F.when(first > 0, F.element_at("owns", F.nullif(first, F.lit(0)))).alias("template")))
        taken = round_.filter(F.col("template").isNotNull()).select("leaf", "own", "template")
        found = taken if found is None else found.unionByName(taken)
        left = round_.filter(F.col("template").isNull()).drop("template")
        crowds = left.groupBy("leaf").agg(F.count("*").alias("open")).filter("open > 1").select("leaf")
        todo = left.join(crowds, "leaf", "left_semi")
        if not todo.limit(1).count():
            return found


def agree(x: Column, y: Column, similarity: float) -> Column:
    """Whether enough tokens of two lines of one leaf are equal."""
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda z: z))
    return same >= F.lit(similarity) * F.size(x)


def leaf_seeds(lines: DataFrame, similarity: float) -> DataFrame:
    """(leaf, seeds, owns): which of a leaf's next ``SEEDS`` lines found groups, and their hashes."""
    head = top_n(lines, ["leaf"], [F.col("n").desc(), F.col("line").desc()], SEEDS, "place")
    listed = head.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", "own", "line"))).alias("head"))
    told = F.transform("head", lambda h: F.struct(h["own"].alias("own"), F.split(h["line"], " ", -1).alias("tokens")))

    def take(seeds: Column, line: Column) -> Column:
        joins = F.exists(seeds, lambda s: agree(line["tokens"], s["tokens"], similarity))
        return F.when(joins, seeds).otherwise(F.concat(seeds, F.array(line)))

    kept = F.aggregate(told, F.filter(told, lambda x: F.lit(False)), take)
    listed = listed.withColumn("kept", kept)
    return listed.select("leaf", F.transform("kept", lambda s: s["tokens"]).alias("seeds"), F.transform("kept", lambda s: s["own"]).alias("owns"))


def drop_recurring_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """All rows of ``docs``, the text without recurring lines, and n_lines, n_dropped (null for null text or id)."""
    names = docs.columns  # plain names inside: the caller's may be anything
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id, text_at = f"c{names.index(id)}", names.index(text)
    text = f"c{text_at}"
    lines = document_lines(inner, id, text, depth)
    keys = stored(lines.drop("line"))
    general = line_templates(lines, keys, similarity)
    counted = keys.filter(F.col("leaf").isNotNull()).groupBy("leaf", "own").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
    counted = counted.join(general, ["leaf", "own"], "left").withColumn("key", F.coalesce("template", "own"))
    templates = counted.groupBy("leaf", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    recurring = templates.filter("first <> last").select("leaf", "key", F.col("first").alias("_first"))
    decided = counted.select("leaf", "own", "key").join(recurring, ["leaf", "key"]).select("leaf", "own", "_first")
    gone = keys.join(decided, ["leaf", "own"]).filter(F.col("_doc") > F.col("_first"))
    gone = gone.groupBy("_doc", "_text").agg(F.collect_set("pos").alias("_gone"))
    rest = [c for c in inner.columns if c != text]
    cut = inner.select(*rest, F.xxhash64(text).alias("_hash"), F.split(F.col(text), "\n", -1).alias("_parts"))
    joined = cut.join(gone, (F.col(id) == F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(F.transform(stay, lambda i: F.get(F.col("_parts"), i)))
    new = {text_at: F.array_join(kept, "\n")}
    order = [new.get(k, F.col(f"c{k}")).alias(name) for k, name in enumerate(names) if name not in ("n_lines", "n_dropped")]
    n_lines = F.when(F.col(id).isNotNull() & F.col("_parts").isNotNull(), F.size("_parts"))
    n_dropped = F.when(F.col("_gone").isNotNull(), F.size("_gone")).when(n_lines.isNotNull(), 0)
    return joined.select(*order, n_lines.alias("n_lines"), n_dropped.cast("int").alias("n_dropped"))
