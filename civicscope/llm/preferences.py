"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The turns of the chosen and the rejected conversation are compared place by place; the longest
common prefix of equal turns (role and text) is rendered once as the prompt, what follows on
either side is that side's completion.  Loss falls on the assistant's turns of completions, from
after the head of a turn to its closing mark; everything else is masked.

A part of a pair is one row as long as it has at most ``CHUNK`` places; a longer one continues in
further rows (chunk 1, 2, ...), so that one huge conversation is never gathered in one task.

Defined cases: a null text is an empty one, a null role is rendered as ``none`` and never
learned; a null turn number comes first; turns with equal numbers are ordered by role and text,
and each keeps its place, repeated rows too; a pair with one side only has no common prefix and
no other completion; equal conversations have a prompt only; parts without turns have no row;
rows with a null pair id or a side other than the two belong to no pair and are left out; extra
columns play no part; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers (and equal turn numbers) in one row.
CHUNK = 512
END = "<|end|>"


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(pair, part, chunk, n_turns, text, loss): part is prompt, chosen or rejected; loss lists the
    spans of characters in the row's text on which loss falls."""
    rows = turns.filter(F.col(pair).isNotNull() & F.col(side).isin("chosen", "rejected")).select(
        F.col(pair).alias("pair"), F.col(side).alias("side"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role), F.lit("none")).alias("role"), F.col(role).eqNullSafe(F.lit(learn)).alias("learned"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("pair", "side", "turn").orderBy("role", "text")).cast("long") - 1)
    place = ["pair", "turn", "k"]
    said = F.xxhash64("role", "text")
    chosen = placed.filter("side = 'chosen'").select(*place, said.alias("c"), F.length("text").alias("cl"))
    rejected = placed.filter("side = 'rejected'").select(*place, said.alias("r"), F.length("text").alias("rl"))
    differs = ~(F.col("c").eqNullSafe(F.col("r")) & F.col("cl").eqNullSafe(F.col("rl")))
    first = chosen.join(rejected, place, "full_outer").filter(differs).groupBy("pair").agg(F.min(F.struct("turn", "k")).alias("first"))
    parted = placed.join(first, "pair", "left").withColumn("common", F.coalesce(F.struct("turn", "k") < F.col("first"), F.lit(True)))
    parted = parted.filter(~F.col("common") | (F.col("side") == "chosen")).withColumn("part", F.when(F.col("common"), "prompt").otherwise(F.col("side")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    parted = parted.select(
        "pair", "part", F.struct(F.floor(F.greatest(F.col("turn"), F.lit(0)) / CHUNK).alias("a"), F.floor(F.col("k") / CHUNK).alias("b")).alias("chunk"), "turn", "k",
        F.length(head).alias("head"), F.concat(head, F.col("text"), F.lit(END + "\n")).alias("shown"), (F.col("learned") & ~F.col("common")).alias("learned"),
    )
    group = ["pair", "part", "chunk"]
    before = F.sum(F.length("shown")).over(Window.partitionBy(*group).orderBy("turn", "k")) - F.length("shown")
    spans = F.struct((F.col("before") + F.col("head")).alias("start"), (F.col("before") + F.length("shown") - 1).alias("end"))
    spoken = parted.withColumn("before", before).withColumn("span", F.when(F.col("learned"), spans))
    gathered = spoken.groupBy(*group).agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "k", "shown", "span"))).alias("turns"))
    numbered = gathered.withColumn("number", F.row_number().over(Window.partitionBy("pair", "part").orderBy("chunk")) - 1)
    return numbered.select(
        F.col("pair").alias(pair), "part", F.col("number").cast("int").alias("chunk"), "n_turns",
        F.array_join(F.col("turns.shown"), "").alias("text"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )
