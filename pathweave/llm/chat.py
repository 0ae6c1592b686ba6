"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions.

The prompt is the longest prefix of turns that both have in common, rendered once. What follows it in either conversation is
its completion. Each turn is a rendered segment; only the assistant's turns of completions are trained on, all else is masked.
Results have a row for each segment, so that a conversation of very many turns is never gathered in one place; texts() puts
the segments of a pair together where conversations are of a size for one row.

Turns are ordered by number, a null number first; turns of one number by role and text. Null roles and texts are empty.
Rows without a conversation belong to none. Repeated rows are turns of their own. A pair of which one conversation has no
rows gives none. Equal conversations are all prompt. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered: {role} and {text} are put in.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
LOWEST = -(2**63)


def neighbours(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: each conversation of an even id with the one of the next id."""
    return conversations.filter("conv_id IS NOT NULL").select(F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen"), (F.col("pair_id") * 2 + 1).alias("rejected"))


def preference_segments(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, place (among rows of one turn), role, text (rendered), trained."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(LOWEST)).alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    ids = turns.select("conv_id").distinct()
    whole = pairs.join(ids.withColumnRenamed("conv_id", "chosen"), "chosen", "left_semi").join(ids.withColumnRenamed("conv_id", "rejected"), "rejected", "left_semi")
    sides = whole.select("pair_id", F.inline(F.array(F.struct(F.col("chosen").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.col("rejected").alias("conv_id"), F.lit("rejected").alias("side")))))
    rows = turns.join(sides, "conv_id")
    # a place differs if not both sides have it with one role and text; counts and minima are combined before the shuffle
    same = (F.count_if(F.col("side") == "chosen") == F.count_if(F.col("side") == "rejected")) & (F.min("role") == F.max("role")) & (F.min("text") == F.max("text"))
    parting = rows.groupBy("pair_id", "turn", "place").agg(same.alias("same")).filter(~F.col("same")).groupBy("pair_id").agg(F.min(F.struct("turn", "place")).alias("_from"))
    rows = rows.join(parting, "pair_id", "left").withColumn("_prompt", F.col("_from").isNull() | (F.struct("turn", "place") < F.col("_from")))
    rows = rows.filter(~F.col("_prompt") | (F.col("side") == "chosen"))
    rendered = F.concat(F.lit(BEFORE), F.col("role"), F.lit(BETWEEN), F.col("text"), F.lit(AFTER))
    return rows.select(
        "pair_id", F.when(F.col("_prompt"), "prompt").otherwise(F.col("side")).alias("part"), F.when(F.col("turn") != LOWEST, F.col("turn")).alias("turn"), "place", "role", rendered.alias("text"),
        (~F.col("_prompt") & (F.col("role") == TRAINED)).alias("trained"),
    )


def texts(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected (texts), chosen_mask and rejected_mask: spans (s, e) of prompt + completion to train on."""
    order = F.struct(F.coalesce("turn", F.lit(LOWEST)).alias("turn"), "place", "text", "trained")
    parts = segments.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, order))).alias(p) for p in ("prompt", "chosen", "rejected")])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")

    def spans(c: str):
        begin = F.struct(F.length(joined(F.col("prompt"))).alias("at"), F.expr("CAST(array() AS array<struct<s:int,e:int>>)").alias("out"))
        add = lambda a, x: F.struct((a["at"] + F.length(x["text"])).alias("at"), F.when(x["trained"], F.array_append(a["out"], F.struct(a["at"].alias("s"), (a["at"] + F.length(x["text"])).alias("e")))).otherwise(a["out"]).alias("out"))
        return F.aggregate(F.col(c), begin, add, lambda a: a["out"])

    return parts.select("pair_id", *[joined(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")], spans("chosen").alias("chosen_mask"), spans("rejected").alias("rejected_mask"))
