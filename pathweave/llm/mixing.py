"""Mixing sources to target weights by hash-threshold histograms.

A source whose target is e times its size and a rest has each document e times, and once more the documents whose hash
lies under a threshold. The threshold comes from histograms of words by (source, hash bucket): the bucket where the running
sum passes the rest is cut into finer buckets, and only its documents are summed again. Documents are then chosen by
comparing their hash with the threshold, without a sort. At the end the boundary document is taken or left, whichever is
nearer to the target. Thresholds are nested: a larger target keeps every document of a smaller one.

Null texts have size 0. A null source is a source, the last. Documents of size 0 are taken 0 words. Rows that repeat an id
share its hash and are taken together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A document is repeated this often at most.
MOST = 3
#: Bits of a hash, and those that each level of histograms resolves.
BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_hash(key: Column, seed: str = "") -> Column:
    """60 bits of a key's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed))), 1, BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Of (source, source_size): the target of each source, with what is above most times its size shared out again.

    The level that all sources below their bound share follows from one pass in the order of bound over weight: the sources
    up to the last that is full are at their bounds, and the others get the rest by weight.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_full", F.col("source_size") * F.lit(float(most)))
    upto = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "_level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    )  # the level if all sources before this one are full
    open_level = F.min_by(F.when(F.col("_level") * F.col("_w") <= F.col("_full"), F.col("_level")), F.when(F.col("_level") * F.col("_w") <= F.col("_full"), F.col("_full") / F.col("_w"))).over(all_rows)
    return rows.withColumn("_open", open_level).select("source", "source_size", F.least("_full", F.coalesce(F.col("_open") * F.col("_w"), F.col("_full"))).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = MOST, seed: str = "") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), unit_hash(F.col(id_col), seed).alias("_hash")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    goal = goal.withColumn("_times", times.cast("bigint"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size"))
    # one row a source: the hashes under _low are taken; the boundary lies in the 2^_bits hashes from _low on
    edge = written(goal.select("*", F.lit(0).cast("bigint").alias("_low"), F.lit(0).cast("bigint").alias("_sum")), "targets")
    for bits in range(BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        edge = written(_refined(rows, edge, bits), f"level{bits}")
    same = F.col("source").eqNullSafe(F.col("_source"))
    edge = edge.withColumnRenamed("source", "_source")
    copies = F.col("_times") + (F.col("_hash") < F.col("_low")).cast("bigint")
    out = rows.join(edge, same).withColumn("copies", F.least(copies, F.lit(most).cast("bigint")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _refined(rows: DataFrame, edge: DataFrame, bits: int) -> DataFrame:
    """edge with its boundary bucket cut into buckets of 2^bits hashes; at 0 bits the boundary's hash is taken if that is nearer."""
    wide = bits + LEVEL_BITS
    e = edge.select(F.col("source").alias("_source"), F.col("_low").alias("_from"))
    inside = rows.join(e, rows["source"].eqNullSafe(F.col("_source")) & (F.shiftright("_hash", wide) == F.shiftright("_from", wide)))
    bucket = F.shiftleft(F.shiftright("_hash", bits), bits)
    sums = inside.groupBy(F.col("source").alias("_source"), bucket.alias("_bucket")).agg(F.sum("size").alias("_in"))
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_in").over(run))
    sums = sums.join(edge.select(F.col("source").alias("_s"), F.col("_rest").alias("_goal"), F.col("_sum").alias("_had")), F.col("_source").eqNullSafe(F.col("_s")))
    passes = F.col("_had") + F.col("_upto") > F.col("_goal")
    found = sums.groupBy("_source").agg(
        F.min(F.when(passes, F.col("_bucket"))).alias("_cut"), F.min_by(F.when(passes, F.col("_upto") - F.col("_in")), F.when(passes, F.col("_bucket"))).alias("_before"), F.min_by(F.when(passes, F.col("_in")), F.when(passes, F.col("_bucket"))).alias("_cut_in"),
        F.sum("_in").alias("_total"), F.lit(True).alias("_found"),
    )
    # a bucket always passes but for rounding; without one all of the source is taken, and finer levels find no rows
    low = F.when(F.col("_found").isNull(), F.col("_low")).otherwise(F.coalesce("_cut", F.lit(1 << BITS)))
    total = F.col("_sum") + F.coalesce(F.when(F.col("_cut").isNotNull(), F.col("_before")).otherwise(F.col("_total")), F.lit(0))
    if bits == 0:
        nearer = F.col("_cut").isNotNull() & (F.abs(F.col("_sum") + F.col("_before") + F.col("_cut_in") - F.col("_rest")) < F.abs(F.col("_sum") + F.col("_before") - F.col("_rest")))
        low = low + F.when(nearer, 1).otherwise(0)
    names = [c for c in edge.columns if c not in ("_low", "_sum")]
    out = edge.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select(*names, low.cast("bigint").alias("_new_low"), total.cast("bigint").alias("_new_sum")).withColumnsRenamed({"_new_low": "_low", "_new_sum": "_sum"})
