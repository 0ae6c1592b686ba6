"""Signed deltas of the transitions, and their totals at labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import adjacencies


def path_deltas(transitions: DataFrame) -> DataFrame:
    """rc, peer_ip, fam, file_label, path, d: +1 for a new path, -1 for the one it replaces. Seed rows retract nothing.

    Prefixes of neither family change the table only and give no deltas.
    """
    one = lambda p, d: F.struct(p.alias("path"), F.lit(d).alias("d"))
    both = F.filter(F.array(F.when(F.col("kind") != "W", one(F.col("path"), 1)), F.when((F.col("kind") != "B") & F.col("prev").isNotNull(), one(F.col("prev"), -1))), lambda x: x.isNotNull())
    return transitions.filter("fam <> 0").select("rc", "peer_ip", "fam", "file_label", F.inline(both))


def edge_deltas(deltas: DataFrame) -> DataFrame:
    """rc, peer_ip, fam, file_label, u, v, d: the path deltas on each adjacency."""
    return deltas.select("rc", "peer_ip", "fam", "file_label", "d", F.inline(adjacencies(F.col("path"))))


def totals(deltas: DataFrame, keys: Sequence[str], upto=None) -> DataFrame:
    """keys and n, the sum of d, where it is over 0; upto a label, or of all."""
    if upto is not None:
        deltas = deltas.filter(F.col("file_label") <= F.lit(upto))
    return deltas.groupBy(*keys).agg(F.sum("d").alias("n")).filter("n > 0")


def label_array(labels: Sequence, kind: str) -> Column:
    return F.array(*[F.lit(x).cast(kind) for x in labels]) if labels else F.array().cast(f"array<{kind}>")


def totals_at(deltas: DataFrame, keys: Sequence[str], labels: Sequence, *, positive: bool = True) -> DataFrame:
    """snap, keys and n at each of the labels (driver-side, ascending), for keys whose total is over 0 there.

    Deltas are summed to (keys, first label that sees them); a running sum then holds from one such label to the next, and
    only live rows are written out for each label they hold at.
    """
    labels = sorted(labels)
    kind = dict(deltas.dtypes)["file_label"]
    every = label_array(labels, kind)
    first = F.size(F.filter(every, lambda x: x < F.col("file_label")))
    sums = deltas.withColumn("_at", first).filter(F.col("_at") < len(labels)).groupBy(*keys, "_at").agg(F.sum("d").alias("_d"))
    order = Window.partitionBy(*keys).orderBy("_at")
    held = sums.select(*keys, "_at", F.sum("_d").over(order).alias("n"), (F.lead("_at", 1, len(labels)).over(order) - 1).alias("_to"))
    held = held.filter("n > 0") if positive else held
    return held.select(F.explode(F.sequence("_at", "_to")).alias("_k"), *keys, "n").select(F.get(every, F.col("_k")).alias("snap"), *keys, "n")
