"""Connected components of an edge table, distributed: large-star and small-star rounds until nothing changes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b", into: Scratch | None = None) -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge. Null ends and loops are dropped.

    Each round hooks a node's neighbours to the smallest of them; minima are combined before the shuffle, so a node with
    many neighbours is not gathered in one task. Rounds go on until two end alike, about the logarithm of the longest path.
    The labels are a written table, in the caller's scratch folder or one that goes when the driver ends.
    """
    with Scratch(edges.sparkSession) as tmp:
        e = tmp.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "round")
        before, last = None, "round"
        for k in itertools.count():
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
            large = both.join(low, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
            joined = large.join(low, F.col("u") == F.col("_u"))
            small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
            e = tmp.written(small, f"round{k}")
            tmp.remove(last)
            last, now = f"round{k}", e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        heads = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
        labels = e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads)
        return into.written(labels, "components") if into else written(labels, "components")
