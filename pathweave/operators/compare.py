"""Differences between a reconstructed table or graph and the true one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import percentage


def keyed_diff(mine: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status (added: only in truth, removed: only in mine, modified), mine, truth. Values aren't null."""
    a = mine.select(*keys, F.col(value).alias("mine"))
    b = truth.select(*keys, F.col(value).alias("truth"))
    status = F.when(F.col("mine").isNull(), "added").when(F.col("truth").isNull(), "removed").when(F.col("mine") != F.col("truth"), "modified")
    return a.join(b, keys, "full_outer").withColumn("status", status).filter(F.col("status").isNotNull()).select(*keys, "status", "mine", "truth")


def rib_diff(mine: DataFrame, truth: DataFrame, known: DataFrame) -> DataFrame:
    """keyed_diff of two tables over the peers that mine knows and truth has prefixes of."""
    peers = truth.select("rc", "peer_ip").distinct().join(known, ["rc", "peer_ip"], "left_semi")
    of = lambda t: t.join(peers, ["rc", "peer_ip"], "left_semi")
    return keyed_diff(of(mine), of(truth), ["rc", "peer_ip", "pfx"], "path")


def rib_diff_summary(mine: DataFrame, truth: DataFrame, known: DataFrame) -> DataFrame:
    """rc, peer_ip, truth_size, and added, removed, modified as numbers and as per cent of it."""
    sizes = truth.groupBy("rc", "peer_ip").agg(F.count("*").alias("truth_size")).join(known, ["rc", "peer_ip"], "left_semi")
    kinds = ("added", "removed", "modified")
    counts = rib_diff(mine, truth, known).groupBy("rc", "peer_ip").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    out = sizes.join(counts, ["rc", "peer_ip"], "left").fillna(0, list(kinds))
    return out.select("rc", "peer_ip", "truth_size", *kinds, *[percentage(F.col(k), F.col("truth_size")).alias(f"{k}_pct") for k in kinds])


def edge_diff(mine: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("fam", "u", "v"), weight: str = "n") -> DataFrame:
    """Edges that differ, by canonical orientation; both families."""
    return keyed_diff(mine, truth, list(keys), weight)


def nodes(edges: DataFrame) -> DataFrame:
    """fam, node of live edges: isolated nodes aren't nodes."""
    return edges.select("fam", F.explode(F.array("u", "v")).alias("node")).distinct()


def node_diff(mine: DataFrame, truth: DataFrame) -> DataFrame:
    """fam, node, status: nodes of only one graph."""
    a, b = nodes(mine), nodes(truth)
    return b.join(a, ["fam", "node"], "left_anti").withColumn("status", F.lit("added")).union(a.join(b, ["fam", "node"], "left_anti").withColumn("status", F.lit("removed")))


def graph_check(mine: DataFrame, truth: DataFrame) -> DataFrame:
    """fam, differences, same: whether the weighted graphs of each family are equal."""
    found = edge_diff(mine, truth).select("fam").union(node_diff(mine, truth).select("fam")).groupBy("fam").agg(F.count("*").alias("differences"))
    families = mine.select("fam").union(truth.select("fam")).distinct()
    return families.join(found, "fam", "left").select("fam", F.coalesce("differences", F.lit(0)).cast("bigint").alias("differences"), F.col("differences").isNull().alias("same"))


def degrees(multi: DataFrame) -> DataFrame:
    """fam, node, degree of a multigraph: parallel edges count, a loop twice."""
    return multi.select("fam", F.explode(F.array("u", "v")).alias("node")).groupBy("fam", "node").agg(F.count("*").alias("degree"))


def multigraph_equal(mine: DataFrame, truth: DataFrame) -> DataFrame:
    """fam, same: whether node sets and degrees are equal."""
    a, b = degrees(mine), degrees(truth).withColumnRenamed("degree", "_other")
    return a.join(b, ["fam", "node"], "full_outer").groupBy("fam").agg(F.bool_and(F.coalesce(F.col("degree") == F.col("_other"), F.lit(False))).alias("same"))
