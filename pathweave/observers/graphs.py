"""Undirected AS graphs of the paths in the table, for each family: by adjacency, and by adjacency and peer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import edge_diff
from ..operators.snapshots import edge_deltas, path_deltas, totals, totals_at
from ..sinks import write_graph
from .base import DeltaObserver


class AsMultigraph(DeltaObserver):
    """fam, u, v, rc, peer_ip, n: parallel edges, one for each peer that has paths over the adjacency."""

    keys = ("fam", "u", "v", "rc", "peer_ip")

    def contribution(self, deltas: DataFrame) -> DataFrame:
        return edge_deltas(deltas).select(*self.keys, "file_label", "d")


class AsGraph(DeltaObserver):
    """fam, u, v, paths_count, peers_count, mean_paths: a second sum over the multigraph's live edges."""

    keys = ("fam", "u", "v")

    def contribution(self, deltas: DataFrame) -> DataFrame:
        return edge_deltas(deltas).select(*AsMultigraph.keys, "file_label", "d")

    @staticmethod
    def over_peers(multi: DataFrame, *by: str) -> DataFrame:
        out = multi.groupBy(*by, "fam", "u", "v").agg(F.sum("n").alias("paths_count"), F.count("*").alias("peers_count"))
        return out.withColumn("mean_paths", F.col("paths_count") / F.col("peers_count"))

    def now(self, transitions: DataFrame, upto=None) -> DataFrame:
        return self.over_peers(totals(self.contribution(path_deltas(transitions)), AsMultigraph.keys, upto))

    def at(self, transitions: DataFrame, labels: Sequence) -> DataFrame:
        return self.over_peers(totals_at(self.contribution(path_deltas(transitions)), AsMultigraph.keys, labels), "snap")

    def write(self, rows: DataFrame, where: str, stamp: str, metadata: str | None = None, peers: bool = True) -> None:
        for fam in (4, 6):
            write_graph(rows.filter(F.col("fam") == fam), f"{where}/{self.name}_ipv{fam}.{stamp}.csv", metadata=metadata, peers=peers)

    def compare(self, mine: DataFrame, truth: DataFrame) -> DataFrame:
        return edge_diff(mine, truth, weight="paths_count")
