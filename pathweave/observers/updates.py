"""Counts of effective updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.snapshots import label_array
from ..sinks import write_json
from .base import Observer

COUNTS = ("n_updates", "n_withdrawals_ipv4", "n_withdrawals_ipv6", "n_announcements_ipv4", "n_announcements_ipv6")


def effective(transitions: DataFrame) -> DataFrame:
    return transitions.filter("kind <> 'B' AND fam <> 0")


def counters() -> list:
    of = lambda kind, fam: F.count_if((F.col("kind") == kind) & (F.col("fam") == fam))
    return [F.count("*").alias("n_updates"), of("W", 4).alias("n_withdrawals_ipv4"), of("W", 6).alias("n_withdrawals_ipv6"), of("A", 4).alias("n_announcements_ipv4"), of("A", 6).alias("n_announcements_ipv6")]


class UpdateCounts(Observer):
    """Updates, withdrawals and announcements since the start, by collector and by peer. Labels never reset a count."""

    def by_collector(self, transitions: DataFrame) -> DataFrame:
        return effective(transitions).groupBy("rc").agg(*counters())

    def by_peer(self, transitions: DataFrame) -> DataFrame:
        return effective(transitions).groupBy("rc", "peer_ip").agg(F.count("*").alias("n_updates"))

    def at(self, transitions: DataFrame, labels: Sequence) -> DataFrame:
        """snap, rc, peer_ip and the counts; an absent peer has had no update yet."""
        labels = sorted(labels)
        every = label_array(labels, dict(transitions.dtypes)["file_label"])
        at = F.size(F.filter(every, lambda x: x < F.col("file_label")))
        each = effective(transitions).withColumn("_at", at).filter(F.col("_at") < len(labels)).groupBy("rc", "peer_ip", "_at").agg(*counters())
        order = Window.partitionBy("rc", "peer_ip").orderBy("_at")
        held = each.select("rc", "peer_ip", "_at", (F.lead("_at", 1, len(labels)).over(order) - 1).alias("_to"), *[F.sum(c).over(order).alias(c) for c in COUNTS])
        return held.select(F.explode(F.sequence("_at", "_to")).alias("_k"), "rc", "peer_ip", *COUNTS).select(F.get(every, F.col("_k")).alias("snap"), "rc", "peer_ip", *COUNTS)

    def document(self, rows: DataFrame) -> DataFrame:
        """One row, json: maps by collector, and by collector and peer; zeros are left out."""
        by_rc = rows.groupBy("rc").agg(*[F.sum(c).alias(c) for c in COUNTS])
        entry = lambda c: F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("rc", c))), lambda x: x[c] > 0)).alias(c)
        peers = rows.groupBy("rc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer_ip", "n_updates")))).alias("m"))
        one = by_rc.agg(*[entry(c) for c in COUNTS])  # as many entries as collectors and peers
        two = peers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rc", F.to_json("m"))))).alias("j"))
        nested = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("j"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
        flat = F.to_json(F.struct(*COUNTS))
        return one.crossJoin(two).select(F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(',"n_updates_per_peer":'), nested, F.lit("}")).alias("json"))

    def write(self, rows: DataFrame, where: str, stamp: str) -> None:
        write_json(self.document(rows), f"{where}/{self.name}.{stamp}.json")
