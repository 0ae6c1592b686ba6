"""Replay of an ordered update log over a seed table, as one window.

The state of a key (collector, peer, prefix) after an event depends on that event alone: a valid announcement leaves its
path, anything else leaves the key absent. So the path before an event is the LAG of the paths of the key's events, and one
exchange on the key replays any number of collectors and files.

Feeds:
  rib_raw  rc, line_no, peer_ip, peer_asn, pfx, as_path
  upd_raw  rc, file_label, line_no, ts, typ, nf, peer_ip, peer_asn, pfx, as_path
transitions: rc, peer_ip, pfx, fam, file_label, line_no, path, prev, kind (B seed, A announcement, W withdrawal)
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import family, valid_path

KEY = ("rc", "peer_ip", "pfx")
#: Fields of an announcement and of a withdrawal; lines of any other shape are no updates.
ANNOUNCEMENT_FIELDS, WITHDRAWAL_FIELDS = 15, 6


def of_peers(rows: DataFrame, peer_ips: Sequence[str] = (), peer_asns: Sequence[int] = ()) -> DataFrame:
    """Rows of the given peers; an empty list is all."""
    if peer_ips:
        rows = rows.filter(F.col("peer_ip").isin(*peer_ips))
    return rows.filter(F.col("peer_asn").isin(*peer_asns)) if peer_asns else rows


def parsed_rib(rib_raw: DataFrame, peer_ips: Sequence[str] = (), peer_asns: Sequence[int] = ()) -> DataFrame:
    """rib_raw with path and fam; path is null on an invalid row."""
    rows = of_peers(rib_raw, peer_ips, peer_asns)
    return rows.select("rc", "line_no", "peer_ip", "peer_asn", "pfx", "as_path", family(F.col("pfx")).alias("fam"), valid_path(F.col("as_path"), F.col("peer_asn")).alias("path"))


def seed(parsed: DataFrame) -> DataFrame:
    """Valid rows: invalid ones leave the table as it is and must go before the window."""
    return parsed.filter(F.col("path").isNotNull())


def known_peers(parsed: DataFrame) -> DataFrame:
    """Peers with a valid seed row; updates of others are ignored."""
    return seed(parsed).select("rc", "peer_ip").distinct()


def rib_state(parsed: DataFrame) -> DataFrame:
    """The seed table: the last valid row of each key."""
    return seed(parsed).groupBy(*KEY).agg(F.max_by("path", "line_no").alias("path"))


def build_stats(rib_raw: DataFrame, peer_ips: Sequence[str] = ()) -> DataFrame:
    """rc, entries, invalid_entries, invalid_pct: entries count all peers, invalid ones those of the filter."""
    kept = F.col("peer_ip").isin(*peer_ips) if peer_ips else F.lit(True)
    invalid = F.count_if(kept & valid_path(F.col("as_path"), F.col("peer_asn")).isNull())
    return rib_raw.groupBy("rc").agg(F.count("*").alias("entries"), invalid.alias("invalid_entries")).withColumn("invalid_pct", F.round(F.lit(100.0) * F.col("invalid_entries") / F.col("entries"), 2))


def is_update() -> Column:
    return ((F.col("nf") == WITHDRAWAL_FIELDS) & (F.col("typ") == "W")) | ((F.col("nf") == ANNOUNCEMENT_FIELDS) & (F.col("typ") == "A"))


def clipped(upd_raw: DataFrame, start: datetime | None = None, end: datetime | None = None, grace_seconds: int = 1) -> DataFrame:
    """Lines from start to end plus the grace, both included."""
    if start is not None:
        upd_raw = upd_raw.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return upd_raw.filter(F.col("ts") <= _last(end, grace_seconds)) if end is not None else upd_raw


def _last(end: datetime, grace_seconds: int) -> Column:
    return F.lit(end).cast("timestamp_ntz") + F.expr(f"INTERVAL {grace_seconds} SECONDS")


def stopped(upd_raw: DataFrame, end: datetime, grace_seconds: int = 1) -> DataFrame:
    """Lines of each file before its first one past the end: later lines go even if they are earlier in time."""
    past = upd_raw.filter(F.col("ts") > _last(end, grace_seconds))
    first = past.groupBy("rc", "file_label").agg(F.min("line_no").alias("_stop"))  # at most a row for each file
    return upd_raw.join(first, ["rc", "file_label"], "left").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))).drop("_stop")


def cut_label(upd_raw: DataFrame, seeded: DataFrame, end: datetime, grace_seconds: int = 1) -> DataFrame:
    """One row, cut: the label after which all seeded collectors have passed the end; null if one never does."""
    past = upd_raw.filter(F.col("ts") > _last(end, grace_seconds)).groupBy("rc").agg(F.min("file_label").alias("_at"))
    each = seeded.select("rc").distinct().join(past, "rc", "left")
    return each.agg(F.when(F.bool_and(F.col("_at").isNotNull()), F.max("_at")).alias("cut"))


def until_cut(upd_raw: DataFrame, seeded: DataFrame, end: datetime, grace_seconds: int = 1) -> DataFrame:
    """Files up to the one after which a run ends early."""
    cut = F.broadcast(cut_label(upd_raw, seeded, end, grace_seconds))  # one row
    return upd_raw.join(cut, F.col("cut").isNull() | (F.col("file_label") <= F.col("cut"))).drop("cut")


def parsed_updates(upd_raw: DataFrame, known: DataFrame, peer_ips: Sequence[str] = (), peer_asns: Sequence[int] = ()) -> DataFrame:
    """Updates of known peers with path and fam; path is null on withdrawals and on invalid announcements."""
    rows = of_peers(upd_raw.filter(is_update()), peer_ips, peer_asns)
    rows = rows.join(known, ["rc", "peer_ip"], "left_semi")
    path = F.when(F.col("typ") == "A", valid_path(F.col("as_path"), F.col("peer_asn")))
    return rows.select("rc", "file_label", "line_no", "peer_ip", "pfx", family(F.col("pfx")).alias("fam"), "typ", path.alias("path"))


def events(parsed: DataFrame, updates: DataFrame, seed_label: Column) -> DataFrame:
    """Seed rows and updates as one log; seed_label sorts before all labels of updates."""
    first = seed(parsed).select("rc", "peer_ip", "pfx", "fam", seed_label.alias("file_label"), "line_no", F.lit("B").alias("src"), "path")
    return first.unionByName(updates.select("rc", "peer_ip", "pfx", "fam", "file_label", "line_no", F.col("typ").alias("src"), "path"))


def with_previous(log: DataFrame) -> DataFrame:
    """Events with prev, the key's path before them, and kind; kind is null where nothing changes."""
    order = Window.partitionBy(*KEY).orderBy("file_label", "line_no")
    kind = F.when(F.col("src") == "B", "B").when(F.col("path").isNotNull(), "A").when(F.col("prev").isNotNull(), "W")
    return log.withColumn("prev", F.lag("path").over(order)).withColumn("kind", kind)


def transitions(log: DataFrame) -> DataFrame:
    """Events that change something."""
    return with_previous(log).filter(F.col("kind").isNotNull()).drop("src")


def rib_at(log: DataFrame, label=None) -> DataFrame:
    """The table after the files up to a label (or all): rc, peer_ip, pfx, path of live keys."""
    if label is not None:
        log = log.filter(F.col("file_label") <= F.lit(label))
    last = log.groupBy(*KEY).agg(F.max_by(F.struct("path"), F.struct("file_label", "line_no"))["path"].alias("path"))
    return last.filter(F.col("path").isNotNull())
