"""Whole runs: from decoded files to snapshots of every view, and the check against the true table at the end."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TIME_FORMAT, CollectionConfig
from ..observers import AsGraph, AsMultigraph, Observer, PathCounts, UpdateCounts
from ..operators import compare, replay
from ..sinks import write_rib
from ..sources import landing, lines, mrt
from .window import Plan, plan

#: The seed sorts before all updates; its snapshot is named after the start.
SEED_LABEL = datetime(1, 1, 1)
log = logging.getLogger("pathweave")


@dataclass
class Run:
    """The lazy tables of a run. Nothing is read before one of them is used."""

    spark: SparkSession
    config: CollectionConfig
    plan: Plan
    rib_raw: DataFrame
    upd_raw: DataFrame
    truth_raw: DataFrame | None = None
    #: rc, kind, ts, path, present: the files of the plan; and rc, kind, bad, lines: the malformed lines among those read.
    coverage: DataFrame | None = None
    bad_lines: DataFrame | None = None

    def __post_init__(self) -> None:
        c = self.config
        asns = c.peer_asns if c.filter_peer_asns else ()
        self.parsed = replay.parsed_rib(self.rib_raw, c.peer_ips, asns)
        self.known = replay.known_peers(self.parsed)
        updates = replay.stopped(self.upd_raw, self.plan.end)
        updates = replay.until_cut(updates, self.parsed.filter("path IS NOT NULL"), self.plan.end)
        updates = replay.parsed_updates(replay.clipped(updates, self.plan.start, self.plan.end), self.known, c.peer_ips, asns)
        before = F.lit(SEED_LABEL).cast("timestamp_ntz")
        self.log = replay.events(self.parsed, updates, before)
        self.transitions = replay.transitions(self.log)

    def labels(self) -> list[datetime]:
        """The start, and the labels up to the one after which all collectors had passed the end."""
        cut = replay.cut_label(self.upd_raw, self.parsed.filter("path IS NOT NULL"), self.plan.end).first()[0]
        return [SEED_LABEL] + [x for x in self.plan.labels if cut is None or x <= cut]

    def table(self) -> DataFrame:
        return replay.rib_at(self.log)

    def write(self, observers: Sequence[Observer]) -> None:
        """Each observer's files at each label. The transitions are kept on disk for the observers that read them."""
        kept = self.transitions.persist(StorageLevel.DISK_ONLY)
        try:
            where = f"{self.config.output_dir}/processed/{self.config.output_filename}"
            labels = self.labels()
            for o in observers:
                rows = o.at(kept, labels).persist(StorageLevel.DISK_ONLY)
                for label in labels:
                    stamp = (self.plan.start if label == labels[0] else label).strftime(self.config.time_format)
                    o.write(rows.filter(F.col("snap") == F.lit(label).cast("timestamp_ntz")).drop("snap"), where, stamp)
                    log.info("wrote %s at %s", o.name, stamp)
                rows.unpersist()
        finally:
            kept.unpersist()

    def verify(self, observers: Sequence[Observer] = ()) -> dict[str, DataFrame] | None:
        """Differences of the table, the AS graph and each observer's view from the true ones at the end; None without a true table.

        An observer is compared with itself over the true table, under its name, if it has a compare().
        """
        if self.truth_raw is None:
            return None
        truth = replay.parsed_rib(self.truth_raw, self.config.peer_ips, self.config.peer_asns if self.config.filter_peer_asns else ())
        before = F.lit(SEED_LABEL).cast("timestamp_ntz")
        true_moves = replay.transitions(replay.events(truth, self.log.limit(0).withColumnRenamed("src", "typ"), before))
        graph = AsGraph("graph")
        mine, true = graph.now(self.transitions), graph.now(true_moves)
        state = replay.rib_state(truth)
        found = {
            "rib": compare.rib_diff(self.table(), state, self.known),
            "rib_summary": compare.rib_diff_summary(self.table(), state, self.known),
            "edges": graph.compare(mine, true),
            "nodes": compare.node_diff(mine, true),
            "graph": compare.graph_check(mine.withColumnRenamed("paths_count", "n"), true.withColumnRenamed("paths_count", "n")),
        }
        for o in observers:
            if hasattr(o, "now") and (rows := o.compare(o.now(self.transitions), o.now(true_moves))) is not None:
                found[f"view_{o.name}"] = rows
        return found


def default_observers() -> list[Observer]:
    return [AsGraph("graph"), AsMultigraph("multigraph"), UpdateCounts("update_count"), PathCounts("path")]


def from_files(spark: SparkSession, config: CollectionConfig, where, read=lines.read_lines, feed: str | None = None) -> Run:
    """A run over landed files: where(url) is the path of an address's file; read is lines.read_lines or mrt.read_mrt.

    A missing file raises FileNotFoundError if the configuration is strict, and otherwise counts in the run's coverage. With
    feed, a folder, the files are decoded once into Parquet tables by collector there, which all else then reads.
    """
    p = plan(config)
    files = [(rc, kind, ts, where(u)) for ts, rc, kind, u in p.files]
    there = landing.present(spark, [f[3] for f in files])
    if config.strict and (missing := [f[3] for f in files if f[3] not in there]):
        raise FileNotFoundError(f"{len(missing)} files are missing, the first is {missing[0]}")
    coverage = spark.createDataFrame([(*f, f[3] in there) for f in files], "rc string, kind string, ts timestamp_ntz, path string, present boolean")

    def rows(kind, keep, parse, name):
        some = [(path, rc, ts) for rc, k, ts, path in files if k == kind and keep(ts) and path in there]
        out = parse(read(spark, some) if some else spark.createDataFrame([], "rc string, file_label timestamp_ntz, line_no bigint, f array<string>"))
        if feed is None:
            return out
        out.write.mode("overwrite").partitionBy("rc").parquet(f"{feed}/{name}")
        return spark.read.schema(out.schema).parquet(f"{feed}/{name}").select(out.columns)

    labelled = lambda r: lines.update_rows(r.withColumn("file_label", F.col("file_label").cast("timestamp_ntz")))
    ribs = rows("rib", lambda ts: ts == p.start, lines.rib_rows, "rib")
    updates = rows("update", lambda ts: True, labelled, "updates")
    truth = rows("rib", lambda ts: ts == p.end, lines.rib_rows, "truth") if p.compare else None
    bad = lines.bad_counts(ribs).withColumn("kind", F.lit("rib")).union(lines.bad_counts(updates).withColumn("kind", F.lit("update")))
    return Run(spark, config, p, lines.good(ribs, config.strict), lines.good(updates, config.strict), lines.good(truth, config.strict) if p.compare else None, coverage, bad)


def main(argv: Sequence[str] | None = None) -> None:
    d = CollectionConfig()
    a = argparse.ArgumentParser(description="Reconstruct routing tables from decoded archive files and write views of them.")
    a.add_argument("-f", "--output_filename", default=d.output_filename, help="name of the output folder")
    a.add_argument("-d", "--date_range", default=d.date_range, help="start,end, both included")
    a.add_argument("-c", "--collector", nargs="+", default=list(d.collectors), help="route collectors")
    a.add_argument("-i", "--interval", type=int, default=d.interval, help="seconds between snapshots")
    a.add_argument("-j", "--peer_asn", nargs="+", type=int, default=[], help="AS numbers of peers")
    a.add_argument("-k", "--peer_ip", nargs="+", default=[], help="addresses of peers")
    a.add_argument("-l", "--time_format", default=TIME_FORMAT, help="format of times in arguments and names")
    a.add_argument("--output_dir", default=d.output_dir)
    a.add_argument("--landing", default="data/landing", help="folder of the files")
    a.add_argument("--mrt", action="store_true", help="the landing folder holds binary MRT files, as the archives have them")
    a.add_argument("--fetch", action="store_true", help="fetch missing files first")
    a.add_argument("--filter_peer_asn", action="store_true", help="apply --peer_asn")
    a.add_argument("--strict", action="store_true", help="stop at malformed lines and missing files")
    a.add_argument("--table", action="store_true", help="write the table at the end as well")
    a.add_argument("--log_file", help="append the log to this file too")
    x = a.parse_args(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(x.log_file)] if x.log_file else [])]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers)
    config = CollectionConfig(x.date_range, tuple(x.collector), x.output_filename, x.output_dir, x.interval, tuple(x.peer_ip), tuple(x.peer_asn), x.time_format, x.filter_peer_asn, x.strict)
    where = lambda url: f"{x.landing}/{url.split('://', 1)[-1].replace('/', '_')}"
    if x.fetch:
        log.info("landed %s", landing.statistics(landing.land([f[3] for f in plan(config).files], x.landing, strict=config.strict)))
    spark = SparkSession.builder.appName("pathweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = f"{config.output_dir}/processed/{config.output_filename}"
    run = from_files(spark, config, where, mrt.read_mrt if x.mrt else lines.read_lines, f"{out}/feed")
    observers = default_observers()
    run.write(observers)
    tables = {"files": run.coverage, "lines": run.bad_lines, **{f"check_{name}": rows for name, rows in (run.verify(observers) or {}).items()}}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
    if x.table:
        write_rib(run.table(), f"{out}/table")


if __name__ == "__main__":
    main()
