"""Which archive files a time window needs, and at which labels there are snapshots.

The window's start moves to the nearest table dump and its end to the nearest quarter of an hour. A run reads the dumps at
the start, the update files from one tick before to two after the window, and the dumps at the end if all collectors have one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CollectionConfig
from ..functions.archive import RIS_SECONDS, RV_SECONDS, project, url

#: Hours between table dumps.
RIS_RIB_HOURS, RV_RIB_HOURS = 8, 2


def nearest(candidates: Sequence[datetime], ts: datetime) -> datetime:
    """The candidate nearest to ts; of two as near the earlier."""
    return min(candidates, key=lambda c: (abs(c - ts), c))


def rib_times(ts: datetime, projects: Sequence[str]) -> list[datetime]:
    """Times of dumps around ts: from the midnight a day before, every 8 hours if RIS takes part, else every 2."""
    first = datetime(ts.year, ts.month, ts.day) - timedelta(days=1)
    hours, n = (RIS_RIB_HOURS, 10) if "RIS" in projects else (RV_RIB_HOURS, 50)
    return [first + timedelta(hours=hours * i) for i in range(n)]


def update_times(ts: datetime) -> list[datetime]:
    """Quarters of an hour around ts, from an hour before its hour on."""
    first = datetime(ts.year, ts.month, ts.day, ts.hour) - timedelta(hours=1)
    return [first + timedelta(seconds=RV_SECONDS * i) for i in range(10)]


def ticks(start: datetime, end: datetime, seconds: int) -> list[datetime]:
    """Labels of update files: one before the start, and one after the first that is past the end."""
    n = int((end - start).total_seconds() // seconds) + 1
    return [start + timedelta(seconds=seconds * i) for i in range(-1, n + 2)]


def snapshot_labels(start: datetime, end: datetime, interval: int) -> list[datetime]:
    return [start + timedelta(seconds=interval * i) for i in range(1, int((end - start).total_seconds() / interval) + 1)]


def has_truth(end: datetime, projects: Sequence[str]) -> bool:
    """Whether all collectors of the projects have a table dump at the end."""
    hours = RIS_RIB_HOURS if "RIS" in projects else RV_RIB_HOURS
    return end.minute == 0 and end.hour % hours == 0


@dataclass(frozen=True)
class Plan:
    start: datetime
    end: datetime
    compare: bool
    #: (ts, rc, type, url), ordered.
    files: tuple[tuple[datetime, str, str, str], ...]
    labels: tuple[datetime, ...]

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.files), "ts timestamp_ntz, rc string, type string, url string")


def plan(config: CollectionConfig) -> Plan:
    """The files of a run. Collectors that the archives' prefixes do not name have none."""
    start = nearest(rib_times(config.start, config.projects), config.start)
    end = nearest(update_times(config.end), config.end)
    compare, files = has_truth(end, config.projects), set()
    grid = set(ticks(start, end, RIS_SECONDS))
    for rc in config.collectors:
        if not rc.startswith(("rrc", "route-views")):
            continue
        files |= {(ts, rc, "rib", url(rc, ts, "rib")) for ts in [start, end][: 1 + compare]}
        files |= {(ts, rc, "update", url(rc, ts, "update")) for ts in ticks(start, end, RIS_SECONDS if project(rc) == "RIS" else RV_SECONDS)}
    there = {f[0] for f in files if f[2] == "update"}
    return Plan(start, end, compare and bool(files), tuple(sorted(files)), tuple(ts for ts in snapshot_labels(start, end, config.interval) if ts in there or ts in grid & there))


def nearest_column(ts: Column, first: Column, step: str, n: int) -> Column:
    """The time of n that begin at first, a step apart, that is nearest to ts; of two as near the earlier. TIMESTAMP_NTZ."""
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + F.expr(f"INTERVAL {step}") * i)
    away = lambda c: F.abs(F.timestamp_diff("MICROSECOND", ts, c))
    return F.array_min(F.transform(every, lambda c: F.struct(away(c).alias("away"), c.alias("at"))))["at"]


def _steps(start: Column, first: int, last: Column, seconds: int) -> Column:
    return F.transform(F.sequence(F.lit(first), last), lambda i: F.timestamp_add("SECOND", i * seconds, start))


def _whole(start: Column, end: Column, seconds: int) -> Column:
    """The whole steps between two times."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / seconds).cast("int")


def ticks_column(start: Column, end: Column, seconds: int) -> Column:
    """ticks() of columns: an array."""
    return _steps(start, -1, _whole(start, end, seconds) + 2, seconds)


def labels_column(start: Column, end: Column, interval: int) -> Column:
    """snapshot_labels() of columns: an array, empty for a window shorter than the interval."""
    n = _whole(start, end, interval)
    return F.when(n > 0, _steps(start, 1, n, interval)).otherwise(F.array().cast("array<timestamp_ntz>"))


def nearest_rib(ts: Column, ris: bool) -> Column:
    first = (F.date_trunc("day", ts).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return nearest_column(ts, first, "8 HOURS" if ris else "2 HOURS", 10 if ris else 50)


def nearest_update(ts: Column) -> Column:
    first = (F.date_trunc("hour", ts).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")
    return nearest_column(ts, first, "15 MINUTES", 10)
