"""Names of archive files: addresses by collector, time and kind, and what a name tells; as Columns and as plain functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public archives' hosts, and how each names its table dumps and update files.
RIS_HOST = "https://data.ris.ripe.net/"
RV_HOST = "https://routeviews.org/"
RIS_NAMES = {"rib": "bview", "update": "updates"}
RV_NAMES = {"rib": "rib", "update": "updates"}
RV_FOLDERS = {"rib": "RIBS", "update": "UPDATES"}
#: Seconds between update files.
RIS_SECONDS, RV_SECONDS = 300, 900


def project(rc: str) -> str:
    """RIS or RV; ValueError for a collector of neither."""
    if rc.startswith("rrc"):
        return "RIS"
    if "route-views" in rc:
        return "RV"
    raise ValueError(f"unknown collector {rc!r}")


def url(rc: str, ts: datetime, kind: str) -> str:
    """Address of a collector's file of a kind (rib or update)."""
    names = RIS_NAMES if project(rc) == "RIS" else RV_NAMES
    if kind not in names:
        raise ValueError(f"a file is a rib or an update, not {kind!r}")
    month, stamp = f"{ts:%Y.%m}", f"{names[kind]}.{ts:%Y%m%d.%H%M}"
    if project(rc) == "RIS":
        return f"{RIS_HOST}{rc}/{month}/{stamp}.gz"
    folder = "" if rc == "route-views2" else f"{rc}/"
    return f"{RV_HOST}{folder}bgpdata/{month}/{RV_FOLDERS[kind]}/{stamp}.bz2"


def url_column(rc: Column, ts: Column, kind: Column) -> Column:
    """url() of columns; an unknown collector or kind raises."""
    month, stamp = F.date_format(ts, "yyyy.MM"), F.date_format(ts, "yyyyMMdd.HHmm")
    named = lambda names: F.when(kind == "rib", names["rib"]).when(kind == "update", names["update"]).otherwise(F.raise_error(F.concat(F.lit("not a rib or an update: "), kind)))
    ris = F.concat(F.lit(RIS_HOST), rc, F.lit("/"), month, F.lit("/"), named(RIS_NAMES), F.lit("."), stamp, F.lit(".gz"))
    folder = F.when(rc == "route-views2", "").otherwise(F.concat(rc, F.lit("/")))
    rv = F.concat(F.lit(RV_HOST), folder, F.lit("bgpdata/"), month, F.lit("/"), named(RV_FOLDERS), F.lit("/"), named(RV_NAMES), F.lit("."), stamp, F.lit(".bz2"))
    return F.when(F.startswith(rc, F.lit("rrc")), ris).when(F.contains(rc, F.lit("route-views")), rv).otherwise(F.raise_error(F.concat(F.lit("unknown collector "), rc)))


def filename_column(address: Column) -> Column:
    """rc.kind.YYYYMMDD.HHMM.ext of an address."""
    parts = F.split(F.trim(address), "/")
    last = F.element_at(F.split(address, "/"), -1)
    rc = F.when(F.contains(address, F.lit("routeviews.org")) & ~F.contains(address, F.lit("route-views")), "route-views2").otherwise(F.get(parts, F.lit(3)))
    dots = F.split(last, r"\.")
    first = F.get(dots, F.lit(0))
    kind = F.when(first == "bview", "rib").when(first == "updates", "update").otherwise(first)
    ext = F.when(F.size(dots) > 1, F.concat(F.lit("."), F.element_at(dots, -1))).otherwise("")
    return F.concat(rc, F.lit("."), kind, F.lit("."), F.array_join(F.slice(dots, 2, 2), "."), ext)


def collector_column(filename: Column) -> Column:
    """The collector of a name that filename_column() made."""
    dots = F.split(filename, r"\.")
    first = F.get(dots, F.lit(0))
    return F.when(first == "route-views", F.concat(first, F.lit("."), F.get(dots, F.lit(1)))).otherwise(first)
