"""What a run needs to know: the window, the collectors, the filters and where to write."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from .functions.archive import project

#: Pattern of times on the command line and in file names, as strptime and as Spark write it.
TIME_FORMAT, SPARK_TIME_FORMAT = "%Y%m%d.%H%M", "yyyyMMdd.HHmm"


@dataclass(frozen=True)
class CollectionConfig:
    date_range: str = "20100901.0000,20100901.0200"
    collectors: tuple[str, ...] = ("route-views.sydney", "route-views.wide")
    output_filename: str = "default_conf"
    output_dir: str = "data"
    #: Seconds between snapshots.
    interval: int = 900
    peer_ips: tuple[str, ...] = ()
    peer_asns: tuple[int, ...] = ()
    time_format: str = TIME_FORMAT
    #: Whether peer_asns filters anything; off keeps every peer.
    filter_peer_asns: bool = False
    #: Whether malformed lines and missing files raise, instead of being counted.
    strict: bool = False
    projects: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "projects", frozenset(project(rc) for rc in self.collectors))
        if self.interval <= 0:
            raise ValueError("the interval between snapshots is over 0 seconds")
        if len(self.date_range.split(",")) != 2:
            raise ValueError("date_range is start,end")

    @property
    def start(self) -> datetime:
        return datetime.strptime(self.date_range.split(",")[0], self.time_format)

    @property
    def end(self) -> datetime:
        return datetime.strptime(self.date_range.split(",")[1], self.time_format)
