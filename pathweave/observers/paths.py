"""How often each AS path is in the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..sinks import write_json
from .base import DeltaObserver


def length_histogram(counts: DataFrame, *by: str) -> DataFrame:
    """Distinct paths by their length."""
    return counts.groupBy(*by, F.size("path").cast("bigint").alias("path_length")).agg(F.count("*").alias("n_paths"))


class PathCounts(DeltaObserver):
    """path, n: both families and all collectors together."""

    keys = ("path",)

    def contribution(self, deltas: DataFrame) -> DataFrame:
        return deltas.select("path", "file_label", "d")

    def lines(self, counts: DataFrame) -> DataFrame:
        """key, n: the members of the JSON document's paths_count, a row each, so that no row grows with the table."""
        return counts.select(path_key(F.col("path")).alias("key"), "n")

    def write(self, rows: DataFrame, where: str, stamp: str) -> None:
        lengths = {str(r["path_length"]): r["n_paths"] for r in length_histogram(rows).orderBy("path_length").collect()}
        head = {"n_unique_paths": sum(lengths.values()), "paths_length_count": lengths}
        write_json(self.lines(rows), f"{where}/{self.name}.{stamp}.json", head=head, member="paths_count")
