"""Files of the views. Rows are sorted and written by the executors; the one file of a label is then put together from the parts.

The parts are appended in order as streams through the file system API, so that a file never has to fit the driver's memory
and any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_HEADER = "#origin,destination,paths_count"


def _one_file(lines: DataFrame, path: str, before: str, after: str) -> None:
    """Write a column of ordered lines as one file, between two texts."""
    spark: SparkSession = lines.sparkSession
    jvm = spark._jvm
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(parts)
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    try:
        out.write(bytearray(before.encode()))
        for name in sorted(s.getPath().toString() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if s.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
        out.write(bytearray(after.encode()))
    finally:
        out.close()
        fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def graph_lines(edges: DataFrame, peers: bool = True) -> DataFrame:
    """line: origin, destination, mean paths of a peer and number of peers; or the plain number of paths without peers."""
    cells = ["u", "v", "mean_paths", "peers_count"] if peers else ["u", "v", "paths_count"]
    return edges.orderBy("u", "v").select(F.concat_ws(",", *[F.col(c).cast("string") for c in cells]).alias("line"))


def write_graph(edges: DataFrame, path: str, *, metadata: str | None = None, peers: bool = True) -> None:
    head = (f"#{metadata}\n" if metadata else "") + GRAPH_HEADER + (",peers_count" if peers else "") + "\n"
    _one_file(graph_lines(edges, peers), path, head, "")


def write_json(rows: DataFrame, path: str, *, head: dict | None = None, member: str | None = None) -> None:
    """One JSON document: rows has it as its json column, or its key and n columns are the entries of a member after head."""
    if member is None:
        return _one_file(rows.select("json"), path, "", "")
    before = json.dumps(head or {})[:-1] + (", " if head else "") + f'"{member}": {{\n'
    # a comma before each line but the first: the first key in order is found beforehand
    first = rows.agg(F.min("key")).first()[0]
    quoted = F.get_json_object(F.to_json(F.struct(F.col("key").alias("k"))), "$.k")
    line = F.concat(F.when(F.col("key") == F.lit(first), "").otherwise(","), F.lit('"'), F.regexp_replace(quoted, '(["\\\\\\\\])', r"\\\\$1"), F.lit('": '), F.col("n").cast("string"))
    return _one_file(rows.orderBy("key").select(line.alias("line")), path, before, "}}\n")


def write_rib(table: DataFrame, path: str) -> None:
    """The table itself, as Parquet by collector."""
    table.write.mode("overwrite").partitionBy("rc").parquet(path)
