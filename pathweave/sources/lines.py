"""Decoded routing lines: one record a line, fields between pipes, from text files (plain, gz or bz2).

Files are told apart by their path, which a manifest maps to collector and label. A line's number is restored from its
file's block and its place in the partition, so that replay has file order however files are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import epoch_time


def read_lines(spark: SparkSession, files: Sequence[tuple[str, str, object]] | DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """rc, file_label, line_no, f (the fields) of files: rows (path, rc, file_label), on the driver or as a DataFrame with paths."""
    if not isinstance(files, DataFrame):
        paths = [f[0] for f in files]
        files = spark.createDataFrame([(p.split(":", 1)[-1].lstrip("/") if "://" not in p else p.split("://", 1)[1].split("/", 1)[-1], rc, label) for p, rc, label in files], ["_path", "rc", "file_label"])
    at = F.col("_metadata.file_path")
    rows = spark.read.text(list(paths)).select("value", F.regexp_replace(at, r"^[a-z0-9]+:(//[^/]*)?/+", "").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    order = Window.partitionBy("_path").orderBy("_block", "_at")
    numbered = rows.withColumn("line_no", F.row_number().over(order).cast("bigint"))
    # the manifest has a row a file; the planner broadcasts it only under its size threshold
    return numbered.join(files, "_path").select("rc", "file_label", "line_no", F.split(F.rtrim("value"), "[|]").alias("f"))


def field(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def rib_rows(lines: DataFrame) -> DataFrame:
    """rib_raw and bad: whether a line is too short or its peer number no number."""
    asn = field(4).try_cast("bigint")
    return lines.select("rc", "line_no", field(3).alias("peer_ip"), asn.alias("peer_asn"), field(5).alias("pfx"), field(6).alias("as_path"), ((F.size("f") < 7) | asn.isNull()).alias("bad"))


def update_rows(lines: DataFrame) -> DataFrame:
    """upd_raw and bad: whether a line is too short, its time no number, or an announcement's peer number no number."""
    asn = field(4).try_cast("bigint")
    seconds = field(1).try_cast("decimal(28,9)")
    bad = (F.size("f") < 6) | seconds.isNull() | ((F.size("f") == 15) & (field(2) == "A") & asn.isNull())
    return lines.select("rc", "file_label", "line_no", epoch_time(seconds).alias("ts"), field(2).alias("typ"), F.size("f").alias("nf"), field(3).alias("peer_ip"), asn.alias("peer_asn"), field(5).alias("pfx"), field(6).alias("as_path"), bad.alias("bad"))


def good(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that aren't bad; with strict a bad one raises when it is read."""
    ok = ~F.col("bad")
    if strict:
        ok = F.when(F.col("bad"), F.raise_error(F.lit("malformed line")).cast("boolean")).otherwise(True)
    return rows.filter(ok).drop("bad")


def bad_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rc").agg(F.count_if("bad").alias("bad"), F.count("*").alias("lines"))
