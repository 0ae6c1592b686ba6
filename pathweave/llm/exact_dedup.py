"""Exact duplicates by content sort: sampled splitters, a range partition, a sort, and neighbour comparisons.

Texts are ordered by (first characters, 64-bit hash, whole text, id). Splitters sampled on (first characters, hash, id)
deal the rows to partitions, so that a text held by a third of all rows is cut into several partitions by its ids. Each
partition is sorted (an external sort that spills) and each row is compared in full with the one before it. Only the runs
that touch a partition's edge are compared across partitions: at most two for each partition.

Null texts count as empty. Repeated rows (equal id and text) are copies of each other and one of them stays. A null id is
smaller than any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, partitions, range_id, written

#: Characters of a text that lead the sort key.
HEAD = 16
MERGED = pa.schema([("_pid", pa.int32()), ("_run", pa.int32()), ("_all_keep", pa.int64()), ("_all_size", pa.int64()), ("_keeper", pa.bool_())])


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the columns named in carry.

    keep: whether the row with the "max" or the "min" id of equal texts stays. normalise: a function of a Column, applied
    to the text before it is compared; None compares the text as it is.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep is max or min, not {keep}")
    spark = docs.sparkSession
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), text.alias("_t"), F.substring(text, 1, HEAD).alias("_head"), F.xxhash64(text).alias("_h"),
        F.struct(*[F.col(c) for c in carry]).alias("_row") if carry else F.lit(None).cast("struct<none:int>").alias("_row"),
    )
    n = partitions(spark)
    dealt = rows.withColumn("_pid", range_id(rows, [("_head", "string"), ("_h", "bigint"), ("_id", "bigint")], F.length("_t") + 64, n)).repartitionById(n, F.col("_pid"))
    order = Window.partitionBy("_pid").orderBy("_head", "_h", "_t", F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_first())
    seen = (
        dealt.withColumn("_before", F.lag("_t").over(order))
        .withColumn("_after", F.lead("_t").over(order))
        .withColumn("_n", F.row_number().over(order))
        .withColumn("_new", F.col("_before").isNull() | (F.col("_before") != F.col("_t")))
        .withColumn("_run", F.max(F.when(F.col("_new"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    runs_in = written(
        seen.select("_pid", "_id", "_new", "_run", "_row", F.unhex(F.sha2(F.col("_t"), 256)).alias("_sha"), F.when(F.col("_before").isNull() | F.col("_after").isNull(), F.col("_t")).alias("_edge"), F.col("_after").isNull().alias("_last")), "runs"
    )
    best = F.max("_id") if keep == "max" else F.min(F.coalesce("_id", F.lit(-(2**63))))
    runs = runs_in.groupBy("_pid", "_run").agg(best.alias("_keep"), F.count("*").alias("_size"))
    merged = local_table(spark, _across(runs_in, runs, keep), MERGED)
    out = runs_in.join(runs, ["_pid", "_run"]).join(F.broadcast(merged), ["_pid", "_run"], "left")
    kept_id = F.coalesce("_all_keep", "_keep")
    return out.select(
        F.col("_id").alias("doc_id"),
        F.when(kept_id != F.lit(-(2**63)), kept_id).alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        (F.col("_new") & F.coalesce("_keeper", F.lit(True))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        *[F.col("_row")[c].alias(c) for c in carry],
    )


def _across(rows: DataFrame, runs: DataFrame, keep: str) -> list[tuple]:
    """Runs of equal texts that go on in the next partition, joined. It gathers two short rows a partition, no texts."""
    edges = rows.filter(F.col("_edge").isNotNull())
    ends = edges.groupBy("_pid").agg(
        F.min("_run").alias("first"), F.max("_run").alias("last"), F.min_by("_edge", F.struct("_last", "_run")).alias("head"), F.max_by("_edge", F.struct("_last", "_run")).alias("tail")
    )  # _last is false before true, so head is the first row's text and tail the last row's
    after = Window.orderBy("_pid")
    ends = ends.select("_pid", "first", "last", F.coalesce(F.col("tail") == F.lead("head").over(after), F.lit(False)).alias("on"))
    sizes = runs.join(F.broadcast(ends), "_pid").filter((F.col("_run") == F.col("first")) | (F.col("_run") == F.col("last")))
    found = {(r[0], r[1]): (r[2], r[3]) for r in sizes.select("_pid", "_run", "_keep", "_size").collect()}
    groups, group = [], []
    for r in sorted(ends.collect()):
        if group:
            group.append((r["_pid"], r["first"]))
        if not (group and r["first"] == r["last"] and r["on"]):
            if group:
                groups.append(group)
            group = [(r["_pid"], r["last"])] if r["on"] else []
    out = []
    for group in groups:
        ids = [found[g][0] for g in group]
        low = [(i is not None, i or 0) for i in ids]
        best = low.index(max(low) if keep == "max" else min(low))
        size = sum(found[g][1] for g in group)
        out += [(*g, ids[best], size, k == best) for k, g in enumerate(group)]
    return out
