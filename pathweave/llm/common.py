"""Pieces the training-data operators share: written tables, sampled splitters, exact range partitions."""

from __future__ import annotations

import atexit
import ctypes
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows sampled for each output partition when range splitters are chosen.
SAMPLE_PER_PARTITION = 64
_OWN: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _OWN.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="pathweave-")
        if not _OWN[spark.sparkContext.applicationId]:
            atexit.register(shutil.rmtree, at, True)
        _OWN[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


#: Most files of a written table, and tasks of its last stage, for each core. For each file an executor runs chmod up to three
#: times where Hadoop's native library is missing; as such a child starts it shares all memory of the executor.
FILES_A_CORE = 4
#: Whether Spark removes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries run in this block go when each ends. What is cached keeps its own."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


class Scratch:
    """Tables that cut lineage, Parquet files in one folder of the shared folder. The folder goes at the end of a with block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.at = spark, f"{shared_dir(spark)}/pathweave-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        with suppress(Exception):  # at the driver's end the session may be gone
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, whose shuffle files go at once, in FILES_A_CORE files a core at most, and read it back."""
        path = f"{self.path}/{uuid.uuid4().hex[:8]}-{name}"
        self.at[name] = path
        with cleaned_up(self.spark):
            df.coalesce(FILES_A_CORE * self.spark.sparkContext.defaultParallelism).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        for name in names:
            self._delete(self.at.pop(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Removed when the driver ends."""
    scratch = Scratch(df.sparkSession)
    atexit.register(scratch.__exit__)
    return scratch.written(df, name)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The one thing that this worker process keeps from task to task, made when it is first asked for."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def alone(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that drops what tasks of other operators kept in its worker process, and at its end leaves nothing there.

    Workers go from query to query: an executor holds what they keep beside its heap, also while they have no task.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        forget()  # by its name: _KEPT would be sent along as a copy
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


#: Stands for a null id on the way through pandas, whose numbers beside nulls lose digits. It is no id of its own.
NO_ID = -(2**63)


def id_or_none(col: Column) -> Column:
    """A bigint id with NO_ID for null."""
    return F.coalesce(col.cast("bigint"), F.lit(NO_ID))


def id_again(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A table of rows of the driver, sent as Arrow: rows sent as Python objects start Python workers of their own on the executors, which stay."""
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema))


#: Bits of the filter that spares rows without a partner a shuffle; a full one lets all through.
FILTER_BITS = 1 << 23


def perhaps_in(value: Column, wanted: DataFrame, of: Column) -> Column:
    """Whether a value may be among those of wanted: true for each that is. By a filter of FILTER_BITS, whatever the size of wanted.

    The filter is a scalar subquery of 64-bit words, so that it is looked up without a Python worker; nor is it sent by one.
    """
    place = F.pmod(F.xxhash64(of), F.lit(FILTER_BITS))
    parts = wanted.select(place.alias("p")).selectExpr("CAST(shiftright(p, 6) AS INT) AS k", "shiftleft(1L, CAST(p & 63 AS INT)) AS b")
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in parts.groupBy("k").agg(F.bit_or("b").alias("b")).collect():  # FILTER_BITS / 64 rows at most
        words[r["k"]] = r["b"]
    bits = local_table(wanted.sparkSession, [(words,)], pa.schema([("bits", pa.list_(pa.int64()))])).scalar()
    here = F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))
    return F.getbit(F.get(bits, F.shiftright(here, 6).cast("int")), here.bitwiseAND(F.lit(63)).cast("int")) == 1


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def search(splitters: Column, n: int, key: Column) -> Column:
    """How many of the n ascending splitters are at most key, by binary search inside one expression."""
    if n == 0:
        return F.lit(0)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(splitters, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at),
    )


def range_id(rows: DataFrame, key: Sequence[tuple[str, str]], weight: Column, n: int) -> Column:
    """A partition number from 0 to n-1 that ascends with the key columns, by splitters from a bounded sample.

    key holds (column, SQL type) pairs; types are string or bigint. Null keys sort first. The splitters only balance
    the partitions: results never depend on them. The sample holds about SAMPLE_PER_PARTITION rows a partition.
    """
    total = rows.count()
    share = min(1.0, n * SAMPLE_PER_PARTITION / max(total, 1))
    got = rows.select(*[c for c, _ in key], weight.cast("double").alias("_w")).sample(share, 7).collect()

    def order(r):
        return tuple((v is not None, v.encode() if isinstance(v, str) else (v if v is not None else 0)) for v in r[:-1])

    got.sort(key=order)
    goal, seen, at = sum(r[-1] for r in got) / n, 0.0, []
    for r in got:
        seen += r[-1]
        if goal and seen >= goal * (len(at) + 1) and len(at) < n - 1 and (not at or order(at[-1]) != order(r)):
            at.append(r)
    fields = ",".join(f"k{i}:{t}" for i, (_, t) in enumerate(key))
    text = json.dumps([{f"k{i}": r[i] for i in range(len(key)) if r[i] is not None} for r in at])
    splitters = F.from_json(F.lit(text), f"array<struct<{fields}>>")
    return search(splitters, len(at), F.struct(*[F.col(c).cast(t).alias(f"k{i}") for i, (c, t) in enumerate(key)]))
