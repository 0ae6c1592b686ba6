"""Landing of archive files in a folder: each address is fetched once and then found there.

The driver fetches. On a cluster the folder must be a mounted one that all executors share, or be copied to a store before the run.
"""

from __future__ import annotations

import os
import shutil
import urllib.error
import urllib.request
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

FETCHERS = 10


@dataclass(frozen=True)
class Landed:
    url: str
    path: str
    cached: bool
    size: int


def land(urls: Iterable[str], folder: str, *, strict: bool = True, opener=urllib.request.urlopen) -> list[Landed]:
    """Fetch what is not in the folder yet. A missing file raises RuntimeError, or is left out if not strict."""
    os.makedirs(folder, exist_ok=True)

    def one(url: str) -> Landed | None:
        path = os.path.join(folder, url.split("://", 1)[-1].replace("/", "_"))
        if os.path.exists(path):
            return Landed(url, path, True, os.path.getsize(path))
        try:
            with opener(url) as r, open(f"{path}.part", "wb") as out:
                shutil.copyfileobj(r, out)
        except (OSError, urllib.error.URLError) as e:
            if strict:
                raise RuntimeError(f"can't fetch {url}: {e}") from e
            return None
        os.replace(f"{path}.part", path)
        return Landed(url, path, False, os.path.getsize(path))

    with ThreadPoolExecutor(FETCHERS) as pool:
        return [x for x in pool.map(one, urls) if x]


def present(spark: SparkSession, paths: Iterable[str]) -> set[str]:
    """Those of the paths where a file is, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return {p for p, path in at if path.getFileSystem(conf).exists(path)}


def statistics(landed: Iterable[Landed]) -> dict[str, float]:
    """GB in all and GB that were there before."""
    landed = list(landed)
    return {"total_gb": sum(x.size for x in landed) / 1e9, "cached_gb": sum(x.size for x in landed if x.cached) / 1e9}
