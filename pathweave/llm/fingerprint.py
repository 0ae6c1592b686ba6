"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded likeness of two digests.

A digest counts the byte triplets of all windows of four bytes in BUCKETS hash buckets and writes for each bucket the
quartile its count lies in (two bits), after a byte for the length on a logarithmic scale and two nibbles for the ratios of
the quartiles. Equal texts have equal digests. The difference of two digests adds the distance of the quartiles of each
bucket (three quartiles apart count 6, as they seldom come by chance) and that of length and ratios; likeness falls from 1
at no difference to 0 at BOUND.

A null text is empty; an empty text, or one under three bytes, has a digest of zero buckets. A document is compared with the
next by ascending id, the last with the first; repeated rows follow each other, ordered by text, and a null id comes first.
A single row is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_again, id_or_none, partitions, range_id, search

BUCKETS = 128
#: Places in a window of four bytes that make a triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: The difference at which likeness is 0.
BOUND = 400


def digest(data: bytes) -> str:
    """The digest of a text's bytes, in hexadecimal: length, ratios, then four buckets a byte."""
    counts = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    for k, (i, j, l) in enumerate(TRIPLETS):
        n = len(b) - l
        if n > 0:
            v = (b[i : i + n] << np.uint32(16)) | (b[j : j + n] << np.uint32(8)) | b[l : l + n]
            v = (v + np.uint32(k << 24)) * np.uint32(2654435761)
            counts += np.bincount(v >> np.uint32(25), minlength=BUCKETS)
    order = np.sort(counts)
    q1, q2, q3 = (int(order[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    ratios = (q1 * 15 // q3) << 4 | (q2 * 15 // q3) if q3 else 0
    c = codes.reshape(-1, 4)
    return bytes([length, ratios, *(c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3])]).hex()


_PAIR = np.zeros((256, 256), np.int64)
for _s in (6, 4, 2, 0):
    _d = np.abs(((np.arange(256) >> _s) & 3)[:, None] - ((np.arange(256) >> _s) & 3)[None, :])
    _PAIR += np.where(_d == 3, 6, _d)


def difference(a: str, b: str) -> int:
    """How far two digests are apart."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    out = int(_PAIR[x[2:], y[2:]].sum()) + abs(int(x[0] - y[0]))
    return out + abs(int((x[1] >> 4) - (y[1] >> 4))) + abs(int((x[1] & 15) - (y[1] & 15)))


def likeness(a: str, b: str) -> float:
    return 1 - min(difference(a, b), BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """text with the last half of its characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k (the id, NO_ID for null), _t, _next: each document's text and that of the next by ascending id, around the end.

    Documents are dealt by ranges of ids. The first document of each range goes to the range before it as well, so that its
    last document finds its next there: one more row for each partition.
    """
    rows = docs.select(id_or_none(F.col(id_col)).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    n = partitions(docs.sparkSession)
    pid = range_id(rows.select("_k"), [("_k", "bigint")], F.lit(1), n)
    heads = sorted((r[1], r[0]) for r in rows.select("_k", pid.alias("_pid")).groupBy("_pid").agg(F.min("_k")).collect())
    firsts = F.from_json(F.lit(str([h for h, _ in heads])), "array<bigint>")
    before = F.from_json(F.lit(str([heads[k - 1][1] for k in range(len(heads))])), "array<int>")
    place = search(firsts, len(heads), F.col("_k")) - 1
    ghost = F.when(F.get(firsts, place) == F.col("_k"), F.struct(F.get(before, place).alias("_pid"), F.lit(True).alias("_ghost")))
    copies = F.filter(F.array(F.struct(pid.alias("_pid"), F.lit(False).alias("_ghost")), ghost), lambda x: x.isNotNull())
    dealt = rows.select("*", F.inline(copies)).repartitionById(n, F.col("_pid"))
    order = Window.partitionBy("_pid").orderBy("_ghost", "_k", "_t")
    return dealt.withColumn("_next", F.lead("_t").over(order)).filter(~F.col("_ghost")).select("_k", "_t", "_next")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, texts, nexts = [], list(b["_t"]), list(b["_next"])
            own = [digest(t.encode()) for t in texts]
            for k, (i, t, following) in enumerate(zip(b["_k"], texts, nexts, strict=True)):
                e = edited(t, following).encode()
                there = own[k + 1] if k + 1 < len(own) and texts[k + 1] == following else digest(following.encode())
                of_edited = digest(e)
                out.append((int(i), len(t), hashlib.sha256(e).hexdigest(), own[k], of_edited, likeness(own[k], of_edited), likeness(own[k], there), there))
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_fingerprint string"
    names = [x.split()[0] for x in schema.split(", ")]
    return with_next(docs, id_col=id_col, text_col=text_col).mapInPandas(run, schema).withColumn("doc_id", id_again(F.col("doc_id")))
