"""Near duplicates by an exact Jaccard join of word 5-gram sets, over a partition of the universe by pigeonhole.

1. Each text becomes the set of the 64-bit hashes of its distinct shingles. Equal sets are one node from here on.
2. Sets are put in size bands whose bounds grow by 4/3, so that a set's partners are in its own band or the one below. Each
   band deals the universe of hashes into a fixed number of segments. Two sets that differ in at most H hashes agree in all
   but H segments; so, with each set's segments put in one global order (larger ones, which are rarer, first, empty ones
   last), the first H + c segments of either have c in common. Those alone are indexed, for its own band and, where sizes
   allow, for the band below. One pass over the texts makes these keys, the sets' names and their parity maps.
3. Segments that two or more nodes share give candidates. Each node is compared first with the smallest node of the segments
   it shares with most, then with the smallest of its other segments, then with all that share c segments with it and are
   still in another component. So a group of n near copies costs about n comparisons, and no link between components is lost.
4. Where a segment would give more pairs than indexing its nodes anew costs, its nodes are joined by fewer, larger segments
   and their one-deletion neighbourhoods: two linked sets differ by at most one hash in several of these, so that a whole
   segment of one is a whole segment of the other or lacks one hash of it. A key is met only where one side is whole.
5. A parity map has, for each of 8 H buckets of hashes or more, whether the set holds an odd number of them. Two maps differ
   in no more bits than the sets differ in hashes, so a pair whose maps differ in more than a link allows is none: such pairs
   leave within the join that meets them. Every other candidate is verified on the whole sets: 100 * intersection >= 75 * union.

Texts are lower-cased A-Z and split at white space (space, 09-0D). Fewer than five words are one shingle. A text without
words, or null, has an empty set and is alone. Repeated rows are copies of each other. A null id is a document whose
component is named by the others' ids, or null. An empty table gives no rows. A text of any length is one row's work, in
memory of about 30 bytes for each of its words. Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import Scratch, alone, id_again, id_or_none, perhaps_in, written
from .components import components

WORDS = 5
#: Linked at a similarity of NUM / DEN.
NUM, DEN = 3, 4
#: Segments beyond the necessary, as a share and a number, so that few sets need empty ones; and of those indexed.
SLACK, MORE = 1.2, 2
COMMON = 10
#: Pairs of a key, for each shingle of its nodes, from which on a new index of the nodes is cheaper.
DEAR = 4
#: Least bits of a parity map, and bits for each difference that a link allows.
MAP_LEAST, MAP_EACH = 256, 8
#: Nodes of a key's largest component that others are compared with first, and how many of all those.
HEADS, TRIED = 8, 4
#: Low bits of a key that hold its band.
BAND_BITS = 7
#: Words a worker remembers, documents it handles at once, nodes a task remembers to have indexed.
REMEMBER, AT_ONCE, INDEXED = 400_000, 500, 200_000
_U = np.uint64
_P = [_U(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes(dict):
    """Hashes of words, each made when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self) -> None:
        self.known = Hashes()

    def of(self, text: str | bytes | None) -> np.ndarray:
        raw = text.encode() if isinstance(text, str) else text or b""
        words = raw.lower().split()  # bytes: A-Z only, and the white space of the contract
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
        if len(self.known) > REMEMBER:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        h = w[:n] * _P[0]
        for k in range(1, WORDS):
            h = (h ^ (h >> _U(29))) * _P[k - 1] + w[k : k + n] * _P[k]
        h = _mix(h)
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a set."""
    a = _mix(np.array([_mix(hashes, 1).sum() + _U(len(hashes)), _mix(hashes, 2).sum()], np.uint64), 3).view(np.int64)
    return int(a[0]), int(a[1])


@lru_cache(None)
def bands(upto: int) -> tuple[tuple[int, ...], None]:
    """Lower bounds of the size bands, to beyond upto."""
    low = [1]
    while low[-1] <= upto:
        low.append(-(-low[-1] * DEN // NUM))
    return tuple(low)


def differences(total: int) -> int:
    """The most that two linked sets of so many hashes in all can differ in."""
    return total * (DEN - NUM) // (DEN + NUM)


def band_of(size: int) -> tuple[int, int]:
    """A size's band and that band's lower bound."""
    low = bands(1 << max(4, size.bit_length()))
    k = int(np.searchsorted(low, size, "right")) - 1
    return k, low[k]


def band_top(k: int) -> int:
    upto = 16
    while len(low := bands(upto)) < k + 2:
        upto *= 4
    return low[k + 1] - 1


@lru_cache(None)
def needed(k: int) -> int:
    """The most differences of linked sets that meet in band k, and one."""
    top = band_top(k)
    return differences(top + top * DEN // NUM) + 1


def common(k: int) -> int:
    """Segments that linked sets in band k have in common among those indexed of either."""
    return 1 + needed(k) // COMMON


@lru_cache(None)
def plan(k: int, deletions: bool) -> int:
    """Segments of band k: enough for its largest set and a partner from the band above.

    With deletions, differences that leave none of the common() segments with one at most need two for each other segment.
    """
    return (needed(k) + 1) // 2 + common(k) - 1 if deletions else int(SLACK * needed(k)) + MORE


@lru_cache(None)
def map_bits(k: int) -> int:
    return max(MAP_LEAST, 1 << (MAP_EACH * needed(k) - 1).bit_length())


def parity_maps(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity map of a set at its own band's size and at that of the band below."""
    k, _ = band_of(len(hashes))
    bits, less = map_bits(k), map_bits(max(k - 1, 0))
    odd = np.bincount((_mix(hashes, 4) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    below = odd if less == bits else odd[:less] ^ odd[less:]
    return np.packbits(odd.astype(np.uint8)).view(np.int64), np.packbits(below.astype(np.uint8)).view(np.int64)


def _segments(hashes: np.ndarray, k: int, deletions: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The set's hashes in the order of band k's segments, the segment of each, and of each segment that holds any: number, size, sum."""
    mixed = _mix(hashes, 2 * k + deletions + 10)
    mixed.sort()
    segment = ((mixed >> _U(32)) * _U(plan(k, deletions)) >> _U(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return mixed, segment, segment[starts], np.diff(np.append(starts, len(mixed))), np.add.reduceat(mixed, starts)


def _place(segments: np.ndarray, k: int) -> np.ndarray:
    return _mix(segments.astype(np.uint64) + _U(k << 40), 7)


def _key(hashed: np.ndarray, k: int) -> np.ndarray:
    return (hashed >> _U(BAND_BITS + 1) << _U(BAND_BITS) | _U(k)).view(np.int64)


def keys(hashes: np.ndarray, k: int, take: int) -> np.ndarray:
    """The index keys of a set in band k: its first segments in the global order."""
    _, _, full, sizes, sums = _segments(hashes, k, False)
    whole = _mix(sums + _place(full, k), k)
    order = (_U(255) - np.minimum(sizes, 255).astype(np.uint64)) << _U(56) | whole >> _U(8)
    if len(full) < take:
        empty = _mix(_place(np.setdiff1d(np.arange(plan(k, False)), full, assume_unique=True), k), k)
        order = np.concatenate([order, _U(255 << 56) | empty >> _U(8)])
    order.sort()
    return _key(order[:take] << _U(8), k)


def deletion_keys(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all segments of a set in band k and of their one-deletion neighbours, their segments, and which are whole."""
    mixed, segment, full, _, sums = _segments(hashes, k, True)
    m = plan(k, True)
    of = np.zeros(m, np.uint64)
    of[full] = sums
    place = _place(np.arange(m), k)
    key = _key(np.concatenate([_mix(of + place, k), _mix(of[segment] - mixed + place[segment], k)]), k)
    return key, np.concatenate([np.arange(m), segment]).astype(np.int32), np.arange(len(key)) < m


def index_bands(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bands that a set is indexed for, each with the most differences from its partners there."""
    size = len(hashes)
    k, low = band_of(size)
    yield k, differences(size + min(size * DEN // NUM, band_top(k)))
    if k and size * NUM <= (low - 1) * DEN:
        yield k - 1, differences(size + low - 1)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id. A written table, for which all others made on the way go."""
    texts = docs.select(id_or_none(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t"))
    with Scratch(docs.sparkSession) as tmp:
        rows = _indexed(texts, frozenset(), tmp)
        sets = _sets(rows)
        clash = sets.filter("n > 0").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y").select("node")
        if clashing := frozenset(r[0] for r in clash.collect()):  # different sets with one 57-bit name: about one in 10^8 documents
            tmp.remove("indexed")
            rows = _indexed(texts, clashing, tmp)
            sets = _sets(rows)
        nodes = sets.filter("n > 0").groupBy("node").agg(F.min("_id").alias("first"), F.min(id_again(F.col("_id"))).alias("named"), F.first("n").alias("n"))
        labels = _linked(texts, tmp.written(nodes, "nodes"), rows, clashing, tmp)
        nodes = nodes.select("node", "named")
        named = labels.join(nodes, "node")
        heads = named.groupBy("label").agg(F.min("named").alias("component"))
        linked = labels.join(heads, "label").select(F.col("node").alias("_linked"), "component")
        found = nodes.join(linked, F.col("node") == F.col("_linked"), "left").select(F.col("node").alias("_node"), F.coalesce("component", "named").alias("component"))
        out = sets.join(found, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")  # rows of one node are many: a skewed partition is split
        out = out.select(id_again(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(id_again(F.col("_id"))).alias("component_id"))
        return written(out, "near_duplicates")


def _sets(rows: DataFrame) -> DataFrame:
    return rows.filter("about IS NOT NULL").select("about._id", F.col("about.n").alias("n"), "about.check", "node")


def _name(hashes: np.ndarray, clashing: frozenset[int]) -> tuple[int, int]:
    """A set's name, with its band in the low bits, and a number that tells sets of one name apart."""
    a, check = set_id(hashes)
    band = band_of(len(hashes))[0]
    node = (a >> BAND_BITS << BAND_BITS) | band
    if node in clashing:
        node = (int(_mix(np.array([a, check], np.int64).view(np.uint64), 6).sum().view(np.int64)) >> BAND_BITS << BAND_BITS) | band
    return node, check


ABOUT = pa.struct([("_id", pa.int64()), ("n", pa.int64()), ("check", pa.int64()), ("own", pa.list_(pa.int64())), ("below", pa.list_(pa.int64()))])
#: A band that no set has: of the rows that describe documents.
NO_BAND = (1 << BAND_BITS) - 1


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _describe(clashing: frozenset[int]):
    """Of each document a row about it, and of each set, once in a task or so, its keys.

    The key of a row about a document only deals it: copies of one text, and rows of one id, do not go to one task.
    """

    @alone
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, done, serial = Shingles(), set(), 0
        with np.errstate(over="ignore"):
            for b in (b.slice(lo, AT_ONCE) for b in batches for lo in range(0, b.num_rows, AT_ONCE)):
                got, named, about = [], [], []
                for i, t in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                    h = shingles.of(t)
                    node, check = _name(h, clashing) if len(h) else (0, 0)
                    mine = {"_id": i, "n": len(h), "check": check, "own": None, "below": None}
                    about.append((mine, node))
                    if not len(h) or node in done:
                        continue
                    if len(done) > INDEXED:
                        done.clear()
                    done.add(node)
                    mine["own"], mine["below"] = parity_maps(h)
                    for k, most in index_bands(h):
                        got.append(keys(h, k, most + common(k)))
                        named.append(np.full(len(got[-1]), node, np.int64))
                n = sum(map(len, got))
                deal = np.array([(node ^ mine["_id"]) & 2**63 - 1 for mine, node in about], np.uint64) + np.arange(serial, serial + len(about), dtype=np.uint64)
                serial += len(about)
                deal = (_mix(deal, 8) >> _U(BAND_BITS) << _U(BAND_BITS) | _U(NO_BAND)).view(np.int64)
                columns = [
                    pa.array(np.concatenate([*got, deal])),
                    pa.array(np.concatenate([*named, np.array([node for _, node in about], np.int64)])),
                    pa.concat_arrays([pa.nulls(n, ABOUT), pa.array([mine for mine, _ in about], ABOUT)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "about"])

    return run


def _indexed(texts: DataFrame, clashing: frozenset[int], tmp: Scratch) -> DataFrame:
    """Rows about documents (about, node), and key, node, head: the keys that two nodes or more share, one of them in its own band."""
    rows = texts.mapInArrow(_describe(clashing), "key bigint, node bigint, about struct<_id:bigint,n:bigint,check:bigint,own:array<bigint>,below:array<bigint>>")
    by = Window.partitionBy("key").orderBy("node")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.first("node").over(every).alias("lo"), F.last("node").over(every).alias("hi"), F.min(F.when(is_own("key", "node"), F.col("node"))).over(every).alias("head"), F.lag("node").over(by).alias("before")
    )
    rows = rows.filter("about IS NOT NULL OR lo <> hi AND head IS NOT NULL AND (before IS NULL OR before <> node)")
    return tmp.written(rows.select("key", "node", "head", "about"), "indexed")


def band(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def is_own(key: str, node: str) -> Column:
    """Whether a key is of its node's own band."""
    return band(F.col(key)) == band(F.col(node))


def common_of(k: Column) -> Column:
    """common() of a band."""
    return F.get(F.array(*[F.lit(common(b)) for b in range(64)]), k)


def _with_enough(rows: DataFrame, segments: Column) -> DataFrame:
    """The rows (key, node, ...) of nodes that share keys of common() segments of a band; segments count them over _place."""
    rows = rows.withColumn("_band", band(F.col("key"))).withColumn("_segments", segments)
    return rows.filter(F.col("_segments") >= common_of(F.col("_band"))).drop("_band", "_segments")


def _of_node() -> WindowSpec:
    """A node's rows of one band."""
    return Window.partitionBy("node", "_band")


def _unlike(x: Column, y: Column) -> Column:
    """Bits in which two parity maps differ: at most the hashes in which their sets do."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _may_link(nx: Column, ny: Column, x: Column, y: Column) -> Column:
    return _unlike(x, y) * (DEN + NUM) <= (nx + ny) * (DEN - NUM)


def _linked(texts: DataFrame, nodes: DataFrame, rows: DataFrame, clashing: frozenset[int], tmp: Scratch) -> DataFrame:
    """node, label of the nodes that have links."""
    shared = tmp.written(_with_enough(rows.filter("about IS NULL").select("key", "node", "head"), F.count("*").over(_of_node())), "shared")
    wanted = shared.select("node").distinct()
    maps = rows.filter("about.own IS NOT NULL").select("node", "about.n", "about.own", "about.below").join(wanted, "node", "left_semi")
    maps = tmp.written(maps.groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("below").alias("below")), "maps")
    some = tmp.written(_texts_of(texts, wanted.join(nodes, "node").select("node", F.col("first").alias("_first")), clashing), "candidates")
    heads = tmp.written(shared.filter("node <> head").groupBy("node", "head").agg(F.count("*").alias("keys")), "heads")
    best = heads.groupBy("node").agg(F.max_by("head", F.struct("keys", "head")).alias("head"))
    links = _verified(best.select(F.col("node").alias("a"), F.col("head").alias("b")), some, maps, tmp, "best")
    labels = components(links, into=tmp)
    # the other heads, where they are in another component yet
    more = _apart(heads.join(best.withColumnRenamed("head", "_h"), "node").filter("head <> _h").select(F.col("node").alias("a"), F.col("head").alias("b")), labels)
    links = links.union(_verified(more, some, maps, tmp, "heads"))
    labels = components(links, into=tmp)
    # all others of segments whose nodes are in two components or more
    pairs, dear = _across(shared, labels, maps, tmp)
    pairs = tmp.written(pairs, "pairs")
    again = some.join(dear.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left_semi").select("text")
    refined = tmp.written(_refined(again, clashing), "refined")
    near = tmp.written(_to_heads(refined, labels, maps), "near_heads")
    links = links.union(_verified(near, some, None, tmp, "near"))
    labels = components(links, into=tmp)
    anew, _ = _across(refined, labels, maps, None)
    known = heads.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).union(near).distinct()
    rest = pairs.union(anew).distinct().join(known, ["a", "b"], "left_anti")
    links = links.union(_verified(rest, some, None, tmp, "rest"))
    return components(links, into=tmp)


def _refined(texts: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """key, node, segment, whole, earlier: the keys of large segments and their one-deletion neighbours that two nodes share, a whole segment of one.

    earlier holds the node's whole keys of earlier segments: two nodes that have one in common have met there already.
    """

    @alone
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        with np.errstate(over="ignore"):
            for b in (b.slice(lo, AT_ONCE) for b in batches for lo in range(0, b.num_rows, AT_ONCE)):
                got = []
                for t in _bytes(b.column(0)):
                    h = shingles.of(t)
                    node = _name(h, clashing)[0]
                    for k, _ in index_bands(h):
                        key, segment, whole = deletion_keys(h, k)
                        got.append((key, np.full(len(key), node, np.int64), segment, whole))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names=["key", "node", "segment", "whole"])

    rows = texts.mapInArrow(run, "key bigint, node bigint, segment int, whole boolean")
    by = Window.partitionBy("key")
    own = is_own("key", "node")
    rows = rows.select("*", F.min("node").over(by).alias("lo"), F.max("node").over(by).alias("hi"), F.max("whole").over(by).alias("some"), F.max(own).over(by).alias("mine")).filter("lo <> hi AND some AND mine")
    rows = rows.select("key", "node", "segment", "whole").withColumn("_band", band(F.col("key")))
    earlier = _of_node().orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.collect_list(F.when(F.col("whole"), F.col("key"))).over(earlier))
    return _with_enough(rows, F.size(F.collect_set("segment").over(_of_node())))


def _to_heads(refined: DataFrame, labels: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a > b) of nodes outside a key's largest component with nodes of it: with the TRIED nearest, by parity maps, of each key's HEADS.

    They spare most nodes of a dense group, whose links to the least nodes failed, a comparison with all of the group; the
    rest follows, so that no link hangs on them.
    """
    rows = refined.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts"))
    rows = rows.join(sizes.filter("parts > 1").drop("parts"), "key").join(maps, "node")
    rows = rows.select("key", "node", "label", "main", "n", F.when(is_own("key", "node"), F.col("own")).otherwise(F.col("below")).alias("map"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    heads = rows.filter("label = main").withColumn("_place", place).filter(F.col("_place") <= HEADS).select("key", F.col("node").alias("head"), F.col("n").alias("n_y"), F.col("map").alias("map_y"))
    met = rows.filter("label <> main").join(heads, "key").filter(_may_link(F.col("n"), F.col("n_y"), F.col("map"), F.col("map_y")))
    best = met.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(_unlike(F.col("map"), F.col("map_y")).alias("d"), "head"))).alias("heads"))  # HEADS for each of a node's keys at most
    best = best.select("node", F.explode(F.slice("heads", 1, TRIED)).alias("h")).select("node", "h.head")
    return best.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in two components."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _across(shared: DataFrame, labels: DataFrame, maps: DataFrame, tmp: Scratch | None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a > b) of nodes that share a key, are in two components and whose parity maps allow a link; and the nodes of dear keys.

    Keys that are in two components or more and have the same nodes count as one of their number. Of each key, the nodes
    outside its largest component are paired with all others: a key of many near copies and a few others costs the few times
    the many. A key is dear that would compare more pairs than a new index of its nodes costs; with whole (a new index), none is.
    """
    refined = "whole" in shared.columns
    if not refined:
        shared = shared.select("key", "node", F.lit(0).alias("segment"), F.lit(True).alias("whole"), F.lit(None).cast("array<bigint>").alias("earlier"))
    rows = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("segment").alias("segment"), *[F.sum(F.xxhash64(F.lit(k), "node", "whole").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)])
    by_key = each.groupBy("key").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("parts"), F.min("segment").alias("segment"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")
    )
    by_key = by_key.filter("parts > 1").groupBy(band(F.col("key")), "h1", "h2", "all").agg(F.min(F.struct("segment", "key", "main", "most")).alias("one"), F.count("*").alias("times"))
    by_key = by_key.select("one.key", "one.main", "one.most", "all", "times")  # of the first segment: a pair is taken where it meets first
    by_key = by_key.select("key", "main", "times", ((F.col("all") - F.col("most")) * F.col("all")).alias("pairs"))
    few, dear = rows.join(by_key, "key"), None
    if not refined:
        mixed = tmp.written(few, "mixed")
        # a new index of a node serves all its keys: each bears a part of the cost
        part = mixed.groupBy("node").agg(F.count("*").alias("_keys")).join(maps.select("node", "n"), "node").select("node", (F.col("n") / F.col("_keys")).alias("_cost"))
        cost = mixed.join(part, "node").groupBy("key").agg(F.sum("_cost").alias("rows"), F.first("pairs").alias("pairs"))
        too = tmp.written(cost.filter(F.col("pairs") > F.lit(DEAR) * F.col("rows")).select("key"), "too_dear")
        few = mixed.join(too, "key", "left_anti")
        dear = tmp.written(mixed.join(too, "key", "left_semi").select("node").distinct(), "dear")
    few = few.join(maps, "node").select("key", "node", "label", "whole", "earlier", "main", "times", "n", is_own("key", "node").alias("own"), F.when(is_own("key", "node"), F.col("own")).otherwise(F.col("below")).alias("map"))
    sides = ("node", "label", "own", "whole", "earlier", "n", "map")
    left = few.filter("label <> main").select("key", "times", *[F.col(c).alias(f"{c}_x") for c in sides])
    right = few.select("key", "main", *[F.col(c).alias(f"{c}_y") for c in sides])
    meet = F.expr("label_x <> label_y AND (own_x OR own_y) AND (whole_x OR whole_y) AND (label_y = main OR node_x > node_y)" + " AND NOT arrays_overlap(earlier_x, earlier_y)" * refined)
    pairs = left.join(right, "key").filter(meet & _may_link(F.col("n_x"), F.col("n_y"), F.col("map_x"), F.col("map_y")))
    pairs = pairs.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b"), band(F.col("key")).alias("band"), "times")
    if not refined:
        # a pair that shares no dear key has all that it shares here; one that does is in the new index
        pairs = pairs.groupBy("a", "b", "band").agg(F.sum("times").alias("c")).filter(F.col("c") >= common_of(F.col("band")))
    return pairs.select("a", "b").distinct(), dear


def _named_texts(clashing: frozenset[int]):
    @alone
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        with np.errstate(over="ignore"):
            for b in batches:
                got = [(_name(h, clashing)[0], t) for t in b["_t"] if len(h := shingles.of(t))]
                yield pd.DataFrame({"node": np.array([n for n, _ in got], np.int64), "text": [t for _, t in got]})

    return run


def _texts_of(texts: DataFrame, wanted: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """node, text: of each wanted node, a text that makes its set. A filter by id keeps most others from the shuffle.

    Null and repeated ids share a place in it; nodes find their texts by the name of the text's own set.
    """
    rows = texts.filter(perhaps_in(F.col("_id"), wanted, F.col("_first")))
    got = rows.select("_t").mapInPandas(_named_texts(clashing), "node bigint, text string")
    return got.groupBy("node").agg(F.first("text").alias("text")).join(wanted.select("node"), "node", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, maps: DataFrame | None, tmp: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets; with maps, those whose parity maps rule a link out go before texts are met."""
    if maps is not None:
        at = lambda x: maps.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "own", "below")])
        same, above = band(F.col("a")) == band(F.col("b")), band(F.col("a")) > band(F.col("b"))
        mapped = pairs.join(at("a"), "a").join(at("b"), "b").filter(F.abs(band(F.col("a")) - band(F.col("b"))) <= 1)
        x, y = F.when(same | ~above, F.col("own_a")).otherwise(F.col("below_a")), F.when(same | above, F.col("own_b")).otherwise(F.col("below_b"))
        pairs = mapped.filter(_may_link(F.col("n_a"), F.col("n_b"), x, y)).select("a", "b")

    @alone
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last = Shingles(), OrderedDict()

        def of(node, text):
            if node not in last:
                last[node] = shingles.of(text)
                if len(last) > 64:
                    last.popitem(last=False)
            return last[node]

        with np.errstate(over="ignore"):
            for p in batches:
                out = []
                for a, b, x, y in zip(p["a"], p["b"], p["x"], p["y"], strict=True):
                    s, t = of(a, x), of(b, y)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if DEN * both >= NUM * (len(s) + len(t) - both):
                        out.append((a, b))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    got = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return tmp.written(got.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint"), f"links_{name}")
