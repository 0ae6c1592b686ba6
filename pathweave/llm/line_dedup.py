"""Fuzzy line deduplication over all documents.

1. Lines are normalised (lower case, runs of characters other than letters and digits become one space, ends cut off). Equal
   normalised lines are one node, named by a 64-bit hash; two lines of one name, under ten pairs in 10^10 lines, count as
   equal. Lines of any length take part; lines without letters and digits always stay.
2. A line's SimHash is taken over its distinct words. Near lines differ in about a tenth of its bits, others in nearly half
   of them, and fewer where all words weigh alike. It is cut into blocks; lines with an equal block meet. A block has a bit
   more than the logarithm of the number of lines, so that a line meets a fixed number of others by chance, and there are as many
   blocks as put RECALL of the pairs at DISTANCE of all bits into one at least: the keys grow with about the 1.2nd power of the lines.
   They are dealt some blocks at a time, so that the disk they take grows with the lines only.
3. Pairs that meet are compared by a part of their SimHashes within the join, by 128 bits of them after it, and then verified:
   edit similarity, 1 - edits / longer length, of SIMILARITY at least. A line is compared with the line that is the least
   of most of its blocks first, then with all others that are still in another group: n near lines cost about n comparisons.
4. Of each connected group the occurrence in the document of the smallest id, and there the first, stays.

Against all pairs of edit similarity 0.75 or more, the links' recall on the 7569 lines of sf0.01 stands in the README; a test
measures it on a smaller table. A null text has no lines. Repeated rows hold repeated lines: rows are told apart by text, rows
equal in id and text keep the same lines. A null id comes before all others. An empty table gives no rows. A long text is one
row's work, in memory proportional to it; of long lines, edits are counted up to the bound only. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, alone, perhaps_in, written
from .components import components

SIMILARITY = 0.75
#: The share of bits in which pairs differ that RECALL of them are to meet at; fewest bits of a block.
DISTANCE, RECALL, LEAST_BITS = 0.125, 0.9, 16
#: Blocks whose keys are dealt at once: they bound the disk that the meeting takes.
AT_A_TIME = 12
#: Most bits of the 31 beside a key, and of the first 128, in which a pair to be verified differs.
NEAR_31, NEAR_128 = 10, 34
#: Words handled at once (their counters stay in a core's cache), words that four bits and a byte can count, words and lines a worker remembers.
AT_ONCE, NIBBLE, COUNTED, REMEMBER, SEEN = 2048, 15, 255, 400_000, 400_000
LOWEST = -(2**63)
_GAPS = re.compile(r"[^\w\n]+")


def lines_of(text: str | None) -> list[str]:
    """The normalised lines of a text, as many as it has."""
    return [] if text is None else [x.strip() for x in _GAPS.sub(" ", text.lower().replace("_", " ")).split("\n")]


def node_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def blocks(lines: int) -> tuple[int, int]:
    """Bits of a block and the number of blocks for so many lines."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(lines, 2))) + 1)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DISTANCE) ** bits))


class SimHash:
    """SimHashes of the distinct words of lines, as rows of bits; the bits are a multiple of 64, at least 128.

    A word's bits are dealt to counters of four bits, 16 in a number; the counters of NIBBLE words become bytes, those of up
    to COUNTED words wider ones. A line of very many words is counted some words at a time.
    """

    def __init__(self, bits: int) -> None:
        self.words = max(2, -(-bits // 64))
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def nibbles(self, hashes: np.ndarray) -> np.ndarray:
        """Four bits for each bit of words of these hashes."""
        with np.errstate(over="ignore"):
            x = hashes[:, None] + np.arange(1, self.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x ^= x >> np.uint64(shift)
                x *= np.uint64(factor)
            x ^= x >> np.uint64(31)
            out = np.empty((len(x), 4, self.words), np.uint64)
            for k in range(4):
                np.right_shift(x, np.uint64(k), out=out[:, k])
            out &= np.uint64(0x1111111111111111)
            return out.reshape(len(x), -1)

    def bits_of(self, hashes: np.ndarray) -> np.ndarray:
        """A byte for each bit of words of these hashes, eight in a number."""
        return _bytes(self.nibbles(hashes))

    def counts(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of runs of n hashes each, how many have each bit."""
        runs = -(-n // NIBBLE)
        sums = _bytes(np.add.reduceat(self.nibbles(hashes), _starts(n, NIBBLE), axis=0))
        if len(sums) > len(n):
            sums = np.add.reduceat(sums, _starts(runs, COUNTED // NIBBLE), axis=0)
        sums, parts = sums.view(np.uint8), -(-runs // (COUNTED // NIBBLE))
        return np.add.reduceat(sums.astype(np.uint32), _starts(parts, None), axis=0) if len(sums) > len(n) else sums

    def of(self, lines: list[str]) -> np.ndarray:
        out, at = np.zeros((len(lines), self.words * 64), bool), 0
        while at < len(lines):
            if len(self.known) > REMEMBER:
                self.known.clear()
            known, hashes, first, n = self.known, [], at, []
            while at < len(lines) and len(hashes) < AT_ONCE:
                words = dict.fromkeys(lines[at].split(" "))
                hashes += [known[w] if w in known else self._hash(w) for w in words]
                n.append(len(words))
                at += 1
            hashed, sizes = np.array(hashes, np.uint64), np.array(n)
            if n[-1] > AT_ONCE:  # by itself, for its counters would take much memory
                at -= 1
                hashed, long = np.split(hashed, [len(hashed) - n.pop()])
                out[at] = sum(self.counts(x, np.array([len(x)]))[0].astype(np.int64) for x in np.split(long, range(AT_ONCE, len(long), AT_ONCE))) > len(long) // 2
                sizes, at = sizes[:-1], at + 1
            if n:
                out[first : first + len(n)] = self.counts(hashed, sizes) > (sizes // 2)[:, None]
        return out


def _bytes(nibbles: np.ndarray) -> np.ndarray:
    low = np.uint64(0x0F0F0F0F0F0F0F0F)
    return np.concatenate([nibbles & low, nibbles >> np.uint64(4) & low], axis=1)


def _starts(n: np.ndarray, most: int | None) -> np.ndarray:
    """Where runs of n begin that follow each other, each cut into pieces of most."""
    begins = np.cumsum(n) - n
    return np.concatenate([np.arange(b, b + k, most) for b, k in zip(begins, n, strict=True)]) if most and n.max() > most else begins


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit vectors over whole rows; what the ends have in common costs nothing. Above most, any number above it."""
    if a == b:
        return 0
    lo, least = 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, out = full, 0, len(a)  # vertical steps of +1 and -1
    for j, c in enumerate(b):
        if most is not None and out - (len(b) - j) > most:
            return out - (len(b) - j)
        eq = where.get(c, 0)
        diagonal = (((eq & more) + more) ^ more) | eq | less
        up, down = less | (full & ~(diagonal | more)), more & diagonal
        out += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | (full & ~((eq | less) | up)), up & (eq | less)
    return out


def alike(a: str, b: str) -> bool:
    most = int(((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9) // 1)
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most:  # some words are other ones
        return True
    return abs(len(a) - len(b)) <= most and edits(a, b, most) <= most


PLACE = pa.struct([("i", pa.int64()), ("r", pa.int64()), ("p", pa.int32())])


def _describe(bits: int):
    """node, place and, of each node once in a task or so, the SimHash of every line with letters or digits."""

    @alone
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = SimHash(bits), set()
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            nodes, places, new, at = [], [], [], []
            for i, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p, line in enumerate(lines_of(t)):
                    if line:
                        node = node_of(line)
                        if len(seen) > SEEN:
                            seen.clear()
                        if node not in seen:
                            seen.add(node)
                            new.append(line)
                            at.append(len(nodes))
                        nodes.append(node)
                        places.append({"i": i, "r": r, "p": p})
            sketches: list = [None] * len(nodes)
            for k, longs in zip(at, np.packbits(hashes.of(new), axis=1).view(np.int64), strict=True):
                sketches[k] = longs
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, PLACE), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "place", "bits"])

    return run


def _unlike(x: str, y: str) -> str:
    return f"bit_count({x} ^ {y})"


def _block(k: int, bits: int) -> Column:
    """Block k of the SimHash, with its number above it."""
    word, shift = divmod(k * bits, 64)
    value = F.shiftrightunsigned(F.get("bits", F.lit(word)), shift)
    if shift + bits > 64:
        value = value.bitwiseOR(F.shiftleft(F.get("bits", F.lit(word + 1)), 64 - shift))
    return value.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(k << bits)


def _meeting(described: DataFrame, bits: int, some: range) -> DataFrame:
    """key, part, node, head, head_part: the nodes that meet in one of some blocks, the least of them, and 31 bits of either.

    Of up to four nodes of a key, those go whose 31 bits are far from the others'.
    """
    rows = described.filter("bits IS NOT NULL").select(F.explode(F.array(*[_block(k, bits) for k in some])).alias("key"), F.shiftrightunsigned(F.get("bits", F.lit(0)), 33).cast("int").alias("part"), "node")
    by = Window.partitionBy("key").orderBy("node")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.lead(F.struct("node", "part"), k).over(by).alias(f"to{k + 3}") for k in (-3, -2, -1, 1, 2, 3)]
    rows = rows.select("*", F.first("node").over(every).alias("head"), F.first("part").over(every).alias("head_part"), F.last("node").over(every).alias("hi"), F.count("*").over(every).alias("c"), *near)
    close = " OR ".join(f"to{k + 3}.node <> node AND {_unlike(f'to{k + 3}.part', 'part')} <= {NEAR_31}" for k in (-3, -2, -1, 1, 2, 3))
    return rows.filter(f"head <> hi AND (to2 IS NULL OR to2.node <> node) AND (c > 4 OR {close})").select("key", "part", "node", "head", "head_part")


def line_links(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """a, b: links of alike lines that make all groups; of rows (_id, _row, _t), with the places of all lines written as lines."""
    total = rows.agg(F.sum(F.size(F.split("_t", "\n")))).first()[0] or 0
    bits, number = blocks(total)
    described = tmp.written(rows.mapInArrow(_describe(max(bits * number, 128)), "node bigint, place struct<i:bigint,r:bigint,p:int>, bits array<bigint>"), "described")
    met = {f"met{lo}": _meeting(described, bits, range(lo, min(number, lo + AT_A_TIME))) for lo in range(0, number, AT_A_TIME)}
    met = {name: tmp.written(some, name) for name, some in met.items()}
    shared = reduce(DataFrame.union, met.values())
    sketches = described.filter("bits IS NOT NULL").select("node", F.struct("place.i", "place.r").alias("at"), F.get("bits", F.lit(0)).alias("s1"), F.get("bits", F.lit(1)).alias("s2"))
    sketches = tmp.written(sketches.groupBy("node").agg(F.min("at").alias("at"), F.min("s1").alias("s1"), F.min("s2").alias("s2")), "sketches")
    tmp.written(described.select("node", "place"), "lines")
    tmp.remove("described")  # the other bits are most of the disk that lines take
    heads = shared.filter(f"node <> head AND {_unlike('part', 'head_part')} <= {NEAR_31}").groupBy("node", "head").agg(F.count("*").alias("c"))
    to_head = tmp.written(heads.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("c", "head")).alias("b")), "to_head")  # the head of most of its blocks
    links = _verified(to_head, rows, sketches, tmp, "to_head")
    labels = components(links, into=tmp)
    pairs = []
    for name, some in met.items():  # one at a time: no key is in two of them, and what a join moves is a part of all
        pairs.append(tmp.written(_across(some, labels), f"pairs_{name}"))
        tmp.remove(name)
    pairs = reduce(DataFrame.union, pairs).distinct()
    return links.union(_verified(pairs.join(to_head, ["a", "b"], "left_anti"), rows, sketches, tmp, "across"))


def _across(met: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the pairs (a > b) of nodes that meet, are in two groups yet and have 31 bits that are near."""
    named = met.select("key", "part", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    named = named.join(mixed, "key", "left_semi")
    x, y = (named.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("part", "node", "label")]) for side in "xy")
    pairs = x.join(y, "key").filter(f"node_x > node_y AND label_x <> label_y AND {_unlike('part_x', 'part_y')} <= {NEAR_31}")
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """The pairs (a > b) of lines that are alike: by 128 bits, then by edits of the lines, which are read again from their documents."""
    at = lambda x: sketches.select(F.col("node").alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"))
    near = pairs.join(at("a"), "a").join(at("b"), "b").filter(f"{_unlike('a1', 'b1')} + {_unlike('a2', 'b2')} <= {NEAR_128}")
    near = tmp.written(near.select("a", "b"), f"near_{name}")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = wanted.join(sketches, "node").select("node", F.xxhash64("at.i", "at.r").alias("_doc"))

    @alone
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {node_of(x): x for t in b.column(0).to_pylist() for x in lines_of(t) if x}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.string())], names=["node", "line"])

    texts = rows.filter(perhaps_in(F.xxhash64("_id", "_row"), places, F.col("_doc"))).select("_t").mapInArrow(read, "node bigint, line string")
    texts = tmp.written(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("line").alias("line")), f"texts_{name}")

    @alone
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[alike(x, y) for x, y in zip(p["x"], p["y"], strict=True)], ["a", "b"]]

    line = lambda x, y: texts.select(F.col("node").alias(x), F.col("line").alias(y))
    return tmp.written(near.join(line("a", "x"), "a").join(line("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(verify, "a bigint, b bigint"), f"links_{name}")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_lines, n_kept, text (of the lines that stay), kept_lines (their places)."""
    text = F.col(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"), text.alias("_t"))
    with Scratch(docs.sparkSession) as tmp:
        groups = components(line_links(rows, tmp), into=tmp)
        described = docs.sparkSession.read.schema("node bigint, place struct<i:bigint,r:bigint,p:int>").parquet(tmp.at["lines"])
        lines = described.join(groups, "node", "left").select(F.coalesce("label", "node").alias("group"), F.struct("place.i", "place.r", "place.p").alias("place"))
        many = lines.groupBy("group").agg(F.min("place").alias("stays"), F.count("*").alias("c")).filter("c > 1").select("group", "stays")
        gone = lines.join(many, "group").filter("place <> stays").groupBy(F.col("place.i").alias("_id"), F.col("place.r").alias("_row"))
        gone = written(gone.agg(F.collect_set("place.p").alias("_gone")), "gone")  # as many as a document's lines
    # documents that lose no line stay where they are
    some = perhaps_in(F.xxhash64("_id", "_row"), gone.select(F.xxhash64("_id", "_row").alias("_doc")), F.col("_doc"))
    split = rows.withColumn("_some", some)
    same = split.filter("NOT _some").select("_id", "_t", F.array().cast("array<int>").alias("_gone"))
    cut = split.filter("_some").join(gone, ["_id", "_row"], "left").select("_id", "_t", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    out = same.union(cut).withColumn("_raw", F.coalesce(F.split("_t", "\n"), F.array().cast("array<string>")))
    places = F.when(F.size("_raw") > 0, F.sequence(F.lit(0), F.size("_raw") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.select(F.when(F.col("_id") != LOWEST, F.col("_id")).alias("doc_id"), "_raw", F.array_except(places, "_gone").alias("kept_lines"))
    return out.select(
        "doc_id", F.size("_raw").cast("bigint").alias("n_lines"), F.size("kept_lines").cast("bigint").alias("n_kept"), F.array_join(F.transform("kept_lines", lambda k: F.get("_raw", k)), "\n").alias("text"), "kept_lines"
    )
