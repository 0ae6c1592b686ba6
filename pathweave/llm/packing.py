"""Packing documents into token sequences in the order of a space-filling curve.

Each document's tokens are hashed into a signed vector that is projected to a few dimensions; its place on a Hilbert curve
through that space is its sort key. Sampled splitters deal the documents to partitions by (key, id) and each partition is
sorted, so that alike documents are neighbours. The tokens then form one stream that is cut at every multiple of the
sequence length: all sequences are full but the last. A partition knows where its stream begins from the number of tokens
of each partition before it, one number for each partition.

A null text is empty and has only the end token. Documents with equal vectors are ordered by id; repeated rows are packed
each for itself. An empty table gives no rows. Texts are tokenised whole; a long one lies in many sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_again, id_or_none, kept, partitions, range_id, written

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 4096, 2
#: Dimensions of the curve and bits of each.
DIMS, BITS = 4, 12
#: Chunks of text whose ids a worker remembers; a full memory is emptied.
REMEMBER = 500_000
#: Documents that a worker splits at once, and new pieces that it encodes together.
AT_ONCE, TOGETHER = 200, 100


#: ASCII marks that end a word of small letters, the apostrophe apart, are tokens of their own; the vocabulary has no capitals,
#: of which bytes.lower() meets A-Z. Small letters are a-z and those of Latin-1 (here in UTF-8).
_MARKS = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xC3[\x9F-\xB6\xB8-\xBF].))[!-&(-/:-@\[-`{-~]*(?=[\x20\x09-\x0D]|$)")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


class Numbers(dict):
    """Numbers of pieces, from 0 in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Words:
    """Token ids of whole texts, by remembering those of each piece between white space.

    The vocabulary drops white space, so that no token reaches over it and a text's ids are those of its pieces, joined.
    New pieces are encoded together, as one text, and told apart by where their tokens begin. Those that are one word of
    small letters go past the normaliser and the search for words, which leave them as they are.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(vocabulary)
        self.plain = Tokenizer(self.model.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()
        # special tokens are found before the vocabulary lower-cases: only as they are written
        self.special = re.compile(b"|".join(re.escape(x.content.encode()) for x in self.model.get_added_tokens_decoder().values()) or rb"(?!)", re.IGNORECASE)

    def _clear(self) -> None:
        """known: numbers of pieces; ids: of all pieces, as many as sizes has, from begins on."""
        self.known, self.used = Numbers(), 0
        self.ids, self.begins, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def pieces(self, text: str | None) -> list[bytes]:
        """What is between white space, lower-cased, but for pieces that hold a special token in capitals or not."""
        raw = (text or "").encode()
        if not self.special.search(raw):
            return _MARKS.sub(rb" \g<0>", raw.lower()).split()
        out: list[bytes] = []
        for w in raw.split():
            out += [w] if self.special.search(w) else _MARKS.sub(rb" \g<0>", w.lower()).split()
        return out

    def _learn(self) -> None:
        """Encode the pieces that have a number but no ids yet."""
        first, new = len(self.known) - len(self.known.new), [w.decode() for w in self.known.new]
        self.begins, self.sizes = _room(self.begins, len(self.known)), _room(self.sizes, len(self.known))
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in new), bool, len(new))
        for model, numbers in ((self.plain, np.flatnonzero(plain)), (self.model, np.flatnonzero(~plain))):
            for lo in range(0, len(numbers), TOGETHER):
                at = numbers[lo : lo + TOGETHER]
                some = [new[k] for k in at.tolist()]
                got = model.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(got.ids, "<u4")
                if model is self.plain:
                    sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
                else:
                    begins = np.cumsum([0] + [len(w) + 1 for w in some])
                    sizes = np.diff(np.searchsorted(np.fromiter((o for o, _ in got.offsets), np.int64, len(ids)), begins))
                self.ids = _room(self.ids, self.used + len(ids))
                self.ids[self.used : self.used + len(ids)] = ids
                self.begins[first + at], self.sizes[first + at] = self.used + np.cumsum(sizes) - sizes, sizes
                self.used += len(ids)
        self.known.new.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, the end token not included."""
        if len(self.known) > REMEMBER:
            self._clear()
        try:
            each = []
            for t in texts:
                p = self.pieces(t)
                each.append(np.fromiter(map(self.known.__getitem__, p), np.int32, len(p)))
            self._learn()
        except BaseException:  # the worker goes on to other tasks
            self._clear()
            raise
        out = []
        for numbers in each:
            sizes = self.sizes[numbers]
            at = np.repeat(self.begins[numbers] - np.cumsum(sizes) + sizes, sizes)
            at += np.arange(len(at))
            out.append(self.ids[at].tobytes())
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with room for n."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


def words_of(vocabulary: str) -> Words:
    """One for each worker process, which goes from task to task, until another operator's task comes to it."""
    return kept(f"words of {vocabulary}", lambda: Words(vocabulary))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def directions(size: int, dims: int) -> np.ndarray:
    """For each token id its hashed contribution, +1 or -1, to each dimension."""
    with np.errstate(over="ignore"):
        bits = _mix(np.arange(1, size * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
    return bits.astype(np.float32).reshape(size, dims) * 2 - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of rows of cell coordinates, each of so many bits (Skilling's transposed form)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(ids: list[bytes], table: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document; a document without tokens lies at the middle of the space."""
    dims = table.shape[1]
    points = np.zeros((len(ids), dims))
    for k, b in enumerate(ids):
        if b:
            counts = np.unique(np.frombuffer(b, "<u4"), return_counts=True)
            weights = np.sqrt(counts[1])
            points[k] = weights @ table[counts[0]] / np.sqrt((weights**2).sum())
    # a sum of random signs of unit length is near a normal deviate: its rank in (0, 1) spreads the cells evenly
    places = 1 / (1 + np.exp(-1.702 * points))
    return hilbert(np.minimum((places * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 32-bit little-endian)."""
    spark = docs.sparkSession

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = words_of(vocabulary), np.asarray([end_id], "<u4").tobytes()
        table = directions(max(words.model.get_vocab_size(), end_id + 1), DIMS)
        for b in (b[lo : lo + AT_ONCE] for b in batches for lo in range(0, len(b), AT_ONCE)):
            got = words.encode(list(b["_t"]))
            yield pd.DataFrame({"_id": b["_id"], "_key": curve_keys(got, table), "_n": [len(x) // 4 + 1 for x in got], "_ids": [x + end for x in got]})

    texts = docs.select(id_or_none(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t"))
    rows = written(texts.mapInPandas(tokenise, "_id bigint, _key bigint, _n bigint, _ids binary"), "tokens")
    n = partitions(spark)
    dealt = rows.withColumn("_pid", range_id(rows, [("_key", "bigint"), ("_id", "bigint")], F.col("_n"), n))
    counts = dict(dealt.groupBy("_pid").agg(F.sum("_n")).collect())  # a number for each partition
    begins, at = {}, 0
    for pid in range(n):
        begins[pid] = at
        at += counts.get(pid, 0)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[int, int] = {}
        for b in batches:
            out = []
            for pid, doc, ids in zip(b["_pid"], b["_id"], b["_ids"], strict=True):
                at = place.get(pid, begins[pid])
                n, start = len(ids) // 4, 0
                while start < n:
                    take = min(n - start, length - at % length)
                    piece = ids[4 * start : 4 * (start + take)]
                    out.append((int(doc), start, take, zlib.crc32(piece), n, at // length, at % length, piece))
                    start, at = start + take, at + take
                place[pid] = at
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]
    placed = dealt.repartitionById(n, F.col("_pid")).sortWithinPartitions("_pid", "_key", "_id", F.crc32("_ids"))
    return placed.select("_pid", "_id", "_ids").mapInPandas(cut, schema).withColumn("doc_id", id_again(F.col("doc_id")))
