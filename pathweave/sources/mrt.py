"""Decoding of binary MRT archive files (RFC 6396; plain, gzip or bzip2) into the decoded lines that lines.py reads.

Table dumps of both versions (IPv4 and IPv6 unicast) and BGP4MP messages and state changes are decoded; records of other
kinds are skipped. A file is decoded by one task, record by record, and its lines are numbered as they come. Decompressed
bytes and lines are streamed, so that only the packed file (2 GB at most) is in memory.
"""

from __future__ import annotations

import bz2
import io
import ipaddress
import struct
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record types and subtypes, attribute types and segment types of the public formats.
TABLE_DUMP, TABLE_DUMP_V2, BGP4MP, BGP4MP_ET = 12, 13, 16, 17
PEER_INDEX, RIB_V4, RIB_V6 = 1, 2, 4
STATE, MESSAGE, MESSAGE_AS4, STATE_AS4, MESSAGE_LOCAL, MESSAGE_AS4_LOCAL = 0, 1, 4, 5, 6, 7
ORIGIN, AS_PATH, NEXT_HOP, MED, LOCAL_PREF, ATOMIC, AGGREGATOR, COMMUNITY, MP_REACH, MP_UNREACH, AS4_PATH = 1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 17
SEGMENTS = {1: ("{", ",", "}"), 2: ("", " ", ""), 3: ("(", " ", ")"), 4: ("[", ",", "]")}
ORIGINS = ("IGP", "EGP", "INCOMPLETE")
#: Lines of one batch.
BATCH = 20_000


class Cursor:
    """Big-endian numbers and bytes from a buffer; reading past its end raises ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated record")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def left(self) -> int:
        return len(self.data) - self.at


def address(data: bytes) -> str:
    return str(ipaddress.ip_address(data))


def prefix(c: Cursor, v6: bool) -> str:
    bits = c.number(1)
    width = 16 if v6 else 4
    if bits > 8 * width:
        raise ValueError("prefix too long")
    return f"{address(c.take((bits + 7) // 8).ljust(width, b'\0'))}/{bits}"


def segments(data: bytes, asn_bytes: int) -> list[tuple[int, list[int]]]:
    c, out = Cursor(data), []
    while c.left():
        kind, n = c.number(1), c.number(1)
        out.append((kind, [c.number(asn_bytes) for _ in range(n)]))
    return out


def merged(path: list[tuple[int, list[int]]], path4: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """A path of two-byte numbers with its end replaced by the four-byte path; a set counts as one hop."""
    hops = lambda p: sum(len(a) if k == 2 else 1 for k, a in p)
    extra, out = hops(path) - hops(path4), []
    if not path4 or extra < 0:
        return path
    for k, a in path:
        if extra <= 0:
            break
        out.append((k, a[:extra] if k == 2 else a))
        extra -= min(extra, len(a)) if k == 2 else 1
    if out and path4 and out[-1][0] == path4[0][0] == 2:
        return [*out[:-1], (2, out[-1][1] + path4[0][1]), *path4[1:]]
    return out + path4


def path_text(path: list[tuple[int, list[int]]]) -> str:
    return " ".join(SEGMENTS.get(k, SEGMENTS[2])[0] + SEGMENTS.get(k, SEGMENTS[2])[1].join(map(str, a)) + SEGMENTS.get(k, SEGMENTS[2])[2] for k, a in path)


def attributes(data: bytes, asn_bytes: int) -> dict:
    """Fields of a route, and the prefixes of multiprotocol attributes."""
    c, out, path, path4 = Cursor(data), {"reach": [], "unreach": []}, [], []
    while c.left():
        flags, kind = c.number(1), c.number(1)
        v = Cursor(c.take(c.number(2 if flags & 16 else 1)))
        if kind == AS_PATH:
            path = segments(v.data, asn_bytes)
        elif kind == AS4_PATH:
            path4 = segments(v.data, 4)
        elif kind == ORIGIN:
            out["origin"] = ORIGINS[min(v.number(1), 2)]
        elif kind == NEXT_HOP:
            out["next_hop"] = address(v.take(4))
        elif kind in (MED, LOCAL_PREF):
            out["med" if kind == MED else "local_pref"] = v.number(4)
        elif kind == ATOMIC:
            out["atomic"] = "AG"
        elif kind == AGGREGATOR:
            asn = v.number(v.left() - 4)
            out["aggregator"] = f"{asn} {address(v.take(4))}"
        elif kind == COMMUNITY:
            out["community"] = " ".join(f"{v.number(2)}:{v.number(2)}" for _ in range(v.left() // 4))
        elif kind == MP_REACH and v.data[:1] == b"\0":
            family, _, hop = v.number(2), v.number(1), v.take(v.number(1))
            v.number(1)
            if len(hop) in (4, 16, 32):
                out["next_hop"] = address(hop[:16] if len(hop) > 4 else hop)
            out["reach"] = prefixes(v, family == 2)
        elif kind == MP_REACH and v.left() > 1:  # table dumps hold the next hop alone
            hop = v.take(v.number(1))
            if len(hop) in (4, 16, 32):
                out["next_hop"] = address(hop[:16] if len(hop) > 4 else hop)
        elif kind == MP_UNREACH:
            family = v.number(2)
            v.number(1)
            out["unreach"] = prefixes(v, family == 2)
    out["path"] = path_text(merged(path, path4) if asn_bytes == 2 else path)
    return out


def prefixes(c: Cursor, v6: bool) -> list[str]:
    out = []
    while c.left():
        out.append(prefix(c, v6))
    return out


def route(tag: str, when: str, kind: str, peer: str, asn: int, pfx: str, a: dict) -> str:
    cells = (tag, when, kind, peer, asn, pfx, a["path"], a.get("origin", "INCOMPLETE"), a.get("next_hop", ""), a.get("local_pref", 0), a.get("med", 0), a.get("community", ""), a.get("atomic", "NAG"), a.get("aggregator", ""), "")
    return "|".join(map(str, cells))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, int, bytes]]:
    """Time, type, subtype and body of each record; a cut-off last one is left out."""
    while len(head := stream.read(12)) == 12:
        when, kind, sub, n = struct.unpack(">IHHI", head)
        body = stream.read(n)
        if len(body) < n:
            return
        yield when, kind, sub, body


class Decoder:
    """Lines of records, in order. Peers of a table dump are kept from its index record."""

    def __init__(self) -> None:
        self.peers: list[tuple[str, int]] = []

    def lines(self, when: int, kind: int, sub: int, body: bytes) -> Iterator[str]:
        c = Cursor(body)
        if kind == TABLE_DUMP_V2 and sub == PEER_INDEX:
            c.take(4)
            c.take(c.number(2))
            self.peers = []
            for _ in range(c.number(2)):
                flags = c.number(1)
                c.take(4)
                self.peers.append((address(c.take(16 if flags & 1 else 4)), c.number(4 if flags & 2 else 2)))
        elif kind == TABLE_DUMP_V2 and sub in (RIB_V4, RIB_V6):
            c.take(4)
            pfx = prefix(c, sub == RIB_V6)
            for _ in range(c.number(2)):
                peer, asn = self.peers[c.number(2)]
                c.take(4)
                yield route("TABLE_DUMP2", str(when), "B", peer, asn, pfx, attributes(c.take(c.number(2)), 4))
        elif kind == TABLE_DUMP and sub in (1, 2):
            width = 16 if sub == 2 else 4
            c.take(4)
            pfx = f"{address(c.take(width))}/{c.number(1)}"
            c.take(5)
            peer, asn = address(c.take(width)), c.number(2)
            yield route("TABLE_DUMP", str(when), "B", peer, asn, pfx, attributes(c.take(c.number(2)), 2))
        elif kind in (BGP4MP, BGP4MP_ET):
            tag, stamp = "BGP4MP", str(when)
            if kind == BGP4MP_ET:
                tag, stamp = "BGP4MP_ET", f"{when}.{c.number(4):06d}"
            yield from self.message(tag, stamp, sub, c)

    def message(self, tag: str, when: str, sub: int, c: Cursor) -> Iterator[str]:
        if sub not in (STATE, MESSAGE, MESSAGE_AS4, STATE_AS4, MESSAGE_LOCAL, MESSAGE_AS4_LOCAL):
            return
        wide = 4 if sub in (MESSAGE_AS4, STATE_AS4, MESSAGE_AS4_LOCAL) else 2
        asn = c.number(wide)
        c.take(wide + 2)
        width = 16 if c.number(2) == 2 else 4
        peer = address(c.take(width))
        c.take(width)
        if sub in (STATE, STATE_AS4):
            yield f"{tag}|{when}|STATE|{peer}|{asn}|{c.number(2)}|{c.number(2)}"
            return
        c.take(18)  # marker and length
        if c.number(1) != 2:  # an update
            return
        gone = prefixes(Cursor(c.take(c.number(2))), False)
        a = attributes(c.take(c.number(2)), wide)
        for pfx in gone + a["unreach"]:
            yield f"{tag}|{when}|W|{peer}|{asn}|{pfx}"
        for pfx in prefixes(c, False) + a["reach"]:
            yield route(tag, when, "A", peer, asn, pfx, a)


class _Inflated(io.RawIOBase):
    """A stream of gzip members from bytes, a piece at a time."""

    def __init__(self, data: bytes, make):
        self.data, self.at, self.make, self.unpack, self.rest = data, 0, make, make(), b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.rest:
            if self.unpack.eof:
                self.data, self.at, self.unpack = self.unpack.unused_data + self.data[self.at :], 0, self.make()
            piece = self.data[self.at : self.at + (1 << 16)]
            if not piece:
                return 0
            self.at += len(piece)
            self.rest = self.unpack.decompress(piece)
        n = min(len(b), len(self.rest))
        b[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def opened(data: bytes) -> io.BufferedIOBase:
    """The records' bytes, whatever the packing."""
    if data[:2] == b"\x1f\x8b":
        return io.BufferedReader(_Inflated(data, lambda: zlib.decompressobj(31)), 1 << 16)
    if data[:3] == b"BZh":
        return io.BufferedReader(_Inflated(data, bz2.BZ2Decompressor), 1 << 16)
    return io.BytesIO(data)


def decoded(data: bytes) -> Iterator[str]:
    """All lines of a file; a malformed record is left out."""
    decoder = Decoder()
    for record in records(opened(data)):
        try:
            yield from list(decoder.lines(*record))
        except (ValueError, IndexError):
            continue


def read_mrt(spark: SparkSession, files: Sequence[tuple[str, str, object]]) -> DataFrame:
    """rc, file_label, line_no, f of MRT files, as lines.read_lines() gives them: files are (path, rc, file_label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                held, n = [], 0
                for line in decoded(content):
                    held.append(line)
                    if len(held) == BATCH:
                        yield pd.DataFrame({"_path": path, "line_no": range(n + 1, n + 1 + len(held)), "value": held})
                        n, held = n + len(held), []
                if held:
                    yield pd.DataFrame({"_path": path, "line_no": range(n + 1, n + 1 + len(held)), "value": held})

    name = lambda p: p.split("://", 1)[-1].split(":", 1)[-1].lstrip("/")
    manifest = spark.createDataFrame([(name(p), rc, label) for p, rc, label in files], ["_path", "rc", "file_label"])
    content = spark.read.format("binaryFile").load([f[0] for f in files]).select(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?/+", "").alias("path"), "content")
    lines = content.mapInPandas(run, "_path string, line_no bigint, value string")
    return lines.join(manifest, "_path").select("rc", "file_label", "line_no", F.split("value", "[|]").alias("f"))
