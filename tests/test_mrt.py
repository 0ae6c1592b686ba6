"""MRT decoding of generated records."""

import bz2
import gzip
import ipaddress
import struct

import pytest

from pathweave.operators import replay
from pathweave.sources import lines, mrt

ip = lambda s: ipaddress.ip_address(s).packed


def record(when, kind, sub, body):
    return struct.pack(">IHHI", when, kind, sub, len(body)) + body


def attribute(kind, value, flags=0x40):
    return bytes([flags, kind, len(value)]) + value


def path(asns, wide, kind=2):
    return bytes([kind, len(asns)]) + b"".join(a.to_bytes(wide, "big") for a in asns)


def pfx(s):
    n = ipaddress.ip_network(s)
    return bytes([n.prefixlen]) + n.network_address.packed[: (n.prefixlen + 7) // 8]


def update(gone=(), attrs=b"", here=()):
    body = b"".join(map(pfx, gone))
    body = len(body).to_bytes(2, "big") + body + len(attrs).to_bytes(2, "big") + attrs + b"".join(map(pfx, here))
    return b"\xff" * 16 + (19 + len(body)).to_bytes(2, "big") + b"\x02" + body


def message(when, asn, msg, wide=4, micro=None):
    body = asn.to_bytes(wide, "big") * 2 + b"\0\0" + b"\0\1" + ip("192.0.2.1") + ip("192.0.2.9") + msg
    sub = 4 if wide == 4 else 1
    return record(when, 16, sub, body) if micro is None else record(when, 17, sub, micro.to_bytes(4, "big") + body)


def dump():
    peers = b"\0\0\0\1" + b"\0\0" + b"\0\2" + b"\2" + b"\0\0\0\1" + ip("192.0.2.1") + (70000).to_bytes(4, "big") + b"\1" + b"\0\0\0\2" + ip("2001:db8::1") + (65001).to_bytes(2, "big")
    attrs = attribute(1, b"\0") + attribute(2, path([70000, 5], 4) + path([7, 8], 4, 1)) + attribute(3, ip("192.0.2.1")) + attribute(8, b"\0\1\0\2")
    entry = lambda k, a: k.to_bytes(2, "big") + b"\0\0\0\0" + len(a).to_bytes(2, "big") + a
    v4 = b"\0\0\0\0" + pfx("10.0.0.0/8") + b"\0\1" + entry(0, attrs)
    v6 = b"\0\0\0\1" + pfx("2001:db8::/33") + b"\0\1" + entry(1, attribute(2, path([65001, 9], 4)) + attribute(14, b"\x10" + ip("2001:db8::2")))
    return record(100, 13, 1, peers) + record(100, 13, 2, v4) + record(100, 13, 4, v6)


def updates():
    here = attribute(1, b"\0") + attribute(2, path([70000, 6], 4)) + attribute(3, ip("192.0.2.1"))
    six = attribute(2, path([70000, 9], 4)) + attribute(14, b"\0\2\1\x10" + ip("2001:db8::2") + b"\0" + pfx("2001:db8::/32"))
    off = attribute(15, b"\0\2\1" + pfx("2001:db8::/32"))
    old = attribute(2, path([1, 23456, 23456], 2)) + attribute(17, path([70001, 70002], 4))
    state = record(105, 16, 5, (70000).to_bytes(4, "big") * 2 + b"\0\0\0\1" + ip("192.0.2.1") + ip("192.0.2.9") + b"\0\6\0\1")
    return message(101, 70000, update(["10.0.0.0/8"], here, ["10.1.0.0/16"])) + message(102, 70000, update(attrs=six), micro=250000) + message(103, 70000, update(attrs=off)) + message(104, 1, update(attrs=old, here=["10.2.0.0/16"]), wide=2) + state


DUMP = ["TABLE_DUMP2|100|B|192.0.2.1|70000|10.0.0.0/8|70000 5 {7,8}|IGP|192.0.2.1|0|0|1:2|NAG||", "TABLE_DUMP2|100|B|2001:db8::1|65001|2001:db8::/33|65001 9|INCOMPLETE|2001:db8::2|0|0||NAG||"]
UPDATES = [
    "BGP4MP|101|W|192.0.2.1|70000|10.0.0.0/8", "BGP4MP|101|A|192.0.2.1|70000|10.1.0.0/16|70000 6|IGP|192.0.2.1|0|0||NAG||", "BGP4MP_ET|102.250000|A|192.0.2.1|70000|2001:db8::/32|70000 9|INCOMPLETE|2001:db8::2|0|0||NAG||",
    "BGP4MP|103|W|192.0.2.1|70000|2001:db8::/32", "BGP4MP|104|A|192.0.2.1|1|10.2.0.0/16|1 70001 70002|INCOMPLETE||0|0||NAG||", "BGP4MP|105|STATE|192.0.2.1|70000|6|1",
]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lambda d: gzip.compress(d[:50]) + gzip.compress(d[50:])])
def test_decoded(pack):
    assert list(mrt.decoded(pack(dump()))) == DUMP
    assert list(mrt.decoded(pack(updates()))) == UPDATES


def test_malformed_records_are_left_out():
    broken = record(1, 13, 2, b"\0\0\0\0\xff") + record(1, 99, 0, b"other") + record(1, 16, 4, b"\0")
    assert list(mrt.decoded(broken + dump() + updates()[:-3])) == DUMP + UPDATES[:-1]


def test_old_table_dump():
    attrs = attribute(1, b"\1") + attribute(2, path([65001, 3], 2)) + attribute(3, ip("192.0.2.1"))
    body = b"\0\0\0\0" + ip("10.0.0.0") + b"\x08" + b"\1" + b"\0\0\0\0" + ip("192.0.2.1") + (65001).to_bytes(2, "big") + len(attrs).to_bytes(2, "big") + attrs
    assert list(mrt.decoded(record(7, 12, 1, body))) == ["TABLE_DUMP|7|B|192.0.2.1|65001|10.0.0.0/8|65001 3|EGP|192.0.2.1|0|0||NAG||"]


def test_read_and_replay(spark, tmp_path):
    (tmp_path / "rib.bz2").write_bytes(bz2.compress(dump()))
    (tmp_path / "updates.gz").write_bytes(gzip.compress(updates()))
    rib = lines.good(lines.rib_rows(mrt.read_mrt(spark, [(str(tmp_path / "rib.bz2"), "r", 0)])))
    upd = lines.update_rows(mrt.read_mrt(spark, [(str(tmp_path / "updates.gz"), "r", 1)]))
    assert [r.line_no for r in upd.orderBy("line_no").collect()] == [1, 2, 3, 4, 5, 6] and upd.filter("bad").count() == 0
    parsed = replay.parsed_rib(rib)
    assert [(r.pfx, r.path) for r in parsed.orderBy("line_no").collect()] == [("10.0.0.0/8", None), ("2001:db8::/33", [65001, 9])]
