"""Paths, replay and views: edge cases by hand, random feeds against a sequential fold, and known totals."""

import random
from collections import Counter
from datetime import datetime
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from pathweave.functions import paths
from pathweave.observers import AsGraph, AsMultigraph, PathCounts, UpdateCounts
from pathweave.operators import compare, replay
from pathweave.queries import Feed

RIB = "rc string, line_no bigint, peer_ip string, peer_asn bigint, pfx string, as_path string"
UPD = "rc string, file_label int, line_no bigint, ts timestamp_ntz, typ string, nf int, peer_ip string, peer_asn bigint, pfx string, as_path string"


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ("1 1 2", [1, 2]), ("1 2 1", [1, 2, 1]), ("1 1", None), ("77 1 2", None), ("1 {2,3}", None), ("(65000) 1", None), ("1  2", None), (" 1 2", None), ("1 2 ", None), ("", None), (None, None),
        ("1 1.10", None), ("1 01 2", [1, 1, 2]), ("1 4200000000", [1, 4200000000]), ("1 99999999999999999999", None), ("1", None), ("1\n2", None),
    ],
)
def test_valid_path(spark, text, path):
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(paths.valid_path(F.col("p"), F.lit(1))).first()[0] == path


@pytest.mark.parametrize(("prefix", "fam"), [("10.0.0.0/8", 4), ("2001:db8::/32", 6), ("::ffff:1.2.3.0/120", 4), ("weird", 0)])
def test_family(spark, prefix, fam):
    assert spark.range(1).select(paths.family(F.lit(prefix))).first()[0] == fam


def test_time_keeps_microseconds(spark):
    df = spark.createDataFrame([("1283299205.250001",), ("0",)], "s string")
    assert [r[0] for r in df.select(paths.epoch_time(F.col("s"))).collect()] == [datetime(2010, 9, 1, 0, 0, 5, 250001), datetime(1970, 1, 1)]


def feed(spark, rib, upd):
    parsed = replay.parsed_rib(spark.createDataFrame(rib, RIB))
    known = replay.known_peers(parsed)
    return parsed, replay.events(parsed, replay.parsed_updates(spark.createDataFrame(upd, UPD), known), F.lit(-1)), known


def fold(rib, upd):
    """State, path counts, edge counts and update counts by playing the log line by line."""
    state, seen, n_paths, edges, counts = {}, set(), Counter(), Counter(), Counter()

    def path_of(text, asn):
        try:
            p = [int(k) for k, _ in groupby(text.split(" "))] if text and all(c in "0123456789 " for c in text) else None
        except ValueError:
            p = None
        return tuple(p) if p and len(p) > 1 and p[0] == asn else None

    def note(p, d, rc, peer, pfx):
        fam = 4 if "." in pfx else 6 if ":" in pfx else 0
        if p and fam:
            n_paths[p] += d
            for a, b in zip(p, p[1:]):
                edges[fam, min(a, b), max(a, b), rc, peer] += d
        return fam

    for rc, _, peer, asn, pfx, text in sorted(rib, key=lambda r: r[1]):
        if p := path_of(text, asn):
            state[rc, peer, pfx] = p
            seen.add((rc, peer))
            note(p, 1, rc, peer, pfx)
    for rc, _, _, _, typ, nf, peer, asn, pfx, text in sorted(upd, key=lambda r: (r[1], r[2])):
        if (typ, nf) not in (("A", 15), ("W", 6)) or (rc, peer) not in seen:
            continue
        old, p = state.get((rc, peer, pfx)), path_of(text, asn) if typ == "A" else None
        if p is None and old is None:
            continue
        note(old, -1, rc, peer, pfx)
        fam = note(p, 1, rc, peer, pfx) if p else 4 if "." in pfx else 6 if ":" in pfx else 0
        if fam:
            counts[rc, "A" if p else "W", fam] += 1
        if p:
            state[rc, peer, pfx] = p
        else:
            del state[rc, peer, pfx]
    return state, +n_paths, +edges, counts


@pytest.mark.parametrize("seed", [1, 2])
def test_random_feeds_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    path = lambda asn: " ".join(str(x) for x in [rng.choice([asn, asn, 9])] + [rng.randint(1, 6) for _ in range(rng.randint(0, 3))]) + rng.choice(["", "", "", " {1}"])
    pfxs = ["10.0.0.0/8", "10.1.0.0/16", "2001:db8::/32", "weird", "::ffff:1.2.3.0/120"]
    rib = [("rc%d" % (k % 2), k, "p%d" % rng.randint(0, 3), 1, rng.choice(pfxs), path(1)) for k in range(25)]
    upd = []
    for k in range(1500):
        typ, nf = rng.choice([("A", 15), ("A", 15), ("W", 6), ("A", 14), ("STATE", 7)])
        upd.append(("rc%d" % rng.randint(0, 1), k // 100, rng.randint(0, 10**9), datetime(2020, 1, 1), typ, nf, "p%d" % rng.randint(0, 4), 1, rng.choice(pfxs), path(1) if typ == "A" else None))
    state, n_paths, edges, counts = fold(rib, upd)
    _, log, _ = feed(spark, rib, upd)
    tr = replay.transitions(log).cache()
    assert {(r.rc, r.peer_ip, r.pfx): tuple(r.path) for r in replay.rib_at(log).collect()} == state
    assert {tuple(r.path): r.n for r in PathCounts("p").now(tr).collect()} == n_paths
    assert {(r.fam, r.u, r.v, r.rc, r.peer_ip): r.n for r in AsMultigraph("m").now(tr).collect()} == edges
    got = {r.rc: r for r in UpdateCounts("u").by_collector(tr).collect()}
    for rc in ("rc0", "rc1"):
        assert got[rc].n_withdrawals_ipv4 == counts[rc, "W", 4] and got[rc].n_announcements_ipv6 == counts[rc, "A", 6]
    for label in (-1, 3, 14):
        part = fold(rib, [u for u in upd if u[1] <= label])
        assert {tuple(r.path): r.n for r in PathCounts("p").at(tr, [-1, 3, 14]).filter(F.col("snap") == label).collect()} == part[1]


def test_known_totals(spark):
    f, g = Feed(spark, "/root/testdata/sf0.001"), AsGraph("g")
    tr = f.transitions.cache()
    for label, e4, e6, uniq, total in ((-1, 1103, 496, 1336, 1363), (59, 1154, 508, 1344, 1366), (119, 1180, 505, 1344, 1369)):
        edges = Counter(r.fam for r in g.now(tr, label).collect())
        counts = [r.n for r in PathCounts("p").now(tr, label).collect()]
        assert (edges[4], edges[6], len(counts), sum(counts)) == (e4, e6, uniq, total)
    assert replay.rib_at(f.log, 59).count() == 794


def test_time_and_stops(spark):
    t = lambda h, m, s=0, us=0: datetime(2020, 1, 1, h, m, s, us)
    row = lambda rc, label, n, ts: (rc, label, n, ts, "W", 6, "p", 1, "10.0.0.0/8", None)
    upd = spark.createDataFrame([row("a", 0, 1, t(0, 0)), row("a", 0, 2, t(1, 0, 1)), row("a", 0, 3, t(1, 0, 1, 1)), row("a", 0, 4, t(0, 30)), row("a", 1, 1, t(0, 40)), row("b", 1, 1, t(2, 0)), row("b", 2, 1, t(0, 50))], UPD)
    assert replay.clipped(upd, t(0, 0), t(1, 0)).count() == 5
    assert sorted((r.rc, r.file_label, r.line_no) for r in replay.stopped(upd, t(1, 0)).collect()) == [("a", 0, 1), ("a", 0, 2), ("a", 1, 1), ("b", 2, 1)]
    seeded = spark.createDataFrame([("a",), ("b",)], "rc string")
    assert replay.cut_label(upd, seeded, t(1, 0)).first()[0] == 1
    assert replay.until_cut(upd, seeded, t(1, 0)).count() == 6
    assert replay.cut_label(upd, spark.createDataFrame([("a",), ("c",)], "rc string"), t(1, 0)).first()[0] is None


def test_rib_diff_is_over_shared_peers(spark):
    table = lambda rows: spark.createDataFrame(rows, "rc string, peer_ip string, pfx string, path array<bigint>")
    mine = table([("a", "p", "x", [1, 2]), ("a", "p", "y", [1, 2]), ("a", "q", "x", [1, 2])])
    truth = table([("a", "p", "x", [1, 3]), ("a", "p", "z", [1, 2]), ("a", "new", "x", [1, 2])])
    known = spark.createDataFrame([("a", "p"), ("a", "q")], "rc string, peer_ip string")
    assert sorted((r.pfx, r.status) for r in compare.rib_diff(mine, truth, known).collect()) == [("x", "modified"), ("y", "removed"), ("z", "added")]
    assert [tuple(r) for r in compare.rib_diff_summary(mine, truth, known).collect()] == [("a", "p", 2, 1, 1, 1, 50.0, 50.0, 50.0)]


def test_multigraph_degrees(spark):
    g = lambda rows: spark.createDataFrame(rows, "fam int, u bigint, v bigint, rc string, peer_ip string, n bigint")
    loop = g([(4, 1, 1, "a", "p", 1), (4, 1, 2, "a", "p", 1)])
    assert {(r.node, r.degree) for r in compare.degrees(loop).collect()} == {(1, 3), (2, 1)}
    assert compare.multigraph_equal(loop, loop).first().same and not compare.multigraph_equal(loop, g([(4, 1, 2, "a", "p", 1)])).first().same
