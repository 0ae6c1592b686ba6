"""File planning, reading decoded files and whole runs."""

import bz2
import dataclasses
import gzip
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathweave.config import CollectionConfig
from pathweave.functions import archive
from pathweave.observers import AsGraph
from pathweave.plans import window
from pathweave.plans.run import default_observers, from_files
from pathweave.sinks import write_graph
from pathweave.sources import landing, lines
from pathweave.streaming.replay import transitions_stream

T = datetime(2010, 9, 1)


def test_addresses():
    assert archive.url("rrc00", T, "rib") == "https://data.ris.ripe.net/rrc00/2010.09/bview.20100901.0000.gz"
    assert archive.url("route-views.wide", T, "update") == "https://routeviews.org/route-views.wide/bgpdata/2010.09/UPDATES/updates.20100901.0000.bz2"
    assert archive.url("route-views2", T, "rib") == "https://routeviews.org/bgpdata/2010.09/RIBS/rib.20100901.0000.bz2"
    with pytest.raises(ValueError):
        archive.url("x", T, "rib")
    with pytest.raises(ValueError):
        archive.url("rrc00", T, "other")


def test_nearest_and_ties():
    assert window.nearest(window.rib_times(datetime(2020, 3, 1, 4), ["RIS"]), datetime(2020, 3, 1, 4)) == datetime(2020, 3, 1, 0)
    assert window.nearest(window.rib_times(datetime(2020, 3, 1, 1), ["RV"]), datetime(2020, 3, 1, 1)) == datetime(2020, 3, 1, 0)
    assert window.nearest(window.update_times(datetime(2020, 3, 1, 1, 7, 30)), datetime(2020, 3, 1, 1, 7, 30)) == datetime(2020, 3, 1, 1, 0)
    assert window.has_truth(datetime(2020, 1, 1, 8), ["RIS", "RV"]) and not window.has_truth(datetime(2020, 1, 1, 2), ["RIS", "RV"]) and window.has_truth(datetime(2020, 1, 1, 2), ["RV"])


def test_plan():
    p = window.plan(CollectionConfig())
    assert (p.start, p.end, p.compare, len(p.files), len(p.labels)) == (T, datetime(2010, 9, 1, 2), True, 2 * (2 + 12), 8)
    mixed = window.plan(CollectionConfig(collectors=("rrc00", "route-views2"), date_range="20100831.2300,20100901.0100"))
    assert mixed.start == T and not mixed.compare
    assert not window.plan(CollectionConfig(collectors=("x.route-views",))).files
    with pytest.raises(ValueError):
        CollectionConfig(collectors=("nothing",))


def test_landing(tmp_path):
    import io

    got = landing.land(["https://h/a", "https://h/b"], str(tmp_path), opener=lambda u: io.BytesIO(u.encode()))
    again = landing.land(["https://h/a"], str(tmp_path), opener=None)
    assert again[0].cached and not got[0].cached and landing.statistics(again)["cached_gb"] == 11 / 1e9

    def missing(u):
        raise OSError

    with pytest.raises(RuntimeError):
        landing.land(["https://h/c"], str(tmp_path), opener=missing)
    assert landing.land(["https://h/c"], str(tmp_path), opener=missing, strict=False) == []


def rib_line(peer, asn, pfx, path):
    return f"TABLE_DUMP2|1283299200|B|{peer}|{asn}|{pfx}|{path}|IGP|192.0.2.1|0|0||NAG||"


def test_line_numbers_and_bad_lines(spark, tmp_path):
    a, b = tmp_path / "a.gz", tmp_path / "b.txt"
    with gzip.open(a, "wt") as f:
        f.writelines(f"x|{k}.5|W|p|1|10.0.0.0/8\n" for k in range(500))
    b.write_text("x|zz|W|p|1|10.0.0.0/8\nshort|1\nx|1|A|p|q|10.0.0.0/8|1 2|IGP|n|0|0||NAG||\nx|1|W|p|1|10.0.0.0/8\n")
    rows = lines.update_rows(lines.read_lines(spark, [(str(a), "r1", 0), (str(b), "r2", 1)]))
    assert [r.ts.second for r in lines.good(rows).filter("rc = 'r1'").orderBy("line_no").collect()] == [k % 60 for k in range(500)]
    assert {(r.rc, r.bad, r["lines"]) for r in lines.bad_counts(rows).collect()} == {("r1", 0, 500), ("r2", 3, 4)}
    with pytest.raises(Exception, match="malformed"):
        lines.good(rows, strict=True).collect()


def test_whole_run(spark, tmp_path):
    config = CollectionConfig("20100901.0000,20100901.0200", ("route-views.wide",), "run", str(tmp_path / "out"), 3600)
    where = lambda url: str(tmp_path / url.rsplit("/", 1)[-1].replace(".bz2", ".txt"))
    for ts, _, kind, url in window.plan(config).files:
        if kind == "rib":
            rows = [rib_line("p", 1, "10.0.0.0/8", "1 1 2 3" if ts == T else "1 3"), rib_line("p", 1, "2001:db8::/32", "1 2")]
        else:
            at = ts.timestamp() - datetime(1970, 1, 1).timestamp()
            rows = [f"BGP4MP|{at + 1}|A|p|1|10.0.0.0/8|1 3|IGP|n|0|0||NAG||"] if ts == datetime(2010, 9, 1, 1) else [f"BGP4MP|{at}|STATE|p|1|6|1"]
        open(where(url), "w").write("\n".join(rows) + "\n")
    run = from_files(spark, config, where, feed=str(tmp_path / "feed"))
    run.write(default_observers())
    assert all(r.present for r in run.coverage.collect()) and {(r.kind, r.bad) for r in run.bad_lines.collect()} == {("rib", 0), ("update", 0)}
    out = tmp_path / "out/processed/run"
    assert (out / "graph_ipv4.20100901.0000.csv").read_text() == "#origin,destination,paths_count,peers_count\n1,2,1.0,1\n2,3,1.0,1\n"
    assert (out / "graph_ipv4.20100901.0100.csv").read_text() == "#origin,destination,paths_count,peers_count\n1,3,1.0,1\n"
    assert json.loads((out / "path.20100901.0000.json").read_text()) == {"n_unique_paths": 2, "paths_length_count": {"2": 1, "3": 1}, "paths_count": {"(1, 2)": 1, "(1, 2, 3)": 1}}
    counts = json.loads((out / "update_count.20100901.0200.json").read_text())
    assert counts["n_announcements_ipv4"] == {"route-views.wide": 1} and counts["n_updates_per_peer"] == {"route-views.wide": {"p": 1}} and counts["n_withdrawals_ipv4"] == {}
    assert json.loads((out / "update_count.20100901.0000.json").read_text())["n_updates"] == {}
    found = run.verify(default_observers())
    assert found["view_graph"].count() == 0
    assert found["rib"].count() == 0 and all(r.same for r in found["graph"].collect()) and found["edges"].count() == 0


def test_missing_files_and_bad_lines_of_a_run(spark, tmp_path):
    config = CollectionConfig("20100901.0000,20100901.0200", ("route-views.wide",), "run", str(tmp_path / "out"), 3600)
    where = lambda url: str(tmp_path / url.rsplit("/", 1)[-1])
    files = window.plan(config).files
    for _, _, kind, url in files:
        if kind == "rib":
            with bz2.open(where(url), "wt") as f:
                f.write(rib_line("p", 1, "10.0.0.0/8", "1 2 3") + "\nshort|1\n")
    run = from_files(spark, config, where)
    assert run.table().count() == 1 and {(r.kind, r.bad, r["lines"]) for r in run.bad_lines.collect()} == {("rib", 1, 2)}
    assert {(r.kind, r.present) for r in run.coverage.collect()} == {("rib", True), ("update", False)}
    assert run.coverage.count() == len(files) and run.verify()["rib"].count() == 0
    with pytest.raises(FileNotFoundError):
        from_files(spark, dataclasses.replace(config, strict=True), where)


def test_labels_as_columns(spark):
    row = spark.range(1).select(F.lit(T).cast("timestamp_ntz").alias("a"), F.lit(T + timedelta(minutes=127)).cast("timestamp_ntz").alias("b"))
    got = row.select(window.ticks_column(F.col("a"), F.col("b"), 300).alias("t"), window.labels_column(F.col("a"), F.col("b"), 900).alias("l"), window.labels_column(F.col("a"), F.col("b"), 9000).alias("none")).first()
    assert (got.t, got.l, got.none) == (window.ticks(T, T + timedelta(minutes=127), 300), window.snapshot_labels(T, T + timedelta(minutes=127), 900), [])


def test_graph_without_peers(spark, tmp_path):
    edges = spark.createDataFrame([(4, 2, 3, 5), (4, 1, 2, 4)], "fam int, u bigint, v bigint, paths_count bigint")
    write_graph(edges, str(tmp_path / "g.csv"), metadata="note", peers=False)
    assert (tmp_path / "g.csv").read_text() == "#note\n#origin,destination,paths_count\n1,2,4\n2,3,5\n"


def test_stream_equals_batch(spark, tmp_path):
    from pathweave.queries import Feed

    f = Feed(spark, "/root/testdata/sf0.001")
    log = f.log.withColumn("file_label", F.col("file_label").cast("int")).cache()
    for k, part in enumerate((log.filter("file_label < 30"), log.filter("file_label >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        q = transitions_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "got"))
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "got"))
    cols = ["rc", "peer_ip", "pfx", "fam", "file_label", "line_no", "path", "prev", "kind"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, f.transitions.select(cols).collect()))
