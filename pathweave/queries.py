"""The registered queries over the adapter feeds, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import archive, paths
from .observers import AsGraph, AsMultigraph, PathCounts, UpdateCounts, replay_with
from .observers.paths import length_histogram
from .operators import compare, replay
from .operators.snapshots import path_deltas
from .plans import window
from .sinks import graph_lines
from .sources.adapter import RIB_SQL, SEED_LABEL, UPD_SQL, feeds

#: Labels of snapshots, the last label, and an earlier one that stands for a reconstruction that stopped too soon.
LABELS, LAST, EARLIER = (-1, 19, 39, 59, 79, 99, 119), 119, 59
#: The window and the peers of the filter queries.
START, END, PEERS, ASNS = "2024-01-05 00:00:00", "2024-01-20 00:00:00", ("192.0.2.1", "192.0.2.4", "192.0.2.10"), (64502, 64505)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_RIB, _UPD = RIB_SQL.format(orders="orders"), UPD_SQL.format(events="events")


def _path(asn: str = "peer_asn") -> str:
    hops = "list_transform(list_filter(string_split(as_path, ' '), lambda x, i: i = 1 OR x <> string_split(as_path, ' ')[i - 1]), lambda x: CAST(x AS BIGINT))"
    return f"CASE WHEN regexp_full_match(as_path, '[0-9]+( [0-9]+)*') AND len({hops}) > 1 AND {hops}[1] = {asn} THEN {hops} END"


_FAM = "CASE WHEN contains(pfx, '.') THEN 4 WHEN contains(pfx, ':') THEN 6 ELSE 0 END"
_TEXT = "array_to_string({}, ' ')"
WITH = f"""WITH rib_raw AS ({_RIB}), upd_raw AS ({_UPD}),
rp AS (SELECT *, {_FAM} AS fam, {_path()} AS path FROM rib_raw),
known AS (SELECT DISTINCT rc, peer_ip FROM rp WHERE path IS NOT NULL),
up AS (SELECT u.*, {_FAM} AS fam, CASE WHEN typ = 'A' THEN {_path()} END AS path FROM upd_raw u SEMI JOIN known USING (rc, peer_ip) WHERE nf = 6 AND typ = 'W' OR nf = 15 AND typ = 'A'),
ev AS (SELECT rc, peer_ip, pfx, fam, {SEED_LABEL} AS file_label, line_no, 'B' AS src, path FROM rp WHERE path IS NOT NULL
  UNION ALL SELECT rc, peer_ip, pfx, fam, file_label, line_no, typ, path FROM up),
lg AS (SELECT *, lag(path) OVER (PARTITION BY rc, peer_ip, pfx ORDER BY file_label, line_no) AS prev FROM ev),
al AS (SELECT *, CASE WHEN src = 'B' THEN 'B' WHEN path IS NOT NULL THEN 'A' WHEN prev IS NOT NULL THEN 'W' END AS kind FROM lg),
tr AS (SELECT * FROM al WHERE kind IS NOT NULL),
pd AS (SELECT rc, peer_ip, fam, file_label, path, 1 AS d FROM tr WHERE kind <> 'W' AND fam <> 0
  UNION ALL SELECT rc, peer_ip, fam, file_label, prev, -1 FROM tr WHERE kind <> 'B' AND prev IS NOT NULL AND fam <> 0),
ed AS (SELECT rc, peer_ip, fam, file_label, d, least(path[i], path[i + 1]) AS u, greatest(path[i], path[i + 1]) AS v FROM (SELECT *, unnest(range(1, len(path))) AS i FROM pd)),
labels AS (SELECT unnest([{", ".join(map(str, LABELS))}]) AS snap),
"""


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else WITH.rstrip().rstrip(",") + "\n" + sql
        return f

    return register


def _multi(upto: int | None = None, peer: str | None = None) -> str:
    where = "" if upto is None else f"WHERE file_label <= {upto}"
    where += "" if peer is None else f" AND peer_ip = '{peer}'"
    return f"SELECT fam, u, v, rc, peer_ip, CAST(sum(d) AS BIGINT) AS n FROM ed {where} GROUP BY ALL HAVING sum(d) > 0"


def _rib(upto: int) -> str:
    return f"SELECT rc, peer_ip, pfx, path FROM (SELECT *, row_number() OVER (PARTITION BY rc, peer_ip, pfx ORDER BY file_label DESC, line_no DESC) AS k FROM ev WHERE file_label <= {upto}) WHERE k = 1 AND path IS NOT NULL"


class Feed:
    """The tables of the adapter feeds, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.rib_raw, self.upd_raw = feeds(spark, sf_dir)
        self.parsed = replay.parsed_rib(self.rib_raw)
        self.known = replay.known_peers(self.parsed)
        self.log = replay.events(self.parsed, replay.parsed_updates(self.upd_raw, self.known), F.lit(SEED_LABEL))
        self.transitions = replay.transitions(self.log)


def text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), paths.path_text(F.col(c))) for c in names})


@query(f"SELECT line_no, as_path, array_to_string(list_filter(string_split(as_path, ' '), lambda x, i: i = 1 OR x <> string_split(as_path, ' ')[i - 1]), ' ') AS collapsed FROM rib_raw")
def parse_collapse_prepending(spark, d):
    return feeds(spark, d)[0].select("line_no", "as_path", F.array_join(paths.collapsed(F.col("as_path")), " ").alias("collapsed"))


@query("SELECT line_no, array_to_string(path, ' ') AS path, path IS NOT NULL AS valid FROM rp")
def parse_path_validity(spark, d):
    return text(Feed(spark, d).parsed, "path").select("line_no", "path", F.col("path").isNotNull().alias("valid"))


@query("SELECT fam, count(*) AS n FROM rp GROUP BY fam")
def prefix_family(spark, d):
    return feeds(spark, d)[0].groupBy(paths.family(F.col("pfx")).alias("fam")).agg(F.count("*").alias("n"))


@query("SELECT rc, peer_ip, pfx, array_to_string(path, ' ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY rc, peer_ip, pfx ORDER BY line_no DESC) AS k FROM rp WHERE path IS NOT NULL) WHERE k = 1")
def rib_build_state(spark, d):
    return text(replay.rib_state(Feed(spark, d).parsed), "path")


@query("SELECT rc, count(*) AS entries, count(*) FILTER (path IS NULL) AS invalid_entries, round(100.0 * count(*) FILTER (path IS NULL) / count(*), 2) AS invalid_pct FROM rp GROUP BY rc")
def rib_build_stats(spark, d):
    return replay.build_stats(feeds(spark, d)[0])


@query("SELECT * FROM known")
def known_peers(spark, d):
    return Feed(spark, d).known


@query(f"SELECT rc, peer_ip, count(*) AS n FROM upd_raw WHERE peer_ip IN {PEERS} GROUP BY ALL")
def peer_ip_filter(spark, d):
    return replay.of_peers(feeds(spark, d)[1], PEERS).groupBy("rc", "peer_ip").agg(F.count("*").alias("n"))


@query(f"SELECT rc, peer_asn, count(*) AS n FROM rib_raw WHERE peer_asn IN {ASNS} GROUP BY ALL")
def peer_asn_filter(spark, d):
    return replay.of_peers(feeds(spark, d)[0], peer_asns=ASNS).groupBy("rc", "peer_asn").agg(F.count("*").alias("n"))


@query("SELECT typ, nf, count(*) AS n FROM upd_raw WHERE nf = 6 AND typ = 'W' OR nf = 15 AND typ = 'A' GROUP BY ALL")
def record_type_filter(spark, d):
    return feeds(spark, d)[1].filter(replay.is_update()).groupBy("typ", "nf").agg(F.count("*").alias("n"))


def _time(s: str):
    return pd.Timestamp(s).to_pydatetime()


@query(f"SELECT file_label, count(*) AS n FROM upd_raw WHERE ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}' + INTERVAL 1 SECOND GROUP BY ALL")
def time_clip(spark, d):
    return replay.clipped(feeds(spark, d)[1], _time(START), _time(END)).groupBy("file_label").agg(F.count("*").alias("n"))


@query(
    f"""SELECT rc, file_label, count(*) AS n FROM (SELECT *, min(line_no) FILTER (ts > TIMESTAMP '{END}' + INTERVAL 1 SECOND) OVER (PARTITION BY rc, file_label) AS stop FROM upd_raw)
WHERE stop IS NULL OR line_no < stop GROUP BY ALL"""
)
def prefix_stop(spark, d):
    return replay.stopped(feeds(spark, d)[1], _time(END)).groupBy("rc", "file_label").agg(F.count("*").alias("n"))


@query(
    f"""SELECT max(file_label) AS last_label, count(*) AS n FROM upd_raw WHERE file_label <= (
  SELECT CASE WHEN bool_and(first_past IS NOT NULL) THEN max(first_past) ELSE 999 END FROM (SELECT DISTINCT rc FROM known) LEFT JOIN (SELECT rc, min(file_label) AS first_past FROM upd_raw WHERE ts > TIMESTAMP '{END}' + INTERVAL 1 SECOND GROUP BY rc) USING (rc))"""
)
def global_stop(spark, d):
    f = Feed(spark, d)
    return replay.until_cut(f.upd_raw, f.known, _time(END)).agg(F.max("file_label").alias("last_label"), F.count("*").alias("n"))


@query("SELECT rc, peer_ip, pfx, fam, file_label, line_no, array_to_string(path, ' ') AS path, array_to_string(prev, ' ') AS prev, kind FROM tr")
def transitions(spark, d):
    return text(Feed(spark, d).transitions, "path", "prev")


@query("SELECT rc, peer_ip, pfx, file_label, line_no, array_to_string(prev, ' ') AS prev FROM tr WHERE kind = 'W' AND src = 'A'")
def implicit_withdrawals(spark, d):
    rows = replay.with_previous(Feed(spark, d).log).filter("kind = 'W' AND src = 'A'")
    return text(rows, "prev").select("rc", "peer_ip", "pfx", "file_label", "line_no", "prev")


@query("SELECT rc, src, count(*) AS n FROM al WHERE kind IS NULL GROUP BY ALL")
def noop_updates(spark, d):
    return replay.with_previous(Feed(spark, d).log).filter("kind IS NULL").groupBy("rc", "src").agg(F.count("*").alias("n"))


@query("SELECT rc, peer_ip, count(*) AS n FROM tr WHERE kind = 'A' AND path = prev GROUP BY ALL")
def duplicate_announcements(spark, d):
    return Feed(spark, d).transitions.filter("kind = 'A' AND path = prev").groupBy("rc", "peer_ip").agg(F.count("*").alias("n"))


@query(f"SELECT rc, peer_ip, pfx, array_to_string(path, ' ') AS path FROM ({_rib(LAST)})")
def rib_snapshot_end(spark, d):
    return text(replay.rib_at(Feed(spark, d).log, LAST), "path")


_LIVE = """SELECT snap, CAST(sum(CASE WHEN kind <> 'W' AND prev IS NULL THEN 1 WHEN kind = 'W' THEN -1 ELSE 0 END) AS BIGINT) AS n
FROM tr JOIN labels ON file_label <= snap GROUP BY snap"""


@query(_LIVE)
def rib_size_by_label(spark, d):
    live = F.when((F.col("kind") != "W") & F.col("prev").isNull(), 1).when(F.col("kind") == "W", -1).otherwise(0)
    from .operators.snapshots import totals_at

    return totals_at(Feed(spark, d).transitions.select("file_label", live.alias("d"), F.lit(1).alias("all")), ["all"], LABELS).select("snap", "n")


_COUNTS = """count(*) AS n_updates, count(*) FILTER (kind = 'W' AND fam = 4) AS n_withdrawals_ipv4, count(*) FILTER (kind = 'W' AND fam = 6) AS n_withdrawals_ipv6,
 count(*) FILTER (kind = 'A' AND fam = 4) AS n_announcements_ipv4, count(*) FILTER (kind = 'A' AND fam = 6) AS n_announcements_ipv6"""


@query(f"SELECT rc, {_COUNTS} FROM tr WHERE kind <> 'B' AND fam <> 0 GROUP BY rc")
def updates_by_collector(spark, d):
    return UpdateCounts("update_count").by_collector(Feed(spark, d).transitions)


@query("SELECT rc, peer_ip, count(*) AS n_updates FROM tr WHERE kind <> 'B' AND fam <> 0 GROUP BY ALL")
def updates_by_peer(spark, d):
    return UpdateCounts("update_count").by_peer(Feed(spark, d).transitions)


@query(f"SELECT snap, rc, peer_ip, {_COUNTS} FROM tr JOIN labels ON file_label <= snap WHERE kind <> 'B' AND fam <> 0 GROUP BY ALL")
def updates_by_label(spark, d):
    return UpdateCounts("update_count").at(Feed(spark, d).transitions, LABELS)


_PATHS = "SELECT path, CAST(sum(d) AS BIGINT) AS n FROM pd GROUP BY path HAVING sum(d) > 0"


@query(f"SELECT array_to_string(path, ' ') AS path, n FROM ({_PATHS})")
def path_counts(spark, d):
    return text(PathCounts("path").now(Feed(spark, d).transitions), "path")


@query(f"SELECT count(*) AS n_unique_paths, CAST(sum(n) AS BIGINT) AS n_paths FROM ({_PATHS})")
def path_unique(spark, d):
    return PathCounts("path").now(Feed(spark, d).transitions).agg(F.count("*").alias("n_unique_paths"), F.sum("n").alias("n_paths"))


@query(f"SELECT CAST(len(path) AS BIGINT) AS path_length, count(*) AS n_paths FROM ({_PATHS}) GROUP BY ALL")
def path_length_hist(spark, d):
    return length_histogram(PathCounts("path").now(Feed(spark, d).transitions))


@query("SELECT snap, count(*) AS n_unique_paths, CAST(sum(n) AS BIGINT) AS n_paths FROM (SELECT snap, path, sum(d) AS n FROM pd JOIN labels ON file_label <= snap GROUP BY ALL HAVING sum(d) > 0) GROUP BY snap")
def path_counts_by_label(spark, d):
    return PathCounts("path").at(Feed(spark, d).transitions, LABELS).groupBy("snap").agg(F.count("*").alias("n_unique_paths"), F.sum("n").alias("n_paths"))


@query("SELECT line_no, least(path[i], path[i + 1]) AS u, greatest(path[i], path[i + 1]) AS v FROM (SELECT *, unnest(range(1, len(path))) AS i FROM rp WHERE path IS NOT NULL)")
def path_adjacency(spark, d):
    return replay.seed(Feed(spark, d).parsed).select("line_no", F.inline(paths.adjacencies(F.col("path"))))


@query(_multi())
def as_multigraph(spark, d):
    return AsMultigraph("multigraph").now(Feed(spark, d).transitions)


_GRAPH = f"SELECT fam, u, v, CAST(sum(n) AS BIGINT) AS paths_count, count(*) AS peers_count, sum(n) / count(*) AS mean_paths FROM ({_multi()}) GROUP BY ALL"


@query(f"SELECT * FROM ({_GRAPH}) WHERE fam = 4")
def as_graph_v4(spark, d):
    return AsGraph("graph").now(Feed(spark, d).transitions).filter("fam = 4")


@query(f"SELECT * FROM ({_GRAPH}) WHERE fam = 6")
def as_graph_v6(spark, d):
    return AsGraph("graph").now(Feed(spark, d).transitions).filter("fam = 6")


@query(
    """SELECT snap, fam, u, v, CAST(sum(n) AS BIGINT) AS paths_count, count(*) AS peers_count, sum(n) / count(*) AS mean_paths
FROM (SELECT snap, fam, u, v, rc, peer_ip, sum(d) AS n FROM ed JOIN labels ON file_label <= snap GROUP BY ALL HAVING sum(d) > 0) GROUP BY ALL"""
)
def as_graph_by_label(spark, d):
    return AsGraph("graph").at(Feed(spark, d).transitions, LABELS)


@query(f"SELECT fam, node, count(*) AS degree FROM (SELECT fam, unnest([u, v]) AS node FROM ({_multi()})) GROUP BY ALL")
def as_node_degree(spark, d):
    return compare.degrees(AsMultigraph("multigraph").now(Feed(spark, d).transitions))


def _tables(spark, d):
    f = Feed(spark, d)
    return replay.rib_at(f.log, EARLIER), replay.rib_at(f.log, LAST), f.known


_DIFF = f"""SELECT rc, peer_ip, pfx, CASE WHEN m.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'removed' ELSE 'modified' END AS status, m.path AS mine, t.path AS truth
FROM (SELECT * FROM ({_rib(EARLIER)}) SEMI JOIN ({_rib(LAST)}) USING (rc, peer_ip)) m FULL JOIN (SELECT * FROM ({_rib(LAST)}) SEMI JOIN known USING (rc, peer_ip)) t USING (rc, peer_ip, pfx)
WHERE m.path IS DISTINCT FROM t.path"""


@query(f"SELECT rc, peer_ip, pfx, status, array_to_string(mine, ' ') AS mine, array_to_string(truth, ' ') AS truth FROM ({_DIFF})")
def rib_diff(spark, d):
    return text(compare.rib_diff(*_tables(spark, d)), "mine", "truth")


_KINDS = ("added", "removed", "modified")


@query(
    f"""SELECT rc, peer_ip, truth_size, {", ".join(f"coalesce({k}, 0) AS {k}, round(100.0 * coalesce({k}, 0) / truth_size, 2) AS {k}_pct" for k in _KINDS)}
FROM (SELECT rc, peer_ip, count(*) AS truth_size FROM ({_rib(LAST)}) SEMI JOIN known USING (rc, peer_ip) GROUP BY ALL)
LEFT JOIN (SELECT rc, peer_ip, {", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in _KINDS)} FROM ({_DIFF}) GROUP BY ALL) USING (rc, peer_ip)"""
)
def rib_diff_summary(spark, d):
    return compare.rib_diff_summary(*_tables(spark, d))


def _graphs(spark, d):
    f, g = Feed(spark, d), AsGraph("graph")
    return g.now(f.transitions, EARLIER), g.now(f.transitions, LAST)


def _edges(upto: int) -> str:
    return f"SELECT fam, u, v, CAST(sum(n) AS BIGINT) AS n FROM ({_multi(upto)}) GROUP BY ALL"


def _nodes(upto: int, peer: str | None = None) -> str:
    return f"SELECT DISTINCT fam, unnest([u, v]) AS node FROM ({_multi(upto, peer)})"


@query(
    f"""SELECT fam, u, v, CASE WHEN m.n IS NULL THEN 'added' WHEN t.n IS NULL THEN 'removed' ELSE 'modified' END AS status, m.n AS mine, t.n AS truth
FROM ({_edges(EARLIER)}) m FULL JOIN ({_edges(LAST)}) t USING (fam, u, v) WHERE m.n IS DISTINCT FROM t.n"""
)
def graph_diff_edges(spark, d):
    return AsGraph("graph").compare(*_graphs(spark, d))


_OF_ONE = _nodes(-1, PEERS[0])


@query(f"SELECT fam, node, 'added' AS status FROM ({_nodes(LAST)} EXCEPT {_OF_ONE}) UNION ALL SELECT fam, node, 'removed' FROM ({_OF_ONE} EXCEPT {_nodes(LAST)})")
def graph_diff_nodes(spark, d):
    """The graph of one peer's dump against that of all at the end."""
    f, g = Feed(spark, d), AsGraph("graph")
    return compare.node_diff(g.now(f.transitions.filter(F.col("peer_ip") == PEERS[0]), -1), g.now(f.transitions, LAST))


@query(
    f"""SELECT fam, count(*) FILTER (differs) AS differences, count(*) FILTER (differs) = 0 AS same FROM (
  SELECT fam, m.n IS DISTINCT FROM t.n AS differs FROM ({_edges(EARLIER)}) m FULL JOIN ({_edges(LAST)}) t USING (fam, u, v)
  UNION ALL SELECT fam, true FROM ({_nodes(LAST)} EXCEPT {_nodes(EARLIER)}) UNION ALL SELECT fam, true FROM ({_nodes(EARLIER)} EXCEPT {_nodes(LAST)})) GROUP BY fam"""
)
def graph_check(spark, d):
    return compare.graph_check(*(g.withColumnRenamed("paths_count", "n") for g in _graphs(spark, d)))


def _degrees(upto: int) -> str:
    return f"SELECT fam, node, count(*) AS degree FROM (SELECT fam, unnest([u, v]) AS node FROM ({_multi(upto)})) GROUP BY ALL"


@query(f"SELECT fam, bool_and(a.degree IS NOT DISTINCT FROM b.degree) AS same FROM ({_degrees(EARLIER)}) a FULL JOIN ({_degrees(LAST)}) b USING (fam, node) GROUP BY fam")
def multigraph_equal(spark, d):
    f, g = Feed(spark, d), AsMultigraph("multigraph")
    return compare.multigraph_equal(g.now(f.transitions, EARLIER), g.now(f.transitions, LAST))


def _requests(spark, d) -> DataFrame:
    """Collector, kind and time of a file for each order."""
    rc = F.element_at(F.array(*[F.lit(x) for x in ("rrc00", "rrc21", "route-views2", "route-views.sydney")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", rc.alias("rc"), F.when(F.col("o_custkey") % 2 == 0, "rib").otherwise("update").alias("kind"), (F.col("o_orderdate") + F.expr("INTERVAL 5 MINUTES") * (F.col("o_orderkey") % 288).cast("int")).alias("ts"))


_REQUESTS = """SELECT o_orderkey, ['rrc00', 'rrc21', 'route-views2', 'route-views.sydney'][o_orderkey % 4 + 1] AS rc, CASE WHEN o_custkey % 2 = 0 THEN 'rib' ELSE 'update' END AS kind,
 o_orderdate + INTERVAL 5 MINUTE * (o_orderkey % 288) AS ts FROM orders"""
_URLS = f"""SELECT o_orderkey, CASE WHEN rc LIKE 'rrc%' THEN 'https://data.ris.ripe.net/' || rc || '/' || strftime(ts, '%Y.%m') || '/' || CASE kind WHEN 'rib' THEN 'bview' ELSE 'updates' END || strftime(ts, '.%Y%m%d.%H%M') || '.gz'
 ELSE 'https://routeviews.org/' || CASE rc WHEN 'route-views2' THEN '' ELSE rc || '/' END || 'bgpdata/' || strftime(ts, '%Y.%m') || CASE kind WHEN 'rib' THEN '/RIBS/rib' ELSE '/UPDATES/updates' END || strftime(ts, '.%Y%m%d.%H%M') || '.bz2' END AS url,
 rc, kind, ts FROM ({_REQUESTS})"""
_NAMES = f"SELECT o_orderkey, rc || '.' || kind || strftime(ts, '.%Y%m%d.%H%M') || CASE WHEN rc LIKE 'rrc%' THEN '.gz' ELSE '.bz2' END AS filename, rc FROM ({_URLS})"


@query(f"WITH u AS ({_URLS}) SELECT o_orderkey, url FROM u")
def archive_urls(spark, d):
    return _requests(spark, d).select("o_orderkey", archive.url_column(F.col("rc"), F.col("ts"), F.col("kind")).alias("url"))


@query(f"WITH n AS ({_NAMES}) SELECT o_orderkey, filename FROM n")
def url_to_filename(spark, d):
    return archive_urls(spark, d).select("o_orderkey", archive.filename_column(F.col("url")).alias("filename"))


@query(f"WITH n AS ({_NAMES}) SELECT o_orderkey, rc FROM n")
def filename_to_rc(spark, d):
    return url_to_filename(spark, d).select("o_orderkey", archive.collector_column(F.col("filename")).alias("rc"))


def _near(first: str, step: str, n: int) -> str:
    return f"""WITH r AS ({_REQUESTS}), c AS (SELECT o_orderkey, ts, {first} + INTERVAL {step} * i AS cand FROM r, range({n}) t(i))
SELECT o_orderkey, ts, arg_min(cand, abs(epoch_us(cand) - epoch_us(ts)) * 1000 + i) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY cand) AS i FROM c) GROUP BY ALL"""


@query(_near("date_trunc('day', ts) - INTERVAL 1 DAY", "8 HOUR", 10))
def nearest_rib(spark, d):
    return _requests(spark, d).select("o_orderkey", "ts", window.nearest_rib(F.col("ts"), True).alias("nearest"))


@query(_near("date_trunc('hour', ts) - INTERVAL 1 HOUR", "15 MINUTE", 10))
def nearest_update(spark, d):
    return _requests(spark, d).select("o_orderkey", "ts", window.nearest_update(F.col("ts")).alias("nearest"))


@query(_near("date_trunc('day', ts) - INTERVAL 1 DAY", "2 HOUR", 50))
def nearest_rib_of_two_hours(spark, d):
    return _requests(spark, d).select("o_orderkey", "ts", window.nearest_rib(F.col("ts"), False).alias("nearest"))


def _windows(spark, d) -> DataFrame:
    """A window of two hours for each date of orders."""
    begins = F.col("o_orderdate").cast("timestamp_ntz")
    return spark.read.parquet(f"{d}/orders.parquet").select(begins.alias("begins"), (begins + F.expr("INTERVAL 2 HOURS")).alias("ends")).distinct()


_BEGINS = "WITH w AS (SELECT DISTINCT o_orderdate AS begins FROM orders)"


@query(
    f"""{_BEGINS} SELECT begins, 'RIS' AS project, begins + INTERVAL 5 MINUTE * i AS tick FROM w, range(-1, 27) r(i)
 UNION ALL SELECT begins, 'RV', begins + INTERVAL 15 MINUTE * i FROM w, range(-1, 11) r(i)"""
)
def update_ticks(spark, d):
    ticks = [F.struct(F.lit(p).alias("project"), window.ticks_column(F.col("begins"), F.col("ends"), s).alias("ticks")) for p, s in (("RIS", 300), ("RV", 900))]
    return _windows(spark, d).select("begins", F.explode(F.array(*ticks)).alias("p")).select("begins", "p.project", F.explode("p.ticks").alias("tick"))


@query(f"{_BEGINS} SELECT begins, begins + INTERVAL 15 MINUTE * i AS label FROM w, range(1, 9) r(i)")
def dump_labels(spark, d):
    return _windows(spark, d).select("begins", F.explode(window.labels_column(F.col("begins"), F.col("ends"), 900)).alias("label"))


@query(f"SELECT fam, CAST(u AS VARCHAR) || ',' || CAST(v AS VARCHAR) || ',' || CAST(mean_paths AS VARCHAR) || ',' || CAST(peers_count AS VARCHAR) AS line FROM ({_GRAPH})")
def graph_csv_rows(spark, d):
    edges = AsGraph("graph").now(Feed(spark, d).transitions)
    return graph_lines(edges.filter("fam = 4")).select(F.lit(4).alias("fam"), "line").union(graph_lines(edges.filter("fam = 6")).select(F.lit(6), "line"))


@query(f"SELECT '(' || array_to_string(path, ', ') || ')' AS key, n FROM ({_PATHS})")
def path_json_rows(spark, d):
    o = PathCounts("path")
    return o.lines(o.now(Feed(spark, d).transitions))


@query(
    """SELECT rc, peer_ip, pfx, count(*) FILTER (before <> hop) AS changes
FROM (SELECT *, path[2] AS hop, lag(path[2]) OVER (PARTITION BY rc, peer_ip, pfx ORDER BY file_label, line_no) AS before FROM tr) GROUP BY ALL"""
)
def custom_observer_replay(spark, d):
    """An observer in Python: how often each key changed its first hop after the peer."""

    def step(g: pd.DataFrame) -> pd.DataFrame:
        hops = [None if p is None else p[1] for p in g["path"]]
        changes = sum(a is not None and b is not None and a != b for a, b in zip(hops, hops[1:]))
        return pd.DataFrame({"rc": g["rc"].iloc[:1], "peer_ip": g["peer_ip"].iloc[:1], "pfx": g["pfx"].iloc[:1], "changes": [changes]})

    return replay_with(Feed(spark, d).transitions, step, "rc string, peer_ip string, pfx string, changes bigint")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The AS graph of both families at the last label."""
    return AsGraph("graph").now(Feed(spark, d).transitions, LAST)
