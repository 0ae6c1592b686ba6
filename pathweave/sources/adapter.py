"""Routing feeds made from general tables: a seed table from orders, an update log from events.

They exercise parsing, replay and the views where no routing data is at hand. file_label is a number of six hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Both run unchanged in Spark and in other SQL engines; {orders} and {events} stand for the tables.
_PEER = """CASE peer % 3 WHEN 0 THEN 'rrc00' WHEN 1 THEN 'rrc01' ELSE 'route-views.sim' END AS rc,
  '192.0.2.' || CAST(peer AS STRING) AS peer_ip, CAST(64500 + peer AS BIGINT) AS peer_asn,
  CASE WHEN k % 4 = 0 THEN '2001:db8:' || CAST(k AS STRING) || '::/48' ELSE '10.' || CAST(k AS STRING) || '.0.0/16' END AS pfx"""
_FIRST = "CASE WHEN pos % 31 = 0 THEN '64999 ' ELSE '' END || CAST(64500 + peer AS STRING)"
_SET = "CASE WHEN pos % 29 = 0 THEN ' {{1,2}}' ELSE '' END"
RIB_SQL = f"""SELECT pos AS line_no, {_PEER},
  {_FIRST} || CASE WHEN pos % 37 = 0 THEN '' ELSE
    CASE WHEN pos % 5 = 0 THEN ' ' || CAST(64500 + peer AS STRING) ELSE '' END || ' ' || CAST(100 + m % 23 AS STRING)
    || CASE WHEN pos % 3 = 0 THEN ' ' || CAST(200 + m % 7 AS STRING) ELSE '' END || {_SET} || ' ' || CAST(300 + k AS STRING) END AS as_path
FROM (SELECT o_orderkey AS pos, o_custkey % 11 AS peer, (o_orderkey * 7) % 97 AS k, o_custkey AS m FROM {{orders}}) AS o"""
UPD_SQL = f"""SELECT pos AS line_no, file_label, ts, typ, nf, {_PEER},
  CASE WHEN typ = 'A' THEN {_FIRST} || ' ' || CAST(100 + m % 23 AS STRING) || {_SET} || ' ' || CAST(300 + k AS STRING) END AS as_path
FROM (SELECT event_id AS pos, ts, CAST(floor((EXTRACT(DAY FROM ts) - 1) * 4 + EXTRACT(HOUR FROM ts) / 6) AS INT) AS file_label,
  CASE event_type WHEN 'purchase' THEN 'W' WHEN 'error' THEN 'STATE' ELSE 'A' END AS typ,
  CASE event_type WHEN 'purchase' THEN 6 WHEN 'error' THEN 7 ELSE 15 END AS nf,
  user_id % 12 AS peer, (event_id * 13) % 97 AS k, event_id AS m FROM {{events}}) AS e"""
#: The seed's label, before all others.
SEED_LABEL = -1


def feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """rib_raw and upd_raw."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(RIB_SQL, orders=read("orders")), spark.sql(UPD_SQL, events=read("events"))
