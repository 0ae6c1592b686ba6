"""AS paths, prefixes and times, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of digits, one space apart. Anything else (sets, confederations, dotted numbers, stray spaces) spoils the whole path.
CLEAN_PATH = r"^[0-9]+( [0-9]+)*$"


def once(x: Column, f) -> Column:
    """f of x, which is evaluated a single time however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def collapsed(as_path: Column) -> Column:
    """Tokens of a path without the repeats that stand next to each other; tokens are compared as text, and loops stay."""
    return once(F.split(as_path, " "), lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))


def valid_path(as_path: Column, peer_asn: Column) -> Column:
    """ARRAY<BIGINT> of a path that is clean, has two hops at least once collapsed, and begins with the peer; else null."""
    hops = F.when(F.rlike(as_path, F.lit(CLEAN_PATH)), F.transform(collapsed(as_path), lambda x: x.try_cast("bigint")))
    return once(hops, lambda p: F.when((F.size(p) > 1) & (F.get(p, F.lit(0)) == peer_asn) & F.forall(p, lambda x: x.isNotNull()), p))


def family(prefix: Column) -> Column:
    """4 if the prefix holds a dot, else 6 if it holds a colon, else 0."""
    return F.when(F.contains(prefix, F.lit(".")), 4).when(F.contains(prefix, F.lit(":")), 6).otherwise(0)


def adjacencies(path: Column) -> Column:
    """Array of undirected edges (u, v), u <= v, of neighbours on the path; a loop gives an edge twice."""
    hop = lambda i: F.get(path, i)
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.least(hop(i - 1), hop(i)).alias("u"), F.greatest(hop(i - 1), hop(i)).alias("v")))


def path_text(path: Column) -> Column:
    return F.concat_ws(" ", path.cast("array<string>"))


def path_key(path: Column) -> Column:
    """A path as the key of a JSON object: (1, 2, 3)."""
    return F.concat(F.lit("("), F.array_join(path.cast("array<string>"), ", "), F.lit(")"))


def peer_key(rc: Column, peer_ip: Column) -> Column:
    return F.concat_ws("_", rc, peer_ip)


def percentage(part: Column, whole: Column) -> Column:
    """Per cent to two places; null of nothing."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2))


def epoch_time(seconds: Column) -> Column:
    """TIMESTAMP_NTZ in UTC of epoch seconds with a fraction, exact to the microsecond."""
    return F.to_utc_timestamp(F.timestamp_micros(F.round(seconds.cast("decimal(28,9)") * 1_000_000).cast("bigint")), F.current_timezone()).cast("timestamp_ntz")
