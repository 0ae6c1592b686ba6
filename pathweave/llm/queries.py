"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import neighbours, preference_segments
from .exact_dedup import exact_dedup
from .fingerprint import fingerprints
from .language_id import identify
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack
from .pii import digest, find_personal_data
from .secrets import find_secrets

VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary()).drop("ids")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    spans = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).drop("next_fingerprint")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(documents(spark, sf_dir)))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_segments(turns, neighbours(turns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_packing, op3_ngram_join, op4_secrets, op5_exact_dedup, op6_fingerprints, op7_pii, op8_preferences, op9_mixing, op10_line_dedup)}

OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w, source_size * 3.0::DOUBLE AS full_size FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
o AS (SELECT arg_min(level, full_size / w) AS open_level FROM l WHERE level * w <= full_size),
t AS (
  SELECT source, source_size, least(full_size, coalesce(open_level * w, full_size)) AS target FROM l, o),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS times FROM t),
r AS (SELECT *, target - times * source_size AS rest FROM g),
c AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.times, r.rest, d.h,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target,
  size * least(3, times + CASE WHEN upto <= rest OR (upto - own <= rest AND abs(upto - rest) < abs(upto - own - rest)) THEN 1 ELSE 0 END) AS taken
FROM c
"""

OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id // 2 AS pair_id, CASE conv_id % 2 WHEN 0 THEN 'chosen' ELSE 'rejected' END AS side,
    CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS INT) AS place
  FROM conversations),
p AS (SELECT pair_id FROM t GROUP BY pair_id HAVING count(DISTINCT conv_id) = 2),
a AS (SELECT t.* FROM t JOIN p USING (pair_id)),
c AS (SELECT x.pair_id, x.turn, x.place FROM a x JOIN a y ON x.pair_id = y.pair_id AND x.turn = y.turn AND x.place = y.place AND x.role = y.role AND x.text = y.text WHERE x.side = 'chosen' AND y.side = 'rejected'),
d AS (SELECT pair_id, min((turn, place)) AS parting FROM a ANTI JOIN c USING (pair_id, turn, place) GROUP BY pair_id),
m AS (SELECT a.*, d.parting IS NULL OR (a.turn, a.place) < d.parting AS in_prompt FROM a LEFT JOIN d USING (pair_id))
SELECT pair_id, CASE WHEN in_prompt THEN 'prompt' ELSE side END AS part, turn, place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS text,
  NOT in_prompt AND role = 'assistant' AS trained
FROM m WHERE NOT in_prompt OR side = 'chosen'
"""

ORACLE_SQL: dict[str, str] = {"op8_preferences": OP8_SQL, "op5_exact_dedup": OP5_SQL, "op9_mixing": OP9_SQL}
