"""A training corpus from documents: language, exact duplicates, near duplicates, source weights, packed sequences.

Each stage works on all that the one before it kept. run() writes each stage's rows to the shared folder and reads them for
the next; what is read no more goes. Null texts and texts without letters go in the first stage, so that later stages hold
documents of some words. Other columns stay as they are, whatever their names: each stage packs a row before it adds its own.
Ids may be null or repeated: decisions are for rows, and for source and id in the mixing. Ties go by id, then by row hash. An
empty table gives an empty one after each stage. Texts of any length are whole in all stages, and cut in the last alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.common import Scratch, written
from pathweave.llm.exact_dedup import exact_dedup
from pathweave.llm.language_id import UNKNOWN, held_out, learn, predict
from pathweave.llm.mixing import mix
from pathweave.llm.ngram_join import near_duplicates
from pathweave.llm.packing import pack
from pathweave.llm.queries import documents, vocabulary

#: A document whose best language is less like it than this is in none of them. Prose scores 0.35 and more.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters, or like none of the languages, go."""
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    scored = predict(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), profiles, text_col="_text")
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, null ids last; of rows equal in id too, one."""
    return exact_dedup(docs.select("doc_id", "text", F.struct("*").alias("_doc")), carry=["_doc"]).filter("kept").select("_doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id, or of null ids the least key.

    Rows are told apart by a 64-bit hash of their columns, for ids may be null or repeated; the stage before leaves no two
    equal rows. Two of 10^8 rows have one hash with a chance of under 1 in 1000.
    """
    keyed = docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64(*docs.columns).alias("_key"), F.struct("*").alias("_doc"))
    found = near_duplicates(keyed, id_col="_key", text_col="_text").select(F.col("doc_id").alias("_key"), "component_id")
    heads = keyed.select("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key").alias("_at")).join(found, "_key").groupBy("component_id").agg(F.min("_at").alias("_at"))
    return keyed.join(heads.select(F.col("_at")["_key"].alias("_key")), "_key", "left_semi").select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it: from no time to three times.

    How often follows from source and id, so that rows equal in both, null or not, are taken alike.
    """
    takes = mix(docs).filter("copies > 0").select(F.col("doc_id").alias("_takes"), F.col("source").alias("_of"), F.col("copies").alias("_copies")).distinct()
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.struct("*").alias("_doc"))
    taken = rows.join(takes, F.col("_id").eqNullSafe(F.col("_takes")) & F.col("_source").eqNullSafe(F.col("_of")))
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs, vocabulary()).drop("ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mixing), ("packing", packing)]

#: Language profiles and packing are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Scratch(spark) as tmp:
        before = None
        for name, stage in STAGES:
            last = name == STAGES[-1][0]
            docs = written(stage(spark, docs, sf_dir), name) if last else tmp.written(stage(spark, docs, sf_dir), name)
            if before:
                tmp.remove(before)
            before = name
    return docs
