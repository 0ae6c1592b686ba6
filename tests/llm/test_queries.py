"""Registered queries against their SQL on the smallest tables, and the pipeline against its stages by hand."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from pathweave.llm.common import written
from pathweave.llm.queries import ORACLE_SQL, QUERIES, documents

from .test_operators import brute_components, fill


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    line = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(line(r[c] for c in columns) for r in got.collect()) == sorted(line(r[k] for k in order) for r in want.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, sf):
    docs = documents(spark, sf)
    rows = {"start": [(r.doc_id, r.text, r.source) for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns
            rows[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert rows["language"] and len(rows["language"]) == len(rows["start"])  # all of them are prose
    keep = {}
    for i, t, _ in rows["language"]:
        keep[t] = max(i, keep.get(t, i))
    assert sorted(i for i, _, _ in rows["exact_dedup"]) == sorted(keep.values())
    _, label = brute_components([(i, t) for i, t, _ in rows["exact_dedup"]])
    assert sorted(i for i, _, _ in rows["near_duplicates"]) == sorted(i for i, v in label.items() if i == v)
    sources = sorted({s for _, _, s in rows["near_duplicates"]})
    size = lambda some, s: sum(len(t.split()) for _, t, at in some if at == s)
    goal = fill([size(rows["near_duplicates"], s) for s in sources], [k % 3 + 1 for k in range(len(sources))])
    for k, s in enumerate(sources):
        longest = max(len(t.split()) for _, t, at in rows["near_duplicates"] if at == s)
        assert abs(size(rows["mixing"], s) - goal[k]) <= longest / 2 + 1
    assert docs.agg({"length": "sum"}).first()[0] >= len(rows["mixing"])
    whole = corpus_pipeline.run(spark, sf)
    line = lambda df: hashlib.sha256(str(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert line(whole) == line(docs)


def test_pipeline_with_null_and_repeated_ids(spark, sf):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, text(0), "a"), (None, text(0) + " more", "a"), (5, text(1), "a"), (None, text(1) + " more", "b"), (7, text(2), "a"), (7, text(3), "b"), (8, text(3) + " more", "c"), (None, text(4), "b"), (9, "", "c")]
    docs = spark.createDataFrame(rows, documents(spark, sf).select("doc_id", "text", "source").schema)
    kept = corpus_pipeline.near(spark, docs, sf).collect()
    assert len([r for r in kept if r.text.startswith(text(0))]) == 1
    assert sorted((str(r.doc_id), r.text) for r in kept if not r.text.startswith(text(0))) == sorted([("5", text(1)), ("7", text(2)), ("7", text(3)), ("None", text(4)), ("9", "")])
    some = spark.createDataFrame([(i, f"{s} {k} " + "word " * 5, s) for s in "abc" for k, i in enumerate([None, 1, 1, 2, 3, 4])], docs.schema)
    want = sorted((str(r.doc_id), r.source, r.copies) for r in corpus_pipeline.mix(some).distinct().collect() if r.copies)
    taken = corpus_pipeline.mixing(spark, some, sf).groupBy("doc_id", "source", "text").count().collect()
    assert sorted({(str(r.doc_id), r.source, r["count"]) for r in taken}) == want and len({c for _, _, c in want}) > 1


def test_pipeline_with_clashing_columns_long_texts_ties_and_an_empty_table(spark, sf):
    def text(seed, n=60):
        rng = random.Random(seed)
        return " ".join(rng.choice(["the", "of", "and", "house", "river", "thing", "over"]) + rng.choice(["", "s", "ing", "ed"]) + str(rng.randrange(40)) for _ in range(n))

    names = ("kept", "copies", "_copy", "keep_id", "group_size", "text_sha256", "_key", "_text", "_doc", "_id", "size", "component_id", "_takes")
    base = [(1, text(1), "a"), (2, text(1), "b"), (2, text(1), "b"), (3, text(2), "a"), (4, text(2) + " more", "a"), (None, text(3), None), (None, text(3), None), (6, text(4, 60_000), "b"), (7, None, "a"), (8, "", "a")]
    docs = spark.createDataFrame([(*r, *[f"{r[0]}{n}" for n in names]) for r in base], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    kept = corpus_pipeline.exact(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "6", "8", "None"]
    near = corpus_pipeline.near(spark, written(kept, "kept"), sf)
    assert near.columns == docs.columns
    rows = near.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["2", "3", "6", "8", "None"] and all(r[n] == f"{r.doc_id}{n}" for r in rows for n in names)
    mixed = corpus_pipeline.mixing(spark, written(near, "near"), sf)
    assert mixed.columns == docs.columns and {str(r.doc_id) for r in mixed.collect()} <= {str(r.doc_id) for r in rows}
    empty = docs.limit(0)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixing, corpus_pipeline.packing):
        assert stage(spark, empty, sf).count() == 0
