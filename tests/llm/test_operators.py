"""The operators against brute-force versions, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import sys
import time
import unicodedata
import weakref
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pathweave.llm import chat, common, fingerprint, language_id, line_dedup, mixing, ngram_join, packing, pii, secrets
from pathweave.llm.components import components
from pathweave.llm.exact_dedup import exact_dedup
from pathweave.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, schema=DOCS):
    rows = [(*r, *[None] * (5 - len(r))) for r in rows] if schema == DOCS else rows
    return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


def words(rng, n, of=60):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def odd(df):
    """df with columns whose names the operators might use themselves."""
    return df.withColumns({c: F.lit(c) for c in ("_id", "_t", "_pid", "key", "node", "label", "size", "kept", "_n", "part", "score", "line")})


# exact duplicates


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    rng = random.Random(1)
    rows = [(k, rng.choice(["", None, "same", "same ", "é" * 3000, words(rng, 2, 4), "copy of many"] + ["hot"] * 5)) for k in range(400)]
    got = {r.doc_id: r for r in exact_dedup(odd(table(spark, rows)), keep=keep, carry=["label", "text"]).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = max if keep == "max" else min
    for i, t in rows:
        r, ids = got[i], groups[t or ""]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256, r.label, r.text) == (pick(ids), len(ids), i == pick(ids), hashlib.sha256((t or "").encode()).hexdigest(), "label", t)


def test_exact_dedup_edges(spark):
    got = exact_dedup(table(spark, [(1, "a"), (1, "a"), (None, "a"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "1", 3, False), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert exact_dedup(table(spark, [])).count() == 0


# mixing


def fill(sizes, weights):
    """Targets by sharing the excess out again until none is above three times its source's size."""
    total, full, out = sum(sizes), set(), {}
    while True:
        w = sum(weights[k] for k in range(len(sizes)) if k not in full)
        rest = total - sum(3 * sizes[k] for k in full)
        out = {k: 3 * sizes[k] if k in full else rest * weights[k] / w for k in range(len(sizes))}
        above = {k for k in out if k not in full and out[k] > 3 * sizes[k] + 1e-9}
        if not above:
            return out
        full |= above


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, rng.randrange(0, 80)), None, rng.choice(["a", "B", "é", None, "z", "tiny" if k % 40 == 0 else "a"])) for k in range(500)]
    got = mixing.mix(odd(table(spark, rows)).drop("size")).collect()
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in sources]
    goal = fill(sizes, [k % 3 + 1 for k in range(len(sources))])
    for k, s in enumerate(sources):
        mine = [r for r in got if r.source == s]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(sizes[k], round(goal[k], 6))}
        assert abs(sum(r.taken for r in mine) - goal[k]) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken == r.size * r.copies and r.copies <= 3 for r in mine)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=str)


def test_mixing_edges(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    got = mixing.mix(table(spark, [(1, None, None, "a"), (2, "", None, None), (None, "x y", None, "a"), (None, "x y", None, "a")])).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 4 and [r.target for r in got if r.source is None] == [0.0]
    assert {r.taken for r in mixing.mix(table(spark, [(1, None, None, "a")])).collect()} == {0}


# packing


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randrange(0, 900), 5000)) for k in range(60)] + [(100, None), (101, ""), (102, "<|endoftext|> É ǅ 'll don't ... x. y,. z."), (103, words(rng, 9000, 5000)), (None, "no id"), (7, rng.choice("ab"))]
    got = packing.pack(odd(table(spark, rows)), vocabulary()).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    docs = sorted((str(i), np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    made, by_doc, by_sequence = [], defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for (i, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]])) and sum(p.length for p in pieces) == n
        made.append((str(i), b"".join(bytes(p.ids) for p in pieces)))
    assert sorted(made) == docs
    lengths = []
    for s in sorted(by_sequence):
        pieces = sorted(by_sequence[s], key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        lengths.append(sum(p.length for p in pieces))
    assert set(lengths[:-1]) == {4096} and sorted(by_sequence) == list(range(len(lengths)))
    assert packing.pack(table(spark, []), vocabulary()).count() == 0


def test_tokens_of_any_text_are_the_vocabularys():
    rng = random.Random(4)
    from tokenizers import Tokenizer

    model, memo = Tokenizer.from_file(vocabulary()), packing.Words(vocabulary())
    letters = list("abzABC'’sSΣσςİıß  ́ \x1c\x85​中文1٣½.,!?\t\n\r\x0b\x0c﻿😀가") + ["'ll", "'s", " ", "\n", ". ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for t, ids in zip(texts, memo.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_remembered_without_the_marks_that_end_them():
    from tokenizers import Tokenizer

    model, memo = Tokenizer.from_file(vocabulary()), packing.Words(vocabulary())
    texts = ["Onment$$$ onment,%%% onment onment. onmentü!!", "été... é's. o'. x{~ }y÷.. q1. ^ <>,", "Ü. ﬁ. ª, é́. a.b.", None]
    for t, ids in zip(texts, memo.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert {w.decode() for w in memo.known if b"onment" in w} == {"onment", "onmentü"} and b"$$$" in memo.known


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    rows = spark.range(1000).selectExpr("id % 10 AS k", "id").repartition(4, "k")
    held, conf = rows.groupBy("k").count().cache(), spark.conf.get(common.CLEAN_UP, None)
    assert held.count() == 10
    before = files()
    with common.Scratch(spark) as tmp:
        got = tmp.written(rows.join(held, "k"), "joined")
        until = time.time() + 10
        while files() - before and time.time() < until:
            time.sleep(0.1)
        assert not files() - before
        assert got.count() == 1000 and held.count() == 10
    held.unpersist()
    assert spark.conf.get(common.CLEAN_UP, None) == conf


def test_tasks_of_other_operators_drop_the_words_that_packing_kept():
    from pyspark import cloudpickle

    again = lambda f: cloudpickle.loads(cloudpickle.dumps(f))  # noqa: E731  as a worker gets it
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], names=["_id", "_t"])
    for task, batches in ((ngram_join._describe(frozenset()), [rows]), (line_dedup._describe(128), []), (language_id._scorer([]).func, [pd.Series(["text"])])):
        words = weakref.ref(packing.words_of(vocabulary()))
        assert packing.words_of(vocabulary()) is words()
        assert len(list(again(task)(iter(batches)))) == len(batches)
        assert words() is None


def test_written_tables_have_few_files(spark):
    with common.Scratch(spark) as tmp:
        got = tmp.written(spark.range(500).repartition(211), "many")
        assert len(got.inputFiles()) <= common.FILES_A_CORE * spark.sparkContext.defaultParallelism
        assert sorted(r.id for r in got.collect()) == list(range(500))


def test_tables_sent_from_the_driver_start_no_python_workers(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text")
    plan = lambda df: df._jdf.queryExecution().toString()
    some = docs.filter(common.perhaps_in(F.col("doc_id"), spark.range(5), F.col("id")))
    assert {r.doc_id for r in some.collect()} >= set(range(5)) and some.count() < 10
    for df in (some, exact_dedup(docs)):
        assert "LocalRelation" in plan(df) and not re.search("ExistingRDD|LogicalRDD", plan(df))


def test_special_tokens_are_case_sensitive():
    from tokenizers import Tokenizer

    model, memo = Tokenizer.from_file(vocabulary()), packing.Words(vocabulary())
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "Some <|EndOfText|>BAR. Foo, baz.", "x<|endoftext|>Y<|StartOfText|>. A.\nB", "<|startoftext|> É. <|ENDOFTEXT|>,"]
    for t, ids in zip(texts, memo.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_hilbert_is_a_path():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    at = packing.hilbert(cells, 2)
    assert sorted(at) == list(range(64)) and (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


# n-gram join


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
            x, y = label[a], label[b]
            if x != y:
                label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    return sets, label


def near_rows():
    rng = random.Random(5)
    rows, passage = [], words(rng, 40, 400)
    base = words(rng, 120, 300)
    for k in range(40):  # near copies, and chains of them
        w = base.split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    for k in range(40, 120):
        rows.append((k, rng.choice([words(rng, rng.randrange(0, 14), 3), words(rng, rng.randrange(5, 200), 300), passage + " " + words(rng, rng.randrange(1, 25), 400), "Same Text\x0bhere and THERE", None, "", "four words of it", "  é　x"])))
    chain = words(rng, 60, 400).split()
    for k in range(120, 150):
        chain = chain[1:] + [f"c{k}"] * (k % 3 == 0)
        rows.append((k, " ".join(chain)))
    return rows


@pytest.mark.parametrize("cost", [2, 0])
def test_ngram_join(spark, monkeypatch, cost):
    if not cost:  # every key is dear: all links that are left come from the one-deletion index
        monkeypatch.setattr(ngram_join, "DEAR", 0)
    rows = near_rows()
    got = {r.doc_id: r for r in ngram_join.near_duplicates(odd(table(spark, rows))).collect()}
    sets, label = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join_edges(spark):
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    got = ngram_join.near_duplicates(table(spark, [(3, "a b"), (3, "a b"), (None, "a b"), (5, "A B"), (9, None), (None, None), (8, "w " * 50_000)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 1, "3"), ("3", 1, "3"), ("5", 1, "3"), ("8", 1, "8"), ("9", 0, "9"), ("None", 0, "None"), ("None", 1, "3")]


def test_ngram_join_of_shared_ids(spark):
    rng = random.Random(15)
    texts = [words(rng, 80, 4000) for _ in range(12)]
    rows = []
    for k, t in enumerate(texts):  # copies of all texts under no id, and of two texts under one id
        rows += [(100 + k, t), (None, f"{t} more"), (k // 2, f"some {t}")]
    got = ngram_join.near_duplicates(table(spark, rows)).collect()
    want = {k: k // 2 for k in range(12)}
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted([(100 + k, v) for k, v in want.items()] + [(v, v) for v in want.values()])
    assert sorted(r.component_id for r in got if r.doc_id is None) == sorted(want.values())


@pytest.mark.parametrize("deletions", [False, True])
def test_linked_sets_share_keys(deletions):
    rng = np.random.default_rng(6)

    def index(h):
        """By band: whether it is the set's own, and its keys with their segments, of which some are whole."""
        for k, most in ngram_join.index_bands(h):
            own = k == ngram_join.band_of(len(h))[0]
            if deletions:
                yield k, own, [dict(zip(key.tolist(), seg.tolist(), strict=True)) for key, seg, _ in [ngram_join.deletion_keys(h, k)]][0], set(ngram_join.deletion_keys(h, k)[0][ngram_join.deletion_keys(h, k)[2]].tolist())
            else:
                key = ngram_join.keys(h, k, most + ngram_join.common(k)).tolist()
                yield k, own, {x: x for x in key}, set(key)

    links = 0
    with np.errstate(over="ignore"):
        for _ in range(600):
            n = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x[rng.random(len(x)) > rng.choice([0.05, 0.12, 0.2])]
            y = np.unique(np.concatenate([y, rng.integers(0, 2**63, rng.integers(0, max(1, n // 7) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and 4 * both >= 3 * (len(x) + len(y) - both):
                links += 1
                shared = [(k, {p[c] for c in p.keys() & q.keys() if c in u or c in v}) for k, o, p, u in index(x) for m, r, q, v in index(y) if k == m and (o or r)]
                assert any(len(s) >= ngram_join.common(k) for k, s in shared)
                kx, ky = (ngram_join.band_of(len(s))[0] for s in (x, y))
                unlike = int(np.bitwise_count((ngram_join.parity_maps(x)[kx > ky] ^ ngram_join.parity_maps(y)[ky > kx]).view(np.uint64)).sum())
                assert abs(kx - ky) <= 1 and unlike <= len(x) + len(y) - 2 * both
    assert links > 100


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# fingerprints


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(k * 3, rng.choice([None, "", "ab", "é😀x", words(rng, rng.randrange(400), 3000)])) for k in range(80)] + [(None, "first of all")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(odd(table(spark, rows))).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.digest(t.encode()), fingerprint.digest(e.encode()))
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.digest(following.encode())) and 0 <= r.near_edited <= 1
    one = fingerprint.fingerprints(table(spark, [(1, "alone")])).first()
    assert one.near_next == 1 and fingerprint.fingerprints(table(spark, [])).count() == 0
    twice = fingerprint.fingerprints(table(spark, [(1, "b"), (1, "a"), (2, "cdcd"), (2, "cdcd")])).collect()
    assert len(twice) == 4 and sorted(r.n_chars for r in twice) == [1, 1, 4, 4]


def test_half_of_a_text_is_more_like_it_than_another():
    rng = random.Random(9)
    texts = [words(rng, 300, 20000) for _ in range(20)]
    near = [fingerprint.likeness(fingerprint.digest(a.encode()), fingerprint.digest(fingerprint.edited(a, b).encode())) for a, b in zip(texts, texts[1:])]
    far = [fingerprint.likeness(fingerprint.digest(a.encode()), fingerprint.digest(b.encode())) for a, b in zip(texts, texts[1:])]
    assert sum(near) > sum(far) and fingerprint.likeness("00" * 34, "ff" * 34) == 0


# language


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = table(spark, [(10**6, None, "en"), (10**6 + 1, "", "de"), (10**6 + 2, "12 34 !? ²", None), (None, "the and of this", None), (10**6 + 3, "the " * 100_000, None)])
    got = language_id.identify(odd(docs.select(more.columns).union(more))).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {10**6, 10**6 + 1, 10**6 + 2}


def test_remembered_n_grams_take_little_more_than_themselves():
    grams = language_id.Grams()
    n = len(grams.of_text(" ".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(26 * 26))))
    assert len(grams.known) == 26 * 26 and sum(map(sys.getsizeof, grams.known.values())) <= 8 * n + 40 * 26 * 26


def test_language_profiles_by_hand(spark):
    rows = [(1, "abab xx", "a"), (2, "abab", "a"), (3, "xyz zz", "b"), (4, None, "b"), (5, "q", None)]
    got = defaultdict(list)
    for r in language_id.learn(table(spark, rows)).orderBy("lang", "rank").collect():
        got[r.lang].append(r.gram)
    g = language_id.Grams()
    for lang in "ab":
        grams = np.concatenate([g.of_text(t) for _, t, at in rows if at == lang and t])
        assert got[lang] == language_id.ranked(grams).view(np.int64).tolist()


def test_language_edges(spark):
    none = language_id.identify(table(spark, [(1, "words here", None), (2, "more", None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and language_id.identify(table(spark, [])).count() == 0


def test_more_languages_than_a_block(spark, monkeypatch):
    rows = [(k, f"{c}{c}{c} {c}{c}", c) for k, c in enumerate("abcdefgh")]
    whole = sorted(map(tuple, language_id.predict(table(spark, rows), language_id.learn(table(spark, rows))).select("doc_id", "lang_pred", "score").collect()))
    monkeypatch.setattr(language_id, "BLOCK", 3)
    assert whole == sorted(map(tuple, language_id.predict(table(spark, rows), language_id.learn(table(spark, rows))).select("doc_id", "lang_pred", "score").collect()))
    assert [r[1] for r in whole] == list("abcdefgh")


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(10)
    parts = ["a", "Z", "9", "1", "25", "255", "256", ".", "@", "-", "+", " ", "(", ")", "%", "é", "😀", "\n", "+1 (555) 010-2030", "4111 1111 1111 1111", "x@y.zz", "1.2.3.4", "\t"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(600)] + [(900, None), (901, ""), (902, "a" * 50_000), (903, "9" * 20_000), (904, "1." * 5000), (905, "a@b.c " * 2000), (906, "a." * 20_000 + "@"), (907, "+1 " * 3000), (None, "x@y.zz")]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(odd(table(spark, rows)))).collect()}
    for i, t in rows:
        spans = brute_spans(t)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[3] == k for x in spans) for k in PATTERNS]
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))
    assert pii.digest(pii.find_personal_data(table(spark, []))).count() == 0


def test_personal_data_that_is_added(spark):
    texts = ["please call 555-123-4567 now", "mail me at jo.smith (at) example (dot) com ok", "card 4111.1111.1111.1111 ok", "server 10[.]0[.]0[.]7 up", "score 100 200 300", "he was at home dot com", "pages 2010 2011 2012"]
    df = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert [got[k].spans for k in range(7)] == ["phone:12:24", "email:11:42", "card:5:24", "ip:7:21", "", "", ""]
    found = df.join(pii.find_personal_data(df), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.array_sort(F.concat("base", "added"))).alias("r"))
    assert {r.doc_id: r.r for r in found.collect()}[0] == "please call <phone> now"


def test_spelt_out_addresses_in_capitals_are_added(spark):
    texts = ["mail me at jo.smith (AT) example (DOT) com ok", "MAIL ME AT JO.SMITH [AT] EXAMPLE [DOT] COM OK"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(table(spark, list(enumerate(texts))))).collect()}
    assert got == {0: "email:11:42", 1: "email:11:42"}


def test_sql_features_equal_those_of_training(spark):
    rows = pii.examples(200)
    df = spark.createDataFrame([r[:4] for r in rows], "kind string, m string, b string, a string")
    for kind in pii.KINDS:
        got = df.filter(F.col("kind") == kind).select("m", "b", "a", F.array(*pii.features(kind, F.col("m"), F.col("b"), F.col("a"))).alias("f")).collect()
        assert [list(map(float, pii._features_of(kind, r.m, r.b, r.a))) for r in got] == [list(r.f) for r in got]


def test_trees_are_precise_on_examples_they_have_not_seen():
    start, trees, cut = pii.model()
    rows = pii.examples(2000, seed=99)
    x, y = np.array([pii._features_of(*r[:4]) for r in rows], float), np.array([r[4] for r in rows])
    odds = start + sum(t.apply(x) for t in trees)
    said = np.array([o >= cut[r[0]] for o, r in zip(odds, rows, strict=True)])
    assert y[said].mean() >= 0.97 and said[y == 1].mean() >= 0.5


# secrets


def test_secrets(spark):
    rows = [(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', None, "src0"), (2, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff is", None, "src0"), (3, "plain words of no keys", None, None), (4, None), (5, ""), (6, "a1" * 50_000), (None, "password: hunter2!x9", None, "x")]
    got = {r.doc_id: r for r in secrets.find_secrets(odd(table(spark, rows))).collect()}
    assert [(s.start, s.end) for s in got[1].secrets] == [(9, 49)] and got[2].n_candidates == 1 and got[2].n_secrets == 0
    assert [got[k].n_candidates for k in (3, 4, 5, 6)] == [0, 0, 0, 1] and got[None].n_candidates == 1
    assert secrets.find_secrets(table(spark, [])).count() == 0


def test_candidates_hold_whole_assigned_values():
    rng = random.Random(14)
    part = lambda n: "".join(rng.choice("abcXYZ0189_-") for _ in range(n))
    jwt = f"{part(200)}.{part(257)}.{part(42)}"
    assert secrets.candidates(f"token = {jwt} end") == [(8, 509)]
    assert secrets.candidates(f"secret: {'x!' * 50_000}") == [(8, 100_008)]
    assert secrets.candidates("a1b2c3d4-token=abcdefgh1234!rest of") == [(0, 32)]  # a run and the value that goes on after it


def test_forest_on_examples_it_has_not_seen():
    trees, least = secrets.model()
    rows = secrets.examples(1500, seed=77)
    said = secrets.score(trees, np.array([secrets.features(*r[:3]) for r in rows], float)) >= least
    y = np.array([r[3] for r in rows]) == 1
    assert (said == y).mean() >= 0.95 and said[y].mean() >= 0.95


# preferences


def test_preferences(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, None, None)]
    rows += [(2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "lonely"), (None, 0, "user", "x"), (6, None, "user", "t"), (6, 1, "user", "u"), (7, None, "user", "t"), (7, 1, "user", "u"), (7, 1, "user", "u")]
    turns = odd(table(spark, rows, schema)).drop("part")
    got = chat.preference_segments(turns, chat.neighbours(turns))
    t = {r.pair_id: r for r in chat.texts(got).collect()}
    assert set(t) == {0, 1, 3}
    assert t[0].prompt == "<|user|>\nq<|end|>\n" and t[0].chosen.startswith("<|assistant|>\na<|end|>\n<|user|>") and t[0].rejected == "<|assistant|>\nb<|end|>\n<||>\n<|end|>\n"
    whole = t[0].prompt + t[0].chosen
    assert [whole[m.s : m.e] for m in t[0].chosen_mask] == ["<|assistant|>\na<|end|>\n", "<|assistant|>\nyes<|end|>\n"] and len(t[0].rejected_mask) == 1
    assert (t[1].chosen, t[1].rejected, t[1].chosen_mask) == ("", "", []) and t[3].prompt.count("<|user|>") == 2 and t[3].rejected == "<|user|>\nu<|end|>\n"
    empty = table(spark, [], schema)
    assert chat.preference_segments(empty, chat.neighbours(empty)).count() == 0


# lines


def brute_norm(x):
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x.lower()).split())


def brute_alike(a, b):
    """Edit similarity by a plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return 4 * row[-1] <= max(len(a), len(b))


def brute_pairs(lines):
    """Pairs of alike lines: of those that lengths and counts of characters leave, by edits alone."""
    n = np.array([len(x) for x in lines])
    counts = np.array([np.bincount(np.array([ord(c) % 64 for c in x]), minlength=64) for x in lines])
    for i in range(len(lines)):
        most = np.maximum(n, n[i]) // 4
        gap = np.abs(n - n[i])
        for j in np.flatnonzero((np.arange(len(lines)) > i) & (gap <= most) & (np.abs(counts - counts[i]).sum(1) + gap <= 2 * most)):
            if line_dedup.edits(lines[i], lines[j]) <= most[j]:
                yield i, int(j)


def brute_kept(rows, label):
    first = {}
    for i, p, x in sorted((i if i is not None else -(2**63), p, brute_norm(x)) for i, t in rows for p, x in enumerate((t or "").split("\n"))):
        first.setdefault(label.get(x, x), (i, p))
    return {i: [p for p, x in enumerate(t.split("\n")) if not (n := brute_norm(x)) or first[label.get(n, n)] == (i if i is not None else -(2**63), p)] if t is not None else [] for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.randrange(60, 90), 900) for _ in range(20)] + [words(rng, rng.randrange(1, 5), 900) for _ in range(20)]

    def line():
        x = rng.choice(pool)
        w = x.split()
        if len(w) > 50 and rng.random() < 0.4:
            w[rng.randrange(len(w))] += "x"
        return rng.choice([str.upper, str, str])(" ".join(w) + rng.choice(["", ".", " !!"]))

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(6)))) for k in range(60)] + [(100, None), (101, ""), (102, "\n\n* *"), (103, words(rng, 3000, 900)), (None, pool[0])]
    distinct = sorted({n for _, t in rows for x in (t or "").split("\n") if (n := brute_norm(x))})
    label = {x: x for x in distinct}
    for a, b in combinations(distinct, 2):
        if 3 * len(b) <= 4 * len(a) <= 6 * len(b) and len(a) > 100 and label[a] != label[b] and len(set(a.split()) ^ set(b.split())) < 20 and brute_alike(a, b):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    got = {r.doc_id: r for r in line_dedup.line_dedup(odd(table(spark, rows))).collect()}
    want = brute_kept(rows, label)
    for i, t in rows:
        assert (list(got[i].kept_lines), got[i].n_lines, got[i].n_kept) == (want[i], 0 if t is None else len(t.split("\n")), len(want[i]))
        assert got[i].text == "\n".join((t or "").split("\n")[k] for k in want[i])
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_tables_go_once_they_are_read_no_more(spark, monkeypatch):
    there, write = {}, common.Scratch.written

    def written(self, df, name):
        there[name] = set(self.at)
        return write(self, df, name)

    monkeypatch.setattr(common.Scratch, "written", written)
    monkeypatch.setattr(line_dedup, "AT_A_TIME", 8)
    rng = random.Random(5)
    rows = [(k, "\n".join(words(rng, 12, 3000) for _ in range(4)) + "\nthe same line of some words in all of them") for k in range(30)]
    assert sum(r.n_lines - r.n_kept for r in line_dedup.line_dedup(table(spark, rows)).collect()) == 29
    met = sorted((x for x in there if x.startswith("met")), key=lambda x: int(x[3:]))
    assert len(met) > 2 and "described" in there[met[-1]] and "described" not in there["to_head"]
    for k, name in enumerate(met):  # each goes as soon as its pairs are written
        assert there[f"pairs_{name}"] & set(met) == set(met[k:])
    assert not there["near_across"] & {"described", *met}


def test_recall_of_line_links(spark, sf):
    """Against all pairs of edit similarity 0.75 or more, found without SimHashes: 0.9 of the lines that have such a pair find their group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lines = sorted({n for _, t in rows for x in (t or "").split("\n") if (n := brute_norm(x))})
    rng = random.Random(13)
    for x in rng.sample([x for x in lines if len(x.split()) > 9], 200):  # and lines of which a word in twenty is another one
        w = x.split()
        for _ in range(max(1, len(w) // 20)):
            w[rng.randrange(len(w))] = f"other{rng.randrange(900)}"
        lines.append(" ".join(w))
        rows.append((10**6 + len(rows), lines[-1]))
    pairs = list(brute_pairs(lines))
    label = list(range(len(lines)))
    for i, j in pairs:
        if label[i] != label[j]:
            label = [label[i] if v == label[j] else v for v in label]
    want = brute_kept(rows, {x: lines[v] for x, v in zip(lines, label, strict=True)})
    alone = brute_kept(rows, {})
    got = {r.doc_id: set(r.kept_lines) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    fuzzy = [(i, p) for i in want for p in set(alone[i]) - set(want[i])]  # go for a line that is alike, not for an equal one
    assert len(fuzzy) > 100
    assert sum(p not in got[i] for i, p in fuzzy) >= 0.9 * len(fuzzy)
    at = {x: k for k, x in enumerate(lines)}
    text = dict(rows)
    for i in want:  # no line goes that is alike to none
        for p in set(alone[i]) - got[i]:
            assert label.count(label[at[brute_norm(text[i].split("\n")[p])]]) > 1


def test_equal_lines_of_any_length_go(spark):
    rows = [(1, "All rights reserved.\nof\n\n* * *"), (2, "all rights reserved\nOF\n\n* * *"), (3, "on\nnew\n中"), (4, "news\n中\nNEW"), (5, "a b " * 60_000), (6, "A b " * 60_000 + "\nof")]
    got = {r.doc_id: list(r.kept_lines) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: [0, 1, 2, 3], 2: [2, 3], 3: [0, 1, 2], 4: [0], 5: [0], 6: []}


def test_simhash_by_hand():
    lines = ["a b b", "", "one", " ".join(f"w{k}" for k in range(700)), " ".join(f"v{k}" for k in range(9))]
    lines += [" ".join(f"x{k}" for k in range(n)) for n in (15, 16, 255, 256, line_dedup.AT_ONCE, 3 * line_dedup.AT_ONCE + 1)] + ["two words"]
    hashes = line_dedup.SimHash(200)
    got = hashes.of(lines)
    for k, x in enumerate(lines):
        ones = np.zeros(256)
        for w in (words := set(x.split(" "))):
            ones += hashes.bits_of(np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64)).view(np.uint8)[0]
        assert (got[k] == (2 * ones > len(words))).all()
    assert 0.45 < got[3].mean() < 0.55


def test_edits():
    rng = random.Random(12)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(2))
        assert line_dedup.edits(a, b) == slow(a, b)
