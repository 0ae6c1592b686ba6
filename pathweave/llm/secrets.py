"""Secret scans: high-recall patterns propose candidates, a random forest removes the false ones.

Candidates are runs of 16 or more characters of keys with a digit among them, and what is assigned to a name such as
password. The forest sees a candidate's length, how often its kind of character changes, its digits, entropy and alphabet,
how much of it words cover, the path of its document and the words before it. It is trained on labelled findings (the
caller's, or made from templates); the threshold keeps RECALL of the real ones among examples held out.

A null text has no candidates; a null path is empty. Repeated rows have the same findings. An empty table gives no rows.
Texts are searched whole, in linear time. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Tree, forest
from .common import id_again, id_or_none

TREES, DEPTH = 30, 8
SAMPLE, RECALL = 3000, 0.98
AROUND = 32
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_?key)[\"']? ?[:=]=? ?[\"']?([^\s\"']{8,})")
# Words before a candidate that speak for and against a secret, and of paths that speak against one.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential", "access")
AGAINST = ("sha", "md5", "hash", "commit", "checksum", "digest", "uuid", "guid", "version", "revision", "etag", "id", "isbn")
PLAIN_PATHS = ("test", "example", "doc", "fixture", "sample", "mock", "lock")
# Common pieces of words; coverage by them tells names from random characters.
PIECES = ("the", "and", "ing", "ion", "ent", "for", "get", "set", "name", "user", "file", "data", "list", "type", "value", "test", "time", "code", "path", "load", "read", "write", "class", "index", "order", "table", "page", "with", "from", "that", "this", "ver", "con", "pre", "ment", "able", "ter", "est", "example")
_PIECE = re.compile("|".join(sorted(PIECES, key=len, reverse=True)))
FEATURES = ("length", "transitions", "digits", "upper", "entropy", "hexadecimal", "covered", "longest_run", "distinct", "assigned", "for", "against", "plain_path", "uuid")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, by place; overlapping ones are one, their union."""
    found = [m.span() for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0])] + [m.span(1) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        else:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
    return out


def features(text: str, before: str, path: str) -> list[float]:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in text]
    counts, n, low = Counter(text), len(text), text.lower()
    near, words = before.lower(), re.findall("[a-z0-9]+", before.lower())[-4:]
    longest = run = 1
    for a, b in zip(text, text[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    p = np.array(list(counts.values())) / n
    return [
        n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, kinds.count("d") / n, kinds.count("u") / n, float(-(p * np.log2(p)).sum()), bool(re.fullmatch("[0-9a-fA-F-]+", text)),
        sum(len(m) for m in _PIECE.findall(low)) / n, longest, len(counts) / n, bool(re.search(r"[:=]\s*[\"']?$", near)), sum(any(f in w for f in FOR) for w in words), sum(any(w.startswith(a) for a in AGAINST) for w in words),
        any(x in path.lower() for x in PLAIN_PATHS), bool(re.fullmatch("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", text)),
    ]


def examples(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings made from templates: candidate, text before it, path, 1 for a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    letters, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    every = letters + letters.upper() + "0123456789"
    prose = lambda: " ".join(chars(letters, rng.integers(2, 9)) for _ in range(3))
    name = lambda: pick((str.lower, str.title))("".join(pick(PIECES) for _ in range(rng.integers(3, 6))))
    out = []
    for k in range(n):
        real = k % 2
        path = pick(("src0", "src7", "app/main", "config/prod", "lib/auth"))
        if real:
            text = pick((lambda: chars(hexa, pick((32, 40, 64))), lambda: "AKIA" + chars(every.upper(), 16), lambda: chars(every, rng.integers(20, 48)), lambda: chars(every + "+/", 40) + pick(("", "=", "==")), lambda: "sk_" + chars(every, 24), lambda: chars(every + "!#%&*", rng.integers(9, 18))))()
            before = f"{prose()} {pick(('token', 'secret', 'password', 'api_key', 'auth_token', 'client_secret', 'access key'))}{pick((' = ', ': ', '=', ' := '))}{pick(('', chr(34), chr(39)))}"
        else:
            what = rng.integers(6)
            u = chars(hexa, 32)
            text = (chars(hexa, pick((32, 40, 64))), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", name() + chars("0123456789", rng.integers(1, 4)) + name(), chars("0123456789", rng.integers(16, 20)), pick("xX0aA*-=") * int(rng.integers(16, 33)) + chars("0123456789", 1), f"{name()}/{name()}-{chars('0123456789', 2)}")[what]
            before = f"{prose()} {pick(('sha256', 'commit', 'checksum', 'md5 of', 'uuid', 'revision', 'id', 'etag'))}{pick((' = ', ': ', ' ', '='))}{pick(('', chr(34)))}" if what < 2 else f"{prose()} {pick(('', 'in ', 'of ', 'token = ', 'name: '))}"
            if what < 2 and rng.random() < 0.2:
                before, path = f"{prose()} token = ", pick(("tests/data", "docs/example", "fixtures/mock"))
        out.append((text, before[-AROUND:], path, real))
    return out


@lru_cache(4)
def model(labelled: tuple | None = None) -> tuple[list[Tree], float]:
    """The forest and the score from which a candidate is a secret; every fourth finding is held out for the latter."""
    rows = list(labelled) if labelled else examples()
    x, y = np.array([features(*r[:3]) for r in rows], float), np.array([r[3] for r in rows])
    held = np.arange(len(rows)) // 2 % 4 == 0
    trees = forest(x[~held], y[~held], trees=TREES, depth=DEPTH)
    real = np.sort(score(trees, x[held & (y == 1)]))
    return trees, float(min(real[int((1 - RECALL) * len(real))], 0.5)) if len(real) else 0.5


def score(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.apply(x) for t in trees], axis=0)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: tuple | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (array of start, end, score) for each row of docs.

    labelled: a bounded sample of (candidate, text before it, path, 0 or 1) to train on instead of the examples.
    """
    trees, least = model(labelled)  # a few hundred KB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [candidates(t or "") for t in b["_t"]]
            x = [features(t[s:e], t[max(0, s - AROUND) : s], p or "") for t, p, spans in zip(b["_t"], b["_p"], found, strict=True) for s, e in spans]
            scores = iter(score(trees, np.array(x, float)).tolist() if x else [])
            out = []
            for i, spans in zip(b["_id"], found, strict=True):
                kept = [{"start": s, "end": e, "score": v} for (s, e), v in zip(spans, scores) if v >= least]
                out.append((int(i), len(spans), len(kept), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_candidates", "n_secrets", "secrets"])

    rows = docs.select(id_or_none(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t"), F.col(path_col).cast("string").alias("_p"))
    return rows.mapInPandas(run, "doc_id bigint, n_candidates bigint, n_secrets bigint, secrets array<struct<start:bigint,end:bigint,score:double>>").withColumn("doc_id", id_again(F.col("doc_id")))
