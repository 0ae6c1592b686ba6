"""Language identification by rank-order profiles of character n-grams.

A language's profile is its PROFILE most frequent n-grams in order; a document's profile is made alike from its whole text.
The out-of-place distance adds, for each n-gram of the document, how far its rank is from that in the language's profile,
and PROFILE where the language lacks it. The language of least distance is predicted; ties go to the first by name. The
score is 1 - distance / (PROFILE * n-grams of the document).

N-grams have one to four characters and lie within lower-cased words of letters, with a mark at either end of the word.
Equal counts are ordered by the n-gram's hash. Profiles are learnt from at most about TRAIN_DOCS labelled documents of each
language, chosen by a hash of the id from all of them. Every document is scored against every language; profiles travel to
the executors in blocks of at most BLOCK languages.

A null text, or one without letters, is `und` with score 0, and so is every text if there are no labelled documents. Null
labels are not learnt from. A null id is hashed as an empty one. Repeated rows are scored each for itself. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, written

PROFILE = 400
GRAMS = (1, 2, 3, 4)
#: Labelled documents of a language that its profile is learnt from, about.
TRAIN_DOCS = 3000
#: Languages that are scored at once.
BLOCK = 256
#: Languages of which the sampling shares are sent to every task.
BROADCAST_LANGUAGES = 10_000
#: Words whose n-grams a worker remembers, and n-grams it counts before it hands them on.
REMEMBER, HOLD = 200_000, 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


class Grams:
    """Hashes of the n-grams of texts."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}  # an array for each word would take twice the memory

    def of_word(self, word: str) -> bytes:
        w = f"_{word}_"
        got = (w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))
        return np.array([xxhash.xxh3_64_intdigest(g.encode()) for g in got if g != "_"], np.uint64).tobytes()

    def of_text(self, text: str | None) -> np.ndarray | None:
        """The n-grams of all words, with repeats; None if there are no letters."""
        words = _WORD.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return None
        if len(self.known) > REMEMBER:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self.of_word(w)
        return np.frombuffer(b"".join([known[w] for w in words]), np.uint64)


def ranked(grams: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; equal counts by hash."""
    each, counts = np.unique(grams, return_counts=True)
    return each[np.argsort(-counts, kind="stable")[:most]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = TRAIN_DOCS) -> DataFrame:
    """lang, gram (hash), rank from 0: the profile of each language of the labelled documents."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_t"), F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 30)).alias("_u")).filter("lang IS NOT NULL AND _t IS NOT NULL")
    share = labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*") * (1 << 30)).alias("_below"))
    share = written(share, "shares")
    if share.count() <= BROADCAST_LANGUAGES:  # else a join by language, which moves the labelled texts
        share = F.broadcast(share)
    sample = labelled.join(share, "lang").filter("_u < _below").select("lang", "_t")

    @alone
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, held = Grams(), Counter()
        for b in batches:
            for lang, text in zip(b["lang"], b["_t"], strict=True):
                if (got := grams.of_text(text)) is not None:
                    each, counts = np.unique(got, return_counts=True)
                    held.update(dict(zip(((lang, g) for g in each.view(np.int64).tolist()), counts.tolist(), strict=True)))
                if len(held) > HOLD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    def rows(held: Counter) -> pd.DataFrame:
        return pd.DataFrame([(lang, g, n) for (lang, g), n in held.items()], columns=["lang", "gram", "n"]).astype({"gram": "int64", "n": "int64"})

    counts = sample.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ties as ranked() has them: by the hash without a sign
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < PROFILE).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and distance; profiles as learn() gives them."""
    profiles = written(profiles.withColumn("_no", F.dense_rank().over(Window.orderBy("lang")) - 1), "profiles")
    languages = profiles.agg(F.max("_no")).first()[0]
    blocks = (0 if languages is None else languages) // BLOCK + 1
    out = docs
    for k in range(blocks):
        some = profiles.filter((F.col("_no") >= k * BLOCK) & (F.col("_no") < (k + 1) * BLOCK)).orderBy("lang", "rank").collect()  # at most BLOCK * PROFILE rows
        best = _scorer(some)(F.col(text_col))
        out = out.withColumn("_best", best if k == 0 else F.when(best["score"] > F.col("_best")["score"], best).otherwise(F.col("_best")))
    return out.withColumns({c: F.col("_best")[c] for c in ("lang_pred", "score", "distance")}).drop("_best")


def _scorer(profile: list):
    """A vectorised function of texts to the best of the profile's languages."""
    langs = sorted({r["lang"] for r in profile})
    all_grams = np.unique(np.array([r["gram"] for r in profile], np.int64).view(np.uint64)) if profile else np.zeros(0, np.uint64)
    ranks = np.full((len(all_grams) + 1, max(1, len(langs))), 1 << 20, np.int32)  # the last row: n-grams of no language
    if profile:
        at = np.searchsorted(all_grams, np.array([r["gram"] for r in profile], np.int64).view(np.uint64))
        ranks[at, [langs.index(r["lang"]) for r in profile]] = [r["rank"] for r in profile]

    @F.pandas_udf("lang_pred string, score double, distance bigint")
    @alone
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for s in texts:
            out = []
            for t in s:
                got = grams.of_text(t) if langs else None
                if got is None:
                    out.append((UNKNOWN, 0.0, None))
                    continue
                top = ranked(got)
                at = np.searchsorted(all_grams, top)
                at = np.where((at < len(all_grams)) & (all_grams[np.minimum(at, len(all_grams) - 1)] == top), at, len(all_grams))
                r = ranks[at]
                away = np.where(r == 1 << 20, PROFILE, np.abs(r - np.arange(len(top), dtype=np.int32)[:, None])).sum(0)
                k = int(away.argmin())
                out.append((langs[k], 1 - float(away[k]) / (PROFILE * len(top)), int(away[k])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "distance"]).astype({"distance": "Int64"})

    return score


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance, learnt from the labelled documents that are not held out."""
    out = held_out(F.col(id_col))
    profiles = learn(docs.filter(~out), text_col=text_col, lang_col=lang_col, key_col=id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), out.alias("held_out"))
    return predict(rows, profiles, text_col="_t").select("doc_id", "held_out", "lang_pred", "score", "distance")
