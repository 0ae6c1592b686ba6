"""Personal data: base patterns, high-recall generators, and boosted trees with calibrated thresholds that choose what to add.

Base spans (email, ip, card, phone) are found by fixed rules and always stay. Generators propose more spans of the same
kinds that may overlap them and each other: spelt-out addresses, bracketed dots, grouped card numbers, telephone numbers
without a country code. Boosted trees score each proposal by its format and the words around it; one that reaches its kind's
threshold, calibrated to PRECISION on labelled examples held out from training, and overlaps no base span, is added. Of two
proposals that overlap and are next to each other in order, the one of higher score stays, of equals the earlier.

Everything on the way of the data is SQL functions. The trees are trained on the driver from SAMPLE labelled examples (made
from templates, or the caller's own) and become a constant table in an expression.

A null text is empty and has no spans. Repeated rows have the same spans. An empty table gives no rows. Positions are code
points, ends exclusive. A text is searched whole; repetitions in the patterns are possessive, so that long runs of letters or
digits cost linear time and no stack.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import boost, sum_of_trees, threshold

KINDS = ("email", "ip", "card", "phone")
# The base patterns; (?<!x)|\G lets a match begin only where a longer one to its left can't, and changes no match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the generators propose, by kind; each has no more repetitions than the bounds it states.
PROPOSE = {
    "email": r"(?i)[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[0-9]{1,3}[ .-]|\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: A proposal is looked for only in texts that hold this.
HINT = {"email": r"(?i)[ (\[{]at[ )\]}]", "ip": r"[0-9] ?[(\[]", "card": r"[0-9]{4}[ ./_-]", "phone": r"[0-9][) .-]"}
#: Words before a span that speak for a kind, in the languages of the examples.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "addr", "login", "gateway", "serveur", "servidor"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta", "mastercard"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "anruf", "appel", "llam", "ring"),
}
AROUND = 40
PRECISION = 0.99
SAMPLE, TREES, DEPTH = 4000, 30, 3
#: Spans whose places are summed at once.
CHUNK = 256
FEATURES = ("kind", "length", "digits", "letters", "spaces", "dots", "dashes", "brackets", "luhn", "own_words", "other_words", "number_before", "number_after", "same_digits")


def bound(x: Column, f) -> Column:
    """f of x, which is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def places(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): start, end and match of each leftmost non-overlapping match."""
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)")

    def of(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, bound(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"), m.alias("m"))), summed)).otherwise(none)

    def summed(x: Column) -> Column:
        # running sums by chunks, so that a text of very many matches costs their number times CHUNK at most
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK)))
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v["g"] + v["l"])
        begins = lambda cs: F.aggregate(cs, F.expr("array(0)"), lambda a, c: F.array_append(a, F.element_at(a, -1) + total(c)))
        spans = lambda c, at: F.aggregate(
            c, F.struct(at.alias("at"), none.alias("out")),
            lambda a, v: F.struct((a["at"] + v["g"] + v["l"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + v["g"]).alias("s"), (a["at"] + v["g"] + v["l"]).alias("e"), v["m"].alias("m"))).alias("out")),
            lambda a: a["out"],
        )
        return bound(chunks, lambda cs: F.flatten(F.zip_with(cs, F.slice(begins(cs), 1, F.size(cs)), spans)))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, k: bound(d.cast("int") * (1 + k % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return bound(digits(m), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    holds = F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else F.rlike(text, F.lit("[0-9]"))
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)")
    return F.when(holds, F.filter(places(text, BASE[kind]), lambda x: valid(kind, x["m"]))).otherwise(none)


def features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES of a proposal, from its text and the lower-cased text around it."""
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    word = lambda k: r"(?<![a-z])(?:" + "|".join(CONTEXT[k]) + ")"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(float(KINDS.index(kind))), F.length(m).cast("double"), count(m, "[0-9]"), count(m, "[A-Za-z]"), count(m, " "), count(m, r"\."), count(m, "-"), count(m, r"[()\[\]{}]"),
        flag(bound(digits(m), lambda d: (F.length(d) > 11) & luhn(d))), count(before, word(kind)), count(before, "|".join(word(k) for k in KINDS if k != kind)),
        flag(F.rlike(before, F.lit(r"[0-9][ .,;/-]*$"))), flag(F.rlike(after, F.lit(r"^[ .,;/-]*[0-9]"))), flag(F.rlike(digits(m), F.lit(r"^([0-9])\1*$"))),
    ]


def _features_of(kind: str, m: str, before: str, after: str) -> list[float]:
    """features() for training."""
    words = lambda k: len(re.findall(r"(?<![a-z])(?:" + "|".join(CONTEXT[k]) + ")", before))
    d = re.sub("[^0-9]", "", m)
    total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
    count = lambda p: len(re.findall(p, m))
    return [
        KINDS.index(kind), len(m), count("[0-9]"), count("[A-Za-z]"), count(" "), count(r"\."), count("-"), count(r"[()\[\]{}]"), len(d) > 11 and total % 10 == 0, words(kind), sum(words(k) for k in KINDS if k != kind),
        bool(re.search(r"[0-9][ .,;/-]*$", before)), bool(re.search(r"^[ .,;/-]*[0-9]", after)), bool(re.search(r"^([0-9])\1*$", d)),
    ]


def examples(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled proposals made from templates: kind, match, lower-cased text before and after, 1 for personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    name = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(3, 9)))
    prose = lambda: " ".join(name() for _ in range(4))
    noise = {  # words that go with numbers and phrases that are not personal data
        "email": ("look", "was", "stay", "arrived", "sold"), "ip": ("version", "section", "step", "release", "figure"), "card": ("isbn", "order", "serial", "batch", "part"), "phone": ("score", "pages", "years", "range", "table"),
    }
    out = []
    for k in range(n):
        kind, real = KINDS[k % 4], int(rng.random() < 0.5)
        before = f"{prose()} {pick(CONTEXT[kind]) + pick((':', '', ' me')) if real and rng.random() < 0.9 else pick(noise[kind]) if rng.random() < 0.7 else name()} "
        after = f" {prose()}"
        if kind == "email":
            at, dot = pick(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))) if real else (" at ", pick((" dot ", "[dot]")))
            m = f"{name()}{pick(('.', '', '_'))}{name() if real else ''}{at}{name()}{dot}{pick(('com', 'org', 'net', 'de')) if real else name()}"
        elif kind == "ip":
            dot = pick(("[.]", "(.)", "[dot]"))
            m = dot.join(str(rng.integers(1, 256) if real else rng.integers(0, 999)) for _ in range(4))
        elif kind == "card":
            sep = pick((".", "  ", " - ", "/", "_")) if real else pick((".", "/", "_", "-"))
            d = pick("3456") + num(14) if real else num(15)
            d = next(d + str(c) for c in range(10) if bool(_features_of("card", d + str(c), "", "")[8]) == bool(real))
            m = sep.strip().join(d[i : i + 4] for i in range(0, 16, 4)) if sep.strip() else sep.join(d[i : i + 4] for i in range(0, 16, 4))
        else:
            sep = pick((" ", ".", "-"))
            m = pick((f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0049{sep}{num(4)}{sep}{num(4)}")) if real else pick((f"{num(4)}{sep}{num(4)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(3)}", f"{num(2)}{sep}{num(3)}{sep}{num(3)}"))
            if not real and rng.random() < 0.5:
                before, after = before + num(2) + sep, sep + num(3) + after
        out.append((kind, m, before[-AROUND:], after[:AROUND], real))
    return out


@lru_cache(4)
def model(labelled: tuple | None = None):
    """start, trees and a threshold (log-odds) for each kind; half of the labelled examples train, half calibrate."""
    rows = list(labelled) if labelled else examples()
    x, y = np.array([_features_of(*r[:4]) for r in rows], float), np.array([r[4] for r in rows], float)
    train = np.arange(len(rows)) // 4 % 2 == 0
    start, trees = boost(x[train], y[train], trees=TREES, depth=DEPTH)
    odds = start + sum(t.apply(x) for t in trees)
    cut = {k: threshold(odds[~train & (x[:, 0] == i)], y[~train & (x[:, 0] == i)], PRECISION) for i, k in enumerate(KINDS)}
    return start, trees, cut


def proposals(text: Column, kind: str, base: Column, labelled: tuple | None) -> Column:
    """Array of (s, e, o) of the kind's proposals that pass its threshold; o is the score."""
    start, trees, cut = model(labelled)
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,o:double>>)")

    def score(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["s"] - AROUND, F.lit(0)) + 1, F.least(x["s"], F.lit(AROUND))))
        after = F.lower(F.substring(text, x["e"] + 1, F.lit(AROUND)))
        odds = bound(F.array(*features(kind, x["m"], before, after)), lambda f: sum_of_trees(start, trees, DEPTH, f))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), odds.alias("o"))

    apart = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    found = F.filter(F.transform(F.filter(places(text, PROPOSE[kind]), apart), score), lambda x: x["o"] >= F.lit(min(cut[kind], 1e9)))
    return F.when(F.rlike(text, F.lit(HINT[kind])), found).otherwise(none)


def _named(kind: str, *more: str):
    """A function of a span (s, e, ...) to (start, rank, end, kind, ...)."""
    return lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), *[x[c].alias(c) for c in more])


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: tuple | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (start, rank of kind, end, kind), in that order.

    labelled: (kind, match, text before, text after, 0 or 1) of a bounded sample to train on instead of the examples.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    digit = F.rlike(F.col("_t"), F.lit("[0-9]"))
    base = F.array_sort(F.concat(*[F.transform(base_spans(F.col("_t"), k), _named(k)) for k in KINDS]))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")
    rows = rows.withColumn("base", F.when(digit | F.contains(F.col("_t"), F.lit("@")), base).otherwise(none))

    def added(b: Column) -> Column:
        flat = F.transform(b, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))
        every = F.array_sort(F.concat(*[F.transform(proposals(F.col("_t"), k, flat, labelled), _named(k, "o")) for k in KINDS]))
        over = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
        lost = lambda v, x, k: F.coalesce(over(x, F.get(v, k - 1)) & (F.get(v, k - 1)["o"] >= x["o"]), F.lit(False)) | F.coalesce(over(x, F.get(v, k + 1)) & (F.get(v, k + 1)["o"] > x["o"]), F.lit(False))
        kept = bound(every, lambda v: F.filter(v, lambda x, k: ~lost(v, x, k)))
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind")]))

    return rows.select("doc_id", "base", bound(F.col("base"), added).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans replaced by its kind in angle brackets; overlapping spans are one, named by the first."""
    piece = lambda a, x: F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(a["out"])
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, x: F.struct(piece(a, x).alias("out"), F.greatest(a["at"], x["end"]).alias("at")), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _equals(k: int):
    return lambda x: x == k


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of what find_personal_data() gives."""
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.transform("base", lambda x: x["rank"]), _equals(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
