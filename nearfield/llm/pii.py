"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans: the base patterns, and wider ones for written-out or unchecked
forms. Five labelers vote on each span (pattern check, gazetteer, words before it, its
borders, its shape). The votes are counted by pattern of votes over all documents, a
table of bounded size; expectation-maximisation on it estimates how reliable each labeler
is, and the resulting soft labels train a small logistic span classifier, which is applied
as one more expression. Base spans always stay; the classifier decides about the others."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import bounded_rows, stage

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Possessive loops and the start condition give the same matches as the
# plain forms, without going back over long runs of letters or digits. Runs of fewer than 14
# digits can be no card, from no digit of theirs, so they are not listed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, and a piece of text without which they cannot match.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+).-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}

# Fixed values of the gazetteers.
DOMAINS = "com org net edu gov io info biz eu de fr es it uk us ca jp cn ru br in nl pl pt ch at se no"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 98"
FOR = r"(?i)\b(?:e-?mail|mail|contact|phone|telephone|tel|call|fax|mobile|cell|card|visa|credit|payment|server|host|address|ip|telefon|handy|karte|correo|tarjeta|courriel|carte)\b"
AGAINST = r"(?i)\b(?:version|ver|isbn|issn|order|invoice|page|figure|fig|table|section|chapter|ref|sku|doi)\b"

LABELERS = 5
#: Patterns of kind, votes and features that can occur at most; the table of counts is fetched.
MAX_PATTERNS = 4 * 3**LABELERS * 32
ROUNDS = 30
#: Spans of a text that are placed or compared together, so that the work for a text grows
#: with its spans and not with their square.
BLOCK = 256


def length_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def luhn(digits: Column) -> Column:
    """Checksum over the digits from the right, every second one doubled."""

    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: _small(part) <= 255)
    if kind == "card":
        digits = F.regexp_replace(found, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return length_digits(found).between(10, 15)
    return F.lit(True)


def _small(part: Column) -> Column:
    """A part of at most three digits after its leading zeros, as a number."""
    bare = F.ltrim(part, F.lit("0"))
    return F.when(F.length(bare) == 0, 0).when(F.length(bare) <= 3, bare.try_cast("int")).otherwise(999)


def blocks(spans: Column) -> Column:
    """An array cut into arrays of at most ``BLOCK``."""
    starts = F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK))
    return F.when(F.size(spans) > 0, F.transform(starts, lambda at: F.slice(spans, at, BLOCK))).otherwise(F.transform(F.slice(spans, 1, 0), lambda s: F.array(s)))


def positioned(found: str, gaps: str) -> Column:
    """Matches with their places in code points and the text around them.

    The pieces between matches give the places: a match starts where the pieces and
    matches before it end. Places are summed inside blocks of matches first and shifted by
    the blocks before."""
    pairs = F.transform(
        F.col(found),
        lambda m, i: F.struct(
            m.alias("m"),
            F.length(F.element_at(F.col(gaps), i + 1)).cast("long").alias("gap"),
            F.right(F.element_at(F.col(gaps), i + 1), F.lit(32)).alias("left"),
            F.left(F.element_at(F.col(gaps), i + 2), F.lit(2)).alias("right"),
        ),
    )
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint, m: string, left: string, right: string>>)").alias("out"),
    )

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("m"), pair["left"].alias("left"), pair["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def shifted(local: Column) -> Column:
        ahead = F.aggregate(local, F.array(F.lit(0).cast("long")), lambda sums, block: F.concat(sums, F.array(F.element_at(sums, -1) + block["at"])))

        def move(block: Column, shift: Column) -> Column:
            return F.transform(
                block["out"],
                lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"), s["m"].alias("m"), s["left"].alias("left"), s["right"].alias("right")),
            )

        return F.flatten(F.zip_with(local, F.slice(ahead, F.lit(1), F.size(local)), move))

    return bound(bound(pairs, lambda p: F.transform(blocks(p), lambda block: F.aggregate(block, start, add))), shifted)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def apart(wide: Column, base: Column) -> Column:
    """The wide spans that meet no base span. Base spans are looked up by block: only those
    of a block that reaches the span are compared with it."""

    def reached(block: Column) -> Column:
        return F.struct(F.array_min(F.transform(block, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(block, lambda b: b["end"])).alias("hi"), block.alias("spans"))

    def free(held: Column) -> Column:
        def meets(w: Column) -> Column:
            inside = lambda k: (k["lo"] < w["end"]) & (w["start"] < k["hi"])
            return F.exists(held, lambda k: F.when(inside(k), F.exists(k["spans"], lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))).otherwise(False))

        return F.filter(wide, lambda w: ~meets(w))

    return F.when((F.size(wide) == 0) | (F.size(base) == 0), wide).otherwise(bound(F.transform(blocks(F.sort_array(base)), reached), free))


def votes(kind: str, span: Column, base: bool) -> list[Column]:
    """What each labeler says of a span: 1, -1, or 0 for nothing."""
    found, left, right = span["m"], span["left"], span["right"]
    strict = F.lit(1) if base else (F.when(length_digits(found) == 10, 0).otherwise(-1) if kind == "phone" else F.lit(0))
    if kind == "email":
        listed = F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)
        gazetteer = F.when(F.lower(listed).isin(*DOMAINS.split()), 1).otherwise(0)
        shape = F.when(F.length(found) <= 64, 1).otherwise(-1)
    elif kind == "card":
        gazetteer = F.when(found.rlike(r"^(?:3[47]|4|5[1-5]|2[2-7]|6)"), 1).otherwise(-1)
        shape = F.when(found.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), 1).otherwise(-1)
    elif kind == "ip":
        gazetteer = F.when(found.rlike(r"^(?:0+|127|255)\."), -1).otherwise(1)
        shape = F.when(found.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1)
    else:
        code = "|".join(COUNTRY_CODES.split())
        gazetteer = F.when(found.rlike(rf"^\+(?:{code})[\x20(.-]"), 1).otherwise(0)
        shape = F.when(found.rlike(r"[0-9]{3}[\x20.)-]\x20?[0-9]{3}[\x20.-][0-9]{4}$"), 1).otherwise(0)
    context = F.when(left.rlike(AGAINST), -1).when(left.rlike(FOR), 1).otherwise(0)
    borders = F.when(left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(1)
    return [strict, gazetteer, context, borders, shape]


def features(span: Column) -> Column:
    """Five bits of the span itself: length, separators, a plus, brackets."""
    found = span["m"]
    bits = [F.length(found) > 12, F.length(found) > 18, found.rlike(r"[\x20-]"), found.rlike(r"^\+"), found.rlike(r"[\[(]")]
    total = F.lit(0)
    for i, bit in enumerate(bits):
        total = total + bit.cast("int") * (1 << i)
    return total


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and an array of candidate spans (start, kind, end, base, votes, bits) of every
    document. ``votes`` is a number in base three."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    guards = {"email": F.contains("text", F.lit("@")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True), "phone": F.contains("text", F.lit("+"))}
    wide_guards = {
        "email": F.col("text").rlike(r"[\[(]at[\])]"),
        "phone": F.col("text").rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    }
    none = F.expr("cast(array() as array<string>)")
    plans = [(kind, True, BASE[kind], guards[kind]) for kind in KINDS] + [(kind, False, WIDE[kind], wide_guards[kind]) for kind in WIDE]
    names = [f"{kind}_{'base' if base else 'wide'}" for kind, base, _, _ in plans]
    found = table.select(
        "doc_id",
        "text",
        *(F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(n) for n, (_, _, pattern, guard) in zip(names, plans)),
    )
    cut = found.select(
        "doc_id",
        *names,
        *(F.when(F.size(n) > 0, F.split("text", pattern, -1)).otherwise(none).alias(f"{n}_gaps") for n, (_, _, pattern, _) in zip(names, plans)),
    )
    placed = cut.select("doc_id", *(positioned(n, f"{n}_gaps").alias(n) for n in names))

    def spans(name: str, kind: str, base: bool) -> Column:
        checked = F.filter(F.col(name), lambda s: valid(kind, s["m"])) if base else F.col(name)

        def one(s: Column) -> Column:
            code = F.lit(0)
            for vote in votes(kind, s, base):
                code = code * 3 + (vote + 1)
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"),
                code.alias("votes"), features(s).alias("bits"),
            )

        return F.transform(checked, one)

    parts = placed.select("doc_id", *(spans(n, kind, base).alias(n) for n, (kind, base, _, _) in zip(names, plans)))
    wide = F.concat(*(F.col(n) for n in names if n.endswith("wide")))
    base = F.concat(*(F.col(n) for n in names if n.endswith("base")))
    both = parts.select("doc_id", base.alias("base"), wide.alias("wide"))
    return both.select("doc_id", F.sort_array(F.concat("base", apart(F.col("wide"), F.col("base")))).alias("spans"))


def unpacked(code: np.ndarray) -> np.ndarray:
    """Votes from their number: one column per labeler with 0, 1, 2 for -1, 0, 1."""
    return np.stack([code // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], 1)


def reliabilities(kind: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability that a span of each pattern is personal data, by expectation-maximisation.

    A labeler's votes are independent given the truth; their rates are shared by the kinds,
    the prior is the kind's own. It starts from the share of votes in favour."""
    vote = unpacked(code)
    belief = (vote.sum(1) / (2 * LABELERS)).clip(0.05, 0.95)
    for _ in range(ROUNDS):
        rate = np.ones((2, LABELERS, 3))
        for j in range(LABELERS):
            rate[1, j] += np.bincount(vote[:, j], n * belief, 3)
            rate[0, j] += np.bincount(vote[:, j], n * (1 - belief), 3)
        rate /= rate.sum(2, keepdims=True)
        mass = np.bincount(kind, n, len(KINDS)) + 2
        prior = (np.bincount(kind, n * belief, len(KINDS)) + 1) / mass
        logit = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(LABELERS):
            logit = logit + np.log(rate[1, j, vote[:, j]] / rate[0, j, vote[:, j]])
        belief = 1 / (1 + np.exp(-logit.clip(-30, 30)))
    return belief


def design(kind: np.ndarray, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inputs of the span classifier: kind, votes for and against, bits of the span."""
    vote = unpacked(code)
    columns = [kind == k for k in range(len(KINDS))]
    columns += [vote[:, j] == v for j in range(LABELERS) for v in (0, 2)]
    columns += [(bits >> b) & 1 == 1 for b in range(5)]
    return np.stack(columns, 1).astype(float)


def classifier(kind: np.ndarray, code: np.ndarray, bits: np.ndarray, n: np.ndarray) -> list[float]:
    """Logistic weights fitted to the soft labels by Newton steps with a small ridge."""
    x, y = design(kind, code, bits), reliabilities(kind, code, n)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        gradient = x.T @ (n * (p - y)) + w
        curvature = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(curvature, gradient)
    return w.tolist()


def span_logit(span: Column, w: list[float]) -> Column:
    total = F.lit(0.0)
    for k in range(len(KINDS)):
        total = total + F.when(span["kind"] == k, w[k]).otherwise(0.0)
    at = len(KINDS)
    for j in range(LABELERS):
        vote = F.floor(span["votes"] / 3 ** (LABELERS - 1 - j)) % 3
        total = total + F.when(vote == 0, w[at]).when(vote == 2, w[at + 1]).otherwise(0.0)
        at += 2
    for b in range(5):
        total = total + F.when(F.shiftright(span["bits"], b) % 2 == 1, w[at + b]).otherwise(0.0)
    return total


def find(documents: DataFrame) -> DataFrame:
    """doc_id and the accepted spans (start, kind, end, base) of every document.

    A null text is empty and has no spans; repeated rows give repeated results; places are
    code points, the end exclusive. Without any candidate the classifier stays neutral and
    adds nothing."""
    staged = stage(candidates(documents), "pii-candidates")
    one = staged.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.bits")
    counted = one.groupBy("kind", "votes", "bits").agg(F.count("*").alias("n"))
    rows = bounded_rows(counted, MAX_PATTERNS, "vote patterns")
    if rows:
        rows = sorted(rows)
        kind, code, bits, n = (np.array([r[k] for r in rows]) for k in ("kind", "votes", "bits", "n"))
        w = classifier(kind, code, bits, n.astype(float))
    else:
        w = [0.0] * (len(KINDS) + 2 * LABELERS + 5)
    assert all(map(math.isfinite, w))
    return staged.select("doc_id", F.filter("spans", lambda s: s["base"] | (span_logit(s, w) > 0)).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
