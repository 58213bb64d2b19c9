"""Operator 6: personal data by proposed spans, checksums and context.

Regular expressions propose spans; validators (Luhn, mod-97, ranges, digit
counts) confirm them; words shortly before a span adjust its score. DataFrame
functions only: one narrow scan of whole texts, no shuffle. The patterns use
possessive and anchored forms, so matching is linear in a text's length; places
cost n * sqrt(n) number copies for n matches (``spans``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm import spans
from panelforge.llm.common import read


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Luhn's checksum over the digits of a match."""
    d = digits(match)
    values = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 7064 mod 97-10, as bank account numbers use it."""
    moved = F.concat(F.substring(match, 5, 64), F.substring(match, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def octets(match: Column) -> Column:
    """Every dotted part at most 255, leading zeros allowed."""
    return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits(match)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``words`` before a span raise its score."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    score: int
    words: str


#: The first four are the base kinds, in order.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 90, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", octets, 60, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", lambda m: between(13, 19)(m) & luhn(m), 80, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", between(9, 15), 60, "tel|phone|call|fax"),
)
MORE = (Kind("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", mod97, 80, "iban|account|bank|konto"),)
KINDS = BASE + MORE
#: Characters before a span that count as its context, and what a context word adds to a score of at most 100.
CONTEXT = 40
ADDED = 15


def _confirmed(kind: Kind):
    return lambda span: kind.valid(span["match"])


def _scored(kind: Kind):
    def run(span: Column, context: Column) -> Column:
        score = F.when(F.lower(context).rlike(kind.words), kind.score + ADDED).otherwise(kind.score)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), score.alias("score"))

    return run


def _in_context(text: Column, kind: Kind):
    return lambda found: spans.before(text, CONTEXT, found, _scored(kind))


def find(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Confirmed spans with a ``score``, kind by kind and by start; none for a null text."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,score:int>>")
    parts = []
    for k in kinds:
        found = F.filter(spans.find(text, k.name, k.pattern), _confirmed(k))
        scored = spans.let(found, _in_context(text, k))
        parts.append(F.when(text.rlike(k.hint), scored).otherwise(empty))
    return F.coalesce(F.concat(*parts), empty)


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    """Spans of every document; null and empty texts have none, null ids and repeated rows get a row each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = docs.select("doc_id", find(F.col("text")).alias("found"))
    base = [k.name for k in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(spans.joined(F.filter("found", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
