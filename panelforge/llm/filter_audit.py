"""Operator 13: filter interaction audit by exact constrained least squares.

Each document has a failure mask, a bit for each filter. Per part the masks are
counted; every one of the 32 coalitions of five filters then has its removal,
the rows whose mask meets it, and so has each label. A step of an order removes
the difference of two coalitions. A filter's Shapley value is the solution of
the kernel-weighted least squares fit of an additive game to the coalition
removals, constrained so that the shares add up to the removal of all filters;
the normal equations are solved in rationals, so it is exact.

Scale: texts are read once and become narrow rows (digest, mask, id). Copies of
a text share their mask, so the duplicate filter needs no join back to the
rows: counts by digest and the least id give how many copies it removes. Each
grouping combines before its shuffle, so a hot text sends one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.common import SPACE, SPACE_CHARS, read

FILTERS = "ABCDE"
#: Keys over which rows without an id are dealt where they meet the labels.
SALTS = 4096


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    counts = F.transform(F.array(F.split(trimmed, SPACE + "+")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    n, distinct = (F.when(trimmed == "", 0).otherwise(F.get(counts, 0)[c]) for c in ("n", "distinct"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails))


def shapley(removed: list[int], n: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of a game on ``n`` players, from the value of each coalition (a bit mask).

    Minimises the kernel-weighted squares of value less sum of shares over the
    proper coalitions, subject to the shares adding up to the value of all. With
    the multiplier as a further unknown that is one linear system.
    """
    size = n + 1
    a = [[Fraction(0)] * (size + 1) for _ in range(size)]
    for s in range(1, (1 << n) - 1):
        k = s.bit_count()
        weight = Fraction(n - 1, comb(n, k) * k * (n - k))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            for j in inside:
                a[i][j] += weight
            a[i][size] += weight * (removed[s] - removed[0])
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    a[n][size] = Fraction(removed[-1] - removed[0])
    for c in range(size):  # Gauss-Jordan
        pivot = next(r for r in range(c, size) if a[r][c])
        a[c], a[pivot] = a[pivot], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(size):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c], strict=True)]
    return [row[size] for row in a[:n]]


def steps(part: str, total: int, removed: list[int], good: list[int], toxic: list[int], filters: str = FILTERS) -> Iterator[tuple]:
    """A row for each order and step, from the coalition tables of one part."""
    n = len(filters)
    everyone = (1 << n) - 1
    shares = [x * factorial(n) for x in shapley(removed, n)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                part, "".join(filters[j] for j in order), step, total - removed[after], here, removed[1 << i] - here,
                removed[everyone] - removed[everyone ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(shares[i]),
            )
            before = after


ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows, and labelled rows, of each failure mask of each part.

    E, 16 in the mask: a smaller ``doc_id`` has the identical text. A row
    without an id is no larger than any, and no row is larger than it.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = narrow.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "salt": F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0)})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max(F.coalesce((F.col(c) == 1), F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")])
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]
    key = ["digest", "part", "mask", "quality", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = rows.select("digest", "part", "mask", "doc_id", "n", *flags).groupBy(*key).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    # one row for each part and label of a text from here on
    firsts = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct(*key[1:], "n", "least", "free")).alias("g"))
    each = firsts.select("first", F.explode("g").alias("g")).select("first", "g.*")
    stays = F.col("free") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = each.select("part", "quality", "toxic", F.explode(F.array(F.struct(F.col("mask"), stays.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stays).alias("n")))).alias("m"))
    n = F.col("m.n")
    return split.groupBy("part", "m.mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("quality")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def coalitions(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """``(part, total, removed, good, toxic)``; the arrays have a place for each coalition of filters."""
    table = [F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in range(1 << filters)]).alias(a) for c, a in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *table)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the five filters, by part; an empty table gives no part.

    Null texts count as empty, null langs as the part ''. Repeated rows count
    each; E doesn't remove a row that repeats an id and its text. Of rows that
    repeat a label's id, any mark counts. Other columns are ignored.
    """

    def expand(frames):
        names = [c.split()[0] for c in ROW.split(", ")]
        for frame in frames:
            yield pd.DataFrame([r for p in frame.itertuples(index=False) for r in steps(p.part, p.total, *[[int(x) for x in v] for v in (p.removed, p.good, p.toxic)])], columns=names)

    return coalitions(masks(docs, labels)).mapInPandas(expand, ROW)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Counts of five filters in all 120 orders, by language, with Shapley values."""
    return audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
