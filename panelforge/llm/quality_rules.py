"""Operator 8: quality rules as a learned decision list.

Statistics of every whole text come from native columns. Sequential covering
learns from labelled statistics: it grows a conjunction of thresholds for bad
texts, prunes it on held-back rows, removes what it covers, and repeats. The
list becomes one ordered Spark ``when`` expression. DataFrame functions only.

Scale: statistics and the verdict are one narrow scan without a shuffle. For
learning, at most ``SAMPLE`` labelled rows are joined with their statistics and
counted by binned values, so the driver gets at most that many rows of numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.common import SPACE, SPACE_CHARS, read

#: Labelled rows to learn from, bins a statistic, rules, conditions a rule, rows a rule must cover, its least precision.
SAMPLE = 20_000
BINS = 16
RULES = 12
CONDITIONS = 3
COVER = 5
PRECISION = 0.9
#: Statistics that rules may use.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share")


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def window_hashes(w: Column, width: int = 5) -> Column:
    """Hash of each window of ``width`` words, in order."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    one = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(width)])
    return hashes, F.when(F.size("_h") >= width, F.transform(F.sequence(F.lit(0), F.size("_h") - width), one)).otherwise(F.array().cast("array<bigint>"))


def covered(places: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` that begin at the given ascending places."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def repeated_places(hashes: Column) -> Column:
    """Ascending places of the values that occur twice or more; linear but for one sort."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda p, i: ((F.get(F.col("_p"), i - 1)["h"] == p["h"]) & (i > 0)) | F.coalesce(F.get(F.col("_p"), i + 1)["h"] == p["h"], F.lit(False))
    return pairs, F.array_sort(F.transform(F.filter("_p", near), lambda p: p["i"]))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper in place of its text.

    Null texts count as empty. Every count is over the whole text. Columns with
    the names that are added or used inside are dropped first; repeated rows
    stay.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "_w", "_h", "_g", "_p", "_at")
    t = docs.withColumn("_t", F.coalesce("text", F.lit(""))).drop("text")
    t = t.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    t = t.select(
        *[c for c in t.columns if c not in ("_t", "_w")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        window_hashes(F.col("_w"))[0].alias("_h"),
    )
    t = t.withColumn("_g", window_hashes(F.col("_h"))[1]).drop("_h")
    # only texts with a repeated window are sorted
    t = t.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), repeated_places(F.col("_g"))[0])).drop("_g")
    t = t.withColumn("_at", F.when(F.col("_p").isNotNull(), repeated_places(F.col("_p"))[1]))
    return t.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(covered(F.col("_at"))).cast("long")).drop("_p", "_at")


def features() -> dict[str, Column]:
    each = lambda x, of: F.col(x) / F.greatest(F.col(of), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": each("word_chars", "n_words"), "symbol_share": each("n_symbols", "n_words"),
        "dup_line_share": each("n_dup_lines", "n_words"), "repeat_share": each("n_repeat_words", "n_words"), "upper_share": each("n_upper", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.bound if self.above else x <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


def _covers(rule: list, row: tuple) -> bool:
    return all((row[f] > b) == above for f, above, b in rule)


def _counts(rule: list, rows: list) -> tuple[int, int]:
    bad = good = 0
    for row, b, g in rows:
        if _covers(rule, row):
            bad += b
            good += g
    return bad, good


def cover(rows: list[tuple[tuple, int, int]], bins: list[int]) -> list[list[tuple]]:
    """Rules for bad rows by sequential covering over binned rows ``(bins, bad, good)``.

    A rule grows by the condition with the largest information gain, then loses
    last conditions while (bad - good) / (bad + good) on held-back rows does
    not fall. It must cover at least ``COVER`` bad rows at ``PRECISION``.
    """
    out: list[list[tuple]] = []
    left = sorted(rows)
    while len(out) < RULES:
        grow, prune = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if not i % 3]
        rule: list[tuple] = []
        while len(rule) < CONDITIONS:
            now = [r for r in grow if _covers(rule, r[0])]
            bad, good = sum(r[1] for r in now), sum(r[2] for r in now)
            if not bad or not good:
                break
            best = (0.0, ())
            for f, top in enumerate(bins):
                tally = [[0, 0] for _ in range(top + 1)]
                for row, b, g in now:
                    tally[row[f]][0] += b
                    tally[row[f]][1] += g
                lo = [0, 0]
                for bound in range(top):
                    lo = [lo[0] + tally[bound][0], lo[1] + tally[bound][1]]
                    for above, (b, g) in ((False, lo), (True, [bad - lo[0], good - lo[1]])):
                        if b:
                            gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                            best = max(best, (gain, (f, above, bound)))
            if not best[1]:
                break
            rule.append(best[1])
        worth = lambda r: (lambda b, g: (b - g) / max(1, b + g))(*_counts(r, prune))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        bad, good = _counts(rule, left) if rule else (0, 0)
        if bad < COVER or bad < PRECISION * (bad + good):
            return out
        out.append(rule)
        left = [r for r in left if not _covers(rule, r[0])]
    return out


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Decision list for ``labels.quality`` = 0 from ``stats(doc_id, counts...)``.

    Null labels are left out; a document labelled twice is bad if one label
    says so. A column ``quality`` of ``stats`` is no label and is ignored. Of N labelled documents those in the lowest ``sample`` / N of the
    hash range are used. Without labels of both kinds the list is empty.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    total = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample / total)))
    # at most about `sample` rows of two numbers: a proven bound for the broadcast
    # persisted before the filter: a filter that moves below the statistics would compute them many times
    held = statistics(stats.drop("_quality").join(F.broadcast(chosen), "doc_id")).persist()
    rows = held.where(~base_failed()).select(F.col("_quality").alias("quality"), *[c.alias(n) for n, c in features().items()])
    cuts = rows.agg(*[F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 10_000).alias(n) for n in FEATURES], *[F.percentile_approx(F.when(F.col("quality") == 0, F.col(n)), [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98], 10_000).alias(f"{n}_bad") for n in FEATURES]).first()
    bounds = {n: sorted({*(cuts[n] or []), *(cuts[f"{n}_bad"] or [])}) for n in FEATURES}
    binned = [sum((F.when(F.col(n) > float(b), 1).otherwise(0) for b in bounds[n]), F.lit(0)) for n in FEATURES]
    counted = rows.groupBy(*[b.alias(n) for b, n in zip(binned, FEATURES, strict=True)]).agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("good")).collect()
    table = [(tuple(r[n] for n in FEATURES), r["bad"], r["good"]) for r in counted]
    found = cover(table, [len(bounds[n]) for n in FEATURES])
    # thresholds move to the middle of the gap that they fall in, as far from either side's rows as can be
    used = sorted({(FEATURES[f], float(bounds[FEATURES[f]][b])) for rule in found for f, _, b in rule})
    gaps = rows.agg(*[e.alias(f"{side}{i}") for i, (n, b) in enumerate(used) for side, e in (("lo", F.max(F.when(F.col(n) <= b, F.col(n)))), ("hi", F.min(F.when(F.col(n) > b, F.col(n)))))]).first() if used else {}
    held.unpersist()
    middle = {k: k[1] if gaps[f"lo{i}"] is None or gaps[f"hi{i}"] is None else (gaps[f"lo{i}"] + gaps[f"hi{i}"]) / 2 for i, k in enumerate(used)}
    return [[Condition(FEATURES[f], above, middle[FEATURES[f], float(bounds[FEATURES[f]][b])]) for f, above, b in rule] for rule in found]


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; null and empty texts have no word and fail the base, repeated rows get a row each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, read(spark, sf_dir, "labels"))
    stats = statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.when(base_failed(), F.lit(False)).otherwise(verdict(rules)).alias("kept"))
