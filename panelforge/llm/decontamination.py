"""Operator 7: benchmark decontamination by SimHash windows.

A document is compared with benchmark items in windows of the item's number of
words. Each window and item has a 64-bit SimHash of its five-word shingles.
Fingerprints are cut into ``PARTS`` blocks; two within ``RADIUS`` bits agree in
some block up to RADIUS // PARTS bits (pigeonhole), so an index of all such
variants of the items' blocks finds every pair within the radius. Candidates
are verified by exact weighted Jaccard similarity of the shingle multisets.
DataFrame functions only.

Windows: a window of similarity 0.8 holds 80 % of the item's shingles, so at
least one of any k - ceil(0.8 k) + 1 of them (the probes, here those that the
fewest items have). Around the probes of an item in a text the item's shingles
are marked once, in whatever order they stand, and running counts of the marks
say which windows hold enough of them: work is linear in texts and items.

Scale: documents stay where they are until a probe hits. The probes and items
grow with the benchmark alone; they are broadcast only up to ``BROADCAST``
shingles. Beyond that Spark joins (text, place, shingle) rows by shuffle, which it
can split where a shingle is hot. Texts with a probe are found again by a hash of
their row; what moves is the stretch around the probes, and one row of item
length a window.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.llm.common import materialize, read

WIDTH = 5
PERCENT = 80
RADIUS = 20
PARTS = 7
BITS = 64
BROADCAST = 1_000_000
#: Words are runs of letters and digits; case and signs don't count.
BETWEEN = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: str, width: int) -> Column:
    """Hash of each window of ``width`` words of the column of word hashes, in order."""
    one = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), one)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a multiset: each occurrence votes on each bit; ties give 0."""

    def vote(fingerprint: Column, b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, x: n + F.when(F.getbit(x, b) == 1, 1).otherwise(-1))
        return fingerprint.bitwiseOR(F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), vote)


def cuts() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [BITS * i // PARTS for i in range(PARTS + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def block(fingerprint: Column, lo: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << bits) - 1))


def variants(bits: int) -> list[int]:
    """All masks of up to RADIUS // PARTS flipped bits."""
    return [sum(1 << b for b in c) for k in range(RADIUS // PARTS + 1) for c in combinations(range(bits), k)]


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets of hashes: the sum of the least weights."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item_id, n_words, width, hashes, fingerprint)``; items without a word are left out.

    An item with fewer than five words is one shingle of all its words.
    """
    words = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where("size(words) > 0")
    parts = [words.where(F.size("words") == n if n < WIDTH else F.size("words") >= n).select("item_id", F.size("words").alias("n_words"), F.lit(n).alias("width"), shingles("words", n).alias("hashes")) for n in range(1, WIDTH + 1)]
    return reduce(DataFrame.unionAll, parts).withColumn("fingerprint", simhash(F.col("hashes")))


def probed(items: DataFrame) -> DataFrame:
    """``(item, n_words, width, hashes, probes)`` of each distinct item text; ``item`` is a hash of its shingles."""
    texts = items.select(F.xxhash64("hashes").alias("item"), "n_words", "width", "hashes").distinct()
    each = texts.select("item", F.explode("hashes").alias("probe"))
    often = each.groupBy("probe").agg(F.count_distinct("item").alias("n"))
    ranked = each.join(often, "probe").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("n", "probe"))).alias("r"))
    k = F.size("r")
    probes = F.slice("r", F.lit(1), k - F.ceil(k * PERCENT / 100).cast("int") + 1)["probe"]
    return texts.join(ranked.select("item", F.array_distinct(probes).alias("probes")), "item")


def row_key() -> Column:
    """Hash of a row's id and text; rows equal in both are one."""
    return F.xxhash64("doc_id", "text").alias("row")


def _regions(docs: DataFrame, texts: DataFrame, few: bool) -> DataFrame:
    """``(doc_id, row, item, n_words, width, k, size, lo, around)``: the stretch of a text in which an item's windows lie.

    It reaches from one item before the first probe of the item in the text to
    one after the last; ``lo`` is its place, ``size`` the shingles of the text.
    """
    probes = texts.select("item", "n_words", "width", F.size("hashes").alias("k"), F.explode("probes").alias("probe"))
    words = docs.select("doc_id", row_key(), word_hashes(F.col("text")).alias("words"))
    found = []
    for (width,) in texts.select("width").distinct().collect():  # at most WIDTH values
        mine = probes.where(F.col("width") == width)
        # outer: otherwise Spark infers a filter on the array's size, which computes the array again for each element
        at = words.select("row", F.posexplode_outer(shingles("words", width)).alias("pos", "probe"))
        # without the broadcast a narrow row a word crosses the shuffle
        hits = at.join(F.broadcast(mine), "probe") if few else at.where("probe is not null").join(mine, "probe")
        pairs = materialize(hits.groupBy("row", "item", "n_words", "width", "k").agg(F.min("pos").alias("first"), F.max("pos").alias("last")), "benchmark-pairs")
        near = F.broadcast if pairs.count() <= BROADCAST else (lambda df: df)
        lo = F.greatest(F.lit(0), F.col("first") - F.col("k") + 1)
        here = words.select("doc_id", "row", shingles("words", width).alias("g")).join(near(pairs), "row")
        found.append(here.select("doc_id", "row", "item", "n_words", "width", "k", F.size("g").alias("size"), lo.alias("lo"), F.slice("g", lo + 1, F.col("last") - lo + F.col("k")).alias("around")).distinct())
    return reduce(DataFrame.unionAll, found) if found else None


def _starts(regions: DataFrame, shingles_of: DataFrame) -> DataFrame:
    """``(row, item, start)``: where windows are laid, by running counts of the item's shingles in a text.

    A window that starts between two of them holds no more than the one that
    starts at the next, so windows start at them, or at the text's last window.
    One is laid if it holds enough for the similarity. Where no shingle comes
    twice within a window's length, the number held is the overlap itself, and
    only windows that hold the most are laid.
    """
    each = regions.select("row", "item", "k", "size", "lo", F.posexplode("around").alias("at", "shingle"))
    marks = each.join(shingles_of, ["item", "shingle"]).withColumn("pos", F.col("lo") + F.col("at"))
    pair = Window.partitionBy("row", "item")
    marks = marks.withColumn("before", F.row_number().over(pair.orderBy("pos")) - 1)
    marks = marks.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("row", "item", "shingle").orderBy("pos")))
    marks = marks.withColumn("apart", F.coalesce(F.min("gap").over(pair) >= F.col("k"), F.lit(True)))
    start = F.least(F.col("pos"), F.greatest(F.col("size") - F.col("k"), F.lit(0)))
    # each mark as itself, and as a question for the marks before its window's end
    both = marks.select("row", "item", "k", "size", "apart", "before", start.alias("start"), F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("mark")), F.struct((start + F.col("k")).alias("at"), F.lit(0).alias("mark")))).alias("p"))
    until = F.sum("p.mark").over(pair.orderBy("p.at", "p.mark").rowsBetween(Window.unboundedPreceding, 0))
    asked = both.withColumn("held", until - F.col("before")).where("p.mark = 0")
    enough = asked.where((100 + PERCENT) * F.col("held") >= PERCENT * (F.least("k", "size") + F.col("k")))
    return enough.withColumn("most", F.max("held").over(pair)).where("held = most or not apart").select("row", "item", "start").distinct()


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, n_words, width, start, window)``: the item-sized windows that may be similar to an item."""
    texts = materialize(probed(items), "benchmark-probes")
    shingles_of = texts.select("item", F.explode("hashes").alias("shingle")).distinct()
    few = shingles_of.count() <= BROADCAST
    regions = _regions(docs, texts, few)
    if regions is None:
        none = docs.select("doc_id", F.lit(0).alias("n_words"), F.lit(0).alias("width"), F.lit(0).alias("start"), F.array().cast("array<bigint>").alias("window"))
        return none.where("false")
    regions = materialize(regions, "benchmark-regions")
    starts = _starts(regions, F.broadcast(shingles_of) if few else shingles_of)
    laid = regions.join(starts, ["row", "item"])
    return laid.select("doc_id", "n_words", "width", "start", F.slice("around", F.col("start") - F.col("lo") + 1, F.col("k")).alias("window")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word)`` of each leaked item in each document, at its best window.

    Null and empty texts and items match nothing. Rows that repeat a
    ``doc_id`` are taken together; other columns are ignored. Of equal
    similarities the first window counts that starts with a shingle of the item.
    """
    items = materialize(items_of(benchmark), "benchmark-items")
    masks = [F.array(*[F.lit(m).cast("long") for m in variants(bits)]) for _, bits in cuts()]
    index = items.select("item_id", "n_words", "width", "hashes", F.col("fingerprint").alias("of_item"), F.posexplode(F.array(*[F.transform(m, _flip(block(F.col("fingerprint"), lo, bits))) for m, (lo, bits) in zip(masks, cuts(), strict=True)])).alias("part", "values"))
    index = index.select("item_id", "n_words", "width", "part", F.explode("values").alias("value"))
    seen = materialize(windows_of(docs, items).withColumn("fingerprint", simhash(F.col("window"))), "benchmark-windows")
    parts = seen.select("*", F.posexplode(F.array(*[block(F.col("fingerprint"), lo, bits) for lo, bits in cuts()])).alias("part", "value"))
    pairs = parts.join(index, ["n_words", "width", "part", "value"]).groupBy("doc_id", "n_words", "start", "item_id", "fingerprint", "window").agg(F.lit(1).alias("one"))
    near = pairs.join(items.select("item_id", F.col("n_words").alias("of_words"), "hashes", F.col("fingerprint").alias("of_item")), "item_id").where("n_words = of_words").where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item"))) <= RADIUS)
    both = near.select("doc_id", "item_id", "start", (F.size("window") + F.size("hashes")).alias("sizes"), overlap(F.col("window"), F.col("hashes")).alias("common"))
    alike = both.where((100 + PERCENT) * F.col("common") >= PERCENT * F.col("sizes"))
    best = F.max(F.struct((F.col("common") / (F.col("sizes") - F.col("common"))).alias("similarity"), (-F.col("start")).alias("start")))
    return alike.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.start")).alias("start_word"))


def _flip(of: Column):
    return lambda mask: mask.bitwiseXOR(of)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, without a leaked item.

    A row is known by its ``doc_id``, null included, and its text: another text
    under the id of a leaked row is judged for itself.
    """
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text")
    leaked = materialize(matches(named, benchmark).select(F.col("doc_id.doc_id").alias("_leaked_id"), F.col("doc_id.text_key").alias("_leaked_text")).distinct(), "benchmark-leaked")
    rows = docs.withColumn("_own_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_leaked_id")) & (F.col("_own_text") == F.col("_leaked_text"))
    return rows.join(leaked, same, "left_anti").select(docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every leaked item of every document; null and empty texts and items match nothing, rows that repeat a doc_id are taken together."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
