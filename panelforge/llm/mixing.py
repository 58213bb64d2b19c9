"""Operator 9: mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. A source with share w of the weights
gives its i-th block (from 1) the release slot floor((i - 1) / w) and the
deadline ceil(i / w); at every slot the released block with the earliest
deadline goes next. With shares that sum to 1 no deadline is missed, so after
any number of slots each source is less than one block from its target. The
weights are exact rationals: nothing is rounded. When a source runs out a new
phase starts, with the shares of the others scaled up; nothing is dropped or
repeated.

Scale: the schedule needs only the sources' row counts. It has at most about
``SLOTS`` slots, as blocks grow with the table beyond ``BLOCK`` rows, and is
made by one task in time linear in slots. Rows are numbered within (source,
hash bucket) and offset by the counts of the buckets before, so a source with a
third of all rows spreads over all buckets and no task numbers a whole source.
A row that is repeated beyond its share of ``REPEATED`` can't be spread so: its
copies are made from one of them, each with a number of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.llm.common import materialize, read

#: Least rows in a block, slots of the schedule (and one for each source), rows in a numbering bucket, such buckets at most, schedule rows that are broadcast.
BLOCK = 64
SLOTS = 1 << 18
BUCKET = 500
BUCKETS = 100_000
#: Rows that repeat more often than rows / REPEATED: at most so many, a proven bound. Copies made from one in a task.
REPEATED = 10_000
COPIES = 20_000
BROADCAST = 2 * SLOTS
SCHEDULE = "_mix_source string, mix_block long, mix_slot long, _mix_start long"


def integers(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block from 0) of each slot, by earliest deadline among the released blocks; ties go by the source's name.

    Sources without a positive weight come after all others, with equal shares.
    """
    first = {s: w for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    rest = {s: 1 for s, n in blocks.items() if n > 0 and s not in first}
    for group in (first, rest):
        if group:
            yield from _phases({s: blocks[s] for s in group}, integers(group))


def _phases(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    total, given = sum(weights.values()), dict.fromkeys(blocks, 0)
    order = sorted(blocks, key=lambda s: (-weights[s], s))  # deadlines of first blocks ascend in this order
    left = len(order)
    while left:
        if len(order) > 2 * left:
            order = [s for s in order if given[s] < blocks[s]]
        waiting: list = []  # release, deadline, source, block of this phase
        ready: list = []  # deadline, source, block of this phase
        cursor, slot, ended = 0, 0, False
        while not ended:
            while waiting and waiting[0][0] <= slot:
                _, deadline, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, s, i))
            while cursor < len(order) and given[order[cursor]] == blocks[order[cursor]]:
                cursor += 1
            fresh = (-(-total // weights[order[cursor]]), order[cursor], 1) if cursor < len(order) else None
            if fresh and (not ready or fresh < ready[0]):
                s, i = fresh[1:]
                cursor += 1
            else:
                _, s, i = heapq.heappop(ready)
            yield s, given[s]
            given[s] += 1
            slot += 1
            if given[s] == blocks[s]:
                total, left, ended = total - weights[s], left - 1, True
            else:
                heapq.heappush(waiting, (i * total // weights[s], -(-(i + 1) * total // weights[s]), s, i + 1))


def _scheduled(block: int, weights: dict[str, float] | None, power: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}
        for batch in batches:
            rows.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        goal = {s: float(n) ** power for s, n in rows.items()} if weights is None else {s: weights.get(s, 0) for s in rows}
        start, out = 0, []
        for slot, (s, b) in enumerate(schedule({s: -(-n // block) for s, n in rows.items()}, goal)):
            out.append((s, b, slot, start))
            start += min(block, rows[s] - b * block)
            if len(out) == 50_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["_mix_source", "mix_block", "mix_slot", "_mix_start"])


def source_key(column: Column) -> Column:
    """The source's name, with null as a source of its own."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column))


def _hashed(docs: DataFrame) -> Column:
    """Hash of a whole row: rows that are equal in it are interchangeable."""
    as_json = lambda c: F.to_json(F.struct(c))  # noqa: E731  a map has no hash
    return F.xxhash64(*[as_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema], F.lit(9))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_block`` (within the source), ``mix_slot`` and ``mix_position`` (0, 1, ...).

    ``weights`` maps sources to target weights of any proportion; by default a
    source's weight is its row count to the given power. Sources without a
    weight come last. Null sources are one source. Blocks have ``block`` rows,
    or rows / ``SLOTS`` where that is more; a source's last block may be
    shorter. Equal and repeated rows are kept and get positions of their own;
    an empty table gives an empty result. Columns of ``docs`` with the three
    added names, or that begin with ``_mix_``, are replaced.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position", *[c for c in docs.columns if c.startswith("_mix_")])
    keyed = docs.withColumn("_mix_hash", _hashed(docs)).withColumn("_mix_source", source_key(F.col("source")))
    per_source = keyed.groupBy("_mix_source").agg(F.count("*").alias("n"))
    sources, total = per_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    block = max(block, math.ceil(total / SLOTS))
    buckets = min(BUCKETS, max(8, math.ceil(total / BUCKET)))
    keyed = keyed.withColumn("_mix_bucket", F.pmod(F.xxhash64("_mix_hash"), F.lit(buckets)).cast("int"))
    goal = None if weights is None else {("null" if s is None else f"={s}"): w for s, w in weights.items()}
    plan = materialize(per_source.coalesce(1).mapInArrow(_scheduled(block, goal, power), SCHEDULE), "mix-schedule")
    often = materialize(keyed.groupBy("_mix_source", "_mix_hash").agg(F.count("*").alias("_mix_rows")).where(F.col("_mix_rows") > max(BUCKET, total / REPEATED)), "mix-repeated")
    some = not often.isEmpty()
    if some:
        copies = keyed.join(F.broadcast(often), ["_mix_source", "_mix_hash"])
        keyed = keyed.join(F.broadcast(often.select("_mix_source", "_mix_hash")), ["_mix_source", "_mix_hash"], "left_anti")
    # rows of a source before each of its buckets
    counts = keyed.groupBy("_mix_source", "_mix_bucket").agg(F.count("*").alias("_mix_rows"))
    before = counts.withColumn("_mix_before", F.sum("_mix_rows").over(Window.partitionBy("_mix_source").orderBy("_mix_bucket")) - F.col("_mix_rows")).drop("_mix_rows")
    at = F.row_number().over(Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_hash")) - 1
    # the counts grow with the rows, so they are never broadcast; the rows are dealt by the join's key already
    ranked = keyed.withColumn("_mix_at", at).join(before.hint("merge"), ["_mix_source", "_mix_bucket"]).withColumn("_mix_rank", F.col("_mix_at") + F.col("_mix_before"))
    if some:
        ranked = ranked.select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_source", "_mix_rank").unionByName(_copies(copies, counts, docs.columns))
    # at most about SLOTS slots and one for each source: a checked size
    near = F.broadcast if sources + SLOTS <= BROADCAST else (lambda df: df)
    out = ranked.withColumn("mix_block", F.floor(F.col("_mix_rank") / block)).join(near(plan), ["_mix_source", "mix_block"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_block", "mix_slot", (F.col("_mix_start") + F.col("_mix_rank") % block).alias("mix_position"))


def _copies(copies: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """All copies of the often repeated rows with their ``_mix_rank``, after the source's other rows.

    One of each is kept before the shuffle, and makes its copies in several tasks.
    """
    one = copies.groupBy("_mix_source", "_mix_hash", "_mix_rows").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_mix_row"))
    others = counts.groupBy("_mix_source").agg(F.sum("_mix_rows").alias("_mix_others"))
    earlier = F.sum("_mix_rows").over(Window.partitionBy("_mix_source").orderBy("_mix_hash")) - F.col("_mix_rows")
    first = one.withColumn("_mix_earlier", earlier).join(others, "_mix_source", "left")
    first = first.withColumn("_mix_before", F.coalesce("_mix_others", F.lit(0)) + F.col("_mix_earlier"))
    step = first.withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_mix_rows") - 1) / COPIES))))
    dealt = step.repartition("_mix_hash", "_mix_part")
    last = F.least((F.col("_mix_part") + 1) * COPIES, F.col("_mix_rows")) - 1
    each = dealt.withColumn("_mix_i", F.explode(F.sequence(F.col("_mix_part") * COPIES, last)))
    return each.select("_mix_row.*", "_mix_source", (F.col("_mix_before") + F.col("_mix_i")).alias("_mix_rank"))


def in_order(mixed: DataFrame, rows_per_part: int = 25_000, total: int | None = None) -> DataFrame:
    """Rows in mixed order: each partition is a stretch of the mix, sorted. ``total`` is the number of rows, counted where not given."""
    parts = max(1, math.ceil((mixed.count() if total is None else total) / rows_per_part))
    return mixed.repartitionById(parts, F.floor(F.col("mix_position") / rows_per_part).cast("int")).sortWithinPartitions("mix_position")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, by the square root of its source's size; null sources are one source, repeated rows get places of their own."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
