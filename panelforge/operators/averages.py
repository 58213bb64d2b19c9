"""Exponential moving averages as a blocked scan.

y = (1 - alpha) y + alpha x is a linear map of y for each row. Within a block of
rows the maps are composed by running sums; a block is then one map, and a short
fold over the blocks before carries the value across. Work is linear whatever the
span, no row collects its history, and a long series lies over many tasks.

A missing value keeps the average; the next value then weighs as much more as
the average has aged: old weight (1 - alpha) ** gap, new weight alpha, both
divided by their sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.operators import ordering

#: Blocks of the longest span's reach that are folded for a carry: what lies before them weighs less than a rounding error.
BLOCKS = 24


def _reach(span: int) -> int:
    """Rows after which a value weighs exp(-18)."""
    return max(2, math.ceil(18 / -math.log(1 - 2 / (span + 1)))) if span > 1 else 2


def _maps(gap: Column, span: int) -> tuple[Column, Column]:
    """(weight of the old average, weight of the new value) after ``gap`` rows."""
    alpha = 2 / (span + 1)
    old = F.pow(F.lit(1 - alpha), gap)
    return old / (old + alpha), F.lit(alpha) / (old + alpha)


def emas(df: DataFrame, columns: dict[str, tuple[Column, int]], entity: str = "ticker", time: str = "date", part: Column | None = None) -> DataFrame:
    """``df`` with an average for each name of ``columns``: (value, span), seeded by the entity's first value.

    Rows are numbered by entity and time, in parts (by default calendar years),
    which must follow each other in time. Before the first value an average is null.
    """
    kept, spans = df.columns, [span for _, span in columns.values()]
    # one block for all spans; the shortest one's weights must not underflow in it
    size = min(max(map(_reach, spans)), 30 * min(map(_reach, spans)))
    back = BLOCKS * math.ceil(max(map(_reach, spans)) / size)
    rows = df.withColumns({f"_x{j}": x.cast("double") for j, (x, _) in enumerate(columns.values())}).withColumn("_part", F.year(time) if part is None else part)
    # the part stands first in the order; numbers run on over the parts of an entity
    rows = ordering.numbered(rows, [entity], ["_part", time], "_i").withColumn("_b", F.floor(F.col("_i") / size))
    block = Window.partitionBy(entity, "_b").orderBy("_i")
    upto, earlier = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    each = range(len(spans))
    seen = {j: F.when(F.col(f"_x{j}").isNotNull(), F.col("_i")) for j in each}
    rows = rows.withColumns({f"_g{j}": F.when(F.col(f"_x{j}").isNotNull(), F.col("_i") - F.last(seen[j], ignorenulls=True).over(earlier)) for j in each})
    maps = {j: _maps(F.col(f"_g{j}"), spans[j]) for j in each}
    # y = P (y of the block's first value + S): P multiplies the old weights, S adds the new values
    rows = rows.withColumns({f"_p{j}": F.exp(F.coalesce(F.sum(F.log(maps[j][0])).over(upto), F.lit(0.0))) for j in each})
    rows = rows.withColumns({f"_s{j}": F.coalesce(F.sum(maps[j][1] * F.col(f"_x{j}") / F.col(f"_p{j}")).over(upto), F.lit(0.0)) for j in each} | {f"_h{j}": F.count(f"_x{j}").over(upto) > 0 for j in each})
    # each block as a map from the average before it
    at = lambda f, c, j: f(F.when(F.col(f"_x{j}").isNotNull(), F.struct("_i", c)))[c]
    blocks = rows.groupBy(entity, "_b").agg(*[x for j in each for x in (at(F.min, f"_x{j}", j).alias(f"_first{j}"), F.min(seen[j]).alias(f"_from{j}"), F.max(seen[j]).alias(f"_to{j}"), at(F.max, f"_p{j}", j).alias(f"_p{j}"), at(F.max, f"_s{j}", j).alias(f"_s{j}"))])
    series = Window.partitionBy(entity).orderBy("_b")  # a row for each block, a small part of the rows
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_g{j}": F.col(f"_from{j}") - F.last(f"_to{j}", ignorenulls=True).over(before) for j in each})
    for j in each:
        old, new = _maps(F.col(f"_g{j}"), spans[j])
        start = F.when(F.col(f"_g{j}").isNull(), F.col(f"_first{j}")).otherwise(new * F.col(f"_first{j}"))
        blocks = blocks.withColumns({f"_o{j}": F.coalesce(old, F.lit(0.0)), f"_f{j}": start})
        # a block without a value keeps the average and is left out of the fold
        one = F.when(F.col(f"_first{j}").isNotNull(), F.struct((F.col(f"_p{j}") * F.col(f"_o{j}")).alias("a"), (F.col(f"_p{j}") * (F.col(f"_f{j}") + F.col(f"_s{j}"))).alias("c")))
        blocks = blocks.withColumn(f"_m{j}", one)
    last = {j: F.collect_list(f"_m{j}").over(series.rowsBetween(1 - back, 0)) for j in each}
    blocks = blocks.withColumns({f"_l{j}": last[j] for j in each})
    fold = lambda j: F.aggregate(f"_l{j}", F.lit(0.0), lambda y, m: m["a"] * y + m["c"])
    blocks = blocks.withColumns({f"_e{j}": F.when(F.col(f"_first{j}").isNotNull(), fold(j)) for j in each})
    blocks = blocks.withColumns({f"_c{j}": F.last(f"_e{j}", ignorenulls=True).over(before) for j in each})
    carried = blocks.select(entity, "_b", *[x for j in each for x in (F.col(f"_c{j}"), (F.col(f"_o{j}") * F.coalesce(f"_c{j}", F.lit(0.0)) + F.col(f"_f{j}")).alias(f"_y{j}"))])
    out = rows.join(carried, [entity, "_b"])
    value = lambda j: F.when(F.col(f"_h{j}"), F.col(f"_p{j}") * (F.col(f"_y{j}") + F.col(f"_s{j}"))).otherwise(F.col(f"_c{j}"))
    return out.select(*kept, *[value(j).alias(name) for j, name in enumerate(columns)])


def rsi_of(gain: Column, loss: Column) -> Column:
    """Relative strength index from the averages of gains and losses; null without losses."""
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss))
