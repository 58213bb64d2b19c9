"""Ranks and row numbers within large groups, without one task for a group.

A window over a whole cell sorts the cell in one task. Here rows are dealt into
parts that follow each other in the order; each part is ranked by itself and
moved up by the number of rows in the parts before it. Results are those of the
plain window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.functions.windows import average_rank

#: Parts of a group that is ranked by value, and the rows up to which a group is ranked as one.
PARTS = 64
WHOLE = 500_000


def _before(counts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``(keys, part, _before)``: rows of the parts before each."""
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(part) if keys else Window.partitionBy(F.lit(1)).orderBy(part))
    return counts.withColumn("_before", upto - F.col("_n")).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the row number from 0 within the keys, in the given order.

    Parts are the values of the first order column (an entity), so each must
    fit a task; the rows of a part are sorted by the other columns. Keys and
    the first order column are not null.
    """
    before = _before(df.groupBy(*keys, order[0]).agg(F.count("*").alias("_n")), keys, order[0])
    within = F.row_number().over(Window.partitionBy(*keys, order[0]).orderBy(*order[1:])) - 1
    return df.join(before, [*keys, order[0]]).withColumn(name, within + F.col("_before")).drop("_before")


def ranked(df: DataFrame, columns: dict[str, str], keys: list[str], parts: int = PARTS) -> DataFrame:
    """``df`` with the rank of each column (``columns`` names it) within the keys, ties averaged, nulls null.

    Parts lie between approximate quantiles of the group's values, equal values
    in one. Keys are not null. ``df`` is read more than once. Where no group has
    more than ``WHOLE`` rows, a checked size, each is ranked by a plain window.
    """
    largest = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= WHOLE:
        return df.select("*", *[average_rank(c, *keys).alias(name) for c, name in columns.items()])
    edges = df.groupBy(*keys).agg(*[F.percentile_approx(c, [i / parts for i in range(1, parts)], 1000).alias(f"_e_{c}") for c in columns])
    dealt = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    part = lambda c: F.coalesce(F.size(F.filter(f"_e_{c}", lambda e: e < F.col(c))), F.lit(0))
    dealt = dealt.select(*df.columns, *[part(c).alias(f"_b_{c}") for c in columns])
    out = dealt
    for c, name in columns.items():
        before = _before(dealt.groupBy(*keys, f"_b_{c}").agg(F.count(c).alias("_n")), keys, f"_b_{c}")
        out = out.join(before, [*keys, f"_b_{c}"]).withColumn(name, average_rank(c, *keys, f"_b_{c}") + F.col("_before")).drop("_before")
    return out.select(*df.columns, *columns.values())
