"""Exact quantiles of large groups without sorting them or sending their values.

``percentile`` counts each distinct value of a group in one task. Here a group
beyond ``WHOLE`` rows, a checked size, is searched by digits instead: doubles as
whole numbers in the same order, ``DIGIT`` bits at a time from the top. Each pass
counts, in every task, the values below each open prefix by their next digit;
after the last digit the value of each sought rank is known to the bit. Passes
send counts only, at most 2 ** DIGIT for each column and rank of a large group,
and a value that repeats often costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.sources.tables import materialize

WHOLE = 1_000_000
DIGIT = 11


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def double_of(bits: int) -> float:
    raw = bits & (1 << 63) - 1 if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _searched(rows: DataFrame, columns: list[str], ranks: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], float]:
    """Value of each (group, column, rank from 0) of ``rows(_g, columns)``."""
    known = {t: (0, t[2]) for t in ranks}  # prefix and rank below it
    left = 64
    while left:
        width = min(DIGIT, left)
        left -= width
        sought = sorted({(g, c, p) for (g, c, _), (p, _) in known.items()})
        shift, mask, above = np.uint64(left), np.uint64((1 << width) - 1), left + width

        def count(batches, sought=sought, shift=shift, mask=mask, above=above, width=width):
            total = np.zeros((len(sought), 1 << width), np.int64)
            for batch in batches:
                of = batch.column(0).to_numpy()
                for c in range(1, batch.num_columns):
                    mine = [(k, g, p) for k, (g, col, p) in enumerate(sought) if col == c - 1]
                    column = batch.column(c)
                    there = column.is_valid().to_numpy(zero_copy_only=False)
                    bits = ordered_bits(column.drop_null().to_numpy(zero_copy_only=False).astype(float))
                    group = of[there]
                    for k, g, p in mine:
                        inside = group == g if above == 64 else (group == g) & (bits >> np.uint64(above) == np.uint64(p))
                        total[k] += np.bincount((bits[inside] >> shift & mask).astype(np.int64), minlength=1 << width)
            k, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(digit), pa.array(total[k, digit])], ["k", "digit", "n"])

        found = rows.mapInArrow(count, "k long, digit long, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros((len(sought), 1 << width), np.int64)
        for r in found:
            counts[r["k"], r["digit"]] = r["n"]
        at = {s: k for k, s in enumerate(sought)}
        for t, (prefix, rank) in known.items():
            upto = np.cumsum(counts[at[t[0], t[1], prefix]])
            digit = int(np.searchsorted(upto, rank, "right"))
            known[t] = prefix << width | digit, rank - (int(upto[digit - 1]) if digit else 0)
    return {t: double_of(bits) for t, (bits, _) in known.items()}


def quantiles(df: DataFrame, shares: dict[str, list[float] | Callable[[int], list[float]]], keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, columns)``: an array of the exact quantiles of each column, between ranks as ``percentile`` does.

    Null where a group has no value. A share may be a function of the number of
    values where there are no keys. Keys are not null.
    """
    keys, columns = list(keys), list(shares)
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(columns))], F.lit(0))
    if not keys:
        n = counts.first()
        shares = {c: s(max(1, n[i])) if callable(s) else s for i, (c, s) in enumerate(shares.items())}
        large = [n] if max(n) > WHOLE else []
    else:
        large = counts.where(most > WHOLE).collect()  # at most rows / WHOLE
    plain = [F.percentile(c, shares[c]).alias(c) for c in columns]
    if not large:
        return df.groupBy(*keys).agg(*plain)
    spark, kinds = df.sparkSession, df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    if keys:
        names = spark.createDataFrame([(*[r[k] for k in keys], g) for g, r in enumerate(large)], kinds.select(*keys).schema.add("_g", "integer"))
        rows = kinds.join(F.broadcast(names), keys).select("_g", *columns)
    else:
        rows = kinds.select(F.lit(0).alias("_g"), *columns)
    rows = materialize(rows, "selection")
    places = {}
    for g, r in enumerate(large):
        for i, c in enumerate(columns):
            for s in shares[c]:
                at = s * (r[f"_n{i}"] - 1)
                places[g, i, s] = at, math.floor(at), math.ceil(at)
    have = {k: v for k, v in places.items() if large[k[0]][f"_n{k[1]}"]}
    value = _searched(rows, columns, sorted({(g, i, rank) for (g, i, _), (_, lo, hi) in have.items() for rank in (lo, hi)}))

    def between(g: int, i: int, s: float) -> float:
        at, lo, hi = places[g, i, s]
        a, b = value[g, i, lo], value[g, i, hi]
        return a if a == b else (hi - at) * a + (at - lo) * b

    out = [(*[r[k] for k in keys], *[[between(g, i, s) for s in shares[c]] if r[f"_n{i}"] else None for i, c in enumerate(columns)]) for g, r in enumerate(large)]
    schema = kinds.select(*keys).schema if keys else None
    fields = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " if keys else "") + ", ".join(f"`{c}` array<double>" for c in columns)
    found = spark.createDataFrame(out, fields)
    if not keys:
        return found
    return df.join(F.broadcast(found.select(*keys)), keys, "left_anti").groupBy(*keys).agg(*plain).unionByName(found)
