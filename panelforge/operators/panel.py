"""Panel preparation: splits, winsorising, imputation, scaling, assembly, sequences.

Statistics are fitted on training rows in one aggregation over all columns and
broadcast as one row (or one a entity); applying them is a projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalars import zero_if_missing
from panelforge.operators import selection
from panelforge.sources.tables import materialize


def date_index(df: DataFrame, time: str = "date") -> DataFrame:
    """Distinct dates numbered from 0; the window runs over dates only."""
    return df.select(time).distinct().withColumn("date_idx", F.row_number().over(Window.orderBy(time)) - 1)


def temporal_split(df: DataFrame, train: float = 0.6, val: float = 0.2, horizon: int = 5, time: str = "date") -> DataFrame:
    """Dates labelled train, val or test; the last ``horizon`` dates of train and val are purged."""
    dates = date_index(df, time)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    a, b = F.floor(n * train), F.floor(n * train) + F.floor(n * val)
    i = F.col("date_idx")
    label = F.when(i < a - horizon, "train").when((i >= a) & (i < b - horizon), "val").when(i >= b, "test")
    return dates.withColumn("split", label).where("split is not null").select(time, "split")


def split_audit(df: DataFrame, splits: DataFrame, entity: str = "ticker", time: str = "date") -> DataFrame:
    return df.join(F.broadcast(splits), time).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(time).alias("dates"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(entity).alias("entities"))


def overlaps(splits: DataFrame, time: str = "date") -> DataFrame:
    """Dates with more than one label: none in a sound split."""
    return splits.groupBy(time).agg(F.count_distinct("split").alias("n")).where("n > 1")


def winsorize(df: DataFrame, columns: list[str], train: Column, lo: float = 0.001, hi: float = 0.999, accuracy: int | None = None) -> DataFrame:
    """Clip at the training quantiles; columns without training values stay. ``accuracy`` picks approximate quantiles."""
    if accuracy:
        fit = df.where(train).agg(*[F.percentile_approx(c, [lo, hi], accuracy).alias(f"_q_{c}") for c in columns])
    else:
        fit = selection.quantiles(df.where(train), {c: [lo, hi] for c in columns}).select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(fit))
    for c in columns:
        b = F.col(f"_q_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNull() | b.isNull(), F.col(c)).otherwise(F.least(F.greatest(c, b[0]), b[1])))
    return out.drop(*[f"_q_{c}" for c in columns])


def impute(df: DataFrame, columns: list[str], train: Column, entity: str = "ticker") -> DataFrame:
    """Fill with the entity's training median, else the global one, else 0."""
    rows = df.where(train)
    middle = {c: [0.5] for c in columns}
    own = selection.quantiles(rows.where(F.col(entity).isNotNull()), middle, (entity,)).select(entity, *[F.get(c, 0).alias(f"_e_{c}") for c in columns])
    every = selection.quantiles(rows, middle).select(*[F.get(c, 0).alias(f"_g_{c}") for c in columns])
    out = df.join(own, entity, "left").crossJoin(F.broadcast(every))
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_e_{c}", f"_g_{c}", F.lit(0.0)))
    return out.select(df.columns)


def zscore(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - mean) / std of the training rows; a constant column becomes 0."""
    fit = df.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(fit))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return out.select(df.columns)


def missing_rates(df: DataFrame, columns: list[str], warn: float = 0.5) -> DataFrame:
    """Share of missing values a column, from one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], columns, "feature", "rate").withColumn("warn", F.col("rate") > warn)


def split_matrix(df: DataFrame, splits: DataFrame, features: list[str], y: str, keys: tuple[str, ...] = ("ticker", "date"), time: str = "date") -> DataFrame:
    """Model rows of each split: ``(split, keys, x, y, up)``; rows without a target go, missing features are 0."""
    labelled = df.where(F.col(y).isNotNull()).join(F.broadcast(splits), time)  # a row a date
    x = F.array(*[zero_if_missing(F.col(f).cast("double")) for f in features])
    return labelled.select("split", *keys, x.alias("x"), F.col(y).cast("double").alias("y"), F.when(F.col(y) > 0, 1).otherwise(0).alias("up"))


def assemble(targets: DataFrame, inner: list[DataFrame], left: list[DataFrame], keys: list[str]) -> DataFrame:
    """Wide panel: targets joined with every frame on the keys."""
    out = reduce(lambda a, b: a.join(b, keys, "inner"), inner, targets)
    return reduce(lambda a, b: a.join(b, keys, "left"), left, out)


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted features that the panel has, in order."""
    return [c for c in wanted if c in df.columns]


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """Indicator columns of the sorted values, the last one dropped."""
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in sorted(values)[:-1]])


def sanitized(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: zero_if_missing(F.col(c)) for c in columns})


def sequences(df: DataFrame, features: list[str], length: int, entity: str = "ticker", time: str = "date") -> DataFrame:
    """The ``length`` rows before each row as an array of structs; rows with fewer are dropped."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-length, -1)
    return df.withColumn("sequence", F.collect_list(F.struct(*features)).over(w)).where(F.size("sequence") == length)


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def every_kth_date(df: DataFrame, k: int, time: str = "date") -> DataFrame:
    """Rows on every k-th distinct date from the first."""
    return df.join(F.broadcast(date_index(df, time).where(F.col("date_idx") % k == 0).select(time)), time, "left_semi")


def causal_median(df: DataFrame, value: str, time: str = "date", bins: int = 256, together: int = 5_000_000) -> DataFrame:
    """Median of all values on strictly earlier dates, for each date; null where there are none.

    Exact. Values are counted by date, then by date and bin between approximate
    quantiles; the counts before a date tell which bin holds its middle values,
    and how many lie below. Each quantile is a bin of its own, whose value is
    known, so a bin between two of them keeps about one value in ``bins``, however
    often a value repeats. Bins that hold a middle are cut again until values x
    dates that ask for them are at most ``together``; those are ranked. At most
    two bins a date are sought, which bounds what is broadcast.
    """
    dates = date_index(df, time)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(dates), time).groupBy(F.col("date_idx").alias("_i"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    inside = materialize(rows.withColumn("_p", F.lit(0).cast("long")), "causal")
    before = F.sum("_n").over(Window.orderBy("date_idx").rowsBetween(Window.unboundedPreceding, -1))  # a row for each date
    totals = dates.select("date_idx").join(inside.groupBy(F.col("_i").alias("date_idx")).agg(F.sum("_c").alias("_n")), "date_idx", "left").select("date_idx", before.alias("_n"))
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    sought = materialize(totals.where("_n > 0").select("date_idx", F.lit(0).cast("long").alias("_p"), F.explode(middle).alias("_rank")), "sought")
    found = []
    while (sought.groupBy("_p").agg(F.count("*").alias("_d")).join(inside.groupBy("_p").agg(F.count("*").alias("_n")), "_p").agg(F.sum(F.col("_d") * F.col("_n"))).first()[0] or 0) > together:
        inside, sought, values = _cut(inside, sought, bins)
        found.append(values)
    past = inside.join(F.broadcast(sought), "_p").where("_i < date_idx")
    upto = F.sum("_c").over(Window.partitionBy("date_idx", "_p", "_rank").orderBy("_v"))
    ranked = past.groupBy("date_idx", "_p", "_rank", "_v").agg(F.sum("_c").alias("_c")).withColumn("_upto", upto)
    found.append(ranked.where("_upto > _rank").groupBy("date_idx", "_p", "_rank").agg(F.min("_v").alias("_v")).select("date_idx", "_v"))
    medians = reduce(DataFrame.unionByName, found).groupBy("date_idx").agg(F.avg("_v").alias("median"))
    return dates.join(medians, "date_idx", "left").select(time, "median")


def _cut(inside: DataFrame, sought: DataFrame, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of ``causal_median``: values of the bins that still hold a sought rank, the ranks within them, values found.

    ``inside(_p, _i, _v, _c)`` are values of bin p with their count on date i;
    ``sought(date_idx, _p, _rank)`` are ranks among the bin's values before the date.
    """
    # written once: a second sketch may give other quantiles
    edges = F.broadcast(materialize(inside.groupBy("_p").agg(F.array_distinct(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000)).alias("_e")), "edges"))
    at = F.size(F.filter("_e", lambda e: e < F.col("_v"))) + F.size(F.filter("_e", lambda e: e <= F.col("_v")))  # odd: a quantile itself
    binned = inside.join(edges, "_p").select("_p", "_i", "_v", "_c", at.alias("_b"))
    asked = sought.groupBy("_p", F.col("date_idx").alias("_i")).agg(F.collect_set("_rank").alias("_ranks"))  # at most two
    cells = asked.join(edges, "_p").select("_p", "_i", "_ranks", F.explode(F.sequence(F.lit(0), 2 * F.size("_e"))).alias("_b"))
    daily = binned.groupBy("_p", "_i", "_b").agg(F.sum("_c").alias("_c")).unionByName(cells, allowMissingColumns=True)
    before = F.sum("_c").over(Window.partitionBy("_p", "_b").orderBy("_i").rangeBetween(Window.unboundedPreceding, -1))
    held = daily.withColumn("_n", F.coalesce(before, F.lit(0))).where("_ranks is not null")
    held = held.withColumn("_to", F.sum("_n").over(Window.partitionBy("_p", "_i").orderBy("_b"))).withColumn("_from", F.col("_to") - F.col("_n"))
    placed = held.select("*", F.explode("_ranks").alias("_rank")).where("_rank >= _from and _rank < _to").join(edges, "_p")
    name = (F.col("_p") * (2 * bins) + F.col("_b")).alias("_p")
    known = F.when(F.col("_b") % 2 == 1, F.get("_e", F.floor(F.col("_b") / 2).cast("int")))
    placed = materialize(placed.select(F.col("_i").alias("date_idx"), name, (F.col("_rank") - F.col("_from")).alias("_rank"), known.alias("_v")), "sought")
    rest = placed.where("_v is null").drop("_v")
    inside = materialize(binned.select(name, "_i", "_v", "_c").join(F.broadcast(rest.select("_p").distinct()), "_p", "left_semi"), "causal")
    return inside, rest, placed.where("_v is not null").select("date_idx", "_v")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that an input may lack (name: type): as they are, or null."""
    return df.withColumns({c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in columns.items()})


def proxy_return(bars: DataFrame, proxies: DataFrame, group: str = "sector", ret: str = "ret", entity: str = "ticker", time: str = "date") -> DataFrame:
    """Bars with ``proxy_return``: the same date's return of the entity that stands for their group in ``proxies(group, proxy)``.

    Groups without a proxy, and dates on which it has no bar, get null.
    """
    named = bars.join(F.broadcast(proxies.select(group, "proxy")), group, "left")
    of = bars.join(F.broadcast(proxies.select(F.col("proxy").alias(entity)).distinct()), entity, "left_semi").select(F.col(entity).alias("proxy"), time, F.col(ret).alias("proxy_return"))
    return named.join(of, ["proxy", time], "left")


def aligned(tensors: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Tensors with the panel's columns, on the keys that both have."""
    return tensors.join(panel, keys)
