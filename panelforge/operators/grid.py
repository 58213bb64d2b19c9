"""A grid of cells as a resumable run.

Results are a table partitioned by cell. A unit of cells is computed, written to
its own partitions by dynamic overwrite, and only then recorded in a commit
table; readers see committed cells alone. A run that is cut off loses the unit it
was at: the next run computes what is not committed, and overwrites what an
earlier one left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators.metrics import rank_ic
from panelforge.sources.tables import materialize, overwrite_partitions, path_exists


class ResultTable:
    """Rows by cell at ``path``, and the cells that are complete at ``path``-commits."""

    def __init__(self, spark: SparkSession, path: str, cell: list[str]):
        self.spark, self.path, self.commits, self.cell = spark, path, f"{path}-commits", cell

    def done(self) -> DataFrame | None:
        """Complete cells; None before the first."""
        return self.spark.read.parquet(self.commits).select(*self.cell).distinct() if path_exists(self.spark, self.commits) else None

    def pending(self, grid: DataFrame) -> DataFrame:
        done = self.done()
        return grid if done is None else grid.join(F.broadcast(done), self.cell, "left_anti")  # a row a cell

    def add(self, cells: DataFrame, rows: DataFrame) -> None:
        """Write the rows of these cells, then record them as complete; a cell may have none."""
        overwrite_partitions(rows, self.path, self.cell)
        cells.select(*self.cell).distinct().coalesce(1).write.mode("append").parquet(self.commits)

    def read(self) -> DataFrame:
        """Rows of complete cells."""
        return self.spark.read.parquet(self.path).join(F.broadcast(self.done()), self.cell, "left_semi")


def run(table: ResultTable, grid: DataFrame, unit: list[str], compute: Callable[[dict, DataFrame], DataFrame]) -> int:
    """Compute the grid's pending cells, unit by unit; the number of units computed.

    ``unit`` are columns of the cell: cells that share them are one distributed
    job, ``compute(values of the unit, its cells)``. The driver loops over units only.
    """
    todo = materialize(table.pending(grid), "grid")
    units = todo.select(*unit).distinct().orderBy(*unit).collect()
    for values in units:
        cells = todo
        for c in unit:
            cells = cells.where(F.col(c).eqNullSafe(F.lit(values[c])))
        table.add(cells, compute(values.asDict(), cells))
    return len(units)


def window_metrics(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``(cell, window, n_test, r2, rmse, hit)`` from test rows with ``y``, ``pred`` and ``mean``, the window's training mean."""
    y, pred = F.col("y"), F.col("pred")
    error, base = F.sum((y - pred) * (y - pred)), F.sum((y - F.col("mean")) * (y - F.col("mean")))
    return rows.groupBy(*cell, "window").agg(F.count("*").alias("n_test"), (1 - F.try_divide(error, base)).alias("r2"), F.sqrt(error / F.count("*")).alias("rmse"), F.avg(F.when((y > 0) == (pred > 0), 1.0).otherwise(0.0)).alias("hit"))


def pooled_metrics(rows: DataFrame, cell: list[str], tie_digits: int = 12) -> DataFrame:
    """``(cell, windows, n, r2, rmse, hit, ic)`` over all windows' test rows together.

    The baseline of ``r2`` is the mean of the windows' training means. ``ic`` is
    the rank correlation with averaged ties, null for up to 10 rows or where a
    side doesn't vary; ranks are taken in parts, so no cell is in one task.
    """
    y, pred = F.col("y"), F.col("pred")
    means = rows.groupBy(*cell, "window").agg(F.max("mean").alias("mean")).groupBy(*cell).agg(F.avg("mean").alias("base"), F.count("*").alias("windows"))
    both = rows.join(F.broadcast(means), cell)  # a row a cell
    error = F.sum((y - pred) * (y - pred))
    out = both.groupBy(*cell, "windows").agg(F.count("*").alias("n"), (1 - F.try_divide(error, F.sum((y - F.col("base")) * (y - F.col("base"))))).alias("r2"), F.sqrt(error / F.count("*")).alias("rmse"), F.avg(F.when((y > 0) == (pred > 0), 1.0).otherwise(0.0)).alias("hit"))
    rounded = rows.select(*cell, F.round("pred", tie_digits).alias("pred"), F.round("y", tie_digits).alias("y"))
    ic = rank_ic(rounded, "pred", "y", cell, large=True)
    return out.join(ic.select(*cell, F.col("ic")), cell, "left").withColumn("ic", F.when(F.col("n") > 10, F.col("ic")))
