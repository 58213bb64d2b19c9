"""Rounding of derived doubles, so that two engines' results compare.

Many values lie exactly on a rounding tie, where float noise decides; both
sides add the same small part of the last place first.
"""

from pyspark.sql import DataFrame, functions as F


def shift(places: int) -> float:
    return round(0.0123 * 10**-places, places + 6)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c) + shift(places), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: str, places: int = 6) -> str:
    """``a b c`` as rounded select items for the SQL side."""
    return ", ".join(f"ROUND(CAST({c} AS DOUBLE) + {shift(places):.12f}, {places}) + 0.0 AS {c}" for c in columns.split())
