"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.sources.tables import materialize, shared_dir

__all__ = ["connected_components", "exists", "fresh_path", "materialize", "mix64", "read", "remove", "shared_dir", "shingle_set", "word_hashes"]

#: White space of the word definition ``[^\x20\x09-\x0D]+`` as a Java regex.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters as a plain string, for ``trim`` and ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, store = _path(spark, folder)
        store.delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly the
    six ASCII white space characters of the word definition.
    """
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text.

    A text with fewer words gives its whole sequence as one shingle; one
    without words gives none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
        return np.unique(mix64(out))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``; component is the least id.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so that its lineage is one table.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        return row["n"], row["h"]

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        then = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), label)
        remove(spark, now)
        now, before, seen = then, seen, state(then)
        if seen == before:
            break
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
