"""Operator 2: toxicity by FTRL-proximal logistic regression.

Features are hashed word n-grams and skip-grams, present or absent. FTRL gives
each coordinate its own rate and an L1 threshold, so only features that keep
pulling in one direction get a weight: the model is a short list of (index,
weight) pairs that goes to every task. FTRL is sequential; it runs in one task
over a sample of at most ``SAMPLE`` labelled texts of ``SAMPLE_BYTES`` in all, a
bound that does not grow with the input. Scoring is one narrow scan of whole texts.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.llm.common import mix64, read

#: Labelled texts to learn from and their bytes in all, size of the hashed space, passes, FTRL's rates and penalties.
SAMPLE = 12_000
SAMPLE_BYTES = 256 << 20
DIMENSIONS = 1 << 20
PASSES = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
BIAS = 0
SIGNS = string.punctuation.encode()


def features(text: bytes | None) -> np.ndarray:
    """Hashed indices of words, word pairs and pairs with one or two words between; repeats stay."""
    words = (text or b"").lower().translate(None, SIGNS).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        parts = [mix64(h)] + [mix64(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k)) for k in (1, 2, 3)]
    return (np.concatenate(parts) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Nonzero weights (indices, values) of the FTRL-proximal regression, in the order of the rows."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(at):
        zi, root = z[at], np.sqrt(n[at])
        l1 = np.where(at == BIAS, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + root) / ALPHA + L2)), root

    for _ in range(passes):
        for at, label in rows:
            w, root = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    every = np.arange(DIMENSIONS)
    w, _ = weights(every)
    return np.flatnonzero(w), w[np.flatnonzero(w)]


def _fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("order")
    rows = [(np.append(np.unique(features(t)), BIAS), int(y)) for t, y in zip(group.text, group.label, strict=True)]
    at, w = ftrl(rows)
    return pd.DataFrame({"at": at, "w": w})


def learn(labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights from ``labelled(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Null labels and ids are left out; a document labelled twice counts as toxic
    if one label says so. Of N labelled documents, those in the lowest
    ``sample`` / N of the hash range are used, in hash order, as far as their
    whole texts fit in ``SAMPLE_BYTES``: a text that doesn't is left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    total = max(1, known.count())
    order = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000_000))
    chosen = known.withColumn("order", order).where(F.col("order") < math.ceil(1_000_000_000 * min(1.0, sample / total)))
    # at most about `sample` rows of two numbers: a proven bound for the broadcast
    rows = labelled.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("order", "text", "label")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    if (rows.agg(F.sum(size)).first()[0] or 0) > SAMPLE_BYTES:
        # two numbers a row of the sample, in one task; a text of more than a 64th of the bytes is never in
        sizes = rows.select("order", F.xxhash64("text").alias("of"), size.alias("size")).where(F.col("size") <= SAMPLE_BYTES // 64)
        fits = sizes.withColumn("until", F.sum("size").over(Window.orderBy("order", "of").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("until") <= SAMPLE_BYTES)
        rows = rows.join(F.broadcast(fits.select("order", "of").distinct()), (rows["order"] == fits["order"]) & (F.xxhash64(rows["text"]) == fits["of"])).select(rows["order"], "text", "label")
    found = rows.groupBy(F.lit(1).alias("one")).applyInPandas(_fit, "at long, w double").collect()
    found = sorted(found, key=lambda r: r["at"])  # here: sorting in Spark would fit twice, once to sample the range
    return np.array([r["at"] for r in found], np.int64), np.array([r["w"] for r in found], float)


def _score(at: np.ndarray, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(DIMENSIONS)
        dense[at] = w
        has, bias = dense != 0, dense[BIAS]
        has[BIAS] = False
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                f = features(text)
                x = bias + dense[np.unique(f[has[f]])].sum()
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, x)))) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, at: np.ndarray, w: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` for every row, from its whole text.

    Null and empty texts get the bias alone. Without any learned weight (no
    labels) every score is 0. Repeated rows are scored each; other columns are
    ignored.
    """
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_score(at, w), "doc_id long, score double")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document; null and empty texts get the bias alone, a null id is in the fold of the empty text, repeated rows are scored each."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    at, w = learn(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs, at, w)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
