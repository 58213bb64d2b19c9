"""Operator 11: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With the centred rows as the matrix X, each step multiplies X v and then X'u in
one distributed pass over cached blocks of rows. Vectors as long as a row are
on the driver and fully reorthogonalised. Vectors as long as the table are not
stored: u_j = X c_j for a short c_j, so an executor makes its part of u_j anew
from its rows, and the products of u_j with all earlier ones, by which it is
reorthogonalised, are C'(X'u_j). The small bidiagonal matrix is decomposed by
SVD; one more pass rotates its vectors to the eigenvectors of the covariance
within their span (Rayleigh-Ritz), and a last one measures what whitening with
them gives.

Entries are whole numbers (64 times the entry, rounded down), so sums, means and
deviations are exact; rows are centred before they are multiplied.

Scale: a pass reads the rows once, sends one value a dimension and task, and
keeps nothing of the table's length on the driver. Steps end when the wanted
components have converged, at most one a dimension. The blocks are persisted
with spill to disk and are made again from the scan if an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import read

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond this count as not finite: their whole numbers and sums stay exact.
LIMIT = float(1 << 34)
#: Rows of a cached block, a share of the largest singular value that counts as nothing, and as converged.
BLOCK, NOTHING, CONVERGED = 4096, 1e-13, 1e-15
#: Components whose variance is a smaller share of the first one's have no direction to whiten by.
LEAST = 1e-12


def whole(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their entries times 64 rounded down) of a column of vectors; short rows are filled with 0."""
    sizes = pc.list_value_length(column)
    there = np.flatnonzero(sizes.is_valid().to_numpy(zero_copy_only=False))
    sizes = sizes.drop_null().to_numpy().astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(there)), sizes)
    good = np.bincount(owner, ~(np.abs(values) <= LIMIT), len(there)) == 0
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(values)) - starts[owner]
    inside = good[owner]
    rank = np.cumsum(good) - 1
    out = np.zeros((int(good.sum()), max(width, int(sizes[good].max(initial=0)))), np.int64)
    out[rank[owner[inside]], place[inside]] = np.floor(values[inside] * SCALE).astype(np.int64)
    return there[good], out


def _totals(parts: Iterator[dict[int, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out.get(k, 0) + v
    return out


def moments(vectors: DataFrame) -> tuple[int, list[int], int]:
    """(rows that count, exact sum of each dimension without the shift, exact n^2 x trace of the covariance).

    The last is the sum over dimensions of n x (sum of squares) less (sum)^2, which a shift doesn't change.
    """

    def sums(batches):
        def each():
            for batch in batches:
                y = whole(batch.column(0))[1]
                big = int(np.abs(y).max(initial=0))
                wide = y if big * big * max(1, len(y)) < 1 << 62 else y.astype(object)
                yield {-1: len(y)} | {2 * i: int(s) for i, s in enumerate(wide.sum(0))} | {2 * i + 1: int(s) for i, s in enumerate((wide * wide).sum(0))}

        total = _totals(each())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([Decimal(v) for v in total.values()], pa.decimal128(38, 0))], ["pos", "value"])

    found = {r["pos"]: int(r["value"]) for r in vectors.mapInArrow(sums, "pos long, value decimal(38,0)").groupBy("pos").agg(F.sum("value").alias("value")).collect()}
    n, width = found.get(-1, 0), (max(found, default=-1) + 1) // 2
    s = [found[2 * i] for i in range(width)]
    return n, s, sum(n * found[2 * i + 1] - s[i] * s[i] for i in range(width))


class Centre:
    """Takes the exact mean S / n from whole numbers: first its whole part, then the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def rows(self, y: np.ndarray) -> np.ndarray:
        return (y - self.floor) - self.rest

    def deviations(self, y: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n y - S)^2, exact."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 62:
            t = self.n * y - np.array(self.sums, np.int64)
            return pa.array((t * t).sum(1)).cast(pa.decimal128(38, 0))
        t = self.n * y.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) for v in (t * t).sum(1)], pa.decimal128(38, 0))


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """Rows packed into matrices of whole numbers, ``BLOCK`` rows at most."""

    def pack(batches):
        for batch in batches:
            y = whole(batch.column(0), width)[1]
            for lo in range(0, len(y), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([y[lo : lo + BLOCK].astype("<i8" if np.abs(y).max(initial=0) >> 31 else "<i4").tobytes()], pa.binary()), pa.array([len(y[lo : lo + BLOCK])], pa.int64())], ["block", "rows"])

    return vectors.mapInArrow(pack, "block binary, rows long")


def over_blocks(packed: DataFrame, centre: Centre, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``f(centred rows)``, a vector: added up in each task, then by place."""
    width = len(centre.sums)

    def run(batches):
        total = None
        for batch in batches:
            for raw, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.frombuffer(raw, "<i4" if len(raw) == 4 * rows * width else "<i8").reshape(rows, width)
                part = f(centre.rows(y))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, pa.float64())], ["pos", "value"])

    found = packed.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["pos"]] = r["value"]
    return out


def _orthogonal(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    return w


def bidiagonalise(multiply: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, wanted: int) -> np.ndarray:
    """Right singular vectors (columns, largest first) of a matrix X known by ``multiply(c) -> X'Xc, |Xc|^2``.

    Golub-Kahan-Lanczos from a fixed start: ``u = X v - beta u_before`` is held
    as X c. Where a product vanishes the steps go on from a new direction, so
    repeated and zero singular values are found too.
    """
    draw = np.random.default_rng(11)
    v = draw.standard_normal(width)
    v /= np.linalg.norm(v)
    V, C, G = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))
    alphas, betas, before, largest = [], [], np.zeros(width), 0.0
    while True:
        beta = betas[-1] if betas else 0.0
        c = v - beta * before
        g, square = multiply(c)
        h = C.T @ g  # U'u: taken off u, its image and its square
        c, g, square = c - C @ h, g - G @ h, square - h @ h
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha, beta)
        if alpha <= NOTHING * largest or not largest:
            alpha, c, g = 0.0, np.zeros(width), np.zeros(width)
        else:
            c, g = c / alpha, g / alpha
        alphas.append(alpha)
        V, C, G = np.column_stack([V, v]), np.column_stack([C, c]), np.column_stack([G, g])
        k, before = len(alphas), c
        w = _orthogonal(g - alpha * v, V)
        beta = float(np.linalg.norm(w))
        gone = beta <= NOTHING * largest or not largest
        if k == width or k >= wanted and k % 8 == 0:
            left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if k == width or not gone and (beta * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]).all():
                return V @ right.T
        if gone:
            beta, w = 0.0, np.zeros(width)
            while np.linalg.norm(w) < 0.1:
                w = draw.standard_normal(width)
                w = _orthogonal(w / np.linalg.norm(w), V)
        v = w / np.linalg.norm(w)
        betas.append(beta)


class Whitening:
    """What is fitted: exact means, components (columns), their variances, shares and the measured error."""

    def __init__(self, centre: Centre, vectors: np.ndarray, variances: np.ndarray, shares: list[float], error: float):
        self.centre, self.vectors, self.variances, self.shares, self.error = centre, vectors, variances, shares, error


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of one column of vectors; None where no row counts or none differs from another."""
    n, sums, spread = moments(vectors)
    if not n or not spread:
        return None
    centre, width = Centre(n, sums), len(sums)
    packed = blocks(vectors, width).persist(StorageLevel.MEMORY_AND_DISK)

    def multiply(c: np.ndarray) -> tuple[np.ndarray, float]:
        def products(x: np.ndarray) -> np.ndarray:
            u = x @ c
            return np.append(x.T @ u, u @ u)

        out = over_blocks(packed, centre, products)
        return out[:-1], float(out[-1])

    basis = bidiagonalise(multiply, width, min(components, width))[:, :components]
    k = basis.shape[1]

    def gram(x: np.ndarray) -> np.ndarray:
        z = x @ basis
        return (z.T @ z).ravel()

    values, turn = np.linalg.eigh(over_blocks(packed, centre, gram).reshape(k, k) / n)
    values, turn = values[::-1], turn[:, ::-1]
    kept = int((values > LEAST * values[0]).sum())
    variances, found = values[:kept], (basis @ turn)[:, :kept]
    found /= np.linalg.norm(found, axis=0)
    scaled = found / np.sqrt(variances)

    def measured(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    total = over_blocks(packed, centre, measured) / n
    error = float(np.abs(total[kept:].reshape(kept, kept) - np.outer(total[:kept], total[:kept]) - np.eye(kept)).max())
    packed.unpersist()
    return Whitening(centre, found, variances, [float(e * n * n / spread) for e in variances], error)


def whiten(table: DataFrame, vector: str, keys: list[str], components: int = COMPONENTS) -> DataFrame:
    """``(keys, n, deviation, whitened, explained, identity_error)`` of each row whose vector counts, fitted on all of them.

    A row counts unless its vector is null or holds a null, an entry that isn't
    finite or one beyond ``LIMIT``. Vectors shorter than the longest are filled
    with 0. Repeated rows count and come each. Where no two rows differ, and in
    an empty table, there is no component and no row. Other columns are ignored.
    """
    of = table.select(vector)
    model, kinds = fit(of, components), dict(table.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    centre, scaled = model.centre, model.vectors / np.sqrt(model.variances)

    def run(batches):
        for batch in batches:
            at, y = whole(batch.column(0), len(centre.sums))
            z = centre.rows(y) @ scaled
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * z.shape[1])
            n = pa.array(np.full(len(y), centre.n, np.int64))
            shares, error = pa.array(np.tile(model.shares, len(y))), pa.array(np.full(len(y), model.error))
            rest = [n, centre.deviations(y), pa.ListArray.from_arrays(ends, pa.array(z.ravel())), pa.ListArray.from_arrays(ends, shares), error]
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + i).take(pa.array(at)) for i in range(len(keys))], *rest], [*keys, "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(vector, *keys).mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every row of ``embeddings``; a deviation that no long holds is null."""
    rows = whiten(read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
