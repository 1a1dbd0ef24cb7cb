"""Whitening of embeddings with eigenvectors refined from single precision.

Components become integers, x = floor(1024 * c) + 100000. Two distributed passes
fit: count and sums per dimension, then products of vectors centred at the integer
part of the mean. A task adds products with matrix multiplications whose terms and
sums doubles hold exactly, and sends one row per cell of its upper triangle; Spark
adds cells as decimals. What the fraction of the mean still asks for is taken off
in integers, so the covariance that reaches the driver (dimensions squared numbers,
whatever the number of rows) is exact before it is rounded once.

Its eigenvectors come from a single-precision decomposition and are corrected by
Ogita and Aishima's iteration: residuals of orthogonality and of diagonality, both
matrix products in extended precision, give the correction of every vector with no
new factorisation. Where eigenvalues lie too close for that (clusters), the
matrix is shifted by the cluster's value, projected on the cluster's basis and the
small problem is solved by itself (recursively, for clusters within), after which the
iteration goes on.

A third pass projects each vector; the results are stored, and covariances of the
stored values (centred, merged as such by Spark) tell how far they are from the
identity.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped; entries are held at 2^31 either way before they are multiplied, so that
integers stay integers; vectors of each length are a fit list of their own, with
components up to that length; repeated rows count as often as they occur; null ids
stay null; equal eigenvalues get an orthonormal basis of their space; a component
without variance (fewer vectors than dimensions, equal vectors) has ``whitened``
null and ``explained`` 0; a deviation that no long can hold is null; empty vectors
have no component; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table
from ledgerline.session import store

SCALE, SHIFT = 1024, 100_000
MOST = 1 << 31
COMPONENTS = 8
ROWS = 4_096  # rows that are multiplied at once
EXACT = 1 << 53

WIDE = np.longdouble
NOISE = 4 * np.finfo(WIDE).eps
ROUNDS, DEPTH = 40, 6  # corrections, and clusters within clusters


# --- eigenvectors -------------------------------------------------------------


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` of ``a``: vectors, eigenvalues, which pairs are close, and its size."""
    r = np.eye(x.shape[1], dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else its rounding, over a small gap, would bend right angles
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = np.sqrt((a * a).sum())
    bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= bound
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, close, float(np.abs(e).max(initial=0))


def _clusters(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Indices of neighbouring eigenvalues that pairs of ``close`` ones hold together, two or more."""
    order = np.argsort(-values, kind="stable")
    cuts = [k + 1 for k in range(len(order) - 1) if not close[order[k], order[k + 1]]]
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _solved_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, close: np.ndarray, depth: int) -> bool:
    """Turns the basis of each cluster in ``x`` to the eigenvectors of its shifted, projected problem; whether one had any."""
    found = False
    for part in _clusters(values, close):
        basis = x[:, part]
        middle = values[part].mean()
        inner = basis.T @ (a @ basis) - middle * (basis.T @ basis)
        # Below this the problem is rounding: the eigenvalues are equal, and any basis will do.
        if np.abs(inner).max() > NOISE * len(a):
            x[:, part] = basis @ eigenvectors((inner + inner.T) / 2, depth=depth + 1)[1]
            found = True
    return found


def _settled(a: np.ndarray, x: np.ndarray, depth: int) -> tuple[np.ndarray, bool]:
    """``x`` corrected until nothing changes any more, and whether it came to that."""
    before, solved = np.inf, 0
    for _ in range(ROUNDS):
        x, values, close, size = _refined(a, x)
        if size < NOISE * len(a) or before / 2 < size < 1e-8:
            np.fill_diagonal(close, False)
            if solved == DEPTH or depth == DEPTH or not _solved_clusters(a, x, values, close, depth):
                return x, True
            solved, size = solved + 1, np.inf
        before = size
    return x, False


def eigenvectors(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision or better."""
    a = np.asarray(a, WIDE)
    d = len(a)
    if d == 0:
        return np.zeros(0, WIDE), np.zeros((0, 0), WIDE)
    scale = np.sqrt((a * a).sum()) or WIDE(1)
    a = a / scale
    for start in (np.float32, np.float64):  # the second only if the first is too far away
        x, done = _settled(a, np.linalg.eigh(a.astype(start))[1].astype(WIDE), depth)
        if done:
            break
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return values[order] * scale, x * np.where(sign == 0, 1, sign)


# --- distributed passes -------------------------------------------------------


def integers(vector: Column) -> Column:
    """The entries as longs; null where the vector takes no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(vector, lambda c: F.floor(SCALE * F.greatest(F.least(c, F.lit(float(MOST))), F.lit(-float(MOST)))) + F.lit(SHIFT))
    return F.when(vector.isNotNull() & finite, held)


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Length, matrix of longs and rows, for the rows of each length in a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            dims = part["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows = part.take(np.flatnonzero(dims == dim)) if (dims != dim).any() else part
                yield dim, rows["x"].flatten().to_numpy().reshape(rows.num_rows, dim), rows


def _added(partial: DataFrame) -> DataFrame:
    return partial.groupBy("dim", "i", "j").agg(F.sum("cell").alias("cell"))


CELLS = "dim int, i int, j int, cell decimal(38,0)"


def _cells(dim: int, where: list[tuple[int, int]], values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([dim] * len(values), pa.int32()), pa.array([i for i, _ in where], pa.int32()), pa.array([j for _, j in where], pa.int32()),
            pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)),
        ],
        names=["dim", "i", "j", "cell"],
    )


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: the sum of each entry (i, 0), and the number of rows (-1, 0)."""
    total: dict[int, list[int]] = {}
    for dim, x, _ in _stacks(batches):
        held = total.setdefault(dim, [0] * (dim + 1))
        for k, value in enumerate([len(x), *x.sum(axis=0).tolist()]):  # 4,096 numbers below 2^42
            held[k] += value
    for dim, held in total.items():
        yield _cells(dim, [(k - 1, 0) for k in range(dim + 1)], held)


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right`` of integers, exact: in doubles if they hold all sums, else in Python's integers."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * len(left)
    if most < EXACT:
        return (left.astype(float).T @ right.astype(float)).astype(np.int64)
    return left.astype(object).T @ right.astype(object)


def _products(base: dict[int, np.ndarray]):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, x, _ in _stacks(batches):
            centred = x - base[dim]
            total[dim] = total.get(dim, 0) + exact_product(centred, centred).astype(object)
        for dim, matrix in total.items():
            i, j = np.triu_indices(dim)
            yield _cells(dim, list(zip(i.tolist(), j.tolist())), matrix[i, j].tolist())

    return products


@dataclass
class Fit:
    """What one length's fit list gives."""

    n: int
    total: list[int]  # sums per dimension
    base: np.ndarray  # integer part of the mean
    rest: np.ndarray  # its fraction
    values: np.ndarray  # eigenvalues of the components that are returned
    vectors: np.ndarray  # their eigenvectors, a column each
    explained: np.ndarray


def covariance(n: int, rest: list[int], products: np.ndarray) -> np.ndarray:
    """From products of vectors centred at the integer part of the mean, and the sums (0 to n - 1) that this leaves."""
    left = np.array(rest, dtype=object)
    exact = n * products - np.outer(left, left)
    # An integer of more digits than a long double has goes over in two parts.
    high = exact // (1 << 60)
    low = exact - high * (1 << 60)
    return (high.astype(WIDE) * WIDE(1 << 60) + low.astype(WIDE)) / WIDE(n) / WIDE(n)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors in ``rows`` (dim, x)."""
    narrow = rows.select("dim", "x").filter("dim > 0")
    counted: dict[int, dict[int, int]] = {}
    for row in _added(narrow.mapInArrow(sums, CELLS)).collect():  # a row per dimension
        counted.setdefault(row["dim"], {})[row["i"]] = int(row["cell"])
    if not counted:
        return {}
    totals = {dim: [found[i] for i in range(dim)] for dim, found in counted.items()}
    base = {dim: np.array([s // counted[dim][-1] for s in total], np.int64) for dim, total in totals.items()}
    matrices = {dim: np.zeros((dim, dim), object) for dim in totals}
    for row in _added(narrow.mapInArrow(_products(base), CELLS)).toLocalIterator():  # a row per two dimensions
        matrices[row["dim"]][row["i"], row["j"]] = matrices[row["dim"]][row["j"], row["i"]] = int(row["cell"])
    out = {}
    for dim, total in totals.items():
        n = counted[dim][-1]
        rest = [s - n * int(b) for s, b in zip(total, base[dim])]
        v = covariance(n, rest, matrices[dim])
        values, vectors = eigenvectors(v)
        trace = np.trace(v)
        # A variance below what rounding leaves of the largest one is none.
        values = np.where(values > dim * np.finfo(np.float64).eps * values[0], values, 0)
        kept = slice(0, components)
        explained = values[kept] / trace if trace > 0 else np.zeros(len(values[kept]))
        out[dim] = Fit(n, total, base[dim], np.array([r / n for r in rest]), values[kept].astype(float), vectors[:, kept].astype(float), explained.astype(float))
    return out


WHITENED = "vec_id long, dim int, n long, deviation long, whitened array<double>"


def deviations(n: int, x: np.ndarray, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - total)^2, exact; None if no long holds it."""
    top = np.array(total, dtype=object)
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if most < 1 << 62:
        apart = n * x - np.array(total, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    found = ((n * x.astype(object) - top) ** 2).sum(axis=1).tolist()
    return [value if value < 1 << 63 else None for value in found]


def project(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, dim, n, deviation and the whitened components (an array) of each row of ``rows``."""

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, part in _stacks(batches):
            one = fits[dim]
            centred = (x - one.base).astype(float) - one.rest
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (centred @ one.vectors) / np.sqrt(one.values)
            gone = np.broadcast_to(one.values <= 0, scores.shape)
            m = scores.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    part["vec_id"], part["dim"], pa.array(np.full(len(x), one.n)), pa.array(deviations(one.n, x, one.total), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * m + 1, m, dtype=np.int32)), pa.array(scores.ravel(), pa.float64(), mask=gone.ravel())),
                ],
                names=["vec_id", "dim", "n", "deviation", "whitened"],
            )

    return rows.filter("dim > 0").select("vec_id", "dim", "x").mapInArrow(whiten, WHITENED)


def identity_error(whitened: DataFrame, components: int = COMPONENTS) -> float:
    """Largest absolute entry, over all lengths, of the covariance of whitened components minus the identity."""
    at = [F.get("whitened", F.lit(k)) for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    # Sums of centred products that Spark merges as such, divided by n; null where a component has no variance.
    found = whitened.groupBy("dim").agg(*(F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs))
    far = [F.coalesce(F.abs(F.col(f"c{i}_{j}") - float(i == j)), F.lit(0.0)) for i, j in pairs]
    worst = F.greatest(*far) if len(far) > 1 else far[0]
    return found.agg(F.max(worst)).first()[0] or 0.0


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Fit], float]:
    """(stored vectors with their whitened components, the fit of each length, the distance from the identity)."""
    ship_package(rows.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(vector).alias("x")).filter("x IS NOT NULL")
    usable = usable.withColumn("dim", F.size("x"))
    fits = fit(usable, components)
    whitened = store(project(usable, fits), "whitened")
    return whitened, fits, identity_error(whitened, components)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened, fits, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.create_map(*(part for dim, one in fits.items() for part in (F.lit(dim), F.array(*map(F.lit, one.explained.tolist()))))) if fits else F.lit(None).cast("map<int,array<double>>")
    each = whitened.select("vec_id", "n", "deviation", "dim", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(explained[F.col("dim")], F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
