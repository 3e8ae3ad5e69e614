"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Vectors are read as whole numbers, so their sums and products are exact and do
not depend on how Spark deals rows to tasks. The covariance, a matrix of the
vectors' width, is the only thing on the driver. There it is split: the polar
factor of the shifted covariance is 1 on the eigenvectors above the shift and
-1 below, so half of it plus one projects on an invariant subspace. Both
subspaces are split further until they hold one component each. The components
are broadcast to the tasks that whiten the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import read_table

#: Fixed by the contract: entries are rounded down to 64ths and lifted.
SCALE, LIFT = 64, 1_000_000
#: Components that are given; rows that a task reads at a time.
COMPONENTS, ROWS = 32, 2048
#: Largest size of an entry times SCALE.
LARGEST = float(1 << 60)
#: An eigenvalue under this share of the largest counts as none.
NONE = 1e-13
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the dynamically weighted Halley iteration with QR factors."""
    size, x = len(a), a / (np.linalg.norm(a) or 1.0)
    low = EPS  # no singular value that counts is smaller
    while True:
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        p = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.concatenate([math.sqrt(r) * x, np.eye(size)]))
        new = q / r * x + (p - q / r) / math.sqrt(r) * both[:size] @ both[size:].T
        new, low = (new + new.T) / 2, min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        step, x = np.linalg.norm(new - x), new
        if step <= (4 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            return x


def shifts(a: np.ndarray) -> Iterator[float]:
    """Where to split: within the range of the diagonal, so both sides have eigenvalues."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    spread = np.linalg.norm(a - np.diag(np.diag(a))) + diagonal[-1] - diagonal[0]
    for k in range(1, 40):
        yield float(np.median(diagonal) + (-1) ** k * spread * k / 97)


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of two invariant subspaces of a symmetric matrix, that of the larger eigenvalues first."""
    size = len(a)
    rng = np.random.default_rng(size)
    for shift in shifts(a):
        projector = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
        k = round(float(np.trace(projector)))
        # An eigenvalue at the shift itself is on neither side.
        if not 0 < k < size or np.linalg.norm(projector @ projector - projector) > 1e-9:
            continue
        basis = rng.standard_normal((size, k))
        for _ in range(4):
            basis, _ = np.linalg.qr(projector @ basis[:, :k], mode="complete")
            if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 10 * EPS * np.linalg.norm(a):
                break
        return basis[:, :k], basis[:, k:]
    raise ArithmeticError("no shift splits the matrix")


def largest_components(a: np.ndarray, wanted: int, least: float | None = None) -> np.ndarray:
    """Unit eigenvectors of the ``wanted`` largest eigenvalues of a symmetric matrix, as columns in any order."""
    least = EPS * float(np.linalg.norm(a)) if least is None else least
    if len(a) == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= least:
        return np.eye(len(a))[:, np.argsort(-np.diag(a), kind="stable")[:wanted]]
    found = []
    for basis in split(a):
        take = min(wanted, basis.shape[1])
        if take:
            inner = basis.T @ a @ basis
            found.append(basis @ largest_components((inner + inner.T) / 2, take, least))
        wanted -= take
    return np.concatenate(found, axis=1)


def eigen(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    vectors = largest_components(a, wanted)
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(r) < 0, -1, 1)
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors, optimize=True)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) of each vector, as longs."""
    entries = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim) * SCALE)
    if len(entries) and np.abs(entries).max() > LARGEST:
        raise OverflowError("an entry is too large for a long")
    return entries.astype(np.int64)


def _chunks(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, whole_numbers(part.column(part.num_columns - 1), dim)


def _totals(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each entry's whole numbers."""

    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for _, x in _chunks(batches, dim):
            n, total = n + len(x), total + np.array([int(v) for v in x.sum(axis=0, dtype=object if np.abs(x).max(initial=0) > 1 << 50 else np.int64)], object)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(n), *map(str, total)])], ["i", "v"])

    sums = vectors.select("vec").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in sums.collect()}  # a row an entry
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _products(vectors: DataFrame, dim: int, centre: np.ndarray) -> list[list[int]]:
    """The sums of the products of each two entries of (vector - centre), exactly."""

    def run(batches):
        total = np.zeros((dim, dim), object)
        for _, x in _chunks(batches, dim):
            y = x - centre
            most = int(np.abs(y).max(initial=0))
            if most * most * len(y) < 1 << 53:  # whole numbers that a double holds
                f = y.astype(np.float64)
                total = total + (f.T @ f).astype(np.int64).astype(object)
            else:
                o = y.astype(object)
                total = total + o.T @ o
        rows = [pa.array(list(range(dim)), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(rows, ["i", "row"])

    cells = vectors.select("vec").mapInArrow(run, "i int, row array<string>").select("i", F.posexplode("row").alias("j", "v"))
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[0] * dim for _ in range(dim)]
    for r in sums.toLocalIterator():  # a row for two entries
        out[r["i"]][r["j"]] = int(r["v"])
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Project ``vectors(vec_id, embedding)`` on their largest components, each scaled to variance 1.

    Returns one row per row and component: vec_id, component (from 1), n,
    deviation (decimal(38,0): sum of (n * x - S) ** 2 over the entries, exact),
    whitened, explained, identity_error. An entry c counts as x = floor(64 * c)
    + 1000000; S are the sums of x, n their number, the covariance has divisor
    n and is exact before it is rounded to doubles once.

    Rows whose vector is null or holds null, NaN or infinite entries are
    dropped, and so are vectors of another length than the most common one
    (ties to the longer). Repeated rows count each; a null vec_id is returned
    as such. There are as many components as entries if those are fewer. A
    component without variance has whitened 0 and explained 0, and
    identity_error is then 1. An empty table gives an empty result; other
    columns are ignored. An entry over 2**54 in size fails the job.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~bad).select("vec_id", F.col("embedding").alias("vec"))
    size = clean.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = size["dim"] if size else 0
    out = "vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not dim:
        return spark.createDataFrame([], out.format(kind=kind))
    clean = clean.where(F.size("vec") == dim)

    n, total = _totals(clean, dim)
    centre = [round(s / n) if abs(s) < 1 << 52 else s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]  # sums of what is left after centring by whole numbers
    products = _products(clean, dim, np.array(centre, np.int64))
    covariance = np.array([[(n * products[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, found = eigen(covariance, min(components, dim))
    live = values > NONE * max(float(values[0]), 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    trace = float(np.trace(covariance))
    explained = [float(e) / trace if ok else 0.0 for e, ok in zip(values, live, strict=True)]
    shared = spark.sparkContext.broadcast((np.array(centre, np.int64), np.array([r / n for r in rest]), found * scale, rest, n))
    error = _identity_error(clean, dim, shared, len(values))

    def run(batches):
        middle, shift, weights, rest, n = shared.value
        for part, x in _chunks(batches, dim):
            y = x - middle
            white = (y - shift) @ weights
            most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
            own = y if most * most * dim < 1 << 63 else y.astype(object)
            deviation = ((n * own - np.array(rest, own.dtype)) ** 2).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(v) for v in deviation.tolist()], pa.string()), lists], ["vec_id", "deviation", "white"])

    rows = clean.select("vec_id", "vec").mapInArrow(run, f"vec_id {kind}, deviation string, white array<double>")
    rows = rows.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("white").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(vectors: DataFrame, dim: int, shared, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""

    def run(batches):
        middle, shift, weights, *_ = shared.value
        both, one = np.zeros((k, k)), np.zeros(k)
        for _, x in _chunks(batches, dim):
            white = (x - middle - shift) @ weights
            both, one = both + white.T @ white, one + white.sum(axis=0)
        cells = np.concatenate([both.ravel(), one])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["i", "v"])

    sums = vectors.select("vec").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for two components
    cells = np.zeros(k * k + k)
    for r in sums:
        cells[r["i"]] = r["v"]
    n = shared.value[-1]
    mean = cells[k * k :] / n
    return float(np.abs(cells[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
