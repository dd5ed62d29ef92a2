"""Whitening of embeddings by a one-sided Jacobi SVD.

1. Entries become integers; each distinct vector once is the fit list (one shuffle, copies combined
   before it), written to the shared folder. Its size and the sums of its dimensions are exact.
2. TSQR: every task takes its centred rows block by block into one triangular matrix R; the
   tasks' matrices are combined ``FAN_IN`` at a time until one is left. No task holds more than a
   block and two matrices of the dimensions squared, whatever the number of rows.
3. One-sided Jacobi: plane rotations make the columns of R orthogonal. Their lengths are the standard
   deviations times sqrt(n), without ever squaring them in a covariance matrix, and the rotations'
   product holds the components. R is of the dimensions squared, so this runs on the driver.
4. All rows are projected in one pass over the input, and the fit list once more for the check of
   the whitened covariance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, BLOCK, FAN_IN = 256.0, 4096, 16
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a column of lists of floats, by length: the places of the usable vectors and their integer
    entries. Vectors with null or non-finite entries, or ones too large for a long, are left out."""
    out = {}
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    for d in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == d)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        with np.errstate(all="ignore"):
            x = np.floor(SCALE * values)
            good = (np.isfinite(values) & (np.abs(x) < 2.0**63)).all(1)
        out[d] = at[good], x[good].astype(np.int64)
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it: equal vectors give equal bytes."""
    low, high = x.min(1, initial=0), x.max(1, initial=0)
    out = [b""] * len(x)
    left = np.ones(len(x), bool)
    for kind in _WIDTHS:
        own = np.flatnonzero(left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max))
        for i, row in zip(own.tolist(), x[own].astype(kind), strict=True):
            out[i] = row.tobytes()
        left[own] = False
    return out


def _unpacked(rows: list[bytes], d: int) -> np.ndarray:
    x = np.empty((len(rows), d), np.int64)
    for i, raw in enumerate(rows):
        x[i] = np.frombuffer(raw, _WIDTHS[(len(raw) // d).bit_length() - 1])
    return x


def _encoded(batches):
    for batch in batches:
        for d, (_, x) in _rows(batch.column(0)).items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array(_packed(x), pa.binary())], names=["d", "x"])


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums by dimension, also where they pass a long."""
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62:
        return x.sum(0).tolist()
    return [sum(column) for column in x.T.tolist()]


def _sums(d: int):
    def run(batches):
        total = [0] * d
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for k in range(0, len(rows), BLOCK):
                total = [a + b for a, b in zip(total, _exact_sums(_unpacked(rows[k : k + BLOCK], d)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(v) for v in total], pa.string())], names=["dim", "s"])

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list]:
    """n*x - S as floats (exact below 2^53), and the exact sums of its squares as Python integers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        diff = n * x - np.array(sums, np.int64)
        return diff.astype(np.float64), (diff * diff).sum(1).tolist()
    exact = [[n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
    return np.array([[float(v) for v in row] for row in exact]).reshape(x.shape), [sum(v * v for v in row) for row in exact]


def _triangle(batches_of_rows) -> np.ndarray | None:
    """R of all rows, a block at a time."""
    r = None
    for rows in batches_of_rows:
        r = np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")
    return r


def _local_r(d: int, n: int, sums: list[int]):
    def run(batches):
        def blocks():
            for batch in batches:
                rows = batch.column(0).to_pylist()
                for k in range(0, len(rows), BLOCK):
                    yield _deviations(_unpacked(rows[k : k + BLOCK], d), n, sums)[0] / n

        if (r := _triangle(blocks())) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    return run


def _combined(d: int):
    """Rows (at, r) sorted by at: one R for each at."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw).reshape(-1, d)
                if k == at:
                    held = _triangle([held, own])
                    continue
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["at", "r"])
                at, held = k, own
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["at", "r"])

    return run


def tsqr(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows of ``fit`` (x binary)."""
    parts = fit.select("x").mapInArrow(_local_r(d, n, sums), "at long, r binary")
    level, count = written(parts, "whitening-r"), fit.rdd.getNumPartitions()
    while count > 1:
        count = -(-count // FAN_IN)
        dealt = level.select(F.floor(F.col("at") / FAN_IN).cast("long").alias("at"), "r").repartition(count, "at").sortWithinPartitions("at")
        level = written(dealt.mapInArrow(_combined(d), "at long, r binary"), "whitening-r")
    return np.frombuffer(level.first().r).reshape(-1, d)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns. Each round rotates disjoint
    pairs of columns, by a round-robin schedule, until no pair is further from orthogonal than
    rounding."""
    d = r.shape[1]
    u = np.zeros((max(r.shape), d))
    u[: len(r)] = r
    v = np.eye(d)
    even = d + d % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            a, b = ring[: even // 2], ring[even // 2 :][::-1]
            real = (a < d) & (b < d)
            a, b = a[real], b[real]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            ua, ub = u[:, a], u[:, b]
            alpha, beta, gamma = (ua * ua).sum(0), (ub * ub).sum(0), (ua * ub).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.abs(gamma) > 1e-15 * size
            if not off.any():
                continue
            worst = max(worst, float((np.abs(gamma[off]) / size[off]).max()))
            a, b, ua, ub, alpha, beta, gamma = a[off], b[off], ua[:, off], ub[:, off], alpha[off], beta[off], gamma[off]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            u[:, a], u[:, b] = c * ua - s * ub, s * ua + c * ub
            va, vb = v[:, a], v[:, b]
            v[:, a], v[:, b] = c * va - s * vb, s * va + c * vb
        if worst < 1e-14:
            break
    sigma = np.sqrt((u * u).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def _moments(d: int, n: int, sums: list[int], basis: np.ndarray):
    """Sums of the products of the whitened entries of each task; whitened entries have mean zero
    since their vectors are centred exactly."""

    def run(batches):
        k = basis.shape[1]
        total = np.zeros((k, k))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lo in range(0, len(rows), BLOCK):
                w = _deviations(_unpacked(rows[lo : lo + BLOCK], d), n, sums)[0] / n @ basis
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "s"])

    return run


_OUT = "vec_id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"


def _projected(d: int, n: int, sums: list[int], basis: np.ndarray, live: int, explained: list, error: float | None):
    """basis: a column for each component asked for, zero from ``live`` on."""
    k = basis.shape[1]

    def run(batches):
        for batch in batches:
            at, x = _rows(batch.column(1)).get(d, (np.zeros(0, np.int64), None))
            for lo in range(0, len(at), BLOCK):
                own = at[lo : lo + BLOCK]
                diff, squares = _deviations(x[lo : lo + BLOCK], n, sums)
                w = diff / n @ basis
                exact = [v for v in squares for _ in range(k)]
                ids = batch.column(0).take(pa.array(np.repeat(own, k)))
                white = pa.array(w.ravel(), pa.float64(), mask=np.tile(np.arange(k) >= live, len(own)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array([n] * len(exact), pa.int64()), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())]
                    + [pa.array(list(map(str, exact)), pa.string()), white, pa.array(explained * len(own), pa.float64()), pa.array([error] * len(exact), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable row and component: vec_id, component (from 1, by falling variance), n,
    deviation, whitened, explained, identity_error, and deviation_exact as text, which also holds
    what is too large for the long (null there).

    Entries are floor(256 * entry). Rows are left out whose vector is null, empty, holds null or
    non-finite entries or ones beyond a long, or has another length than most distinct vectors (of
    equally common lengths the larger counts). The fit list is each distinct vector once, so
    repeated rows and copies weigh nothing more; they all get their rows, null ids too. A component
    without variance (fewer distinct vectors than dimensions, constant dimensions) has whitened
    null and explained 0; where nothing varies explained and identity_error are null. Of equal
    variances the order is arbitrary, as it must be. Fewer dimensions than ``components`` give that
    many. No usable rows: no rows. Other columns are ignored whatever their names.
    """
    source = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    spark = vectors.sparkSession
    every = written(source.select("v").mapInArrow(_encoded, "d int, x binary").groupBy("d", "x").agg(F.count("*").alias("copies")), "whitening-fit")
    sizes = every.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], _OUT)
    d, n = sizes.d, sizes.n
    fit = every.filter(F.col("d") == d).select("x")
    cells = fit.mapInArrow(_sums(d), "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in cells.orderBy("dim").collect()]  # a row for each dimension
    sigma, v = jacobi(tsqr(fit, d, n, sums))
    total, k = float((sigma**2).sum()), min(components, d)
    live = int((sigma[:k] > sigma[0] * d * np.finfo(float).eps).sum()) if total > 0 else 0
    basis = np.zeros((d, k))
    basis[:, :live] = v[:, :live] * (np.sqrt(n) / sigma[:live])
    explained = [float(s) ** 2 / total if i < live else 0.0 for i, s in enumerate(sigma[:k])] if total > 0 else [None] * k
    error = None
    if live:
        sums2 = fit.mapInArrow(_moments(d, n, sums, basis[:, :live]), "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s"))
        got = np.zeros(live * live)
        for r in sums2.collect():  # components squared
            got[r.cell] = r.s
        error = float(np.abs(got.reshape(live, live) / n - np.eye(live)).max())
    return source.mapInArrow(_projected(d, n, sums, basis, live, explained, error), _OUT)
