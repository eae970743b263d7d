"""Whitening of vectors by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. All that the solver asks of it are products with a few columns at a time, which are Spark
jobs: each task centres its vectors, multiplies them by the columns and the result by itself, and the sums of the tasks
are added. The driver holds the search subspace, whose size is the vectors' length times a constant.

Each round takes the Ritz pairs of the subspace, locks those leading ones whose residuals are down at rounding, and widens
the subspace by corrections to the others: what MINRES gives, in a few steps that share their products, for the equation
(I - QQ')(V - theta)(I - QQ') t = -r, projected against the locked vectors and the pairs at work. A random direction
comes along each round, so that no leading eigenvector can stay outside of the subspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

KEPT = 4
BLOCK = 4096
EPS = float(np.finfo(np.float64).eps)


def _orthonormal(new: np.ndarray, *old: np.ndarray) -> np.ndarray:
    """Columns of new made orthonormal and orthogonal to old ones; what depends on them is left out."""
    base = np.concatenate([o for o in old if o.shape[1]] or [new[:, :0]], axis=1)
    out = base
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            if size > 0:
                column = column / np.linalg.norm(column)
                column = column - out @ (out.T @ column)
                left = np.linalg.norm(column)
                if left < 1e-10:
                    break
        else:
            if size > 0:
                out = np.concatenate([out, column[:, None] / np.linalg.norm(column)], axis=1)
    return out[:, base.shape[1] :]


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, against: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Least-residual solutions t of (I - QQ')(V - shift)(I - QQ') t = right, a column each, from Krylov spaces of a few
    steps; all columns share each product. against is Q."""
    project = lambda x: x - against @ (against.T @ x)
    right = project(right)
    size = np.linalg.norm(right, axis=0)
    n, k = right.shape
    basis, tall = [right / np.where(size > 0, size, 1)], np.zeros((k, steps + 1, steps))
    for m in range(steps):
        x = project(product(basis[m]) - basis[m] * shifts)
        before = np.linalg.norm(x, axis=0)
        for _ in range(2):  # against all earlier ones: a few vectors, and rounding stays out
            for i, b in enumerate(basis):
                part = (b * x).sum(0)
                tall[:, i, m] += part
                x = x - b * part
            x = project(x)  # else what rounding leaves of Q grows from step to step
        norm = np.linalg.norm(x, axis=0)
        norm[norm <= 1e-12 * before] = 0  # the space is exhausted: what is left is rounding
        tall[:, m + 1, m] = norm
        basis.append(np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0))
    out = np.zeros((n, k))
    for j in range(k):
        goal = np.zeros(steps + 1)
        goal[0] = size[j]
        y = np.linalg.lstsq(tall[j], goal, rcond=None)[0]
        out[:, j] = sum(y[m] * basis[m][:, j] for m in range(steps))
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int = KEPT, steps: int = 5, most: int = 80, rounds: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the largest eigenvalues of a symmetric positive semidefinite operator of that size, largest first,
    each with a residual of some rounding errors of the largest value. product multiplies it by the columns of a matrix.
    The subspace has up to `most` columns; beyond, it starts anew from the best of them."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, size)
    space = _orthonormal(rng.standard_normal((size, min(size, 2 * wanted))))
    image = product(space)
    locked = np.zeros((size, 0))
    found: list[float] = []
    # the space stays orthogonal to locked vectors, and holds all but them in the end
    for _ in range(rounds):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, moved = space @ s, image @ s
        residual = moved - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        top = max([*found, theta[0], 0.0])
        whole = space.shape[1] + locked.shape[1] >= size  # nothing is outside: the pairs are those of the operator
        ready = 0
        while ready < min(len(theta), wanted - len(found)) and (whole or np.linalg.norm(residual[:, ready]) <= 8 * np.sqrt(size) * EPS * top):
            ready += 1
        locked = np.concatenate([locked, ritz[:, :ready]], axis=1)
        found += theta[:ready].tolist()
        if len(found) == wanted:
            order = np.argsort(found)[::-1]
            return np.array(found)[order], _orthonormal(locked[:, order])
        ritz, moved, theta, residual = ritz[:, ready:], moved[:, ready:], theta[ready:], residual[:, ready:]
        space, image = ritz, moved
        if space.shape[1] + wanted + 1 > most:
            space, image = space[:, : most // 2], image[:, : most // 2]
        active = min(wanted - len(found), len(theta))
        columns = [np.zeros((size, 0))]
        if active:
            correction = minres(product, theta[:active], np.concatenate([locked, ritz[:, :active]], axis=1), -residual[:, :active], steps)
            columns.append(correction)
        new = _orthonormal(np.concatenate([*columns, rng.standard_normal((size, 1))], axis=1), locked, space)
        space, image = np.concatenate([space, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds")


def quantised(vectors: DataFrame, *keep: str) -> DataFrame:
    """The rows of vectors (embedding, and the columns keep) whose vector has entries, none of them null or not finite, with
    x: every entry times 256, rounded down, as whole numbers; beyond 64 bits the nearest of these."""
    entry = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return vectors.where(sound).select(*keep, F.transform(entry, lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: DataFrame) -> DataFrame:
    """Vectors (x) of one length as blocks (rows, x): raw 64-bit integers, some thousand vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([n]), pa.array([b"".join(held)])], ["rows", "x"])
        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column("x")).tobytes())
                n += batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return rows.select("x").mapInArrow(pack, "rows long, x binary")


def _added(fit: DataFrame, width: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], fan: int = 256) -> np.ndarray:
    """The sum of `of` over blocks of centred vectors. Tasks add up their own; beyond some hundred of them, groups of tasks
    are added up before the driver gets them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("x"):
                part = of(np.frombuffer(raw.as_py(), np.int64).reshape(-1, width) - mean)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(raw.as_py(), np.float64) for batch in batches for raw in batch.column("sums")]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(own, axis=0).tobytes()])], ["sums"])

    parts = fit.select("x").mapInArrow(summed, "sums binary")
    tasks = fit.rdd.getNumPartitions()
    if tasks > fan:
        parts = parts.repartition(int(np.ceil(tasks**0.5)), F.xxhash64("sums")).mapInArrow(again, "sums binary")
    return np.sum([np.frombuffer(r["sums"], np.float64) for r in parts.collect()], axis=0)


def _totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors the blocks hold, and the exact sum of each dimension."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("x"):
                x = np.frombuffer(raw.as_py(), np.int64).reshape(-1, width)
                at = np.arange(width)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], ["at", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = fit.select("x").mapInArrow(split, "at long, high long, low long").groupBy("at").agg(whole("high"), whole("low")).orderBy("at").collect()
    return fit.agg(F.sum("rows")).first()[0] or 0, [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 by row, None beyond 64 bits."""
    most = max(n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums)), 1) if len(x) else 1
    if x.shape[1] * most * most < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, kept: int = KEPT, **solver) -> DataFrame:
    """vectors (vec_id, embedding) projected on the leading `kept` eigenvectors of their covariance and scaled to variance
    one: rows (vec_id, component, n, deviation, whitened, explained, identity_error), component from 1.

    Entries are taken times 256 and rounded down. The covariance is that of all different vectors, each once. Rows whose
    vector is null or empty or has null or non-finite entries are left out, and those whose length isn't the commonest
    (of equally common ones the smaller). Repeated rows come out each; null ids stay null. Fewer dimensions than `kept`
    give fewer components. Without variance along a component whitened is null, without any at all explained too;
    deviation is null where it exceeds 64 bits. An empty table gives an empty one; other columns don't matter, whatever
    they are called. vectors is read three times; the different ones are kept in the shared folder.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors, "vec_id")
    widest = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widest is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widest["width"]
    rows = rows.where(F.size("x") == width)
    fit = written(_packed(rows.select("x").distinct()))
    n, sums = _totals(fit, width)
    mean = np.array([s / n for s in sums])

    def product(columns: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(columns)
        return _added(fit, width, mean, lambda x: x.T @ (x @ columns)).reshape(columns.shape) / n

    trace = float(_added(fit, width, mean, lambda x: np.array([(x * x).sum()]))[0]) / n
    values, vectors_ = jacobi_davidson(product, width, kept, **solver)
    values = np.clip(values, 0, trace)
    k = len(values)
    flat = values <= width * EPS * trace
    scaled = vectors_ / np.where(flat, 1, np.sqrt(np.where(flat, 1, values)))
    second = _added(fit, width, mean, lambda x: np.concatenate([(x @ scaled).T @ (x @ scaled), (x @ scaled).sum(0, keepdims=True)])).reshape(k + 1, k) / n
    off = np.abs(second[:k] - np.outer(second[k], second[k]) - np.eye(k))[np.ix_(~flat, ~flat)]
    error = float(off.max()) if off.size else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                x = _matrix(part.column("x"))
                m = len(x)
                columns = [
                    pa.array(np.repeat(np.arange(m), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(_deviations(x, n, sums), pa.int64()),
                    pa.array(((x - mean) @ scaled).ravel(), mask=np.tile(flat, m)), pa.array(np.tile(values / trace if trace > 0 else values, m), mask=np.full(m * k, not trace > 0)), pa.array(np.full(m * k, np.nan if error is None else error), mask=np.full(m * k, error is None)),
                ]
                at = columns[0]
                columns[0], columns[3] = part.column("vec_id").cast(pa.int64()).take(at), columns[3].take(at)
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
