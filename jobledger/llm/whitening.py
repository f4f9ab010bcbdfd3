"""Whitening of embeddings: blockwise QR of the centred rows, then the bidiagonal qd solver on R.

Components become integers, ``floor(scale * c) + offset``, so that counts, sums and deviations are exact. Tasks reduce their
centred rows to one triangle R of dimensions x dimensions each (covariance = R'R / n, but never formed, so small directions
keep their digits); triangles are stacked and reduced again, a few at a time, until one is left. ``bidiagonal`` finds its
singular values and right singular vectors, which are the covariance's eigenvalues (squared, over n) and eigenvectors.

Nothing that goes through the driver is larger than dimensions x dimensions numbers.

Defined results
    * Rows whose vector is null or has a null or non-finite entry are left out; an empty table gives no rows.
    * Directions without variance (eigenvalues below 1e-12 of the largest) cannot be whitened and have no rows; so a table
      whose vectors are all equal gives none. Equal eigenvalues: any orthonormal directions of their space.
    * Null and repeated ids are ordinary; rows that repeat get equal results. Other columns are ignored.
    * Vectors must have one length and integers below 2^52 in size; anything else is a ``ValueError``. A deviation beyond 64
      bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.bidiagonal import right_singular
from jobledger.llm.common import merge_packed, settle
from jobledger.llm.vector_codes import finite, floors

LARGEST = 1 << 52
ROWS_AT_ONCE = 4096
NO_VARIANCE = 1e-12
LONG = (1 << 63) - 1


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in slices of bounded size, with their vectors (column ``x``) as a matrix of integers."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            column = part.column(part.schema.get_field_index("x"))
            if np.any(np.diff(column.offsets.to_numpy()) != width):
                raise ValueError(f"vectors must have one length, {width} like the first")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError(f"components must be below {LARGEST} after scaling")
            yield part, values


@dataclass(frozen=True)
class Fit:
    """Number of vectors and exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact; as Python integers if 64 bits do not hold their squares."""
        means = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, means)]
        beside = x - np.array(means, np.int64)
        largest = self.n * (int(np.abs(beside).max(initial=0)) + 1)
        if largest * largest * len(means) <= LONG:
            return beside * self.n - np.array(rest, np.int64)
        return beside.astype(object) * self.n - np.array(rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


def fitted(rows: DataFrame, width: int) -> Fit:
    def add(batches):
        n, sums = 0, [0] * width
        for _, x in matrices(batches, width):
            n, sums = n + len(x), [a + b for a, b in zip(sums, _exact_sums(x))]
        if n:
            columns = [pa.array([v], pa.string()) for v in (str(n), *map(str, sums))]
            yield pa.RecordBatch.from_arrays(columns, names=["n", *[f"s{j}" for j in range(width)]])

    names = ["n", *[f"s{j}" for j in range(width)]]
    found = rows.select("x").mapInArrow(add, ", ".join(f"{n} string" for n in names))
    total = found.agg(*[F.sum(F.col(n).cast("decimal(38, 0)")).alias(n) for n in names]).first()
    return Fit(int(total["n"] or 0), tuple(int(total[n] or 0) for n in names[1:]))


def _exact_sums(x: np.ndarray) -> list[int]:
    # Halves of 32 bits, so that no sum of a slice overflows.
    return [(int(high) << 32) + int(low) for high, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]


def _triangle(above: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([above, rows]), mode="r")


def triangle(rows: DataFrame, fit: Fit) -> np.ndarray:
    """R of the QR decomposition of all centred rows (up to signs of its rows), dimensions x dimensions."""
    width = len(fit.sums)

    def factor(batches):
        above = np.zeros((0, width))
        for _, x in matrices(batches, width):
            above = _triangle(above, fit.centred(x))
        if len(above):
            yield pa.RecordBatch.from_arrays([pa.array([above.tobytes()], pa.binary())], names=["packed"])

    def merge(packed):
        above = np.zeros((0, width))
        for part in packed:
            above = _triangle(above, np.frombuffer(part).reshape(-1, width))
        return above.tobytes()

    found = np.frombuffer(merge_packed(rows.select("x").mapInArrow(factor, "packed binary"), merge) or b"").reshape(-1, width)
    return np.concatenate([found, np.zeros((width - len(found), width))])


@dataclass(frozen=True)
class Whitening:
    """``directions`` (dimensions x components) are unit eigenvectors of the covariance, by falling ``variances``."""

    fit: Fit
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ self.directions / np.sqrt(self.variances)


def learn(rows: DataFrame, width: int, components: int) -> Whitening | None:
    fit = fitted(rows, width)
    if not fit.n:
        return None
    squares, vectors = right_singular(triangle(rows, fit))
    kept = min(components, int(np.count_nonzero(squares > NO_VARIANCE * max(squares.max(initial=0.0), np.finfo(float).tiny))))
    variances = squares / fit.n
    return Whitening(fit, vectors[:, :kept], variances[:kept], variances[:kept] / max(variances.sum(), np.finfo(float).tiny))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Blocks are centred before they are multiplied, and merged by count, mean and scatter.
    """
    width, k = model.directions.shape

    def join(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def packed(state):
        return np.concatenate([[state[0]], state[1], state[2].ravel()]).tobytes()

    def unpacked(part):
        v = np.frombuffer(part)
        return v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)

    def measure(batches):
        state = (0.0, np.zeros(k), np.zeros((k, k)))
        for _, x in matrices(batches, width):
            if len(x):
                w = model.of(x)
                mean = w.mean(axis=0)
                state = join(state, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        if state[0]:
            yield pa.RecordBatch.from_arrays([pa.array([packed(state)], pa.binary())], names=["packed"])

    def merge(parts):
        state = (0.0, np.zeros(k), np.zeros((k, k)))
        for part in parts:
            state = join(state, unpacked(part))
        return packed(state) if state[0] else b""

    n, _, scatter = unpacked(merge_packed(rows.select("x").mapInArrow(measure, "packed binary"), merge))
    return float(np.abs(scatter / n - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    table: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """A row for each vector and component: its exact squared deviation times n², the whitened value, the component's share."""
    x = F.col(f"`{vector}`")
    whole = table.where(finite(x) & (F.size(x) > 0))
    moved = F.transform(floors(x, scale), lambda v: v + F.lit(offset).cast("long"))
    rows = settle(whole.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), moved.alias("x")), "integer-vectors")
    first = rows.first()
    model = learn(rows, len(first["x"]), components) if first else None
    if model is None or not len(model.variances):
        return table.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, model)
    width, k = model.directions.shape

    def project(batches):
        for part, values in matrices(batches, width):
            if not len(values):
                continue
            squares = (model.fit.deviations(values) ** 2).sum(axis=1).tolist()
            deviation = pa.array([s if s <= LONG else None for s in squares], pa.int64())
            of = pa.array(np.repeat(np.arange(len(values)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(values))),
                    pa.array(np.full(len(of), model.fit.n)),
                    deviation.take(of),
                    pa.array(model.of(values).ravel()),
                    pa.array(np.tile(model.explained, len(values))),
                    pa.array(np.full(len(of), error)),
                ],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(project, SCHEMA)
