"""Embedding whitening: components of the covariance by QDWH spectral divide and conquer, then a broadcast projection.

Sums and centred products are aggregated over all vectors on the executors; what reaches the driver is one matrix of the vectors'
dimension. Its eigenvectors come from polar decompositions:

1. The polar factor of ``A - sI`` is a matrix sign: +1 on the invariant subspace of eigenvalues above the shift s, -1 below.
   It is computed by QDWH, a Halley iteration whose weights follow a lower bound of the smallest singular value, with QR factors only.
2. ``(U + I) / 2`` projects on the upper subspace. Orthonormal bases of it and of its complement split A into two blocks.
3. Both blocks are split on, as far as the wanted components ask for, until a block is one number or a multiple of the identity.

The model (mean, components, eigenvalues) is broadcast: ``dims * (components + 2)`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import without

#: Largest size of a scaled entry: below it floor and sums are exact.
LARGEST = 2.0**52
_EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix that is not singular, by QR-based dynamically weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)  # Frobenius: not below the largest singular value
    # a bound from below of the smallest singular value; too small a one only takes another step
    least = max(1.0 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n)), _EPS)
    for _ in range(40):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square)) if least < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        moved, x = np.linalg.norm(new - x), new
        least = min(1.0, least * (wa + wb * square) / (1 + wc * square))
        if moved < np.cbrt(n * _EPS) and 1 - least < 1e-8:
            break
    return (3 * x - x @ (x.T @ x)) / 2  # one Newton-Schulz step takes what rounding left


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split at, between the smallest and the largest diagonal entry: the middle of the entries, the mean, then between them."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(len(a)))
    for k in range(1, 33):
        yield float(diagonal.mean() + spread * (0.61803398875 * k % 1 - 0.5))


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the eigenvalues above some shift, and k; None where a is a multiple of I."""
    n = len(a)
    for shift in _shifts(a):
        shifted = a - shift * np.eye(n)
        if np.linalg.norm(shifted) <= 4 * n * _EPS * scale:
            return None
        try:
            projector = (polar(shifted) + np.eye(n)) / 2
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            continue
        projector = (projector + projector.T) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n or not np.all(np.isfinite(projector)):
            continue
        # two rounds of subspace iteration with a fixed start give bases of the range and of its complement
        start = np.random.default_rng(7).standard_normal((n, n))
        upper = np.linalg.qr(projector @ np.linalg.qr(projector @ start[:, :k])[0])[0]
        rest = start[:, k:]
        for _ in range(2):
            rest = rest - projector @ rest
            rest = np.linalg.qr(rest - upper @ (upper.T @ rest))[0]
        basis = np.hstack([upper, rest])
        if np.linalg.norm(upper.T @ a @ rest) <= 64 * n * _EPS * scale:
            return basis, k
    return None


def _rotated(block: np.ndarray, basis: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Plane rotations for a block that no shift splits, since its eigenvalues are too close to each other."""
    block, basis = block.copy(), basis.copy()
    for _ in range(8 * len(block) ** 2):
        off = np.abs(np.triu(block, 1))
        i, j = np.unravel_index(np.argmax(off), off.shape)
        if off[i, j] <= _EPS * scale:
            break
        angle = 0.5 * np.arctan2(2 * block[i, j], block[i, i] - block[j, j])
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        block[:, [i, j]] = block[:, [i, j]] @ turn
        block[[i, j], :] = turn.T @ block[[i, j], :]
        basis[:, [i, j]] = basis[:, [i, j]] @ turn
    return block, basis


def components_of(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    The larger entry of a vector in size, the first of equal ones, is positive; within one eigenvalue the basis is as the splits left it.
    """
    scale = float(np.linalg.norm(a)) or 1.0
    done: list[tuple[float, np.ndarray]] = []
    stack = [(a, np.eye(len(a)), min(wanted, len(a)))]  # a block, its basis, and how many of its largest are asked for
    while stack:
        block, basis, want = stack.pop()
        off = block - np.diag(np.diag(block))
        found = None if len(block) == 1 or np.linalg.norm(off) <= _EPS * scale else _split(block, scale)
        if found is None:
            block, basis = _rotated(block, basis, scale)
            done += [(float(block[i, i]), basis[:, i]) for i in range(len(block))]
            continue
        parts, k = found
        turned = parts.T @ block @ parts
        turned = (turned + turned.T) / 2
        if want > k:
            stack.append((turned[k:, k:], basis @ parts[:, k:], want - k))
        stack.append((turned[:k, :k], basis @ parts[:, :k], min(want, k)))
    done.sort(key=lambda x: -x[0])
    vectors = np.array([v / np.linalg.norm(v) for _, v in done[:wanted]]).reshape(-1, len(a))
    signs = np.sign(vectors[np.arange(len(vectors)), np.argmax(np.abs(vectors), axis=1)]) if len(vectors) else np.ones(0)
    vectors = vectors * np.where(signs == 0, 1, signs)[:, None]
    return np.einsum("ij,jk,ik->i", vectors, a, vectors), vectors


@dataclass(frozen=True)
class Whitening:
    """A fitted model. ``n`` vectors of sums ``sums`` (exact); components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    offset: int

    @property
    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean in two parts: its floor, and what is left of it."""
        n = max(1, self.n)
        low = np.array([s // n for s in self.sums], np.int64)
        return low, np.array([(s % n) / n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance that is more than rounding of the largest."""
        most = self.values.max(initial=0.0)
        return self.values > len(self.sums) * _EPS * most


def usable_rows(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there, has entries, and only finite ones."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite)


def _whole(column: pa.Array, scale: float, offset: int) -> np.ndarray:
    """floor(scale * entry) + offset of a list column without nulls, as a matrix; rows of another length are an error."""
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return np.zeros((0, 0), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries cannot be whitened together")
    x = np.floor(flat * scale)
    if np.abs(x).max() >= LARGEST:
        raise ValueError(f"an entry times {scale} is 2^52 or larger: its sums would not be exact")
    return x.astype(np.int64).reshape(n, sizes[0]) + offset


def _sums(scale: float, offset: int):
    """mapInArrow: vectors -> (dimension, exact sum) of a task, and its number of vectors at minus their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _whole(batch.column(0), scale, offset)
            if not len(x):
                continue
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)  # neither can overflow in a batch
            own = [(int(h) << 26) + int(v) for h, v in zip(high, low)]
            if total is not None and len(total) != len(own):
                raise ValueError(f"vectors of {len(total)} and of {len(own)} entries cannot be whitened together")
            total = own if total is None else [a + b for a, b in zip(total, own)]
            n += len(x)
        rows = [(-len(total), n), *enumerate(total)] if total else []
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array([Decimal(v) for _, v in rows], pa.decimal128(38, 0))], names=["dim", "total"])

    return run


def _products(scale: float, offset: int, low: np.ndarray, part: np.ndarray, project: np.ndarray | None):
    """mapInArrow: vectors -> (i, j, sum over a task of the products of centred entries i <= j), of projections where ``project`` is given.

    Row -1 has the sums of the entries themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = first = None
        for batch in batches:
            x = _whole(batch.column(0), scale, offset)
            if not len(x):
                continue
            d = (x - low) - part
            d = d if project is None else d @ project.T
            products = d.T @ d + (0 if products is None else products)
            first = d.sum(axis=0) + (0 if first is None else first)
        i, j = np.triu_indices(0 if products is None else len(products))
        values = np.zeros(0) if products is None else products[i, j]
        if first is not None:
            i, j, values = np.r_[np.full(len(first), -1), i], np.r_[np.arange(len(first)), j], np.r_[first, values]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.float64())], names=["i", "j", "v"])

    return run


def _covariance(rows: DataFrame, column: str, n: int, size: int, scale: float, offset: int, low: np.ndarray, part: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the vectors, or of their projections; ``size`` squared numbers reach the driver."""
    v = rows.select(F.col(f"`{column}`").alias("v"))
    found = v.mapInArrow(_products(scale, offset, low, part, project), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    products, first = np.zeros((size, size)), np.zeros(size)
    for r in found.collect():
        if r.i < 0:
            first[r.j] = r.v
        else:
            products[r.i, r.j] = products[r.j, r.i] = r.v
    mean = first / n  # what rounding left of the centre
    return products / n - np.outer(mean, mean)


def fit(vectors: DataFrame, *, components: int = 8, scale: float = 1024, offset: int = 100_000, vector_col: str = "embedding") -> Whitening:
    """Fits on all usable rows (see ``usable_rows``): entries are ``floor(scale * entry) + offset``, covariances have the divisor n.

    Vectors of different lengths are an error. No usable row gives a model of no components; fewer dimensions than ``components`` give
    as many. Repeated rows count each.
    """
    rows = usable_rows(vectors, vector_col)
    found = rows.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(_sums(scale, offset), "dim int, total decimal(38,0)")
    totals = {r.dim: int(r.total) for r in found.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    lengths = sorted(-d for d in totals if d < 0)
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and of {lengths[-1]} entries cannot be whitened together")
    n = totals.pop(-lengths[0]) if lengths else 0
    sums = tuple(totals[d] for d in range(len(totals)))
    empty = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0, scale, offset)
    if not n:
        return empty
    low, part = empty.means
    v = _covariance(rows, vector_col, n, len(sums), scale, offset, low, part)
    values, basis = components_of(v, components)
    return Whitening(n, sums, values, basis, float(np.trace(v)), scale, offset)


def whiten(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding") -> DataFrame:
    """The usable rows with ``deviation`` and ``whitened``; other rows go, as the model says nothing about them.

    ``whitened`` holds ``(x - S / n)`` projected on each component over the root of its eigenvalue; it is null for a component without
    variance. ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2`` as a whole decimal, exact. Other columns pass through,
    columns named as the new ones are replaced; repeated rows stay.
    """
    vectors = without(usable_rows(vectors, vector_col), ["deviation", "whitened"])
    low, part = model.means
    ok = model.usable
    matrix = (model.vectors[ok] / np.sqrt(model.values[ok])[:, None]).T
    shipped = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.scale, model.offset, low, part, ok, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scale, offset, low, part, ok, matrix = shipped.value
        rest = np.array([s - n * int(m) for s, m in zip(sums, low)], np.int64)  # n * x - S = n * (x - low) - rest
        for batch in batches:
            row = batch.column(0)
            x = _whole(batch.column(1), scale, offset)
            if len(x) and x.shape[1] != len(sums):
                raise ValueError(f"the model has {len(sums)} dimensions, a vector {x.shape[1]}")
            white = np.full((len(x), len(ok)), np.nan)
            deviation: list[int] = []
            if len(x):
                near = x - low
                white[:, ok] = (near - part) @ matrix
                bound = n * (int(np.abs(near).max()) + 1)
                if bound * bound * len(sums) < 1 << 63:
                    d = n * near - rest
                    deviation = np.einsum("ij,ij->i", d, d).tolist()
                else:
                    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, rest.tolist())) for r in near.tolist()]
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(ok), pa.int32()), flat)
            columns = [row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], names=[*(f.name for f in row.type), "deviation", "whitened"])

    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row")
    schema = T.StructType([*vectors.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.select(row, F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding") -> float:
    """Largest entry in size of the whitened vectors' covariance minus the identity, measured over all usable rows."""
    ok = model.usable
    if not model.n or not ok.any():
        return 0.0
    low, part = model.means
    matrix = model.vectors[ok] / np.sqrt(model.values[ok])[:, None]
    found = _covariance(usable_rows(vectors, vector_col), vector_col, model.n, len(matrix), model.scale, model.offset, low, part, matrix)
    return float(np.abs(found - np.eye(len(found))).max())
