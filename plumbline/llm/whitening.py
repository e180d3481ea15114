"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Entries become integers ``x = floor(64 * c) + 1000000``; every distinct ``x``
vector counts once in the fit.  Each task reduces its centred rows to one
triangular factor R, block by block, and factors are merged in groups until one
is left, so that no product of rows is ever formed and what meets in a task is
a bounded number of dim x dim matrices.  On that one matrix Householder
reflections make a bidiagonal B, dqds finds its singular values to high relative
accuracy, and twisted factorisations of B'B - s^2 give one right vector each.
Values closer than ``CLUSTER`` share their directions: their vectors come from
solves with the twisted factors, made orthogonal to each other.

Whitened coordinates are projections divided by the standard deviation; they
are measured once more over the whole fit list (``identity_error``).

Defined results: vectors that are null, empty, or hold null or non-finite
entries are dropped, and so are those of another length than most (the longer
at a tie); repeated rows, ids and null ids stay as they are; scaled entries beyond
2^53 count as 2^53; a component whose deviation is below ``RANK`` times
the largest has null ``whitened``, as have all in a fit list of one vector;
``explained`` is null where nothing varies; ``deviation`` is null where it
exceeds a 64-bit integer; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import task_block, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block of the QR, and factors merged by one task.
BLOCK_ROWS, MERGED = 4_096, 16
#: Relative distance of eigenvalues below which their vectors are made orthogonal to each other.
CLUSTER = 1e-3
#: Singular values below this share of the largest are rounding errors.
RANK = 1e-11
_EPS = float(np.finfo(float).eps)
_EDGE = float(1 << 53)


# Singular values and vectors of one small matrix ------------------------------------------------


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of B = U'AP for a square matrix, and the unit vectors of P's reflections."""
    a, n = a.copy(), len(a)
    diagonal, above, turns = np.zeros(n), np.zeros(max(0, n - 1)), []

    def reflection(v: np.ndarray) -> tuple[np.ndarray, float]:
        top = float(np.linalg.norm(v))
        if top == 0:
            return np.zeros_like(v), 0.0
        u = v / top
        sign = 1.0 if u[0] >= 0 else -1.0
        u[0] += sign
        return u / np.linalg.norm(u), -sign * top

    for k in range(n):
        u, diagonal[k] = reflection(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(u, u @ a[k:, k + 1 :])
        if k + 1 < n:
            w, above[k] = reflection(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            turns.append(w)
    return diagonal, above, turns


def turned(z: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """P z for the reflections of ``bidiagonal``."""
    z = z.copy()
    for k in range(len(turns) - 1, -1, -1):
        z[k + 1 :] -= 2 * turns[k] * (turns[k] @ z[k + 1 :])
    return z


def _differential_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift is above the least eigenvalue."""
    d, new_q, new_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        pivot = d + e[k]
        if pivot == 0 and shift:
            return None
        factor = q[k + 1] / pivot if pivot else 0.0
        new_q.append(pivot)
        new_e.append(e[k] * factor)
        d = d * factor - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _lower_end(q: list[float], e: list[float]) -> tuple[float, float]:
    """Least eigenvalue of the last 2 x 2 block of BB', and the size of what couples it to the rest."""
    a, c, b2 = q[-2] + e[-1], q[-1], q[-1] * e[-1]
    half = (a + c) / 2
    root = math.sqrt(((a - c) / 2) ** 2 + b2)
    least = (a * c - b2) / (half + root) if half + root else 0.0
    return max(0.0, least), math.sqrt(q[-2] * e[-2]) if len(e) > 1 else 0.0


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds."""
    top = max([0.0, *np.abs(diagonal), *np.abs(above)])
    if top == 0:
        return np.zeros(len(diagonal))
    small = (16 * _EPS) ** 2
    found: list[float] = []
    waiting = [([float(v) ** 2 for v in diagonal / top], [float(v) ** 2 for v in above / top], 0.0)]
    left = 200 * len(diagonal) + 1000
    while waiting:
        q, e, base = waiting.pop()
        while e:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= small * base or e[k] == 0), None)
            if cut is None and e[-1] <= small * (base + q[-1]):
                cut = len(e) - 1
            if cut is not None:
                waiting.append((q[cut + 1 :], e[cut + 1 :], base))
                q, e = q[: cut + 1], e[:cut]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            least, coupling = _lower_end(q, e)
            for shift in (max(least - coupling, 0.75 * least), 0.25 * least, 0.0):
                if step := _differential_step(q, e, shift):
                    break
            q, e = step
            base += shift
            left -= 1
            if left < 0:
                raise ArithmeticError("qd iteration does not converge")
        found += [base + v for v in q]
    return np.sort(np.array(found))[::-1] * top * top


class Twisted:
    """Factors of B'B - value: LDL' from the top and UDU' from the bottom, joined where the pivot is least."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        a2, b2 = (diagonal**2).tolist(), (above**2).tolist()
        ab = (diagonal[: n - 1] * above).tolist()
        tiny = _EPS * max(value, float(np.finfo(float).tiny))
        down, up = [0.0] * n, [0.0] * n
        self.low, self.high = [0.0] * (n - 1), [0.0] * (n - 1)
        stationary, progressive = [0.0] * n, [0.0] * n
        stationary[0] = -value
        for k in range(n - 1):
            down[k] = (a2[k] + stationary[k]) or tiny
            self.low[k] = ab[k] / down[k]
            stationary[k + 1] = b2[k] / down[k] * stationary[k] - value
        down[n - 1] = (a2[n - 1] + stationary[n - 1]) or tiny
        progressive[n - 1] = a2[n - 1] - value
        for k in range(n - 2, -1, -1):
            up[k + 1] = (b2[k] + progressive[k + 1]) or tiny
            self.high[k] = ab[k] / up[k + 1]
            progressive[k] = progressive[k + 1] / up[k + 1] * a2[k] - value
        pivots = [s + p + value for s, p in zip(stationary, progressive, strict=True)]
        self.at = min(range(n), key=lambda k: abs(pivots[k]))
        self.pivots = [*down[: self.at], pivots[self.at] or tiny, *up[self.at + 1 :]]

    def vector(self) -> np.ndarray:
        """The direction that the twisted factors almost annihilate."""
        n = len(self.pivots)
        z = [0.0] * n
        z[self.at] = 1.0
        for k in range(self.at - 1, -1, -1):
            z[k] = -self.low[k] * z[k + 1]
        for k in range(self.at, n - 1):
            z[k + 1] = -self.high[k] * z[k]
        return np.array(z) / np.linalg.norm(z)

    def solve(self, right: np.ndarray) -> np.ndarray:
        y, at, n = right.tolist(), self.at, len(self.pivots)
        for k in range(at):
            y[k + 1] -= self.low[k] * y[k]
        for k in range(n - 2, at - 1, -1):
            y[k] -= self.high[k] * y[k + 1]
        y = [v / p for v, p in zip(y, self.pivots, strict=True)]
        for k in range(at - 1, -1, -1):
            y[k] -= self.low[k] * y[k + 1]
        for k in range(at, n - 1):
            y[k + 1] -= self.high[k] * y[k]
        z = np.array(y)
        return z / np.linalg.norm(z)


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest singular values of a square matrix, and right vectors as columns; values below ``RANK`` are 0."""
    diagonal, above, turns = bidiagonal(a)
    squares = squared_values(diagonal, above)
    wanted = min(most, len(a))
    values = np.sqrt(squares[:wanted])
    if len(values):
        values[values <= RANK * values[0]] = 0
    vectors = np.zeros((len(a), wanted))
    k = 0
    while k < wanted and values[k] > 0:
        end = k + 1
        while end < len(squares) and squares[end - 1] - squares[end] <= CLUSTER * squares[end - 1]:
            end += 1
        own: list[np.ndarray] = []
        for j in range(k, min(end, wanted)):
            factors = Twisted(diagonal, above, float(squares[j]))
            if end == k + 1:
                own.append(factors.vector())
                continue
            z = np.random.default_rng(j).normal(size=len(a))
            for _ in range(3):
                z = factors.solve(z)
                for _ in range(2):
                    for other in own:
                        z -= other * (other @ z)
                    z /= np.linalg.norm(z)
            own.append(z)
        for j, z in enumerate(own, start=k):
            v = turned(z, turns)
            vectors[:, j] = v if v[np.abs(v).argmax()] > 0 else -v
        k = end
    return values, vectors


# Rows ----------------------------------------------------------------------------------------


def scaled_rows(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of all vectors of a batch, which of them take part, and the integers of those of ``length`` as rows."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    wrong = np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(numbers)]
    fine = sizes > 0
    fine[wrong] = False
    if length is None:
        return sizes, fine, np.empty((0, 0), np.int64)
    fine &= sizes == length
    own = numbers[np.repeat(fine, sizes)].reshape(-1, length)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(own * SCALE), -_EDGE, _EDGE).astype(np.int64) + SHIFT
    return sizes, fine, x


def _unpacked(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, length)


def common_length(vectors: DataFrame) -> int | None:
    """The most frequent length of vectors that take part, the longer at a tie; ``vectors`` has one column ``v``."""

    def lengths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes, fine, _ = scaled_rows(batch.column(0))
            own, counts = np.unique(sizes[fine], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts)], ["length", "n"])

    best = vectors.mapInArrow(lengths, "length bigint, n bigint").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return best and int(best["length"])


def fit_list(vectors: DataFrame, length: int) -> DataFrame:
    """Each distinct integer vector once, as little-endian 64-bit numbers, written to the shared folder."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            _, _, x = scaled_rows(batch.column(0), length)
            data = x.astype("<i8").tobytes()
            rows = [data[at : at + 8 * length] for at in range(0, len(data), 8 * length)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])

    return written(vectors.mapInArrow(packed, "x binary").distinct(), "fit_list")[0]


def exact_sums(fits: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exactly."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in parts:
            x = _unpacked(batch, length)
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
        sums = [Decimal((int(h) << 26) + int(v)) for h, v in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], ["k", "n", "total"])

    rows = fits.mapInArrow(partial, "k int, n bigint, total decimal(38,0)").groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_place = {r["k"]: r for r in rows}
    return int(rows[0]["n"]), [int(by_place[k]["total"]) for k in range(length)]


def centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean, which is the integers ``base`` plus the fractions ``rest``: exact but for one rounding."""
    return (x - base).astype(float) - rest


def triangular_factor(fits: DataFrame, length: int, base: np.ndarray, rest: np.ndarray, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""

    def joined(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack((r, rows)), mode="r")

    def reduce_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, length)), False
        for batch in parts:
            rows = centred(_unpacked(batch, length), base, rest)
            for at in range(0, len(rows), block_rows):
                r, seen = joined(r, rows[at : at + block_rows]), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([task_block()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["block", "r"])

    def merge(group: pa.Table) -> pa.Table:
        r = np.zeros((0, length))
        for at in np.argsort(group.column("block").to_numpy()):
            r = joined(r, np.frombuffer(group.column("r")[int(at)].as_py()).reshape(-1, length))
        return pa.table({"block": pa.array([group.column("merged")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors, _ = written(fits.mapInArrow(reduce_rows, "block bigint, r binary"), "factors")
    blocks = factors.agg(F.max("block")).first()[0] + 1
    while blocks > 1:
        merged = factors.withColumn("merged", F.floor(F.col("block") / F.lit(MERGED)))
        factors, blocks = merged.groupBy("merged").applyInArrow(merge, "block bigint, r binary"), -(-blocks // MERGED)
    r = np.frombuffer(factors.first()["r"]).reshape(-1, length)
    return np.vstack((r, np.zeros((length - len(r), length))))


def identity_error(fits: DataFrame, model: dict) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    length, to, n = model["length"], model["directions"][:, model["values"] > 0], model["n"]
    k, base, rest = to.shape[1], model["base"], model["rest"]
    if not k:
        return None

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in parts:
            w = centred(_unpacked(batch, length), base, rest) @ to
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "total"])

    rows = fits.mapInArrow(partial, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros((k + 1) * k)
    for row in rows:
        flat[row["at"]] = row["total"]
    moments = flat.reshape(k + 1, k) / n
    return float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> dict | None:
    """Mean, directions (columns, scaled to unit variance), deviations and shares of variance; None without vectors.

    The model holds a few numbers a dimension and component, whatever the number of rows.
    """
    v = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    length = common_length(v)
    if length is None:
        return None
    fits = fit_list(v, length)
    n, sums = exact_sums(fits, length)
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    r = triangular_factor(fits, length, base, rest)
    values, directions = leading(r, components)
    whole = float((r**2).sum())
    scale = np.divide(math.sqrt(n), values, out=np.zeros_like(values), where=values > 0)
    model = {"length": length, "n": n, "sums": sums, "base": base, "rest": rest, "values": values, "directions": directions * scale}
    model["explained"] = (values**2 / whole).tolist() if whole else [None] * len(values)
    model["identity_error"] = identity_error(fits, model)
    return model


def squared_deviations(x: np.ndarray, n: int, sums: list[int], base: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; null where it exceeds a 64-bit integer."""
    left = np.array([s - n * int(b) for s, b in zip(sums, base, strict=True)], np.int64)
    apart = x - base
    widest = int(np.abs(apart).max(initial=0)) * n + n
    if widest * widest * x.shape[1] < 1 << 63:
        d = apart * n - left
        return (d * d).sum(axis=1).tolist()
    exact = (sum((int(a) * n - int(b)) ** 2 for a, b in zip(row, left, strict=True)) for row in apart)
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, model: dict | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``whitened``, with the share of variance and the measured error of the fit."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    if model is None:
        return rows.limit(0).selectExpr("vec_id", *[f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in schema.split(", ")[1:])])
    k = len(model["values"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            _, fine, x = scaled_rows(batch.column(1), model["length"])
            w = centred(x, model["base"], model["rest"]) @ model["directions"]
            m = len(x)
            each = np.repeat(np.arange(m), k)
            nothing = np.tile(model["values"] == 0, m)
            ids = batch.column(0).filter(pa.array(fine)).take(pa.array(each))
            deviation = pa.array(squared_deviations(x, model["n"], model["sums"], model["base"]), pa.int64()).take(pa.array(each))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model["n"])),
                deviation,
                pa.array(w.ravel(), pa.float64(), mask=nothing),
                pa.array(model["explained"] * m, pa.float64()),
                pa.array([model["identity_error"]] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
