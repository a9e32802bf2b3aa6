"""Whitening of vectors by the leading eigenvectors of their covariance, found with a Jacobi-Davidson method.

The covariance is never formed. A product with a block of directions is one pass over the vectors: every task centres
its rows, projects them and sums; the sums of the tasks are added as fixed-point numbers, so their order does not
matter and a repeated task changes nothing. The driver holds directions only, never rows: a subspace of at most
``SPACE`` times the components.

A round takes the best directions of the subspace (Rayleigh-Ritz) with their residuals. Those at the precision of
doubles are locked. For the others a correction equation, projected against the directions already known, is solved
with a few steps of MINRES; all equations advance together, so that a step is one pass. The corrections extend the
subspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.session import pin

#: Size of the subspace at which it is cut back to the best directions, in components; inner steps; rounds.
SPACE, STEPS, ROUNDS = 5, 6, 60
#: Residuals below this share of the trace count as double precision.
PRECISION = 4e-15
#: Directions with less than this share of the trace hold no variance that doubles can tell from zero.
NOTHING = 1e-13
SUM_BITS = 60

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """Of n vectors: per-dimension sums (exact), components as columns with their eigenvalues, trace, and how it was found."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    products: int


def orthogonal(block: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``block`` add to the known orthonormal columns."""
    basis = np.hstack(known)
    out: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            held = np.column_stack([basis, *out])
            column = column - held @ (held.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out.append(column)
    return np.column_stack(out) if out else np.zeros((len(block), 0))


def minres(product: Product, shifts: np.ndarray, known: np.ndarray, right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Approximate solutions of (I - QQ') (A - shift) (I - QQ') t = right, a column each, all advanced together.

    Q are the orthonormal columns ``known``; right and solutions are orthogonal to them. A column stops when its
    residual is down to ``share`` of the first.
    """

    def outside(block: np.ndarray) -> np.ndarray:
        return block - known @ (known.T @ block)

    y = outside(right)
    first = np.linalg.norm(y, axis=0)
    x, w, w2, r1, r2 = (np.zeros_like(y) for _ in range(5))
    r2 = y.copy()
    beta, old_beta = first.copy(), np.ones_like(first)
    d_bar, epsilon, sine = (np.zeros_like(first) for _ in range(3))
    cosine, phi_bar = -np.ones_like(first), first.copy()
    going = first > 0
    for step in range(steps):
        v = np.where(going, y / np.where(going, beta, 1), 0)
        y = outside(product(v) - v * shifts)
        if step:
            y = y - r1 * (beta / old_beta)
        alpha = (v * y).sum(axis=0)
        y = y - r2 * (alpha / np.where(beta > 0, beta, 1))
        r1, r2, old_beta = r2, y, np.where(going, beta, 1)
        beta = np.linalg.norm(y, axis=0)
        old_epsilon = epsilon
        delta, g_bar = cosine * d_bar + sine * alpha, sine * d_bar - cosine * alpha
        epsilon, d_bar = sine * beta, -cosine * beta
        gamma = np.maximum(np.hypot(g_bar, beta), np.finfo(float).tiny)
        cosine, sine = g_bar / gamma, beta / gamma
        phi, phi_bar = cosine * phi_bar, sine * phi_bar
        w1, w2 = w2, w
        w = (v - w1 * old_epsilon - w2 * delta) / gamma
        x = x + np.where(going, w * phi, 0)
        going = going & (phi_bar > share * first) & (beta > 1e-14 * np.abs(shifts))
        if not going.any():
            break
    return outside(x)


def jacobi_davidson(product: Product, size: int, k: int, trace: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors and residual norms of the k largest of a symmetric positive matrix.

    ``product`` multiplies it with a block of columns of length 1 or less. Fewer than k come back if the matrix has no
    more that hold a share of the trace.
    """
    k = min(k, size)
    empty = np.zeros((size, 0))
    start = np.random.default_rng(7).standard_normal((size, k))
    locked, space = empty, orthogonal(start, empty)
    space = orthogonal(product(space), empty) if trace else space
    space = np.hstack([space, orthogonal(start, space)[:, : k - space.shape[1]]])
    image = product(space)
    best, stuck = np.full(k, np.inf), 0
    for _ in range(ROUNDS):
        wanted = k - locked.shape[1]
        inner = space.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        near, theta = space[:, :wanted], values[:wanted]
        residual = image[:, :wanted] - near * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        worst = norms.max(initial=0)
        stuck = 0 if worst < 0.5 * best[: len(norms)].max(initial=0) else stuck + 1
        best = np.minimum(best[: len(norms)], norms)
        whole = space.shape[1] + locked.shape[1] == size  # the subspace is all there is: rounding is all that is left
        right = (norms <= PRECISION * trace) | whole | ((stuck > 3) & (norms <= 100 * PRECISION * trace))
        if right.any():
            locked = np.hstack([locked, near[:, right]])
            rest = np.concatenate([~right, np.ones(space.shape[1] - wanted, bool)])
            space, image, best, stuck = space[:, rest], image[:, rest], best[~right], 0
            near, theta, residual = near[:, ~right], theta[~right], residual[:, ~right]
            if locked.shape[1] == k:
                break
        if space.shape[1] + wanted > SPACE * k:
            space, image = space[:, : 2 * k], image[:, : 2 * k]
        known = orthogonal(np.hstack([locked, near]), empty)
        correction = minres(product, theta, known, -residual, steps, 0.02)
        fresh = orthogonal(np.hstack([correction, residual]), locked, space)[:, : k]
        if not fresh.shape[1]:
            fresh = orthogonal(np.random.default_rng(space.shape[1]).standard_normal((size, 1)), locked, space)
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    else:
        raise RuntimeError("the eigenvectors did not reach double precision")
    found = orthogonal(locked, empty)
    image = product(found)
    inner = found.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    found, image = found @ turn, image @ turn
    keep = values > NOTHING * trace
    norms = np.linalg.norm(image - found * values, axis=0)
    return values[keep], found[:, keep] / np.linalg.norm(found[:, keep], axis=0), norms[keep]


def usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(False))


def rows_of(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Integer rows of one width; missing last entries become ``fill``."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def summed(base: DataFrame, columns: list[str], partial: Callable[[list[pa.Array]], np.ndarray]) -> list[int]:
    """Sums over all rows of the integer vectors that ``partial`` makes of batches. Only one number a place leaves Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = partial([batch.column(c) for c in columns]).astype(object)
            total = part if total is None else total + part
        if total is not None:
            places = pa.array(np.arange(len(total)))
            yield pa.RecordBatch.from_arrays([places, pa.array([str(v) for v in total])], ["place", "value"])

    parts = base.select(*columns).mapInArrow(run, "place bigint, value string")
    found = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    return [int(r["value"]) for r in sorted(found, key=lambda r: r["place"])]


def fixed(values: np.ndarray, bound: float) -> np.ndarray:
    """Numbers of a known bound as whole multiples of its 2**-60th part."""
    return np.rint(np.ldexp(values / bound, SUM_BITS)).astype(np.int64)


def squares(rows: np.ndarray) -> np.ndarray:
    top = int(np.abs(rows).max(initial=0))
    if top * top * max(len(rows), 1) < 1 << 62:
        return (rows * rows).sum(axis=0)
    return (rows.astype(object) ** 2).sum(axis=0)


def centred(rows: np.ndarray, middle: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Rows minus their mean, which is ``middle`` (whole) + ``rest``: the large part is taken off exactly."""
    return (rows - middle).astype(np.float64) - rest


def mean_parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    middle = [s // n for s in sums]
    return np.array(middle, dtype=np.int64), np.array([float(Fraction(s - m * n, n)) for s, m in zip(sums, middle)])


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int, shift: int) -> DataFrame:
    """Usable rows as (_id, _x), entries floor(scale * c) + shift, written once as every pass reads them."""
    x = F.transform(F.col("_v"), lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint") + F.lit(shift))
    own = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector}`").alias("_v"))
    return pin(own.filter(usable(F.col("_v"))).select("_id", x.alias("_x")))


def fit(base: DataFrame, k: int, shift: int) -> Whitening:
    """Components of the rows of ``base`` (_id, _x)."""
    width = base.agg(F.max(F.size("_x"))).first()[0] or 0
    if not width:
        return Whitening(base.count(), [], np.zeros(0), np.zeros((0, 0)), 0.0, np.zeros(0), 0)

    def first(columns: list[pa.Array]) -> np.ndarray:
        rows = rows_of(columns[0], width, shift)
        return np.concatenate([np.array([len(rows)], dtype=object), rows.sum(axis=0).astype(object), squares(rows - shift).astype(object)])

    n, *rest = summed(base, ["_x"], first)
    sums, square = rest[:width], rest[width:]
    lean = [s - shift * n for s in sums]
    trace = float(sum(Fraction(n * q - s * s, n * n) for q, s in zip(square, lean)))
    middle, fraction = mean_parts(n, sums)
    asked = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal asked
        asked += 1
        shape = block.shape

        def part(columns: list[pa.Array]) -> np.ndarray:
            rows = centred(rows_of(columns[0], width, shift), middle, fraction)
            return fixed((rows.T @ (rows @ block)).ravel(), 2 * trace * n)

        total = np.array([float(v) for v in summed(base, ["_x"], part)])
        return (np.ldexp(total, -SUM_BITS) * (2 * trace)).reshape(shape)

    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, np.zeros(0), 0)
    values, vectors, residuals = jacobi_davidson(product, width, k, trace)
    return Whitening(n, sums, values, vectors, trace, residuals, asked)


def whitened_rows(rows: np.ndarray, model: Whitening) -> np.ndarray:
    middle, fraction = mean_parts(model.n, model.sums)
    return centred(rows, middle, fraction) @ (model.vectors / np.sqrt(model.values))


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sums of (n * x - S)**2; an error if one is no long."""
    middle = [s // n for s in sums]
    rest = np.array([s - m * n for s, m in zip(sums, middle)], dtype=np.int64)
    off = rows - np.array(middle, dtype=np.int64)
    top = (int(np.abs(off).max(initial=0)) + 1) * n
    if top * top * max(len(sums), 1) < 1 << 62:
        return ((off * n - rest) ** 2).sum(axis=1)
    return np.array(((off.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1).tolist(), dtype=np.int64)


def identity_error(base: DataFrame, model: Whitening, shift: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from one more pass over all rows."""
    k, width = len(model.values), len(model.sums)

    def part(columns: list[pa.Array]) -> np.ndarray:
        w = whitened_rows(rows_of(columns[0], width, shift), model)
        # sums of w are at most n in size, as those of w * w are n
        return fixed(np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]), 4.0 * model.n)

    total = np.array([float(v) for v in summed(base, ["_x"], part)]) * 4.0 / (1 << SUM_BITS)
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row per usable vector: id, n, deviation, whitened (array of up to k), explained (array) and identity_error.

    Entries become x = floor(scale * c) + shift. Vectors that are null or hold null, NaN or infinite entries take no
    part; missing last entries of shorter vectors count as c = 0. Repeated rows count as often as they stand there; ids
    may be null. Components without variance (equal rows, a single row, more components than dimensions) are left out,
    so the arrays may be shorter than k. An empty table gives no rows. A deviation that is no long raises an error.
    """
    base = whole_vectors(df, id_col, vector, scale, shift)
    model = fit(base, k, shift)
    kind = base.schema["_id"].dataType.simpleString()
    error = identity_error(base, model, shift) if len(model.values) else 0.0
    explained = [float(v / model.trace) for v in model.values]
    count, width = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column("_x"), width, shift)
            far = pa.array(deviations(rows, model.n, model.sums))
            w = whitened_rows(rows, model) if count else np.zeros((len(rows), 0))
            ends = pa.array((np.arange(len(rows) + 1) * count).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), far, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["id", "deviation", "whitened"])

    out = base.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")
    shares = F.array(*[F.lit(v) for v in explained]) if explained else F.array().cast("array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
