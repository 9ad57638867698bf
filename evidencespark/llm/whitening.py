"""Whitening of embeddings by an incremental eigendecomposition.

A spectrum is a count, exact sums, and the eigenvalues and eigenvectors of the scatter around the mean. A task takes its
vectors one by one: each is a rank-one update around the mean, whose eigenvalues are the roots of a secular equation, with
deflation of directions that it does not touch and of equal eigenvalues. Two spectra are combined by successive rank-one
updates: one for each eigenvector of the one, scaled, and one for the distance between the means. Groups of spectra are
combined on the executors, until one is left; its size depends on the dimensions only.

Rounding adds up over many updates. A last pass over all vectors projects their covariance on the eigenvectors that
were found (Rayleigh-Ritz, with all directions), and the small matrix's own eigenvectors correct them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencespark.llm.common import free_name, stored

#: Spectra that one task combines.
FAN_IN = 8
_EPS = np.finfo(float).eps
_SPECTRUM = "width int, id long, n long, sums array<string>, values array<double>, vectors binary"


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of each component as longs; null if the vector is null or has a null or non-finite component."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(good, F.transform(wide, lambda c: F.floor(c * scale)))


# --- rank-one updates --------------------------------------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of ``diag(d) + rho z z'`` and the matrix of ``d[j] - root[i]`` (row i), which is exact near the poles.

    ``d`` ascends strictly, no ``z`` is 0 and ``rho`` > 0, so there is one root after each pole. A root is held as its
    distance from the nearer pole, and found by interpolating both sides of the equation (the two sums over poles
    before and after it) by a rational function each; a step that leaves the bracket is halved instead.
    """
    m = len(d)
    weight = rho * z * z
    reach = d[-1] + weight.sum()
    upper = np.append(d[1:], reach)
    middle = (d + upper) / 2
    own = np.arange(m)
    with np.errstate(divide="ignore"):
        f = 1 + (weight / (d[None, :] - middle[:, None])).sum(1)
    near = own + ((f < 0) & (own < m - 1))
    pole = d[near]
    gaps = d[None, :] - pole[:, None]
    low, high = np.where(f < 0, middle - pole, 0.0), np.where(f < 0, np.where(near > own, 0.0, reach - pole), middle - pole)
    rows, before, nxt = own, np.tri(m), np.minimum(own + 1, m - 1)
    # First guess: the two poles beside a root as they are, and of all others their sum in the middle.
    with np.errstate(all="ignore"):
        gap, wn = upper - d, np.append(weight[1:], 0.0)
        turned = near > own
        c = f - weight / (d - middle) - wn / (upper - middle)
        c, w0, w1 = np.where(turned, -c, c), np.where(turned, wn, weight), np.where(turned, weight, wn)
        a, b = c * gap + w0 + w1, w0 * gap
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        tau = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
        tau = np.where(turned, -tau, tau)
        tau = np.where((tau > low) & (tau < high), tau, (low + high) / 2)
    for _ in range(80):
        with np.errstate(all="ignore"):
            t = tau[rows]
            delta = gaps[rows] - t[:, None]
            terms = weight / delta
            slopes = terms / delta
            left = before[rows]
            psi, dpsi = np.einsum("ij,ij->i", terms, left), np.einsum("ij,ij->i", slopes, left)
            f, dphi = 1 + terms.sum(1), slopes.sum(1) - dpsi
            low[rows], high[rows] = np.where(f < 0, t, low[rows]), np.where(f < 0, high[rows], t)
            each = np.arange(len(rows))
            dk, dn = delta[each, rows], delta[each, nxt[rows]]
            c = f - dk * dpsi - dn * dphi
            a = (dk + dn) * f - dk * dn * (dpsi + dphi)
            b = dk * dn * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(rows == m - 1, dk + dk * dk * dpsi / (1 + psi - dk * dpsi), step)
            new = t + step
            bad = ~((new > low[rows]) & (new < high[rows]))
            new = np.where(bad, (low[rows] + high[rows]) / 2, new)
            # A step so small is the last one: errors are squared by the next.
            exact = np.abs(f) <= 8 * _EPS * (f - 2 * psi)  # no better by rounding
            done = exact | (~bad & (np.abs(step) <= 1e-8 * np.abs(new))) | (high[rows] - low[rows] <= 4 * _EPS * np.abs(new))
        tau[rows] = np.where(exact, t, new)
        rows = rows[~done]
        if not len(rows):
            break
    return pole + tau, gaps - tau[:, None]


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + rho v v'``, for ``rho`` > 0."""
    z = vectors.T @ v
    size = np.linalg.norm(z)
    if rho <= 0 or size == 0:
        return values, vectors
    rho, z = rho * size * size, z / size
    tiny = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho)
    touched = rho * np.abs(z) > tiny
    if (np.diff(values[touched]) <= tiny).any():  # of eigenvalues that are equal to rounding, the last takes all of z
        vectors, before = vectors.copy(), None
        for i in np.flatnonzero(touched).tolist():
            if before is not None and values[i] - values[before] <= tiny:
                r = np.hypot(z[before], z[i])
                c, s = z[i] / r, z[before] / r
                vectors[:, [before, i]] = vectors[:, [before, i]] @ np.array([[c, s], [-s, c]])
                z[before], z[i], touched[before] = 0, r, False
            before = i
    if touched.any():
        d, zt = values[touched], z[touched]
        roots, delta = secular_roots(d, zt, rho)
        # The vector that these roots belong to exactly, so that the eigenvectors are orthogonal.
        gap = d[None, :] - d[:, None]
        m = len(d)
        top = -delta[m - 1]
        exact = top.copy()
        for_j = np.arange(m - 1)
        if m > 1:
            num = -delta[: m - 1].T  # root[j] - d[i]
            den = np.where(for_j[None, :] < np.arange(m)[:, None], gap[:, : m - 1], gap[:, 1:])
            exact = top * np.prod(num / den, axis=1)
        zt = np.copysign(np.sqrt(np.maximum(exact, 0)), zt)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = zt[None, :] / delta
        stuck = ~np.isfinite(q).all(1)
        if stuck.any():  # a root on its pole
            q[stuck] = (delta[stuck] == 0).astype(float)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        values, vectors = values.copy(), vectors.copy()
        values[touched] = roots
        vectors[:, touched] = vectors[:, touched] @ q.T
    order = np.argsort(values, kind="stable")
    return values[order], np.ascontiguousarray(vectors[:, order])


class Spectrum:
    """Count, exact sums, and the spectrum of the scatter of vectors."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.values, self.vectors = np.zeros(width), np.eye(width)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def add(self, rows: np.ndarray) -> None:
        """Take rows of longs, one after another."""
        before = np.array(self.sums, object)
        upto = np.cumsum(rows.astype(object) if np.abs(rows).max(initial=0) > 1 << 40 else rows, axis=0)
        for i, x in enumerate(rows):
            if self.n:
                mean = (before / self.n).astype(float) if i == 0 else ((before + upto[i - 1]) / self.n).astype(float)
                self.values, self.vectors = updated(self.values, self.vectors, x - mean, self.n / (self.n + 1))
            self.n += 1
        if len(rows):
            self.sums = [int(x) for x in before + upto[-1]]

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if self.n:
            apart = other.mean - self.mean
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                self.values, self.vectors = updated(self.values, self.vectors, vector, value)
            self.values, self.vectors = updated(self.values, self.vectors, apart, self.n * other.n / (self.n + other.n))
        else:
            self.values, self.vectors = other.values, other.vectors
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, id: int) -> dict:
        return {"width": len(self.sums), "id": id, "n": self.n, "sums": [str(s) for s in self.sums], "values": self.values.tolist(), "vectors": self.vectors.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        new = cls(row["width"])
        new.n, new.sums = int(row["n"]), [int(s) for s in row["sums"]]
        new.values = np.array(row["values"], float)
        new.vectors = np.frombuffer(row["vectors"], float).reshape(row["width"], row["width"]).copy()
        return new


# --- on Spark ----------------------------------------------------------------------------------------------------


def _matrices(batch: pa.RecordBatch, at: int):
    """For each width in the batch: the rows and their vectors as a matrix of longs."""
    from evidencespark.llm.common import list_parts

    flat, ends = list_parts(batch.column(at))
    sizes = np.diff(ends)
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        yield width, rows, flat[ends[rows][:, None] + np.arange(width)]


_BUFFERS = pa.schema([("width", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.binary())])


def spectra(fit: DataFrame, at: str) -> dict[int, Spectrum]:
    """The spectrum of the column ``at`` (arrays of longs) for each of its lengths."""

    def single(batches):
        from pyspark import TaskContext

        own: dict[int, Spectrum] = {}
        for batch in batches:
            for width, _, x in _matrices(batch, 0):
                own.setdefault(width, Spectrum(width)).add(x)
        for s in own.values():
            yield pa.RecordBatch.from_pylist([s.row(TaskContext.get().partitionId())], schema=_BUFFERS)

    def combined(rows: pa.Table) -> pa.Table:
        total = None
        for i in range(rows.num_rows):
            s = Spectrum.of(rows.slice(i, 1).to_pylist()[0])
            if total is None:
                total = s
            else:
                total.merge(s)
        return pa.Table.from_pylist([total.row(rows.column("id")[0].as_py())], schema=_BUFFERS)

    found = stored(fit.select(at).mapInArrow(single, _SPECTRUM), "spectra")
    largest = found.agg(F.max("id")).first()[0]
    while largest:  # ids are those of partitions, and so is how often this happens bounded
        groups = found.withColumn("id", F.floor(F.col("id") / FAN_IN).cast("long")).groupBy("width", "id")
        found = stored(groups.applyInArrow(combined, _SPECTRUM), "spectra")
        largest //= FAN_IN
    return {row["width"]: Spectrum.of(row) for row in found.collect()}  # one for each length


def _moments(fit: DataFrame, at: str, projections: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """The covariance of ``(x - mean) @ axes`` over ``fit``, for each length; divided by the count, centred first.

    A task centres its rows by their own mean before it multiplies them, and its sums join those of others with the
    distance of the means; what tasks return is added up by place in the matrix.
    """

    def part(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for width, _, x in _matrices(batch, 0):
                mean, axes = projections[width]
                y = (x - mean) @ axes
                own = y.mean(0)
                y -= own
                n, scatter = len(y), y.T @ y
                if width in held:
                    n0, mean0, s0 = held[width]
                    far = own - mean0
                    held[width] = [n0 + n, mean0 + far * (n / (n0 + n)), s0 + scatter + np.outer(far, far) * (n0 * n / (n0 + n))]
                else:
                    held[width] = [n, own, scatter]
        for width, (n, mean, scatter) in held.items():
            k = len(mean)
            # Means are small beside the spread (rows are centred by the mean of all), so their products add up safely.
            upper = scatter + n * np.outer(mean, mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * (k * k + k + 1), pa.int32()), pa.array(np.arange(k * k + k + 1), pa.int32()), pa.array(np.concatenate((upper.ravel(), n * mean, [n])))],
                names=["width", "place", "value"],
            )

    sums = fit.select(at).mapInArrow(part, "width int, place int, value double").groupBy("width", "place").agg(F.sum("value").alias("value"))
    found: dict[int, dict] = {}
    for row in sums.collect():  # the square of the dimensions
        found.setdefault(row["width"], {})[row["place"]] = row["value"]
    out = {}
    for width, by_place in found.items():
        flat = np.array([by_place[i] for i in range(len(by_place))])
        k = projections[width][1].shape[1]
        mean = flat[k * k : k * k + k] / flat[-1]
        out[width] = flat[: k * k].reshape(k, k) / flat[-1] - np.outer(mean, mean)
    return out


def fitted(vectors: DataFrame, at: str, components: int = 4) -> dict[int, dict]:
    """What whitens the vectors of each length: ``n``, ``sums``, ``mean``, ``axes`` (columns), ``values`` (descending),
    ``explained`` and ``identity_error``. Each distinct vector counts once."""
    fit = stored(vectors.select(at).where(F.col(at).isNotNull() & (F.size(at) > 0)).distinct(), "fit-list")
    found = spectra(fit, at)
    basis = {w: (s.mean, s.vectors[:, ::-1]) for w, s in found.items()}
    ritz = _moments(fit, at, basis)
    models = {}
    for width, s in found.items():
        small = (ritz[width] + ritz[width].T) / 2
        trace = float(np.trace(small))
        values, turn = np.linalg.eigh(small)
        axes = basis[width][1] @ turn[:, ::-1]
        axes /= np.linalg.norm(axes, axis=0)
        k = min(components, width)
        values = values[::-1][:k]
        used = values > max(trace, 0) * width * _EPS
        models[width] = {"n": s.n, "sums": s.sums, "mean": s.mean, "axes": axes[:, :k], "values": values, "used": used, "explained": values / trace if trace > 0 else np.zeros(k)}
    scaled = {w: (m["mean"], m["axes"][:, m["used"]] / np.sqrt(m["values"][m["used"]])) for w, m in models.items()}
    for width, cov in _moments(fit, at, scaled).items():
        models[width]["identity_error"] = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else None
    return models


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of ``(n * x - sums)**2`` of each row; null if it is too large for a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most**2 < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """All columns of ``vectors`` but the vector, with ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``: a row for each vector and component (``components``, or as many as dimensions).

    Vectors are taken as ``floor(scale * c)``. Those that are null or have null or non-finite components have no rows, nor
    have those without components. Vectors of different lengths are whitened apart, each length by its own distinct
    vectors; repeated vectors count once in the fit and all have rows. A direction without spread (one distinct vector,
    or fewer than dimensions) has explained 0 and a null ``whitened``; ``identity_error`` is over the others, null without
    any. Of equal eigenvalues any directions are taken, the same for all rows. A deviation beyond a long is null. A
    column that clashes stays; the new one gets underscores before its name. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    at = free_name(vectors, "x")
    rows = vectors.withColumn(at, fixed_point(F.col(vector_col), scale)).drop(vector_col).where(F.col(at).isNotNull() & (F.size(at) > 0))
    models = spark.sparkContext.broadcast(fitted(rows, at, components))  # the square of the dimensions
    names = [free_name(rows, c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    own = [c for c in rows.columns if c != at]
    place = rows.columns.index(at)

    def run(batches):
        for batch in batches:
            for width, which, x in _matrices(batch, place):
                m = models.value[width]
                k, used = len(m["values"]), m["used"]
                axes = np.where(used, m["axes"] / np.sqrt(np.where(used, m["values"], 1)), np.nan)
                y = (x - m["mean"]) @ np.nan_to_num(axes)
                times = np.repeat(which, k)
                columns = [batch.column(i).take(pa.array(times)) for i in range(len(batch.schema)) if i != place]
                new = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(which))), pa.array(np.full(len(times), m["n"], np.int64)),
                    pa.array(np.repeat(np.array(_deviation(x, m["n"], m["sums"]), object), k).tolist(), pa.int64()),
                    pa.array(y.ravel(), mask=np.tile(~used, len(which))), pa.array(np.tile(m["explained"], len(which))),
                    pa.array([m["identity_error"]] * len(times), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*own, *names])

    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    kinds = (IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType())
    schema = StructType([*(f for f in rows.schema.fields if f.name != at), *(StructField(n, t) for n, t in zip(names, kinds, strict=True))])
    return rows.mapInArrow(run, schema)
