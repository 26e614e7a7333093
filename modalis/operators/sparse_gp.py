"""Gaussian processes on any number of training rows, through inducing points.

All that the training rows say about the process at m inducing points are sums: of the products of their covariances with
the points (m x m), of those times the outputs, and of squares. Each setting of the length scales takes one pass for them,
and one pass takes the settings of all restarts of a search at once; variances and noise are settled on the driver from the
same sums. With all training rows as points this is the exact process.

Rows with a null or a number that is not finite are left out. Points may repeat.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linalg as L
from .gp import KERNELS, simplex
from .training import samples


def inducing_points(df: DataFrame, inputs: list[str], m: int, seed: int = 0) -> np.ndarray:
    """``m`` distinct inputs, those with the least hashes."""
    x = samples(df, inputs, inputs).select("x").distinct()
    rows = x.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(m).collect()
    return np.array([r[0] for r in rows], float).reshape(-1, len(inputs))


@dataclass
class Sums:
    """Over the training rows, for a kernel of variance 1: products, products with outputs, the rows' own variances; and the
    number of rows and their outputs' squares."""

    a: np.ndarray
    b: np.ndarray
    own: float
    n: float
    yy: float


def sums_of(rows: DataFrame, z: np.ndarray, kernel: str, settings: list[np.ndarray]) -> list[Sums]:
    """The sums for each setting (logarithms of length scales and of the kernel's own parameters), in one pass."""
    m, d = z.shape
    extra = KERNELS[kernel][0]
    each = m * (m + 1) // 2 + m + 1
    L.checked_size(len(settings) * each)
    upper = np.triu_indices(m)
    shared = rows.sparkSession.sparkContext.broadcast([np.exp(np.clip(s, -12, 12)) for s in settings])

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x, y = L.block(batch, "x"), L.block(batch, "y")[:, 0]
        out = [np.array([len(x), y @ y])]
        for s in shared.value:
            k = KERNELS[kernel][1](x, z, s[:d], s[d : d + extra])
            out += [(k.T @ k)[upper], k.T @ y, [own_variance(kernel, x, s[:d], s[d : d + extra]).sum()]]
        return np.concatenate(out)

    total = L.summed(rows.select("x", "y"), part, 2 + len(settings) * each)
    found = []
    for p in np.split(total[2:], len(settings)):
        a = np.zeros((m, m))
        a[upper] = p[: len(upper[0])]
        found.append(Sums(a + np.triu(a, 1).T, p[len(upper[0]) : -1], float(p[-1]), float(total[0]), float(total[1])))
    return found


def own_variance(kernel: str, x: np.ndarray, scale: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """A row's covariance with itself, for variance 1."""
    if kernel in ("linear", "polynomial"):
        return np.concatenate([np.diag(KERNELS[kernel][1](x[at : at + 256], x[at : at + 256], scale, extra)) for at in range(0, len(x), 256)]) if len(x) else np.zeros(0)
    return np.ones(len(x))


def proposals(start: np.ndarray) -> Generator[list[np.ndarray], list[float], None]:
    """A downhill simplex that asks for all points that its next step may need at once."""
    n = len(start)
    points = [start] + [start + 0.7 * np.eye(n)[k] for k in range(n)]
    values = yield points
    while True:
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        tried = [centre + away, centre + 2 * away, centre - 0.5 * away]
        mirrored, further, nearer = yield tried
        if mirrored < values[0]:
            points[-1], values[-1] = (tried[1], further) if further < mirrored else (tried[0], mirrored)
        elif mirrored < values[-2]:
            points[-1], values[-1] = tried[0], mirrored
        elif nearer < values[-1]:
            points[-1], values[-1] = tried[2], nearer
        else:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0], *(yield points[1:])]


@dataclass
class Spectrum:
    """The factor of the points' covariance, and the sums in the directions that it makes independent."""

    low: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    outputs: np.ndarray


@dataclass
class SparseProcess:
    """One output; ``kernel`` by name, a length scale for each input; noise is fitted unless it is given. ``jitter`` is
    added to the points' own variances: points close together need more of it."""

    kernel: str = "matern32"
    noise: float | None = None
    restarts: int = 3
    rounds: int = 30
    jitter: float = 1e-6

    def covariance(self, x: np.ndarray) -> np.ndarray:
        return KERNELS[self.kernel][1](np.atleast_2d(x), self.z, self.scale, self.extra)

    def settle(self, setting: np.ndarray) -> None:
        e = np.exp(np.clip(setting, -12, 12))
        d = self.z.shape[1]
        self.scale, self.extra = e[:d], e[d : d + KERNELS[self.kernel][0]]

    def spectrum(self, s: Sums) -> Spectrum:
        """Of the present setting, for variance 1: a decomposition once, from which every variance and noise follow."""
        low = np.linalg.cholesky(self.covariance(self.z) + self.jitter * np.eye(len(self.z)))
        w = np.linalg.solve(low, np.linalg.solve(low, s.a).T)
        values, vectors = np.linalg.eigh((w + w.T) / 2)
        # Directions in which the sums are nothing but rounding say nothing.
        told = values > 1e-15 * np.abs(s.a).max(initial=0) / self.jitter
        return Spectrum(low, vectors, np.where(told, values, 0), np.where(told, vectors.T @ np.linalg.solve(low, s.b), 0))

    @staticmethod
    def bound(s: Sums, f: Spectrum, variance: float, sigma2: float) -> float:
        """The negative of the lower bound of the log marginal likelihood, but for constants."""
        g = 1 + variance * f.values / sigma2
        explained = (variance * f.outputs**2 / g).sum() / sigma2**2
        return float(0.5 * (s.n * np.log(sigma2) + s.yy / sigma2 - explained + np.log(g).sum() + variance * (s.own - f.values.sum()) / sigma2))

    def settled(self, s: Sums, setting: np.ndarray) -> tuple[float, float, float]:
        """The least bound of a setting of the length scales, and the variance and noise that give it."""
        self.settle(setting)
        try:
            f = self.spectrum(s)
        except np.linalg.LinAlgError:
            return 1e15, 1.0, 1.0
        start = np.log(max(s.yy / max(1, s.n), 1e-12))

        def values(t: np.ndarray) -> tuple[float, float]:
            # Variance and noise, not less than a share of the outputs' squares that rounding leaves.
            t = np.exp(np.clip(t, start - 18, start + 18))
            return float(t[0]), self.noise if self.noise is not None else float(t[1])

        best, value = simplex(lambda t: self.bound(s, f, *values(t)), np.array([start] if self.noise is not None else [start, start - 3]), 200)
        return value, *values(best)

    def fit(self, df: DataFrame, inputs: list[str], y: str, z: np.ndarray, seed: int = 0) -> SparseProcess:
        """Settings by downhill simplices from several starts, which share each pass over the rows."""
        rows = samples(df, inputs, [y]).persist()
        self.z = np.atleast_2d(z)
        n, rng = self.z.shape[1] + KERNELS[self.kernel][0], np.random.default_rng(seed)
        searches = [proposals(rng.normal(0, 1, n) if k else np.zeros(n)) for k in range(self.restarts)]
        asked = [next(p) for p in searches]
        best: tuple = (np.inf, None, None)
        self.passes = 0
        for _ in range(self.rounds):
            flat = [p for points in asked for p in points]
            found = sums_of(rows, self.z, self.kernel, flat)
            self.passes += 1
            values = []
            for setting, s in zip(flat, found, strict=True):
                value, variance, sigma2 = self.settled(s, setting)
                values.append(value)
                best = min(best, (value, setting, s, variance, sigma2), key=lambda b: b[0])
            at, more = 0, []
            for search, points in zip(searches, asked, strict=True):
                more.append(search.send(values[at : at + len(points)]))
                at += len(points)
            asked = more
        rows.unpersist()
        return self.given(best[2], best[1], best[3], best[4])

    def condition(self, df: DataFrame, inputs: list[str], y: str, z: np.ndarray, theta: np.ndarray) -> SparseProcess:
        """The process given the rows and its parameters: logarithms of variance, length scales, the kernel's own ones
        and, unless it is fixed, noise."""
        self.z, theta = np.atleast_2d(z), np.asarray(theta, float)
        setting = theta[1 : 1 + self.z.shape[1] + KERNELS[self.kernel][0]]
        s = sums_of(samples(df, inputs, [y]), self.z, self.kernel, [setting])[0]
        return self.given(s, setting, float(np.exp(theta[0])), self.noise if self.noise is not None else float(np.exp(theta[-1])))

    def given(self, s: Sums, setting: np.ndarray, variance: float, sigma2: float) -> SparseProcess:
        self.settle(setting)
        self.variance, self.sigma2, f = variance, sigma2, self.spectrum(s)
        self.value = self.bound(s, f, variance, sigma2)
        self.low, self.vectors, self.gains = f.low, f.vectors, 1 + variance * f.values / sigma2
        self.weights = np.linalg.solve(f.low.T, f.vectors @ (f.outputs / self.gains)) / sigma2
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation, noise included."""
        x = np.atleast_2d(x)
        k = self.covariance(x)
        v = self.vectors.T @ np.linalg.solve(self.low, k.T)
        own = own_variance(self.kernel, x, self.scale, self.extra) - (v * v).sum(axis=0) + (v * v / self.gains[:, None]).sum(axis=0)
        return self.variance * (k @ self.weights), np.sqrt(self.variance * np.maximum(own, 0) + self.sigma2)

    def predict_rows(self, df: DataFrame, inputs: list[str], mean: str = "mean", std: str = "std") -> DataFrame:
        """``df`` with ``mean`` and ``std``."""
        return predicted(df, inputs, self, mean, std)


def predicted(df: DataFrame, inputs: list[str], model, mean: str = "mean", std: str = "std") -> DataFrame:
    """``df`` with the mean and deviation that ``model`` predicts for each row; null where an input is not finite."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = [df.columns.index(c) for c in inputs]

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at])
            good = np.isfinite(x).all(axis=1)
            m, s = shared.value.predict(x[good])
            columns = []
            for v in (m, s):
                out = np.full(len(x), np.nan)
                out[good] = v
                columns.append(pa.array(out, mask=~good))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, mean, std])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{mean}` double, `{std}` double")


@dataclass
class SparseFidelities:
    """Fidelities from low to high, linear in the one below: f_k = rho_k f_(k-1) + delta_k. A level's ratio is two sums over
    its rows with the level below at their places, and its process is one of what is left over."""

    kernel: str = "rbf"
    noise: float | None = 1e-6
    jitter: float = 1e-6

    def fit(self, tables: list[DataFrame], inputs: list[str], y: str, points: list[np.ndarray], theta: np.ndarray | None = None) -> SparseFidelities:
        """``theta``: parameters of all levels, if they are not to be fitted."""
        self.levels: list[tuple[float, SparseProcess]] = []
        for df, z in zip(tables, points, strict=True):
            rho, rest = 0.0, df.select(*inputs, F.col(y).cast("double").alias("__y"))
            if self.levels:
                rest = predicted(rest, inputs, self, "__below", "__std").filter(F.col("__y").isNotNull() & ~F.isnan("__y"))
                by, bb = rest.agg(F.sum(F.col("__below") * F.col("__y")), F.sum(F.col("__below") ** 2)).first()
                rho = float(by / bb) if bb else 0.0
                rest = rest.withColumn("__y", F.col("__y") - rho * F.col("__below"))
            g = SparseProcess(self.kernel, self.noise, jitter=self.jitter)
            self.levels.append((rho, g.fit(rest, inputs, "__y", z) if theta is None else g.condition(rest, inputs, "__y", z, theta)))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, var = np.zeros(len(x)), np.zeros(len(x))
        for rho, g in self.levels:
            m, s = g.predict(x)
            mean, var = rho * mean + m, rho * rho * var + s * s
        return mean, np.sqrt(var)
