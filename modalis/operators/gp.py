"""Gaussian processes: hyper-parameters and weights on the driver from a bounded training set, prediction over
any number of rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Training rows up to which the n x n system is solved on the driver.
TRAINING_ROWS = 5_000

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def distance(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    d = a[:, None, :] / scale - b[None, :, :] / scale
    return np.sqrt((d * d).sum(axis=2))


#: By name: (parameters beyond variance and length scales, function of inputs, length scales and those).
KERNELS: dict[str, tuple[int, Callable]] = {
    "rbf": (0, lambda a, b, s, p: np.exp(-0.5 * distance(a, b, s) ** 2)),
    "matern32": (0, lambda a, b, s, p: (1 + np.sqrt(3) * distance(a, b, s)) * np.exp(-np.sqrt(3) * distance(a, b, s))),
    "matern52": (0, lambda a, b, s, p: (1 + np.sqrt(5) * distance(a, b, s) + 5 / 3 * distance(a, b, s) ** 2) * np.exp(-np.sqrt(5) * distance(a, b, s))),
    "exponential": (0, lambda a, b, s, p: np.exp(-distance(a, b, s))),
    "linear": (0, lambda a, b, s, p: (a / s) @ (b / s).T),
    "rational_quadratic": (1, lambda a, b, s, p: (1 + distance(a, b, s) ** 2 / (2 * p[0])) ** -p[0]),
    "polynomial": (1, lambda a, b, s, p: ((a / s) @ (b / s).T + p[0]) ** 3),
    "periodic_exponential": (1, lambda a, b, s, p: np.exp(-np.abs(np.sin(np.pi * distance(a, b, np.ones_like(s)) / p[0])) / s[0])),
    "standard_periodic": (1, lambda a, b, s, p: np.exp(-0.5 * (np.sin(np.pi * (a[:, None, :] - b[None, :, :]) / p[0]) ** 2 / s**2).sum(axis=2))),
    "white": (0, lambda a, b, s, p: (distance(a, b, s) == 0).astype(float)),
}


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """A downhill simplex."""
    n = len(start)
    points = [start] + [start + 0.5 * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < 1e-8:
            break
        centre = np.mean(points[:-1], axis=0)
        mirrored = centre + (centre - points[-1])
        v = f(mirrored)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            nearer = centre + 0.5 * (points[-1] - centre)
            w = f(nearer)
            if w < values[-1]:
                points[-1], values[-1] = nearer, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]


@dataclass
class GaussianProcess:
    """One output; ``kernel`` by name, a length scale for each input."""

    kernel: str = "matern32"
    noise: float | None = None
    restarts: int = 3
    steps: int = 150

    def covariance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.variance * KERNELS[self.kernel][1](a, b, self.scale, self.extra)

    def settle(self, theta: np.ndarray, d: int) -> None:
        e = np.exp(np.clip(theta, -12, 12))
        k = KERNELS[self.kernel][0]
        self.variance, self.scale, self.extra = e[0], e[1 : 1 + d], e[1 + d : 1 + d + k]
        self.sigma2 = self.noise if self.noise is not None else e[-1]

    def likelihood(self, theta: np.ndarray) -> float:
        """Negative log marginal likelihood."""
        self.settle(theta, self.x.shape[1])
        k = self.covariance(self.x, self.x) + (self.sigma2 + 1e-10) * np.eye(len(self.x))
        try:
            low = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return 1e12
        a = np.linalg.solve(low, self.y)
        return float(0.5 * a @ a + np.log(np.diag(low)).sum())

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> GaussianProcess:
        if len(x) > TRAINING_ROWS:
            raise ValueError(f"more than {TRAINING_ROWS} training rows")
        self.x, self.y = np.atleast_2d(x), np.asarray(y, float)
        d = self.x.shape[1]
        n = 1 + d + KERNELS[self.kernel][0] + (self.noise is None)
        rng = np.random.default_rng(seed)
        best = min((simplex(self.likelihood, rng.normal(0, 1, n) if k else np.zeros(n), self.steps) for k in range(self.restarts)), key=lambda r: r[1])
        return self.condition(self.x, self.y, best[0])

    def condition(self, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> GaussianProcess:
        """The process given the training rows and its parameters: logarithms of variance, length scales, the kernel's
        own ones and, unless it is fixed, noise."""
        self.x, self.y = np.atleast_2d(x), np.asarray(y, float)
        self.settle(np.asarray(theta, float), self.x.shape[1])
        k = self.covariance(self.x, self.x) + (self.sigma2 + 1e-10) * np.eye(len(self.x))
        self.low = np.linalg.cholesky(k)
        self.alpha = np.linalg.solve(self.low.T, np.linalg.solve(self.low, self.y))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation, noise included."""
        k = self.covariance(np.atleast_2d(x), self.x)
        v = np.linalg.solve(self.low, k.T)
        own = np.array([self.covariance(r[None], r[None])[0, 0] for r in np.atleast_2d(x)])
        return k @ self.alpha, np.sqrt(np.maximum(own - (v * v).sum(axis=0), 0) + self.sigma2)

    def predict_rows(self, df: DataFrame, inputs: list[str]) -> DataFrame:
        """``df`` with ``mean`` and ``std``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(frames):
            for p in frames:
                if len(p):
                    m, s = shared.value.predict(p[inputs].to_numpy(float))
                    yield p.assign(mean=m, std=s)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{fields}, mean double, std double")


@dataclass
class MultiFidelity:
    """Fidelities from low to high, linear in the one below: f_k = rho_k f_(k-1) + delta_k. Each level fits the
    ratio and a process of what is left over, at the places of its own training rows."""

    kernel: str = "rbf"
    noise: float | None = 1e-6

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], theta: np.ndarray | None = None) -> MultiFidelity:
        """``theta``: parameters of all levels, if they are not to be fitted."""
        self.levels: list[tuple[float, GaussianProcess]] = []
        for x, y in zip(xs, ys, strict=True):
            below = self.predict(x)[0] if self.levels else np.zeros(len(y))
            rho = float(below @ y / (below @ below)) if self.levels else 0.0
            g = GaussianProcess(self.kernel, self.noise)
            self.levels.append((rho, g.fit(x, y - rho * below) if theta is None else g.condition(x, y - rho * below, theta)))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, var = np.zeros(len(x)), np.zeros(len(x))
        for rho, g in self.levels:
            m, s = g.predict(x)
            mean, var = rho * mean + m, rho * rho * var + s * s
        return mean, np.sqrt(var)
