"""Surrogate models without a deep-learning library: perceptrons and polynomial layers in NumPy on a bounded
training set, prediction over DataFrames; a closed form for fields with linear targets; residuals of governing
equations on grids; a search over settings; profiles of airfoils."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions.lineage import cut
from . import linalg as L


def predict_rows(df: DataFrame, inputs: list[str], model, outputs: list[str]) -> DataFrame:
    """``df`` with a model's outputs; the model goes out with the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for p in frames:
            if len(p):
                y = np.asarray(shared.value.predict(p[inputs].to_numpy(float))).reshape(len(p), -1)
                yield p.assign(**{o: y[:, k] for k, o in enumerate(outputs)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, fields + "".join(f", `{o}` double" for o in outputs))


@dataclass
class EarlyStop:
    """Stops after ``patience`` epochs without a gain of ``least``."""

    patience: int = 10
    least: float = 0.0
    best: float = math.inf
    waited: int = 0

    def __call__(self, loss: float) -> bool:
        if loss < self.best - self.least:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class Perceptron:
    """Dense layers with tanh, Adam and a stepped rate, mean squared error. With as many outputs as inputs and a
    narrow layer it is an autoencoder."""

    hidden: tuple[int, ...] = (32, 32)
    epochs: int = 200
    batch: int = 64
    rate: float = 1e-2
    step: int = 50
    gamma: float = 0.5
    seed: int = 0
    weights: list = field(default_factory=list)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(self.weights):
            z = out[-1] @ w + b
            out.append(np.tanh(z) if k < len(self.weights) - 1 else z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, valid: tuple[np.ndarray, np.ndarray] | None = None, stop: EarlyStop | None = None) -> Perceptron:
        rng = np.random.default_rng(self.seed)
        y = y.reshape(len(x), -1)
        sizes = [x.shape[1], *self.hidden, y.shape[1]]
        self.weights = [(rng.normal(0, math.sqrt(1 / a), (a, b)), np.zeros(b)) for a, b in itertools.pairwise(sizes)]
        moments = [[np.zeros_like(p) for p in pair] for pair in self.weights for _ in (0, 1)]
        t, self.losses = 0, []
        for epoch in range(self.epochs):
            rate = self.rate * self.gamma ** (epoch // self.step)
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // self.batch)):
                acts = self.forward(x[at])
                delta = 2 * (acts[-1] - y[at]) / y[at].size
                grads = []
                for k in range(len(self.weights) - 1, -1, -1):
                    grads.append((acts[k].T @ delta, delta.sum(axis=0)))
                    if k:
                        delta = (delta @ self.weights[k][0].T) * (1 - acts[k] ** 2)
                t += 1
                for k, pair in enumerate(reversed(grads)):
                    new = []
                    for i, g in enumerate(pair):
                        m, v = moments[2 * k], moments[2 * k + 1]
                        m[i] = 0.9 * m[i] + 0.1 * g
                        v[i] = 0.999 * v[i] + 0.001 * g * g
                        new.append(self.weights[k][i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
                    self.weights[k] = tuple(new)
            vx, vy = valid if valid is not None else (x, y)
            self.losses.append(float(((self.predict(vx) - vy.reshape(len(vx), -1)) ** 2).mean()))
            if stop is not None and stop(self.losses[-1]):
                break
        return self


@dataclass
class PolynomialLayer:
    """One Chebyshev or Jacobi layer: sums of polynomials of each input, fitted by two aggregates over all rows."""

    degree: int = 3
    kind: str = "chebyshev"

    def terms(self, inputs: list[str]) -> dict[str, Column]:
        make = C.chebyshev if self.kind == "chebyshev" else C.jacobi
        out = {"t0": F.lit(1.0)}
        for i, name in enumerate(inputs):
            out |= {f"t{i}_{k}": c for k, c in enumerate(make(F.tanh(name), self.degree)) if k}
        return out

    def fit(self, df: DataFrame, inputs: list[str], y: str) -> PolynomialLayer:
        t = self.terms(inputs)
        self.coefficients = dict(zip(t, L.ridge_regression(df.select(*(c.alias(n) for n, c in t.items()), y), list(t), y, 1e-9), strict=True))
        return self

    def predict(self, df: DataFrame, inputs: list[str], name: str = "p") -> DataFrame:
        """A column expression: no Python workers."""
        t = self.terms(inputs)
        return df.withColumn(name, sum((float(self.coefficients[n]) * c for n, c in t.items()), F.lit(0.0)))


@dataclass
class PolynomialNetwork:
    """Layers of sums of functions of each input: Chebyshev polynomials of tanh x, or sines of multiples of x. Fitted
    by Adam on a bounded training set. ``coefficients``: of each layer inputs x outputs x functions."""

    hidden: tuple[int, ...] = (8,)
    degree: int = 3
    kind: str = "chebyshev"
    epochs: int = 300
    rate: float = 2e-2
    seed: int = 0
    coefficients: list = field(default_factory=list)

    def basis(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions of each entry and their slopes, the last axis being functions."""
        k = np.arange(self.degree + 1)
        if self.kind == "sine":
            return np.sin(x[..., None] * k), np.cos(x[..., None] * k) * k
        u = np.tanh(x)[..., None]
        angle = np.arccos(np.clip(u, -1 + 1e-12, 1 - 1e-12))
        return np.cos(k * angle), k * np.sin(k * angle) / np.sin(angle) * (1 - u * u)

    def predict(self, x: np.ndarray) -> np.ndarray:
        for c in self.coefficients:
            x = np.einsum("nif,iof->no", self.basis(x)[0], c)
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, stop: EarlyStop | None = None) -> PolynomialNetwork:
        rng, y = np.random.default_rng(self.seed), y.reshape(len(x), -1)
        sizes = [x.shape[1], *self.hidden, y.shape[1]]
        self.coefficients = [rng.normal(0, 1 / (a * (self.degree + 1)) ** 0.5, (a, b, self.degree + 1)) for a, b in itertools.pairwise(sizes)]
        m, v = ([np.zeros_like(c) for c in self.coefficients] for _ in (0, 1))
        self.losses = []
        for t in range(1, self.epochs + 1):
            kept, now = [], x
            for c in self.coefficients:
                f, slope = self.basis(now)
                kept.append((f, slope))
                now = np.einsum("nif,iof->no", f, c)
            self.losses.append(float(((now - y) ** 2).mean()))
            if stop is not None and stop(self.losses[-1]):
                break
            delta = 2 * (now - y) / y.size
            for k in range(len(self.coefficients) - 1, -1, -1):
                f, slope = kept[k]
                g = np.einsum("nif,no->iof", f, delta)
                if k:
                    delta = np.einsum("nif,iof,no->ni", slope, self.coefficients[k], delta)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.coefficients[k] = self.coefficients[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


@dataclass
class VariationalAutoencoder:
    """An encoder to means and log-variances of a latent space and a decoder, each a perceptron of one hidden layer. The
    loss is the reconstruction error plus ``beta`` times the divergence from a standard normal distribution."""

    latent: int = 2
    hidden: int = 16
    beta: float = 1e-3
    epochs: int = 300
    rate: float = 1e-2
    seed: int = 0
    weights: dict = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and log-variances."""
        w = self.weights
        out = np.tanh(x @ w["w0"] + w["b0"]) @ w["w1"] + w["b1"]
        return out[:, : self.latent], out[:, self.latent :]

    def decode(self, z: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(z @ w["w2"] + w["b2"]) @ w["w3"] + w["b3"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Reconstructions by way of the means."""
        return self.decode(self.encode(x)[0])

    def loss(self, x: np.ndarray, noise: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The loss with given noise, and its slopes."""
        w, n, d = self.weights, len(x), self.latent
        h = np.tanh(x @ w["w0"] + w["b0"])
        mean, log_variance = np.split(h @ w["w1"] + w["b1"], [d], axis=1)
        spread = np.exp(0.5 * log_variance)
        z = mean + spread * noise
        g = np.tanh(z @ w["w2"] + w["b2"])
        out = g @ w["w3"] + w["b3"]
        divergence = -0.5 * (1 + log_variance - mean**2 - np.exp(log_variance)).sum() / n
        value = ((out - x) ** 2).sum() / n + self.beta * divergence
        e = 2 * (out - x) / n
        dg = (e @ w["w3"].T) * (1 - g * g)
        dz = dg @ w["w2"].T
        code = np.hstack([dz + self.beta * mean / n, dz * noise * 0.5 * spread + self.beta * 0.5 * (np.exp(log_variance) - 1) / n])
        dh = (code @ w["w1"].T) * (1 - h * h)
        return float(value), {"w0": x.T @ dh, "b0": dh.sum(0), "w1": h.T @ code, "b1": code.sum(0), "w2": z.T @ dg, "b2": dg.sum(0), "w3": g.T @ e, "b3": e.sum(0)}

    def start(self, inputs: int) -> VariationalAutoencoder:
        rng = np.random.default_rng(self.seed)
        sizes = [(inputs, self.hidden), (self.hidden, 2 * self.latent), (self.latent, self.hidden), (self.hidden, inputs)]
        self.weights = {f"w{k}": rng.normal(0, a**-0.5, (a, b)) for k, (a, b) in enumerate(sizes)} | {f"b{k}": np.zeros(b) for k, (_, b) in enumerate(sizes)}
        return self

    def fit(self, x: np.ndarray) -> VariationalAutoencoder:
        self.start(x.shape[1])
        rng = np.random.default_rng(self.seed + 1)
        m, v = ({k: np.zeros_like(a) for k, a in self.weights.items()} for _ in (0, 1))
        self.losses = []
        for t in range(1, self.epochs + 1):
            value, slopes = self.loss(x, rng.normal(size=(len(x), self.latent)))
            self.losses.append(value)
            for k, g in slopes.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def delayed(series: np.ndarray, lags: int) -> np.ndarray:
    """Rows of the values of some series (series x time) at each time and the ``lags`` before it, 0 before the start."""
    n = series.shape[1]
    padded = np.hstack([np.zeros((len(series), lags)), series])
    return np.stack([padded[:, t : t + lags + 1].ravel() for t in range(n)])


def sensor_reconstruction(rows: DataFrame, sensors: list[int] | list[list[int]], lags: int, ridge: float = 1e-8) -> DataFrame:
    """row_id, x: every row as a linear form of the present and past readings of a few of them, by ridge regression over
    all times. That is X times a projection of times x times, which the sensors' few rows give. Of several choices of
    sensors the mean of their reconstructions."""
    n = L.checked_width(rows)
    choices = [c if isinstance(c, list) else [c] for c in sensors] if sensors and isinstance(sensors[0], list) else [sensors]
    seen = {r["row_id"]: r["x"] for r in rows.filter(F.col("row_id").isin(sorted({s for c in choices for s in c}))).collect()}
    projections = []
    for c in choices:
        a = delayed(np.array([seen[s] for s in c]).reshape(len(c), n), lags)
        projections.append(a @ np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T))
    return L.times(rows, np.mean(projections, axis=0))


def sensor_choices(rows: DataFrame, choices: int, each: int, seed: int = 0) -> list[list[int]]:
    """Random choices of rows as sensors: for each, those whose digests with its number are least, a top-k a choice."""
    h = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("row_id").cast("string")).cast("binary"))
    return [[r["row_id"] for r in rows.select("row_id").orderBy(h(k), "row_id").limit(each).collect()] for k in range(choices)]


def grid_search(fit: Callable[[dict], tuple[object, float]], grid: dict[str, list]) -> tuple[dict, float]:
    """The settings with the least loss."""
    tried = trials(fit, grid)
    return min(tried, key=lambda x: x[1])


def trials(fit: Callable[[dict], tuple[object, float]], grid: dict[str, list]) -> list[tuple[dict, float]]:
    """All settings of a grid and their losses."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return [(s, fit(s)[1]) for s in every]


def fold_of(key: Column, folds: int) -> Column:
    """The fold of a row, by a digest of its key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def fold_losses(df: DataFrame, fold: Column, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], loss: Column) -> list[tuple[int, float]]:
    """fold, ``loss`` (an aggregate over predicted rows) of each fold's rows under a model of the others'."""
    d = df.withColumn("__fold", fold)
    of = lambda k: fit(d.filter(F.col("__fold") != k).drop("__fold"))(d.filter(F.col("__fold") == k).drop("__fold")).agg(loss).first()[0]
    return [(k, x) for k in range(folds) if (x := of(k)) is not None]


def cross_validated(df: DataFrame, key: str, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], loss: Column) -> float:
    """The mean over folds of ``loss`` on rows that the fold's model has not seen."""
    return float(np.mean([x for _, x in fold_losses(df, fold_of(F.col(key), folds), folds, fit, loss)]))


def adjust_field(cells: DataFrame, targets: dict[str, float], x: str = "cp") -> DataFrame:
    """``cells`` with ``adjusted``: the least change of ``x`` that meets linear targets sum(a x) = b, where the
    names of ``targets`` are columns of coefficients. Two aggregates, then a column expression."""
    names = list(targets)
    g, now = L.normal_equations(cells, names, x)
    weights = np.linalg.solve(g, np.array([targets[n] for n in names]) - now)
    return cells.withColumn("adjusted", F.col(x) + sum((float(w) * F.col(n) for w, n in zip(weights, names, strict=True)), F.lit(0.0)))


#: A constraint: what each row adds at a value, its slope there, and the target of the sum.
Constraint = tuple[Callable[[Column], Column], Callable[[Column], Column], float]


def adjust_field_nonlinear(cells: DataFrame, constraints: list[Constraint], x: str = "cp", steps: int = 30, tolerance: float = 1e-12) -> DataFrame:
    """``cells`` with ``adjusted``: a least change of ``x`` that meets sums of any smooth functions of single rows. Each
    step meets the constraints' linear forms at the last field, as the change from ``x`` along their slopes: one
    aggregate of constraints x constraints values. The field is a column expression of all steps' multipliers."""
    k = len(constraints)
    d = cut(cells.withColumn("adjusted", F.col(x)))
    for _ in range(steps):
        now = F.col("adjusted")
        slope = [s(now) for _, s, _ in constraints]
        sums = [F.sum(slope[a] * slope[b]) for a in range(k) for b in range(k)] + [F.sum(f(now) - slope[a] * (now - F.col(x))) for a, (f, _, _) in enumerate(constraints)]
        got = np.array(d.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first(), float)
        weights = np.linalg.lstsq(got[: k * k].reshape(k, k), np.array([t for _, _, t in constraints]) - got[k * k :], rcond=None)[0]
        new = F.col(x) + sum((float(w) * s for w, s in zip(weights, slope, strict=True)), F.lit(0.0))
        moved = d.withColumn("__new", new)
        d = cut(moved.withColumn("__gap", F.abs(F.col("__new") - now)).withColumn("adjusted", F.col("__new")).drop("__new"))
        if (d.agg(F.max("__gap")).first()[0] or 0) <= tolerance:
            break
        d = d.drop("__gap")
    return d.drop("__gap")


# --- residuals of equations on grids: differences along sorted axes ------------------------------------------


def derivative(v: str, along: str, by: list[str], step: float) -> Column:
    """Central difference; null at the ends."""
    w = Window.partitionBy(*by).orderBy(along)
    return (F.lead(v).over(w) - F.lag(v).over(w)) / (2 * step)


def second_derivative(v: str, along: str, by: list[str], step: float) -> Column:
    w = Window.partitionBy(*by).orderBy(along)
    return (F.lead(v).over(w) - 2 * F.col(v) + F.lag(v).over(w)) / (step * step)


def burgers_residual(grid: DataFrame, dx: float, dt: float, nu: float) -> DataFrame:
    """u_t + u u_x - nu u_xx on ``grid`` (i, n, u): x = i dx, t = n dt."""
    r = derivative("u", "n", ["i"], dt) + F.col("u") * derivative("u", "i", ["n"], dx) - nu * second_derivative("u", "i", ["n"], dx)
    return grid.withColumn("residual", r)


def incompressible_residual(grid: DataFrame, dx: float, dy: float, re: float) -> DataFrame:
    """Continuity and steady momentum of (i, j, u, v, p)."""
    x = lambda f: derivative(f, "i", ["j"], dx)
    y = lambda f: derivative(f, "j", ["i"], dy)
    lap = lambda f: second_derivative(f, "i", ["j"], dx) + second_derivative(f, "j", ["i"], dy)
    g = grid.withColumns({f"{f}_{a}": c for f in "uvp" for a, c in (("x", x(f)), ("y", y(f)), ("l", lap(f)))})
    return g.withColumns({
        "continuity": F.col("u_x") + F.col("v_y"),
        "momentum_x": F.col("u") * F.col("u_x") + F.col("v") * F.col("u_y") + F.col("p_x") - F.col("u_l") / re,
        "momentum_y": F.col("u") * F.col("v_x") + F.col("v") * F.col("v_y") + F.col("p_y") - F.col("v_l") / re,
    }).drop(*(f"{f}_{a}" for f in "uvp" for a in "xyl"))


def euler_residual(grid: DataFrame, dx: float, dy: float, gamma: float = 1.4) -> DataFrame:
    """Mass, momentum and energy of steady compressible flow, (i, j, rho, u, v, p)."""
    e = F.col("p") / (gamma - 1) + 0.5 * F.col("rho") * (F.col("u") ** 2 + F.col("v") ** 2)
    ru, rv = F.col("rho") * F.col("u"), F.col("rho") * F.col("v")
    flux = {"mass": (ru, rv), "momentum_x": (ru * F.col("u") + F.col("p"), ru * F.col("v")), "momentum_y": (ru * F.col("v"), rv * F.col("v") + F.col("p")), "energy": ((e + F.col("p")) * F.col("u"), (e + F.col("p")) * F.col("v"))}
    g = grid.withColumns({f"{n}_{a}": c for n, (fx, fy) in flux.items() for a, c in (("f", fx), ("g", fy))})
    g = g.withColumns({n: derivative(f"{n}_f", "i", ["j"], dx) + derivative(f"{n}_g", "j", ["i"], dy) for n in flux})
    return g.drop(*(f"{n}_{a}" for n in flux for a in "fg"))


def physics_loss(grid: DataFrame, residual: str, value: str, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: ``equation``, the mean square of a residual where there is one, the mean square of what ``value`` is off
    each boundary or initial condition (where it holds, what is expected there), and their ``loss``. One aggregate."""
    off = {n: F.avg(F.when(where, (F.col(value) - expected) ** 2)) for n, (where, expected) in conditions.items()}
    out = grid.agg(F.avg(F.col(residual) ** 2).alias("equation"), *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in off.items()))
    return out.withColumn("loss", sum((F.col(n) for n in off), F.col("equation")))


# --- airfoils --------------------------------------------------------------------------------------------


def airfoil(x: Column, weights: list[float], trailing: float = 0.0) -> Column:
    """Height of a surface by class and shape functions: sqrt(x) (1 - x) times a Bernstein sum."""
    n = len(weights) - 1
    shape = sum((F.lit(w * math.comb(n, k)) * F.pow(x, F.lit(float(k))) * F.pow(1 - x, F.lit(float(n - k))) for k, w in enumerate(weights)), F.lit(0.0))
    return F.sqrt(x) * (1 - x) * shape + x * trailing


def airfoil_area(weights: list[float], points: int = 201) -> float:
    """The area under such a surface, by the trapezium rule."""
    x = np.linspace(0, 1, points)
    n = len(weights) - 1
    y = np.sqrt(x) * (1 - x) * sum(w * math.comb(n, k) * x**k * (1 - x) ** (n - k) for k, w in enumerate(weights))
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
