"""Training of networks over rows that no machine holds.

A network is a shape and a flat vector of parameters. A pass over the samples (``x``, ``y``: arrays) sends the parameters out
with the tasks; each task adds up its rows' loss and slopes by matrix products, and slices of these sums meet, so that
what is shuffled are parameters and not rows. The step itself, Adam's or L-BFGS', is made on the driver, which holds
some vectors of parameters and no row. One pass can serve many vectors at once: the steps that a line search tries, or the
trials of a search over settings.

Samples with a null or a number that is not finite are left out of every pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from . import linalg as L


class Network(Protocol):
    def start(self, seed: int) -> np.ndarray:
        """Parameters to start from."""

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Outputs of rows."""

    def slopes(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss summed over rows, and its slopes."""


def cut_up(theta: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in shapes])
    return [p.reshape(s) for p, s in zip(np.split(theta, ends[:-1]), shapes, strict=True)]


@dataclass(frozen=True)
class Dense:
    """Layers of weights and biases, tanh between them. A row's loss is its mean squared error. With as many outputs as
    inputs and a narrow layer it is an autoencoder."""

    sizes: tuple[int, ...]

    def shapes(self) -> list[tuple[int, ...]]:
        return [s for a, b in itertools.pairwise(self.sizes) for s in ((a, b), (b,))]

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes()])

    def layers(self, theta: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        p, out = cut_up(theta, self.shapes()), [x]
        for k in range(0, len(p), 2):
            z = out[-1] @ p[k] + p[k + 1]
            out.append(np.tanh(z) if k < len(p) - 2 else z)
        return p, out

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.layers(theta, x)[1][-1]

    def slopes(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        p, out = self.layers(theta, x)
        off = out[-1] - y
        delta, found = 2 * off / y.shape[1], []
        for k in range(len(p) - 2, -1, -2):
            found += [delta.sum(axis=0), out[k // 2].T @ delta]
            delta = (delta @ p[k].T) * (1 - out[k // 2] ** 2)
        return float((off**2).sum() / y.shape[1]), np.concatenate([g.ravel() for g in reversed(found)])


@dataclass(frozen=True)
class Functions:
    """Layers of sums of functions of each input: Chebyshev polynomials of its tanh, or sines of its multiples."""

    sizes: tuple[int, ...]
    degree: int = 3
    kind: str = "chebyshev"

    def shapes(self) -> list[tuple[int, ...]]:
        return [(a, b, self.degree + 1) for a, b in itertools.pairwise(self.sizes)]

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(0, (s[0] * s[2]) ** -0.5, s).ravel() for s in self.shapes()])

    def basis(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions of each entry and their slopes along the last axis."""
        if self.kind == "sine":
            k = np.arange(self.degree + 1)
            return np.sin(x[..., None] * k), np.cos(x[..., None] * k) * k
        u = np.tanh(x)
        t, s = [np.ones_like(u), u], [np.zeros_like(u), np.ones_like(u)]
        for _ in range(self.degree - 1):
            s.append(2 * t[-1] + 2 * u * s[-1] - s[-2])
            t.append(2 * u * t[-1] - t[-2])
        n = self.degree + 1
        return np.stack(t[:n], axis=-1), np.stack(s[:n], axis=-1) * (1 - u * u)[..., None]

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        for c in cut_up(theta, self.shapes()):
            x = np.einsum("nif,iof->no", self.basis(x)[0], c)
        return x

    def slopes(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        p, held = cut_up(theta, self.shapes()), []
        for c in p:
            held.append(self.basis(x))
            x = np.einsum("nif,iof->no", held[-1][0], c)
        off, found = x - y, []
        delta = 2 * off / y.shape[1]
        for (f, slope), c in zip(reversed(held), reversed(p), strict=True):
            found.append(np.einsum("nif,no->iof", f, delta))
            delta = np.einsum("nif,iof,no->ni", slope, c, delta, optimize=True)
        return float((off**2).sum() / y.shape[1]), np.concatenate([g.ravel() for g in reversed(found)])


@dataclass(frozen=True)
class Variational:
    """An encoder to means and log-variances of a latent space and a decoder, of a hidden layer each. ``y`` holds each
    row's noise (as many numbers as latent ones), so that a pass that is run again gives the same sums. A row's loss is its
    squared error plus ``beta`` times the divergence from a standard normal distribution."""

    inputs: int
    hidden: int
    latent: int
    beta: float = 1e-3

    def shapes(self) -> list[tuple[int, ...]]:
        sizes = (self.inputs, self.hidden, 2 * self.latent), (self.latent, self.hidden, self.inputs)
        return [s for z in sizes for a, b in itertools.pairwise(z) for s in ((a, b), (b,))]

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes()])

    def encode(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, w1, b1 = cut_up(theta, self.shapes())[:4]
        return tuple(np.split(np.tanh(x @ w + b) @ w1 + b1, 2, axis=1))

    def decode(self, theta: np.ndarray, z: np.ndarray) -> np.ndarray:
        w, b, w1, b1 = cut_up(theta, self.shapes())[4:]
        return np.tanh(z @ w + b) @ w1 + b1

    def predict(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.decode(theta, self.encode(theta, x)[0])

    def slopes(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        w0, b0, w1, b1, w2, b2, w3, b3 = cut_up(theta, self.shapes())
        h = np.tanh(x @ w0 + b0)
        mean, spread = np.split(h @ w1 + b1, 2, axis=1)
        s = np.exp(spread / 2)
        z = mean + s * y
        g = np.tanh(z @ w2 + b2)
        off = g @ w3 + b3 - x
        loss = (off**2).sum() - self.beta / 2 * (1 + spread - mean**2 - s * s).sum()
        d3 = 2 * off
        d2 = (d3 @ w3.T) * (1 - g * g)
        dz = d2 @ w2.T
        d1 = np.hstack([dz + self.beta * mean, dz * y * s / 2 + self.beta / 2 * (s * s - 1)])
        d0 = (d1 @ w1.T) * (1 - h * h)
        found = [x.T @ d0, d0.sum(axis=0), h.T @ d1, d1.sum(axis=0), z.T @ d2, d2.sum(axis=0), g.T @ d3, d3.sum(axis=0)]
        return float(loss), np.concatenate([f.ravel() for f in found])


# --- passes ----------------------------------------------------------------------------------------------


def samples(df: DataFrame, inputs: list[str | Column], outputs: list[str | Column], *keys: str) -> DataFrame:
    """``keys``, x and y of the rows whose inputs and outputs are all there and finite."""
    x, y = (F.array(*(c if isinstance(c, Column) else F.col(c) for c in cs)).cast("array<double>") for cs in (inputs, outputs))
    fine = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return df.select(*keys, x.alias("x"), y.alias("y")).filter(fine("x") & fine("y"))


def noise(*seeds: Column, latent: int) -> Column:
    """Numbers of a normal distribution that hang on ``seeds`` alone."""
    even = lambda k: (F.pmod(F.xxhash64(*seeds, F.lit(k)), F.lit(1 << 53)) + 0.5) / (1 << 53)
    return F.array(*(F.sqrt(-2 * F.log(even(2 * k))) * F.cos(2 * math.pi * even(2 * k + 1)) for k in range(latent)))


def evaluated(rows: DataFrame, trials: list[tuple[Network, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
    """The mean loss and slopes of each trial (network, parameters), all in one pass over ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(trials)
    sizes = [1 + len(theta) for _, theta in trials]
    L.checked_size(sum(sizes))

    def part(b: pa.RecordBatch) -> np.ndarray:
        x, y = L.block(b, "x"), L.block(b, "y")
        sums = [np.concatenate([[loss], g]) for loss, g in (net.slopes(theta, x, y) for net, theta in shared.value)]
        return np.concatenate([[len(x)], *sums])

    total = L.summed(rows.select("x", "y"), part, 1 + sum(sizes))
    if not total[0]:
        raise ValueError("no rows to learn from")
    each = np.split(total[1:] / total[0], np.cumsum(sizes)[:-1])
    return [(float(e[0]), e[1:]) for e in each]


def dealt(rows: DataFrame, batches: int, seed: int = 0) -> list[DataFrame]:
    """``rows`` in as many batches, told by a hash of x and y: written once, so that a step reads its own batch alone. One
    batch is kept by the executors and made again where it is lost."""
    if batches == 1:
        return [rows.persist()]
    t = written(rows.withColumn("batch", F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(batches)).cast("int")), "batch")
    return [t.filter(F.col("batch") == k) for k in range(batches)]


# --- steps -----------------------------------------------------------------------------------------------


@dataclass
class Adam:
    rate: float = 1e-2
    gamma: float = 1.0
    every: int = 50
    n: int = 0

    def step(self, theta: np.ndarray, g: np.ndarray, epoch: int) -> np.ndarray:
        if not self.n:
            self.m, self.v = np.zeros_like(g), np.zeros_like(g)
        self.n += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        rate = self.rate * self.gamma ** (epoch // self.every)
        return theta - rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)


@dataclass
class Trained:
    network: Network
    theta: np.ndarray
    losses: list[float] = field(default_factory=list)
    held: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.network.predict(self.theta, x)


def adam(rows: DataFrame, network: Network, epochs: int, optimiser: Adam | None = None, batches: int = 1, valid: DataFrame | None = None, stop=None, theta: np.ndarray | None = None, seed: int = 0) -> Trained:
    """Epochs of a step for each batch. ``stop`` is asked after each epoch with the loss of ``valid``, or else of the epoch; the
    parameters with the least one are kept where it is given."""
    o = Adam() if optimiser is None else optimiser
    out = Trained(network, network.start(seed) if theta is None else theta.copy())
    parts = dealt(rows, batches, seed)
    best = math.inf, out.theta
    for epoch in range(epochs):
        before, losses = out.theta, []
        for k in np.random.default_rng((seed, epoch)).permutation(len(parts)):
            loss, g = evaluated(parts[k], [(network, out.theta)])[0]
            losses.append(loss)
            out.theta = o.step(out.theta, g, epoch)
        out.losses.append(float(np.mean(losses)))
        if valid is not None:
            out.held.append(evaluated(valid, [(network, out.theta)])[0][0])
        if stop is not None:
            now, of = (out.held[-1], out.theta) if valid is not None else (out.losses[-1], before)
            best = min(best, (now, of), key=lambda b: b[0])
            if stop(now):
                break
    if stop is not None:
        out.theta = best[1]
    parts[0].unpersist()
    return out


def lbfgs(rows: DataFrame, network: Network, steps: int, memory: int = 10, tries: int = 8, theta: np.ndarray | None = None, seed: int = 0, tolerance: float = 1e-10) -> Trained:
    """Steps along the direction that the last ``memory`` changes of slopes give. All ``tries`` lengths of a line search, each
    half the one before, are evaluated in one pass; the longest that lowers the loss enough is taken."""
    out = Trained(network, network.start(seed) if theta is None else theta.copy())
    rows = rows.persist()
    loss, g = evaluated(rows, [(network, out.theta)])[0]
    out.losses.append(loss)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(held):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        if held:
            s, y = held[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(held, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        if g @ d > -tolerance:
            break
        lengths = 0.5 ** np.arange(tries) * (1 if held else min(1, 1 / np.abs(g).sum()))
        found = evaluated(rows, [(network, out.theta + a * d) for a in lengths])
        good = [k for k, (v, _) in enumerate(found) if v <= loss + 1e-4 * lengths[k] * (g @ d)]
        if not good:
            break
        k = good[0]
        move, change = lengths[k] * d, found[k][1] - g
        if move @ change > 1e-12:
            held = [*held, (move, change)][-memory:]
        out.theta, (loss, g) = out.theta + move, found[k]
        out.losses.append(loss)
    rows.unpersist()
    return out
