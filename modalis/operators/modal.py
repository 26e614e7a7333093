"""Modal decompositions of snapshot matrices (rows: space, columns: time).

Each is a distributed reduction, a small problem on the driver, and a distributed projection: the tall factor
stays a DataFrame, the others are NumPy arrays of at most columns x columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import linalg as L
from .signal import hamming_window


@dataclass
class Modes:
    """X = U diag(s) V': ``u`` holds rows, ``vt`` modes by time."""

    u: DataFrame
    s: np.ndarray
    vt: np.ndarray


def centred(rows: DataFrame, remove_mean: bool = True, divide_variance: bool = False) -> DataFrame:
    if not remove_mean:
        return rows.select("row_id", "x")
    y = C.norm_variance("x") if divide_variance else C.subtract_mean("x")
    return rows.select("row_id", y.alias("x", metadata=rows.schema["x"].metadata))


def pod(rows: DataFrame, remove_mean: bool = True, divide_variance: bool = False, randomized: bool = False, r: int = 1, q: int = 3, seed: int = 0, method: str = "qr") -> Modes:
    y = centred(rows, remove_mean, divide_variance)
    return Modes(*(L.randomized_svd(y, r, q, seed) if randomized else L.tsqr_svd(y, method)))


def truncation(s: np.ndarray, r: float) -> int:
    """Modes to keep: a count (r >= 1); the first N whose residual is below r (0 < r < 1); or the first N whose
    share of the sum of S is above |r| (r < 0)."""
    if r >= 1:
        return min(int(r), len(s))
    if r > 0:
        tail = np.sqrt(np.cumsum((s**2)[::-1])[::-1])
        below = np.flatnonzero(tail / tail[0] < r)
        return int(below[0]) if len(below) else len(s)
    above = np.flatnonzero(np.cumsum(s) / s.sum() > abs(r))
    return int(above[0]) + 1 if len(above) else len(s)


def residuals(s: np.ndarray) -> np.ndarray:
    """The norm of what N = 0, 1, ... modes leave out, over that of all."""
    tail = np.sqrt(np.cumsum((s**2)[::-1])[::-1])
    return tail / tail[0]


def truncate(m: Modes, r: float) -> Modes:
    n = truncation(m.s, r)
    return Modes(m.u.select("row_id", F.slice("x", 1, n).alias("x")), m.s[:n], m.vt[:n])


def reconstruct(m: Modes) -> DataFrame:
    k = min(len(m.s), len(m.u.select("x").first()["x"]))
    return L.times(m.u.select("row_id", F.slice("x", 1, k).alias("x")), m.s[:k, None] * m.vt[:k])


def extract_modes(u: DataFrame, component: int, components: int, modes: list[int]) -> DataFrame:
    """point, x: one field's rows of some modes (fields interleave by row; both count from 1; order stays)."""
    picked = F.array(*(F.element_at("x", m) for m in modes))
    mine = u.filter(F.col("row_id") % components == component - 1)
    return mine.select(F.floor(F.col("row_id") / components).cast("bigint").alias("point"), picked.alias("x"))


def pca(rows: DataFrame, divide_variance: bool = True) -> tuple[DataFrame, np.ndarray]:
    """Principal directions (rows) and scores (time x modes)."""
    m = pod(rows, True, divide_variance)
    return m.u, (m.s[:, None] * m.vt).T


def f_quantile(confidence: float, n: int) -> float:
    """The quantile of F(1, n): the square of Student's, by bisection on its distribution."""
    target = (1 + confidence) / 2

    def cdf(t: float) -> float:
        theta = np.arctan(t / np.sqrt(n))
        c2 = np.cos(theta) ** 2
        if n % 2:
            term, a = np.cos(theta), 0.0
            for k in range(1, n - 1, 2):
                a += term
                term *= c2 * (k + 1) / (k + 2)
            return 0.5 + (theta + np.sin(theta) * a) / np.pi
        term, a = 1.0, 0.0
        for k in range(0, n - 1, 2):
            a += term
            term *= c2 * (k + 1) / (k + 2)
        return 0.5 + np.sin(theta) * a / 2

    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < target else (low, mid)
    return low * low


def t2_score(p: np.ndarray, components: int = 1, confidence: float = 0.8) -> tuple[np.ndarray, float]:
    """Scores of each row over its first components, and the limit of the confidence interval."""
    n = p.shape[0]
    variance = (p[:, 0] ** 2).sum() / (n - 1)
    scores = (p[: p.shape[1], :components] ** 2).sum(axis=1) / variance
    return scores, f_quantile(confidence, n - 1)


def coherent_modes(vt: np.ndarray, time: np.ndarray, divide_variance: bool = False, components: int = 1, confidence: float = 0.8) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Which temporal coefficients have coherent spectra: scores, limit, coherent and other modes."""
    n = len(time)
    y = vt - vt.mean(axis=1, keepdims=True)
    k, x = np.arange(n) - n // 2, np.arange(n) / n - 0.5
    power = np.abs(y @ np.exp(2j * np.pi * np.outer(x, k))) ** 2 / n
    z = power.T - power.T.mean(axis=1, keepdims=True)
    if divide_variance:
        z = z / power.T.var(axis=1, keepdims=True)
    _, s, wt = np.linalg.svd(z, full_matrices=False)
    scores, limit = t2_score((s[:, None] * wt).T, components, confidence)
    modes = np.arange(len(scores))
    return scores, limit, modes[scores > limit], modes[scores < limit]


# --- dynamic modes ---------------------------------------------------------------------------------------


@dataclass
class Dynamics:
    """Eigenvalues, amplitudes, and rows of complex modes as interleaved (re, im) pairs."""

    mu: np.ndarray
    amplitude: np.ndarray
    phi: DataFrame


def paired_order(mu: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By falling amplitude; of a conjugate pair the one with positive imaginary part first."""
    order = list(np.lexsort((-mu.imag, -np.round(np.abs(b), 12))))
    k = 0
    while k < len(order) - 1:
        i, j = order[k], order[k + 1]
        if abs(mu[i].imag) > 0 and np.isclose(mu[i], mu[j].conj()):
            if mu[i].imag < 0:
                order[k], order[k + 1] = j, i
            k += 2
        else:
            k += 1
    return np.array(order, int)


def dmd(rows: DataFrame, r: float, remove_mean: bool = True) -> Dynamics:
    """One pass gives R of all snapshots. With X = Q R, the first n - 1 columns of R give S, V of those of X and the
    others Q'Y2, so neither Q nor U is ever made; a second pass projects the modes."""
    y = centred(rows, remove_mean)
    f = L.tsqr(y)
    u, s, vt = np.linalg.svd(f[:, :-1], full_matrices=False)
    keep = min(truncation(s, r), int((s > 1e-12 * s[0]).sum()))
    u, s, vt = u[:, :keep], s[:keep], vt[:keep]
    sign = L.canonical(vt)
    u, vt = u * sign, vt * sign[:, None]
    small = u.T @ f[:, 1:] @ vt.T / s[None, :]
    mu, vec = np.linalg.eig(small)
    project = (vt.T / s) @ vec / mu
    vander = mu[:, None] ** np.arange(f.shape[1] - 1)[None, :]
    p = (vec.conj().T @ vec) * (vander @ vander.conj().T).conj()
    rhs = np.diag(vander @ (vt.T * s) @ vec).conj()
    b = np.linalg.solve(p, rhs)
    order = paired_order(mu, b)
    mu, b, project = mu[order], b[order], project[:, order]
    shift = np.zeros((f.shape[1], 2 * keep))
    shift[1:, 0::2], shift[1:, 1::2] = project.real, project.imag
    return Dynamics(mu, b, L.times(y, shift))


def extract_dynamics(phi: DataFrame, component: int, components: int, modes: list[int], real: bool = True) -> DataFrame:
    """point, x: the real or imaginary parts of some modes at one field's rows (all count from 1; order stays)."""
    return extract_modes(phi, component, components, [2 * m - 1 if real else 2 * m for m in modes])


def mode_computation(rows: DataFrame, vt: np.ndarray, s: np.ndarray, w: np.ndarray) -> DataFrame:
    """X V diag(1 / S) |W|: modes of given moduli of eigenvectors."""
    return L.times(rows, (vt.T / s) @ np.abs(w))


def frequency_damping(mu: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Damping log |mu| / dt and angular frequency arg mu / dt."""
    return np.log(np.abs(mu)) / dt, np.angle(mu) / dt


def dmd_reconstruct(d: Dynamics, t: np.ndarray) -> DataFrame:
    """Real part of phi diag(b) mu ** t; the exponent is t as it is."""
    m = d.amplitude[:, None] * L.vandermonde(d.mu, t)
    both = np.empty((2 * len(d.mu), len(t)))
    both[0::2], both[1::2] = m.real, -m.imag
    return L.times(d.phi, both)


# --- spectral modes --------------------------------------------------------------------------------------


@dataclass
class Spectral:
    """Energies by (frequency, block), frequencies, both by falling leading energy; row_id, f (its index before
    sorting), x: real parts of modes by block; and that index by place in the order."""

    energy: np.ndarray
    frequency: np.ndarray
    modes: DataFrame
    order: np.ndarray


def extract_spectral(m: Spectral, component: int, components: int, modes: list[int], block: int = 1) -> DataFrame:
    """point, x: the modes of one block at one field's rows, ``modes`` by their place in the order of energies (all
    count from 1; order stays)."""
    wanted = [int(m.order[k - 1]) for k in modes]
    mine = m.modes.filter(F.col("f").isin(wanted) & (F.col("row_id") % components == component - 1))
    point = F.floor(F.col("row_id") / components).cast("bigint").alias("point")
    by_f = F.map_from_entries(F.collect_list(F.struct("f", F.element_at("x", block).alias("v"))))
    return mine.groupBy(point).agg(by_f.alias("m")).select("point", F.array(*(F.element_at("m", f) for f in wanted)).alias("x"))


def spod(rows: DataFrame, t: np.ndarray, n_dft: int = 0, overlap: int = 0, remove_mean: bool = True) -> Spectral:
    """Windowed transforms of every row stay in its task; the R factors of all frequencies (rows x blocks each) are
    merged over levels of tasks; modes are a second pass over rows."""
    n = len(t)
    if n_dft == 0:
        n_dft = int(2 ** np.floor(np.log2(n / 10)))
    if overlap == 0:
        overlap = n_dft // 2
    dt, step = t[1] - t[0], n_dft - overlap
    blocks = (n - overlap) // step
    window = hamming_window(n_dft)
    weight = 1 / window.mean()
    kept = int(np.ceil(n_dft / 2)) + 1
    frequency = np.arange(kept) / dt / n_dft

    def spectra(x: np.ndarray) -> np.ndarray:
        """rows x frequency x block"""
        parts = np.stack([x[:, b * step : b * step + n_dft] for b in range(blocks)], axis=1) * window
        q = np.fft.fft(parts, axis=2)[:, :, :kept] * (weight / n_dft)
        q[:, :, 1:-1] *= 2
        return q.transpose(0, 2, 1) / np.sqrt(blocks)

    y = centred(rows, remove_mean)

    def pack(r: np.ndarray) -> np.ndarray:
        return np.stack([r.real, r.imag]).ravel()

    def unpack(x: np.ndarray) -> np.ndarray:
        re, im = x.reshape(2, kept, -1, blocks)
        return re + 1j * im

    def factor(r: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
        q = spectra(L.block(batch)).transpose(1, 0, 2)
        return pack(np.linalg.qr(q if r is None else np.concatenate([unpack(r), q], axis=1), mode="r"))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pack(np.linalg.qr(np.concatenate([unpack(a), unpack(b)], axis=1), mode="r"))

    L.checked_width(y)
    L.checked_size(2 * kept * blocks * blocks)
    parts = [unpack(x) for x in L.merged(y.select("x"), factor, merge)]
    _, s, vh = np.linalg.svd(np.concatenate(parts, axis=1), full_matrices=False)
    v = vh.conj().transpose(0, 2, 1)
    w = s**2
    turn = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
    v = v * (np.abs(turn) / turn)
    scale = np.where(s > 1e-12 * s.max(initial=1), 1 / np.maximum(s, 1e-300), 0)
    order = np.argsort(-w[:, 0], kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast(v * scale[:, None, :])

    def project(batches: Iterator) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                m = np.einsum("rfa,fab->rfb", spectra(np.vstack(p["x"].to_numpy())), shared.value).real
                rows_, f = np.indices(m.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"row_id": p["row_id"].to_numpy()[rows_], "f": f, "x": list(m.reshape(-1, blocks))})

    return Spectral(w[order], frequency[order], y.mapInPandas(project, "row_id bigint, f int, x array<double>"), order)
