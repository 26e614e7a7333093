"""Search over settings that learns from trials: a density-ratio sampler proposes, successive halving decides.

All live trials of a rung are trained side by side, a step of each in one pass over the rows, and judged in one pass over the
rows held back; the better ones go on with more steps. Later rounds draw settings where good trials are dense against
where the others are. Everything hangs on the seed and the rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .training import Adam, Network, evaluated

#: Of finished trials, the share that counts as good; candidates of which the best ratio is taken.
GOOD, CANDIDATES = 0.25, 24


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else v

    def outer(self, v: float) -> float:
        v = min(max(v, self.inner(self.low)), self.inner(self.high))
        return math.exp(v) if self.log else v


Space = dict[str, Real | list]


@dataclass
class Trial:
    settings: dict
    network: Network
    optimiser: Adam
    theta: np.ndarray
    loss: float = math.inf
    steps: int = 0


@dataclass
class Search:
    """``make`` turns settings into a network and the rate of its steps."""

    space: Space
    make: Callable[[dict], tuple[Network, float]]
    trials: int = 12
    rounds: int = 3
    rungs: int = 3
    steps: int = 4
    keep: float = 0.5
    seed: int = 0
    done: list[Trial] = field(default_factory=list)
    passes: int = 0

    def propose(self, rng: np.random.Generator) -> dict:
        """Settings at random while few trials are done; then, of candidates drawn around good trials, the one where good
        ones are densest against the others."""
        if len(self.done) < 8:
            return {k: (s[int(rng.integers(len(s)))] if isinstance(s, list) else s.outer(rng.uniform(s.inner(s.low), s.inner(s.high)))) for k, s in self.space.items()}
        order = sorted(self.done, key=lambda t: (-t.steps, t.loss))
        n = max(2, int(GOOD * len(order)))
        groups = order[:n], order[n:]
        out = {}
        for name, s in self.space.items():
            good, rest = ([t.settings[name] for t in g] for g in groups)
            if isinstance(s, list):
                # Shares with one of each added, so that nothing is ruled out.
                share = lambda g: np.array([1 + g.count(c) for c in s]) / (len(s) + len(g))  # noqa: B023, E731
                drawn = rng.choice(len(s), CANDIDATES, p=share(good))
                out[name] = s[int(drawn[np.argmax((share(good) / share(rest))[drawn])])]
            else:
                low, high = s.inner(s.low), s.inner(s.high)
                g = np.array([s.inner(v) for v in good])
                width = max(1.06 * float(g.std()) * len(g) ** -0.2, 0.02 * (high - low))
                mass = np.vectorize(lambda c: (math.erf((high - c) / width / 2**0.5) - math.erf((low - c) / width / 2**0.5)) / 2)  # noqa: B023
                # Each kernel counts for what of it is within bounds, so that edges are neither shunned nor sought.
                dense = lambda x, c: (np.exp(-0.5 * ((x[:, None] - c) / width) ** 2) / mass(c)).mean(axis=1) + 1e-6  # noqa: B023, E731
                x = np.array([s.inner(s.outer(rng.normal(g[int(rng.integers(len(g)))], width))) for _ in range(CANDIDATES)])
                rest = np.array([s.inner(v) for v in rest])
                out[name] = s.outer(float(x[np.argmax(dense(x, g) / dense(x, rest))]))
        return out

    def run(self, rows: DataFrame, valid: DataFrame) -> Trial:
        rows, valid = rows.persist(), valid.persist()
        for r in range(self.rounds):
            rng = np.random.default_rng((self.seed, r))
            live = []
            for _ in range(self.trials):
                settings = self.propose(rng)
                net, rate = self.make(settings)
                live.append(Trial(settings, net, Adam(rate), net.start(self.seed)))
            self.done += live
            for rung in range(self.rungs):
                for _ in range(self.steps * 2**rung):
                    found = evaluated(rows, [(t.network, t.theta) for t in live])
                    self.passes += 1
                    for t, (_, g) in zip(live, found, strict=True):
                        t.theta, t.steps = t.optimiser.step(t.theta, g, 0), t.steps + 1
                for t, (loss, _) in zip(live, evaluated(valid, [(t.network, t.theta) for t in live]), strict=True):
                    t.loss = loss if math.isfinite(loss) else math.inf
                self.passes += 1
                live = sorted(live, key=lambda t: t.loss)[: max(1, int(self.keep * len(live)))]
        rows.unpersist()
        valid.unpersist()
        most = max(t.steps for t in self.done)
        return min((t for t in self.done if t.steps == most), key=lambda t: t.loss)
