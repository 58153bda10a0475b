"""Search of settings by the ratio of two densities: what good trials have, and bad ones lack, is tried next.

Trials are ordered by their loss; the best quarter are good. For every setting a density of the good and one of the other values
is made of normal kernels (counts for choices), candidates are drawn from the good one, and the one with the largest ratio is
taken. Trials run a few at a time, each as Spark jobs of its own on frames that are already kept; a batch is proposed before any
of it has run, its own places counted as bad ones, so the order in which jobs end doesn't matter and a seed gives one search.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

GOOD_SHARE, CANDIDATES = 0.25, 24


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def inner(self, x: float) -> float:
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        return ((math.log(x) if self.log else x) - a) / (b - a)

    def outer(self, u: float) -> float:
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = a + min(1.0, max(0.0, u)) * (b - a)
        return min(self.high, max(self.low, math.exp(x) if self.log else x))


@dataclass(frozen=True)
class Whole(Real):
    def outer(self, u: float) -> int:
        return round(super().outer(u))


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Real | Whole | Choice]


@dataclass(frozen=True)
class Trial:
    settings: dict
    loss: float


def _density(values: list[float], u: float) -> float:
    """Normal kernels on 0..1, as wide as the values are apart, and one wide kernel for what was not tried yet."""
    width = max(0.04, 0.7 / math.sqrt(len(values) + 1))
    bell = lambda center, s: math.exp(-0.5 * ((u - center) / s) ** 2) / s
    return (sum(bell(v, width) for v in values) + bell(0.5, 1.0)) / (len(values) + 1)


def propose(space: Space, trials: list[Trial], rng: random.Random) -> dict:
    """The next settings to try."""
    ordered = sorted(trials, key=lambda t: t.loss)
    n = max(1, math.ceil(GOOD_SHARE * len(ordered)))
    good, other = ordered[:n], ordered[n:]
    out = {}
    for name, kind in space.items():
        if isinstance(kind, Choice):
            share = lambda some, v, name=name, kind=kind: (sum(t.settings[name] == v for t in some) + 1) / (len(some) + len(kind.values))
            drawn = rng.choices(kind.values, [share(good, v) for v in kind.values], k=CANDIDATES)
            out[name] = max(drawn, key=lambda v: share(good, v) / share(other, v))
        else:
            a, b = ([kind.inner(t.settings[name]) for t in some] for some in (good, other))
            width = max(0.04, 0.7 / math.sqrt(len(a) + 1))
            drawn = [min(1.0, max(0.0, rng.gauss(rng.choice(a), width) if rng.random() > 1 / (len(a) + 1) else rng.random())) for _ in range(CANDIDATES)]
            out[name] = kind.outer(max(drawn, key=lambda u: _density(a, u) / _density(b, u)))
    return out


def drawn(space: Space, rng: random.Random) -> dict:
    return {name: rng.choice(kind.values) if isinstance(kind, Choice) else kind.outer(rng.random()) for name, kind in space.items()}


def search(space: Space, loss: Callable[[dict], float], trials: int = 24, at_random: int = 8, parallel: int = 4, seed: int = 42) -> list[Trial]:
    """All trials in the order in which they were proposed; a loss that is no number counts as the worst."""
    rng, done = random.Random(seed), []

    def run(settings: dict) -> Trial:
        value = loss(settings)
        return Trial(settings, math.inf if value is None or math.isnan(value) else value)

    with ThreadPoolExecutor(parallel) as pool:
        while len(done) < trials:
            batch: list[dict] = []
            for _ in range(min(parallel, trials - len(done))):
                waiting = [Trial(s, math.inf) for s in batch]
                batch.append(drawn(space, rng) if len(done) + len(batch) < at_random else propose(space, done + waiting, rng))
            done += pool.map(run, batch)
    return done


def best(done: list[Trial]) -> Trial:
    return min(done, key=lambda t: t.loss)
