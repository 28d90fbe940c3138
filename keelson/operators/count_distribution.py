"""The exact distribution of the delayed count (H3): a Poisson-binomial by groups of equal probability.

Shipments of one probability are a binomial; Spark counts them, and only the groups (p, n) reach the driver: with the fallback rates there
are as many as combinations of route type, mode and category, not as shipments.  Groups are convolved smallest first.  Each mass function is
kept on mean +- ``SPREAD`` deviations, outside which less than 1e-40 lies, so its length follows the square root of the shipments.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 14.0
#: groups of different probabilities that may be convolved on the driver
MAX_GROUPS = 100_000
#: shorter products are summed term by term, longer ones by Fourier transforms
DIRECT = 1 << 22


@dataclass
class Counts:
    """Mass of the counts first, first + 1, ..."""

    first: int
    mass: np.ndarray

    def __add__(self, other: Counts) -> Counts:
        a, b = self.mass, other.mass
        if len(a) * len(b) <= DIRECT:
            mass = np.convolve(a, b)
        else:
            n = len(a) + len(b) - 1
            size = 1 << (n - 1).bit_length()
            mass = np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)
        return Counts(self.first + other.first, mass).trimmed()

    def trimmed(self) -> Counts:
        k = np.arange(len(self.mass))
        mean = float((k * self.mass).sum() / self.mass.sum())
        dev = math.sqrt(max(float(((k - mean) ** 2 * self.mass).sum() / self.mass.sum()), 0.0))
        lo, hi = max(0, math.floor(mean - SPREAD * dev - 1)), min(len(k), math.ceil(mean + SPREAD * dev + 2))
        return Counts(self.first + lo, self.mass[lo:hi])

    def quantile(self, q: float) -> int:
        """The least count that at least the share ``q`` of the mass does not exceed."""
        total = np.cumsum(self.mass)
        return self.first + int(np.searchsorted(total, q * total[-1]))

    def moments(self) -> tuple[float, float]:
        k = np.arange(len(self.mass)) + float(self.first)
        p = self.mass / self.mass.sum()
        mean = float((k * p).sum())
        return mean, math.sqrt(float(((k - mean) ** 2 * p).sum()))


def binomial(n: int, p: float) -> Counts:
    """n draws of probability p, on its mean +- SPREAD deviations."""
    if n == 0 or p <= 0:
        return Counts(0, np.ones(1))
    if p >= 1:
        return Counts(n, np.ones(1))
    dev = math.sqrt(n * p * (1 - p))
    lo, hi = max(0, math.floor(n * p - SPREAD * dev - 1)), min(n, math.ceil(n * p + SPREAD * dev + 1))
    k = np.arange(lo, hi, dtype=float)   # ratios of neighbouring masses, in logarithms
    steps = np.concatenate(([0.0], np.cumsum(np.log((n - k) / (k + 1)) + math.log(p) - math.log1p(-p))))
    mass = np.exp(steps - steps.max())
    return Counts(lo, mass / mass.sum())


def convolve(groups: list[tuple[float, int]]) -> Counts:
    """The sum of independent groups (p, n)."""
    parts = [(len(c.mass), i, c) for i, c in enumerate(binomial(n, p) for p, n in groups)]
    heapq.heapify(parts)
    serial = len(parts)
    while len(parts) > 1:
        _, _, a = heapq.heappop(parts)
        _, _, b = heapq.heappop(parts)
        c = a + b
        heapq.heappush(parts, (len(c.mass), serial, c))
        serial += 1
    return parts[0][2] if parts else Counts(0, np.ones(1))


def probability_groups(df: DataFrame, p: str = "Predicted_Delay_Probability") -> DataFrame:
    """p and n of every distinct probability; shipments without one take no part."""
    return df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def delayed_count_summary(df: DataFrame, quantiles: dict[str, float], p: str = "Predicted_Delay_Probability") -> DataFrame:
    """One row: groups, exact mean and deviation of the delayed count, and its quantiles."""
    groups = probability_groups(df, p).limit(MAX_GROUPS + 1).collect()
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} different probabilities: round them to a grid first")
    counts = convolve([(r.p, r.n) for r in groups])
    mean, dev = counts.moments()
    names = list(quantiles)
    return df.sparkSession.createDataFrame(
        [(len(groups), mean, dev, *[counts.quantile(quantiles[k]) for k in names])],
        "groups int, mean double, deviation double, " + ", ".join(f"{k} long" for k in names))
