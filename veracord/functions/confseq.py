"""Confidence sequences for the mean of a bounded sequence: valid at all times at once.

:class:`BettingSequence` keeps, for a grid of candidate means m, the capital of a bettor who
stakes that the mean is greater than m and of one who stakes that it is less. A mean
whose capital passes 1/alpha is ruled out. The stakes are the predictable plug-in of
the empirical-Bernstein kind. With a known population size, the sequence is sampled
without replacement: the mean of what is left is what the bet is about, and the
deterministic bounds are intersected. An observation costs one pass over the grid.
"""

from __future__ import annotations

import math

import numpy as np

GRID = 100


class BettingSequence:
    def __init__(self, level: float, population: int | None = None, grid: int = GRID):
        self.alpha, self.population = 1 - level, population
        self.means = np.linspace(0, 1, grid + 1)
        self.log_up, self.log_down = np.zeros(grid + 1), np.zeros(grid + 1)
        self.n = 0
        self.sum = 0.0
        self.spread = 0.25  # prior variance, one fake observation

    def update(self, x: float) -> None:
        t = self.n + 1
        stake = math.sqrt(2 * math.log(2 / self.alpha) / (t * math.log(t + 1) * (self.spread / t)))
        if self.population:
            mean = (self.population * self.means - self.sum) / max(self.population - self.n, 1)
        else:
            mean = self.means
        outside = (mean < 0) | (mean > 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.minimum(stake, np.where(mean > 0, 0.5 / mean, np.inf))
            down = np.minimum(stake, np.where(mean < 1, 0.5 / (1 - mean), np.inf))
            self.log_up += np.where(outside, np.inf, np.log1p(np.where(outside, 0, up * (x - mean))))
            self.log_down += np.where(outside, np.inf, np.log1p(np.where(outside, 0, -down * (x - mean))))
        self.n, self.sum = t, self.sum + x
        guess = (0.5 + self.sum) / (t + 1)
        self.spread += (x - guess) ** 2

    def interval(self) -> tuple[float, float]:
        """Current bounds: the means not ruled out, a grid step wider."""
        capital = np.maximum(self.log_up, self.log_down) + math.log(0.5)
        kept = self.means[capital <= math.log(1 / self.alpha)]
        step = self.means[1]
        low, high = (max(kept[0] - step, 0.0), min(kept[-1] + step, 1.0)) if len(kept) else (0.0, 1.0)
        if self.population:
            # what is certain; the grid may have ruled out all its means near the true one, which lies between them
            least, most = self.sum / self.population, 1 - (self.n - self.sum) / self.population
            low, high = min(max(low, least), most), max(min(high, most), least)
        return (float(low), float(high)) if low <= high else (float(high), float(low))


def estimate_mean(observations: list[bool], level: float = 0.95, population: int | None = None) -> tuple[float, float]:
    """Bounds of the mean after all observations; with a population equal to their number, the mean itself."""
    cs = BettingSequence(level, population)
    for x in observations:
        cs.update(float(x))
    return cs.interval()


def split_budget(level: float, parts: int) -> float:
    """Level of each of ``parts`` statements that hold together at ``level`` (Bonferroni)."""
    return 1 - (1 - level) / max(parts, 1)


def spend(level: float, expressions: int, group: int) -> float:
    """Level of the ``group``-th of an unknown number of groups: half of what is left, each time."""
    return 1 - (1 - level) / (max(expressions, 1) * 2 ** (group + 1))


def hoeffding_predmix(x, order, by=None, level: float = 0.95):
    """(centre, half width) columns of the predictable-mixture Hoeffding sequence, as window sums.

    ``lambda_t = min(1, sqrt(8 ln(2/alpha) / (t ln(t + 1))))``; centre = sum(lambda x) / sum(lambda),
    half = (ln(2/alpha) + sum(lambda^2) / 8) / sum(lambda).
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    t = F.row_number().over(rank).cast("double")
    log = math.log(2 / (1 - level))
    stake = F.least(F.lit(1.0), F.sqrt(F.lit(8 * log) / (t * F.log(t + 1))))
    return stake, lambda lam: (F.sum(F.col(lam) * x).over(w) / F.sum(lam).over(w), (F.lit(log) + F.sum(F.col(lam) * F.col(lam)).over(w) / 8) / F.sum(lam).over(w))


# --- other sequences and intervals, over numpy arrays ---------------------------------------


def empirical_bernstein(x: np.ndarray, level: float = 0.95, most: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each observation of the predictable-mixture empirical-Bernstein sequence.

    ``lambda_t = min(most, sqrt(2 ln(2/alpha) / (s_{t-1} t ln(t + 1))))``, where ``s`` is a smoothed
    variance; the half width is ``(ln(2/alpha) + sum v_i psi(lambda_i)) / sum lambda_i`` with
    ``psi(l) = -ln(1 - l) - l`` and ``v_i`` the squared distance from the mean before it.
    """
    x = np.asarray(x, float)
    t = np.arange(1, len(x) + 1)
    mean = (0.5 + np.cumsum(x)) / (t + 1)
    before = np.concatenate([[0.5], mean[:-1]])
    spread = (0.25 + np.cumsum((x - mean) ** 2)) / (t + 1)
    log = math.log(2 / (1 - level))
    stake = np.minimum(most, np.sqrt(2 * log / (np.concatenate([[0.25], spread[:-1]]) * t * np.log(t + 1))))
    total = np.cumsum(stake)
    centre = np.cumsum(stake * x) / total
    half = (log + np.cumsum((x - before) ** 2 * (-np.log1p(-stake) - stake))) / total
    return np.clip(centre - half, 0, 1), np.clip(centre + half, 0, 1)


def lower_bounds(x: np.ndarray, level: float = 0.95, grid: int = GRID) -> np.ndarray:
    """One-sided bound after each observation: the greatest mean that a bettor on larger means has ruled out.

    All of alpha is spent on this side, so the bound is tighter than the lower end of an interval.
    """
    means = np.linspace(0, 1, grid + 1)[1:]
    capital, spread, total, out = np.zeros(grid), 0.25, 0.0, []
    for t, v in enumerate(np.asarray(x, float), 1):
        stake = math.sqrt(2 * math.log(1 / (1 - level)) / (spread * math.log(t + 1)))
        capital += np.log1p(np.minimum(stake, 0.5 / means) * (v - means))
        total += v
        spread += (v - (0.5 + total) / (t + 1)) ** 2
        ruled = capital >= math.log(1 / (1 - level))
        out.append(means[ruled].max() if ruled.any() else 0.0)
    return np.maximum.accumulate(np.array(out)) if out else np.zeros(0)


def mixed_bets(x: np.ndarray, level: float = 0.95, bets: int = 10, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each observation when the capital is spread over fixed bets: ``bets`` shares of
    the greatest stake on either side, none of which has to be chosen from what was seen."""
    means = np.linspace(0, 1, grid + 1)[1:-1]
    share = (np.arange(1, bets + 1) / (bets + 1))[:, None]
    up, down = share / means[None, :], share / (1 - means[None, :])
    wins, loses, low, high = np.zeros_like(up), np.zeros_like(down), [], []
    for v in np.asarray(x, float):
        wins += np.log1p(up * (v - means))
        loses += np.log1p(-down * (v - means))
        both = np.logaddexp.reduce(np.concatenate([wins, loses]), axis=0) - math.log(2 * bets)
        kept = means[both < math.log(1 / (1 - level))]
        low.append(max(kept[0] - 1 / grid, 0) if len(kept) else 0.0)
        high.append(min(kept[-1] + 1 / grid, 1) if len(kept) else 1.0)
    return running_intersection(np.array(low), np.array(high))


def fixed_time_interval(x: np.ndarray, level: float = 0.95, grid: int = GRID) -> tuple[float, float]:
    """Interval for one number of observations known before: stakes aim at that number, so it is
    narrower there than a sequence; it says nothing at other times."""
    x = np.asarray(x, float)
    means, n = np.linspace(0, 1, grid + 1), len(x)
    up_log, down_log, spread, total = np.zeros(grid + 1), np.zeros(grid + 1), 0.25, 0.0
    with np.errstate(divide="ignore"):
        most_up, most_down = 0.9 / means, 0.9 / (1 - means)
    for t, v in enumerate(x, 1):
        stake = math.sqrt(2 * math.log(2 / (1 - level)) / (n * spread / t))
        up_log += np.log1p(np.minimum(stake, most_up) * (v - means))
        down_log += np.log1p(-np.minimum(stake, most_down) * (v - means))
        total += v
        spread += (v - (0.5 + total) / (t + 1)) ** 2
    kept = means[np.maximum(up_log, down_log) < math.log(2 / (1 - level))]
    return (max(float(kept[0]) - 1 / grid, 0.0), min(float(kept[-1]) + 1 / grid, 1.0)) if len(kept) else (0.0, 1.0)


def running_intersection(lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all intervals so far have in common."""
    return np.maximum.accumulate(lower) if len(lower) else lower, np.minimum.accumulate(upper) if len(upper) else upper


def intervals_at(x: np.ndarray, times: list[int], level: float = 0.95) -> list[tuple[float, float]]:
    """Fixed-time intervals of the first observations, for each number of them."""
    return [fixed_time_interval(np.asarray(x)[:t], level) for t in times]


def share_missed(sequences: list[tuple[np.ndarray, np.ndarray]], mean: float) -> float:
    """Share of sequences that leave ``mean`` out at any time."""
    return sum(bool(np.any((low > mean) | (high < mean))) for low, high in sequences) / max(len(sequences), 1)
