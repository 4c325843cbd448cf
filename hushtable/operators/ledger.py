"""The privacy budget: what each query costs, how costs compose, and how one release divides its budget."""

from __future__ import annotations

import math
import secrets
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

SLACK = 1e-9


@dataclass
class Ledger:
    """Spends against a declared total. Groups add up; within a group, spends on disjoint partitions cost their maximum.

    A partition is a path such as `cohort/class`: a row in it is also in every partition above it, so a path costs all
    spends along it, and the group costs its dearest path besides what is spent on no partition.
    """

    declared: float
    entries: list[tuple[str, str | None, float, float]] = field(default_factory=list)
    sealed: bool = False

    def spend(self, group: str, epsilon: float, partitions=(None,), sensitivity: float = 1.0) -> float:
        """Charge one query on each partition and return its noise scale; refused if the total would be passed."""
        if self.sealed:
            raise ValueError("the ledger is sealed")
        if not (epsilon > 0 and sensitivity > 0 and math.isfinite(epsilon)):
            raise ValueError("budget and sensitivity must be positive")
        more = [(group, p, epsilon, sensitivity) for p in partitions]
        if total_of(self.entries + more) > self.declared + SLACK:
            raise ValueError(f"{group} would pass the declared budget of {self.declared}")
        self.entries += more
        return sensitivity / epsilon

    @property
    def total(self) -> float:
        return total_of(self.entries)

    @property
    def remaining(self) -> float:
        return self.declared - self.total

    def seal(self) -> None:
        self.sealed = True

    def audit(self) -> dict:
        """All spends and their composition, so that the total can be worked out by hand."""
        groups = dict.fromkeys(e[0] for e in self.entries)
        return {
            "declared": self.declared, "total": self.total, "sealed": self.sealed,
            "groups": {g: total_of([e for e in self.entries if e[0] == g]) for g in groups},
            "entries": [dict(zip(("group", "partition", "epsilon", "sensitivity"), e)) for e in self.entries],
        }


def total_of(entries) -> float:
    plain, own = defaultdict(float), defaultdict(lambda: defaultdict(float))
    for group, partition, epsilon, _ in entries:
        if partition is None:
            plain[group] += epsilon
        else:
            own[group][partition] += epsilon
    total = sum(plain.values())
    for spent in own.values():
        paths = (["/".join(p.split("/")[: i + 1]) for i in range(p.count("/") + 1)] for p in spent)
        total += max(sum(spent.get(a, 0.0) for a in path) for path in paths)
    return total


@dataclass(frozen=True)
class Budget:
    """How a release divides its budget: cohort sizes, each marginal query, cell supports, positive counts of cells."""

    cohorts: float
    query: float
    cells: float
    rates: float


def divide(epsilon: float, conditional_fraction: float, n_columns: int, charge_suppression: bool = True) -> Budget:
    """One query for each column and one for the class balance share what sizes, supports and rates leave."""
    if not 0 < conditional_fraction < 1:
        raise ValueError("the conditional fraction must be between 0 and 1")
    rates = conditional_fraction * epsilon
    counts = 0.05 * epsilon
    marginals = epsilon - rates - counts
    gate = min(0.05 * epsilon, 0.25 * marginals) if charge_suppression else 0.0
    return Budget((counts + gate) / 2, (marginals - gate) / (n_columns + 1), (counts + gate) / 2, rates)


def check_unit(epsilon: float, rows_per_person: int | None, acknowledged: bool = False) -> str | None:
    """Refuse a guarantee that is empty for a person with many rows; a note if their number isn't declared."""
    if rows_per_person is None:
        return "rows per person not declared: the guarantee is for one row"
    if epsilon * rows_per_person > 10 and not acknowledged:
        raise ValueError(f"epsilon for a person is {epsilon * rows_per_person}: over 10 is no protection")
    return None


def chances(n: int) -> np.ndarray:
    """Numbers in (0, 1) from the system's randomness."""
    return (np.array([secrets.randbits(53) for _ in range(n)], float) + 0.5) / 2**53


def laplace(scale: float, n: int, seed: int | None = None) -> np.ndarray:
    """Noise from the system's randomness; a seed is for tests only and voids the guarantee."""
    if seed is not None:
        return np.random.default_rng(seed).laplace(0, scale, n)
    half = chances(n) - 0.5
    return -scale * np.sign(half) * np.log1p(-2 * np.abs(half))


def mean_sensitivity(low: float, high: float, n: int) -> float:
    """How much one of n values within bounds can change their mean."""
    if not low < high or n < 1:
        raise ValueError("bounds must ascend and n be positive")
    return (high - low) / n


def exponential_choice(scores: np.ndarray, epsilon: float, sensitivity: float = 1.0, seed: int | None = None) -> int:
    """The exponential mechanism: number i with a chance in proportion to exp(epsilon * score / (2 * sensitivity)).

    Drawn as the largest score under Gumbel noise, which has that law; from the system's randomness unless seeded.
    """
    noise = -np.log(-np.log(chances(len(scores)))) if seed is None else np.random.default_rng(seed).gumbel(size=len(scores))
    return int(np.argmax(np.asarray(scores, float) * epsilon / (2 * sensitivity) + noise))


def permute_and_flip(scores: np.ndarray, epsilon: float, sensitivity: float = 1.0, seed: int | None = None) -> int:
    """Permute and flip, which is never worse than the exponential mechanism: the largest score under exponential noise."""
    noise = -np.log(chances(len(scores))) if seed is None else np.random.default_rng(seed).exponential(size=len(scores))
    return int(np.argmax(np.asarray(scores, float) * epsilon / (2 * sensitivity) + noise))


def _log_delta(rho, epsilon: float, b: np.ndarray) -> np.ndarray:
    """The logarithm of the delta that the Renyi bound of order 1 + exp(b) gives with zero-concentrated privacy rho."""
    order, rest = 1 + np.exp(b), b - np.logaddexp(0, b)  # rest: log(1 - 1 / order)
    return np.exp(b) * (order * rho - epsilon) + order * rest - b


def delta_of(rho: float, epsilon: float) -> float:
    """The least delta for which rho-zCDP implies (epsilon, delta): the least of the bounds of all orders.

    The bound has one valley over the orders, so a grid over their logarithms is laid anew around its lowest point.
    """
    if rho <= 0:
        return 0.0
    b = np.linspace(-30, 30, 241)
    for _ in range(6):
        values = _log_delta(rho, epsilon, b)
        k = int(np.argmin(values))
        b = np.linspace(b[max(k - 1, 0)], b[min(k + 1, len(b) - 1)], 241)
    return float(np.exp(min(values.min(), 0.0)))


def rho_of(epsilon: float, delta: float) -> float:
    """The largest rho whose zCDP implies (epsilon, delta).

    At the best order the bound is level, which gives rho as (epsilon - log(1 - 1 / order)) / (2 order - 1). Along these
    pairs delta falls as the order rises, so the order sought is the first at which it is low enough.
    """
    if not 0 < delta < 1 or epsilon < 0:
        raise ValueError("epsilon must not be negative, delta be between 0 and 1")
    b = np.linspace(-30, 30, 241)
    for _ in range(7):
        rho = (epsilon - b + np.logaddexp(0, b)) / (1 + 2 * np.exp(b))
        k = max(1, int(np.argmax(_log_delta(rho, epsilon, b) <= np.log(delta))))
        found, b = float(rho[k]), np.linspace(b[k - 1], b[k], 241)
    return found


def gaussian(rho: float, sensitivity: float, size: int, seed: int | None = None) -> np.ndarray:
    """Gaussian noise that spends rho of zero-concentrated privacy on values with this L2 sensitivity; from the system's
    randomness unless seeded."""
    scale = sensitivity / np.sqrt(2 * rho)
    if seed is not None:
        return np.random.default_rng(seed).normal(0, scale, size)
    return scale * np.sqrt(-2 * np.log(chances(size))) * np.cos(2 * np.pi * chances(size))
