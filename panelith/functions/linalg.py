"""Estimators of cohort means from cohort moments: small dense kernels without Spark.

A cohort's moments are its weight, its weighted mean of each observed outcome, and the weighted sums of products.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

RANK_TOLERANCE = 1e-9


@dataclass
class Cohort:
    """at: positions of the observed outcomes among all of the panel."""

    at: np.ndarray
    weight: float
    mean: np.ndarray
    second: np.ndarray

    def without(self, position: int) -> Cohort:
        keep = self.at != position
        return Cohort(self.at[keep], self.weight, self.mean[keep], self.second[np.ix_(keep, keep)])


def from_rows(rows: pd.DataFrame) -> tuple[list[str], dict[str, Cohort]]:
    """All outcomes in order, and cohorts by key, from rows of cohort_key, t, s, w, mean, second."""
    outcomes = sorted(rows["t"].unique())
    place = {t: i for i, t in enumerate(outcomes)}
    out = {}
    for key, g in rows.groupby("cohort_key"):
        own = g[g["t"] == g["s"]].sort_values("t")
        at = np.array([place[t] for t in own["t"]])
        spot = {p: i for i, p in enumerate(at.tolist())}
        second = np.zeros((at.size, at.size))
        second[[spot[place[t]] for t in g["t"]], [spot[place[s]] for s in g["s"]]] = g["second"]
        out[key] = Cohort(at, float(own["w"].iloc[0]), own["mean"].to_numpy(), second)
    return outcomes, out


def projector(m: np.ndarray) -> np.ndarray:
    """Onto the columns of m."""
    return m @ np.linalg.pinv(m)


def cohort_factors(c: Cohort, r: int, demean: bool = False) -> np.ndarray:
    """The r leading principal directions of a cohort's observed outcomes."""
    s = c.second - c.weight * np.outer(c.mean, c.mean) if demean else c.second
    return np.linalg.eigh(s)[1][:, ::-1][:, :r]


#: What makes a cohort's own directions, a column each, from its moments.
Factors = Callable[[Cohort], np.ndarray]


def common_factors(cohorts: list[Cohort], n: int, r: int, factors: Factors | None = None) -> np.ndarray:
    """The r directions over all n outcomes that the cohorts' own directions, by default their r leading ones, leave least
    unexplained, each cohort counting once; cohorts with fewer outcomes than directions count not."""
    factors, rest = factors or (lambda c: cohort_factors(c, r)), np.zeros((n, n))
    for c in cohorts:
        if c.at.size >= r:
            rest[np.ix_(c.at, c.at)] += np.eye(c.at.size) - projector(factors(c))
    return np.linalg.eigh(rest)[1][:, :r]


def factor_means(cohorts: dict[str, Cohort], n: int, r: int, factors: Factors | None = None, use: set[str] | None = None) -> dict[str, np.ndarray]:
    """Means of all outcomes of each cohort, NaN where the factors aren't identified on what it is observed in.

    factors: own directions of a cohort, with a rank of their own; use: the cohorts that the common factors are fitted on.
    """
    f = common_factors([c for k, c in cohorts.items() if use is None or k in use], n, r, factors)
    out = {}
    for key, c in cohorts.items():
        own = f[c.at]
        known = c.at.size >= r and np.linalg.matrix_rank(own, RANK_TOLERANCE) == r
        out[key] = f @ (np.linalg.pinv(own) @ c.mean) if known else np.full(n, np.nan)
    return out


def outcome_parts(cohorts: list[Cohort], n: int) -> np.ndarray:
    """A label for each outcome, the same for outcomes that cohorts connect; -1 for those nobody is observed in."""
    label = np.arange(n)
    seen = np.zeros(n, bool)
    for c in cohorts:
        seen[c.at] = True
        for old in set(label[c.at].tolist()):
            label[label == old] = label[c.at[0]]
    return np.where(seen, label, -1)


def two_way(cohorts: dict[str, Cohort], n: int) -> tuple[dict[str, float], np.ndarray]:
    """Cohort and outcome effects of the weighted two-way regression on units and outcomes, profiled down to cohorts."""
    left, right = np.zeros((n, n)), np.zeros(n)
    for c in cohorts.values():
        centre = np.eye(c.at.size) - 1 / c.at.size
        left[np.ix_(c.at, c.at)] += c.weight * centre
        right[c.at] += c.weight * (centre @ c.mean)
    effect = np.linalg.pinv(left) @ right
    return {k: float((c.mean - effect[c.at]).mean()) for k, c in cohorts.items()}, effect


def two_way_means(cohorts: dict[str, Cohort], n: int) -> dict[str, np.ndarray]:
    own, effect = two_way(cohorts, n)
    part = outcome_parts(list(cohorts.values()), n)
    return {k: np.where(part == part[c.at[0]], own[k] + effect, np.nan) for k, c in cohorts.items()}


def two_way_residuals(cohorts: dict[str, Cohort], n: int) -> dict[str, Cohort]:
    """Moments of the units' residuals from the two-way regression."""
    _, effect = two_way(cohorts, n)
    out = {}
    for k, c in cohorts.items():
        d, centre = effect[c.at], np.eye(c.at.size) - 1 / c.at.size
        cross = c.weight * np.outer(c.mean, d)
        out[k] = Cohort(c.at, c.weight, centre @ (c.mean - d), centre @ (c.second - cross - cross.T + c.weight * np.outer(d, d)) @ centre)
    return out


#: Means of all n outcomes by cohort, from the cohorts' moments.
Estimator = Callable[[dict[str, Cohort], int], dict[str, np.ndarray]]


def two_way_residual_means(cohorts: dict[str, Cohort], n: int, residual: Estimator) -> dict[str, np.ndarray]:
    """Two-way means plus what an estimator makes of the residuals."""
    base, rest = two_way_means(cohorts, n), residual(two_way_residuals(cohorts, n), n)
    return {k: base[k] + rest[k] for k in cohorts}


def estimate(name: str, cohorts: dict[str, Cohort], n: int) -> dict[str, np.ndarray]:
    """By name: twfe_clustered, apm_rank_R, apm_demeaned_rank_R or twfe_apm_rank_R."""
    if name == "twfe_clustered":
        return two_way_means(cohorts, n)
    kind, _, r = name.rpartition("_rank_")
    if kind == "apm":
        return factor_means(cohorts, n, int(r))
    if kind == "apm_demeaned":
        return factor_means(cohorts, n, int(r), lambda c: cohort_factors(c, int(r), demean=True))
    if kind == "twfe_apm":
        return two_way_residual_means(cohorts, n, lambda c, k: factor_means(c, k, int(r)))
    raise ValueError(f"no estimator named {name}")


def _two_way_sums(c: Cohort, n: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.zeros((n, n)), np.zeros(n)
    centre = np.eye(c.at.size) - 1 / c.at.size
    left[np.ix_(c.at, c.at)] = c.weight * centre
    right[c.at] = c.weight * (centre @ c.mean)
    return left, right


def _unexplained(c: Cohort, n: int, r: int) -> np.ndarray:
    rest = np.zeros((n, n))
    if c.at.size >= r:
        rest[np.ix_(c.at, c.at)] = np.eye(c.at.size) - projector(cohort_factors(c, r))
    return rest


def left_out(name: str, cohorts: dict[str, Cohort], n: int, cells: list[tuple[str, int]]) -> list[float]:
    """The estimates of cells (cohort, outcome), each without it. For two-way and plain factor means the sums over cohorts are made
    once and only the cell's own cohort is exchanged; others are estimated anew for each cell."""
    kind, _, r = name.rpartition("_rank_")
    if name == "twfe_clustered":
        sums = {k: _two_way_sums(c, n) for k, c in cohorts.items()}
        left, right = sum(x for x, _ in sums.values()), sum(x for _, x in sums.values())
    elif kind == "apm":
        sums = {k: _unexplained(c, n, int(r)) for k, c in cohorts.items()}
        whole = sum(sums.values())
    out = []
    for key, t in cells:
        c = cohorts[key].without(t)
        if name == "twfe_clustered":
            own = _two_way_sums(c, n)
            effect = np.linalg.pinv(left - sums[key][0] + own[0]) @ (right - sums[key][1] + own[1])
            part = outcome_parts(list((cohorts | {key: c}).values()), n)
            out.append(float((c.mean - effect[c.at]).mean() + effect[t]) if part[t] == part[c.at[0]] else np.nan)
        elif kind == "apm":
            f = np.linalg.eigh(whole - sums[key] + _unexplained(c, n, int(r)))[1][:, : int(r)]
            known = c.at.size >= int(r) and np.linalg.matrix_rank(f[c.at], RANK_TOLERANCE) == int(r)
            out.append(float(f[t] @ (np.linalg.pinv(f[c.at]) @ c.mean)) if known else np.nan)
        else:
            out.append(float(estimate(name, cohorts | {key: c}, n)[key][t]))
    return out
