"""Priors and likelihoods of rule lists: closed forms, and the likelihood of every detector in one product."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, pi

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of detectors and subjects that are held as numbers at once.
CELLS = 1 << 22


@dataclass(frozen=True)
class Hyper:
    """Hyperparameters; the defaults are the published ones."""

    variance: float = 100.0
    alpha_m: float = 0.5
    beta_m: float = 2.0
    alpha_primitives: float = 2.0
    beta_primitives: float = 4.0
    concentration_typical: float = 5.0
    concentration_ratio: float = 0.2
    fraction_std: float = 0.2
    a_empty: float = 0.5
    b_empty: float = 0.5
    max_rules: int = 10
    max_primitives: int = 10
    duration_epsilon: float = 0.01
    least_delta: float = 1e-3
    mean_scale: float = 50.0
    std_scale: float = 25.0
    offset: float = 0.0


def phylogeny_scale(variables: DataFrame, hyper: Hyper = Hyper()) -> DataFrame:
    """One row: delta, centre, mean_variance and std_bound of the log weights of variables."""
    w = F.ln("weight")
    spread = F.greatest(F.max(w) - F.percentile(w, F.lit(0.025)), F.lit(hyper.least_delta))
    return variables.agg(spread.alias("delta"), (F.median(w) + hyper.offset).alias("centre")).select(
        "delta", "centre", (hyper.mean_scale * F.col("delta") * F.col("delta")).alias("mean_variance"), (hyper.std_scale * F.col("delta")).alias("std_bound"))


def flat_prior(detectors: DataFrame, total: float, *, mean: float = 0.0, std: float = 1.0, fraction: float = 0.5, concentration: float = 2.0, epsilon: float = 0.01, phylogeny: bool = True) -> DataFrame:
    """detectors (weight, duration, ...) with log_prior, normalised over all rows by log-sum-exp.

    Constants cancel, so the normal and beta densities are taken without theirs.
    """
    d = F.col("duration") / ((1.0 + epsilon) * total)
    a, b = concentration * fraction, concentration * (1 - fraction)
    raw = (a - 1) * F.ln(d) + (b - 1) * F.ln(1 - d)
    if phylogeny:
        z = (F.ln("weight") - mean) / std
        raw = raw - z * z / 2
    every = Window.partitionBy()
    out = detectors.withColumn("raw", raw).withColumn("top", F.max("raw").over(every))
    return out.withColumn("log_prior", F.col("raw") - F.col("top") - F.ln(F.sum(F.exp(F.col("raw") - F.col("top"))).over(every))).drop("raw", "top")


def log_nb(k: int, alpha: float, beta: float) -> float:
    """Log pmf of the negative binomial with mean alpha / beta."""
    p = beta / (1 + beta)
    return lgamma(k + alpha) - lgamma(alpha) - lgamma(k + 1) + alpha * log(p) + k * log(1 - p)


def log_truncated_nb(k: int, alpha: float, beta: float, most: int) -> float:
    """The same among 0..most - 1; minus infinity beyond."""
    if k >= most:
        return -np.inf
    return log_nb(k, alpha, beta) - log(sum(exp(log_nb(i, alpha, beta)) for i in range(most)))


def structure_prior(lengths: list[int], empty: float, hyper: Hyper = Hyper()) -> float:
    """Log prior of a list whose rules have the given numbers of detectors."""
    if not lengths:
        return log(empty)
    rules = log_truncated_nb(len(lengths) - 1, hyper.alpha_m, hyper.beta_m, hyper.max_rules)
    return log(1 - empty) + rules + sum(log_truncated_nb(n - 1, hyper.alpha_primitives, hyper.beta_primitives, hyper.max_primitives) for n in lengths)


def poisson_structure_prior(lengths: list[int], empty: float, rate_rules: float, rate_atoms: float) -> float:
    """The simpler prior: Poisson numbers of rules and of detectors, given that neither is 0."""
    if not lengths:
        return log(empty)
    positive = lambda n, r: n * log(r) - r - lgamma(n + 1) - log(1 - exp(-r))
    return log(1 - empty) + positive(len(lengths), rate_rules) + sum(positive(n, rate_atoms) for n in lengths)


def log_multinomial(items: list) -> float:
    """Log number of orders of a list with repetitions."""
    return lgamma(len(items) + 1) - sum(lgamma(items.count(x) + 1) for x in set(items))


def length_prior(hyper: Hyper = Hyper(), legacy_truncation: bool = True) -> np.ndarray:
    """P(total number of detectors), by convolution; ``legacy_truncation`` leaves out lists of max_rules rules."""
    most = hyper.max_rules - 1 if legacy_truncation else hyper.max_rules
    one = np.array([0.0] + [exp(log_truncated_nb(k, hyper.alpha_primitives, hyper.beta_primitives, hyper.max_primitives)) for k in range(hyper.max_primitives)])
    share = np.array([exp(log_nb(m, hyper.alpha_m, hyper.beta_m)) for m in range(most)])
    out = np.zeros(hyper.max_primitives * most + 1)
    empty = hyper.a_empty / (hyper.a_empty + hyper.b_empty)
    out[0] = empty
    rule = np.array([1.0])
    for m in range(most):
        rule = np.convolve(rule, one)
        out[: len(rule)] += (1 - empty) * share[m] / share.sum() * rule
    return out


def log_likelihood_given_omega(x: np.ndarray, omega: np.ndarray, y: np.ndarray, variance: float) -> float:
    """log N(z; 0, diag(1 / omega) + variance x x'), z = (y - 1/2) / omega, by the Woodbury identities."""
    z = (y - 0.5) / omega
    a = np.eye(x.shape[1]) / variance + (x.T * omega) @ x
    low = np.linalg.cholesky(a)
    half = np.linalg.solve(low, x.T @ (omega * z))
    logdet = -np.log(omega).sum() + 2 * np.log(np.diag(low)).sum() + x.shape[1] * log(variance)
    return float(-0.5 * (len(y) * log(2 * pi) + logdet + (omega * z * z).sum() - half @ half))


def log_likelihoods_of_options(x: np.ndarray, options: np.ndarray, omega: np.ndarray, y: np.ndarray, variance: float) -> np.ndarray:
    """The same for x with each row of ``options`` (detectors x subjects) as one more column, all at once.

    A further column v changes the covariance C by a term of rank one, so with u = C^-1 z the value is
    base - log(1 + s v'C^-1 v) / 2 + s (v'u)^2 / (2 (1 + s v'C^-1 v)).
    """
    z = (y - 0.5) / omega
    wx = x * omega[:, None]
    a = np.eye(x.shape[1]) / variance + x.T @ wx
    low = np.linalg.cholesky(a)
    base = log_likelihood_given_omega(x, omega, y, variance)
    u = omega * z - wx @ np.linalg.solve(low.T, np.linalg.solve(low, x.T @ (omega * z)))
    out, step = np.empty(len(options)), max(1, CELLS // max(options.shape[1], 1))
    for i in range(0, len(options), step):
        v = options[i : i + step].astype(float)  # of zeros and ones, its own square
        side = np.linalg.solve(low, (v @ wx).T)
        lift = 1 + variance * (v @ omega - (side * side).sum(axis=0))
        out[i : i + step] = base - 0.5 * np.log(lift) + 0.5 * variance * (v @ u) ** 2 / lift
    return out


def bernoulli_log_likelihood(x: np.ndarray, beta: np.ndarray, y: np.ndarray) -> float:
    eta = x @ beta
    return float((y * eta - np.logaddexp(0, eta)).sum())


def polya_gamma(z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws of PG(1, z) by the alternating series of the Jacobi distribution (Polson, Scott, Windle 2013)."""
    half = np.abs(np.asarray(z, float)) / 2
    out = np.empty(len(half))
    cut = 0.64
    todo = np.arange(len(half))
    rate = pi * pi / 8 + half * half / 2
    norm = lambda v: 0.5 * (1 + np.vectorize(_erf)(v / np.sqrt(2.0)))
    right = pi / (2 * rate) * np.exp(-rate * cut)
    low = 2 * np.exp(-half) * (norm((cut * half - 1) / np.sqrt(cut)) + np.exp(2 * half) * norm(-(cut * half + 1) / np.sqrt(cut)))
    while len(todo):
        h, k = half[todo], rate[todo]
        far = rng.random(len(todo)) < right[todo] / (right[todo] + low[todo])
        x = np.where(far, cut + rng.exponential(size=len(todo)) / k, 0.0)
        x[~far] = _inverse_gaussian(h[~far], cut, rng)
        s = _term(0, x, cut)
        y = rng.random(len(todo)) * s
        state = np.zeros(len(todo), int)
        n = 0
        while (state == 0).any():
            n += 1
            a = _term(n, x, cut)
            s = s - a if n % 2 else s + a
            open_ = state == 0
            state[open_ & (y <= s) & bool(n % 2)] = 1
            state[open_ & (y > s) & (not n % 2)] = -1
        done = state == 1
        out[todo[done]] = x[done] / 4
        todo = todo[~done]
    return out


def _erf(v: float) -> float:
    from math import erf

    return erf(v)


def _term(n: int, x: np.ndarray, cut: float) -> np.ndarray:
    k = n + 0.5
    small = np.power(2 / (pi * np.maximum(x, 1e-300)), 1.5) * np.exp(-2 * k * k / np.maximum(x, 1e-300))
    return pi * k * np.where(x > cut, np.exp(-k * k * pi * pi * x / 2), small)


def _inverse_gaussian(h: np.ndarray, cut: float, rng: np.random.Generator) -> np.ndarray:
    """Inverse Gaussian draws with mean 1 / h and shape 1, below ``cut``."""
    out = np.empty(len(h))
    todo = np.arange(len(h))
    while len(todo):
        m = 1 / np.maximum(h[todo], 1e-12)
        wide = m > cut
        x = np.empty(len(todo))
        e1, e2 = rng.exponential(size=len(todo)), rng.exponential(size=len(todo))
        ok = np.where(wide, e1 * e1 <= 2 * e2 / cut, True)
        tail = cut / (1 + cut * e1) ** 2
        ok_wide = ok & (rng.random(len(todo)) <= np.exp(-0.5 * h[todo] ** 2 * tail))
        y = rng.standard_normal(len(todo)) ** 2
        mm = np.minimum(m, 1e6)
        v = mm + 0.5 * mm * mm * y - 0.5 * mm * np.sqrt(4 * mm * y + (mm * y) ** 2)
        v = np.where(rng.random(len(todo)) > mm / (mm + v), mm * mm / np.maximum(v, 1e-300), v)
        x = np.where(wide, tail, v)
        good = np.where(wide, ok_wide, v <= cut)
        out[todo[good]] = x[good]
        todo = todo[~good]
    return out
