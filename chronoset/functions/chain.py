"""A Markov chain over rule lists with Polya-Gamma auxiliaries: the steps that one Spark task takes for one chain.

Rule lists are lists of lists of detector numbers. A chain needs the truths of all detectors at once, so the size of
the detector table (bounded by ``max_thresholds`` when it is mined) bounds the memory of a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np

from chronoset.functions import model
from chronoset.functions.model import Hyper


def log_sum_exp(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum()))


def reflected_unit(x: float) -> float:
    return abs((x + 1) % 2 - 1)


@dataclass
class Chain:
    truths: np.ndarray  # detectors x subjects
    log_weights: np.ndarray
    durations: np.ndarray  # shares of the study's length
    inverse: np.ndarray  # of each detector the one with the other direction
    y: np.ndarray
    rules: list[list[int]]
    rng: np.random.Generator
    delta: float = 1e-3
    centre: float = 0.0
    hyper: Hyper = field(default_factory=Hyper)
    prior_only: bool = False

    def __post_init__(self) -> None:
        h = self.hyper
        self.bound = h.std_scale * self.delta
        self.mean, self.std = self.centre, min(self.bound, 5 * self.delta)
        self.fraction, self.concentration, self.empty = 0.5, 2.0, 0.5
        self.omega = np.ones(len(self.y))
        self.beta = np.zeros(len(self.rules) + 1)

    # ---------------------------------------------------------------- parts of the posterior

    def covariates(self, rules: list[list[int]]) -> np.ndarray:
        return np.column_stack([*(self.truths[r].all(axis=0) for r in rules), np.ones(len(self.y))]).astype(float)

    def likelihood(self, rules: list[list[int]]) -> float:
        return 0.0 if self.prior_only else model.log_likelihood_given_omega(self.covariates(rules), self.omega, self.y, self.hyper.variance)

    def likelihoods(self, rules: list[list[int]], i: int, others: list[int]) -> np.ndarray:
        """Of every detector beside ``others`` in a rule that takes the place of rule i (or is new)."""
        if self.prior_only:
            return np.zeros(len(self.truths))
        base = self.covariates([r for k, r in enumerate(rules) if k != i])
        options = self.truths & self.truths[others].all(axis=0) if others else self.truths
        return model.log_likelihoods_of_options(base, options, self.omega, self.y, self.hyper.variance)

    def flat_prior(self, mean=None, std=None, fraction=None, concentration=None) -> np.ndarray:
        m, s = self.mean if mean is None else mean, self.std if std is None else std
        f, c = self.fraction if fraction is None else fraction, self.concentration if concentration is None else concentration
        d = self.durations / (1 + self.hyper.duration_epsilon)
        raw = -0.5 * ((self.log_weights - m) / s) ** 2 + (c * f - 1) * np.log(d) + (c * (1 - f) - 1) * np.log1p(-d)
        return raw - log_sum_exp(raw)

    def structure(self, rules: list[list[int]]) -> float:
        return model.structure_prior([len(r) for r in rules], self.empty, self.hyper)

    def list_prior(self, rules: list[list[int]], flat: np.ndarray) -> float:
        return self.structure(rules) + sum(flat[k] for r in rules for k in r) + sum(model.log_multinomial(r) for r in rules)

    def hyper_prior(self) -> float:
        h = self.hyper
        a, b = h.a_empty, h.b_empty
        out = (a - 1) * log(self.empty) + (b - 1) * log(1 - self.empty) + lgamma(a + b) - lgamma(a) - lgamma(b)
        out += -log(h.concentration_typical) - self.concentration / h.concentration_typical
        v = h.mean_scale * self.delta**2
        out += -0.5 * (log(2 * np.pi * v) + (self.mean - self.centre) ** 2 / v)
        return out - log(self.bound) if 0 <= self.std <= self.bound else -np.inf

    def coefficient_prior(self) -> float:
        v = self.hyper.variance
        return float(-0.5 * (self.beta @ self.beta / v + len(self.beta) * log(2 * np.pi * v)))

    def prior(self) -> float:
        return self.list_prior(self.rules, self.flat_prior()) + self.hyper_prior() + self.coefficient_prior()

    # ---------------------------------------------------------------- steps

    def draw(self, log_weights: np.ndarray) -> int:
        p = np.cumsum(np.exp(log_weights - log_weights.max()))
        return min(int(np.searchsorted(p, self.rng.random() * p[-1])), len(p) - 1)

    def update_coefficients(self) -> None:
        if self.prior_only:
            self.beta = self.rng.normal(0, self.hyper.variance**0.5, len(self.rules) + 1)
            return
        x = self.covariates(self.rules)
        if len(self.beta) != x.shape[1]:
            self.beta = np.zeros(x.shape[1])
        self.omega = np.maximum(model.polya_gamma(x @ self.beta, self.rng), 1e-12)
        self.update_beta()

    def update_beta(self) -> None:
        x = self.covariates(self.rules)
        if self.prior_only:
            self.beta = self.rng.normal(0, self.hyper.variance**0.5, x.shape[1])
            return
        precision = np.eye(x.shape[1]) / self.hyper.variance + (x.T * self.omega) @ x
        low = np.linalg.cholesky(precision)
        middle = np.linalg.solve(precision, x.T @ (self.y - 0.5))
        self.beta = middle + np.linalg.solve(low.T, self.rng.standard_normal(x.shape[1]))

    def update_slot(self) -> None:
        """Draw one detector anew from its conditional distribution over all detectors."""
        places = [(i, j) for i, r in enumerate(self.rules) for j in range(len(r))]
        if not places:
            return
        i, j = places[self.rng.integers(len(places))]
        others = self.rules[i][:j] + self.rules[i][j + 1 :]
        weights = self.likelihoods(self.rules, i, others) + self.flat_prior()
        for k in set(others):
            n = others.count(k)
            weights[k] += log(1 + n) - lgamma(n + 2)
        self.rules[i][j] = self.draw(weights)
        self.rules[i].sort()

    def _addition(self, base: list[list[int]], i: int, new: bool):
        """(log prior ratio, log likelihood ratio, log weights of detectors, chance of the reverse removal)."""
        flat = self.flat_prior()
        if new:
            longer = base[:i] + [[0]] + base[i:]
            weights = flat + self.likelihoods(longer, i, [])
            prior = self.structure(longer) - self.structure(base)
            return prior, log_sum_exp(weights) - self.likelihood(base), weights, 1 / sum(map(len, longer))
        others = base[i]
        longer = base[:i] + [[*others, 0]] + base[i + 1 :]
        order = np.full(len(flat), log(len(others) + 1))
        for k in set(others):
            order[k] -= log(others.count(k) + 1)
        like = self.likelihoods(longer, i, others)
        weights, piece = flat + order + like, log_sum_exp(flat + order)
        prior = self.structure(longer) - self.structure(base) + piece
        reverse = (len(others) + 1) / sum(map(len, longer)) * exp(log_sum_exp(flat + like) - log_sum_exp(weights))
        return prior, log_sum_exp(weights) - piece - self.likelihood(base), weights, reverse

    def add(self) -> None:
        m = len(self.rules)
        option = int(self.rng.integers(2 * m + 1))
        new, i = option >= m, option - m if option >= m else option
        prior, like, weights, reverse = self._addition(self.rules, i, new)
        if not np.isfinite(prior):
            return
        if log(self.rng.random() + 1e-300) < prior + like + log(reverse) + log(2 * m + 1):
            k = self.draw(weights)
            if new:
                self.rules = self.rules[:i] + [[k]] + self.rules[i:]
            else:
                self.rules[i] = sorted([*self.rules[i], k])

    def remove(self) -> None:
        places = [(i, j) for i, r in enumerate(self.rules) for j in range(len(r))]
        if not places:
            return
        i, j = places[self.rng.integers(len(places))]
        alone = len(self.rules[i]) == 1
        copies = 1 if alone else self.rules[i].count(self.rules[i][j])
        shorter = [list(r) for r in self.rules]
        if alone:
            del shorter[i]
        else:
            del shorter[i][j]
        prior, like, _, _ = self._addition(shorter, i, alone)
        if log(self.rng.random() + 1e-300) < -prior - like - log(2 * len(shorter) + 1) - log(copies / len(places)):
            self.rules = shorter

    def move(self) -> None:
        """Put one detector, or its inverse, at any place of the list, drawn from the conditional distribution."""
        places = [(i, j) for i, r in enumerate(self.rules) for j in range(len(r))]
        if len(places) < 2:
            return
        i, j = places[self.rng.integers(len(places))]
        k = self.rules[i][j]
        base = [list(r) for r in self.rules]
        del base[i][j]
        base = [r for r in base if r]
        options = []
        for d in dict.fromkeys((k, int(self.inverse[k]))):
            options += [base[:n] + [sorted([*base[n], d])] + base[n + 1 :] for n in range(len(base))]
            options += [base[:n] + [[d]] + base[n:] for n in range(len(base) + 1)]
        flat = self.flat_prior()
        self.rules = options[self.draw(np.array([self.list_prior(o, flat) + self.likelihood(o) for o in options]))]

    def update_empty(self) -> None:
        none = not self.rules
        self.empty = float(np.clip(self.rng.beta(self.hyper.a_empty + none, self.hyper.b_empty + (not none)), 1e-12, 1 - 1e-12))

    def _accept(self, **proposed) -> None:
        old = {k: getattr(self, k) for k in proposed}
        before = self.prior()
        for k, v in proposed.items():
            setattr(self, k, v)
        if not log(self.rng.random() + 1e-300) < self.prior() - before:
            for k, v in old.items():
                setattr(self, k, v)

    def update_hyper(self) -> None:
        h = self.hyper
        f = float(np.clip(reflected_unit(self.fraction + self.rng.normal(0, h.fraction_std)), 1e-6, 1 - 1e-6))
        c = abs(self.concentration + self.rng.normal(0, h.concentration_typical * h.concentration_ratio))
        self._accept(fraction=f, concentration=c)
        self._accept(mean=self.mean + self.rng.normal(0, 0.5 * self.delta))
        self._accept(std=max(self.bound * reflected_unit((self.std + self.rng.normal(0, 0.5 * self.delta)) / self.bound), 1e-9))

    def step(self, draws: int = 10) -> list[np.ndarray]:
        """One iteration; returns the coefficients drawn before the move, with the list they belong to unchanged."""
        kept = []
        for _ in range(draws):
            self.update_coefficients()
            kept.append(self.beta.copy())
        u = self.rng.random()
        if u < 0.45:
            self.update_slot()
        elif u < 0.9:
            (self.add if self.rng.random() < 0.5 else self.remove)()
        else:
            self.move()
        self.update_beta()
        self.update_empty()
        self.update_hyper()
        return kept

    def log_likelihood(self) -> float:
        return model.bernoulli_log_likelihood(self.covariates(self.rules), self.beta, self.y)
