"""Gradient descent with momentum on a problem that this loop knows by numbers only.

A problem keeps pairs of iterates. ``step`` moves from the pair (x, s) to a candidate: y = s + beta (s - x), or y = x where
``base`` is "x", and then y - step * gradient(y); it gives the pair of what it was told to ``keep`` (x or s) and the
candidate, and sums: the error at the candidate and at y, and sums of squares of the gradient, the candidate's
distance from x, and the candidate. ``Callables`` is the problem of two functions on DataFrames of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays as A

Pair = TypeVar("Pair")

#: Shares of an error and of the images' norm below which differences of errors and gradients are taken for rounding.
ROUNDING, LEAST = 1e-13, 4e-15


@dataclass(frozen=True)
class Sums:
    error: float
    error_at_y: float
    gradient: float
    change: float
    size: float


class Problem(Protocol[Pair]):
    def begin(self, start: DataFrame) -> Pair: ...

    def step(self, pair: Pair, beta: float, step: float, base: str = "s", keep: str = "x") -> tuple[Pair, Sums]: ...

    def settle(self, pair: Pair) -> Pair:
        """The pair (s, s) of a pair (x, s)."""

    def images(self, pair: Pair) -> DataFrame:
        """s of a pair (x, s)."""


@dataclass
class Run:
    """The images, the error after each iteration, why it ended, and the steps tried in each iteration."""

    images: DataFrame
    errors: list[float]
    ended: str
    steps: list[list[float]] = field(default_factory=list)


def _next(t: float) -> float:
    return 0.5 * (np.sqrt(t**4 + 4 * t**2) - t**2)


def backtracking(problem: Problem, start: DataFrame, iterations: int, step: float, tol: float = 1e-4, xtol: float = 1e-4, early_stop: bool = False, shrink: float = 0.9, within: float | None = None, most: int = 1000) -> Run:
    """A candidate is taken when its error exceeds that at y by no more than half the step times the gradient's sum of
    squares; else it is tried again from there with ``shrink`` times the step. Each iteration begins with ``step`` anew.

    All iterations run, unless ``early_stop`` ends them when error or images change by less than ``tol`` or ``xtol``, as a
    share of themselves.

    With ``within``, steps without momentum follow until the gradient's norm is that or less, or is rounding alone; more than
    ``most`` of them are an error. Where the least curvature is m, the images are then within ``within`` / m of the least.
    """
    pair, t, now = problem.begin(start), 1.0, 1.0
    errors: list[float] = []
    steps: list[list[float]] = []
    near = within is None
    while len(errors) < iterations or not near:
        plain = len(errors) >= iterations
        if len(errors) >= iterations + most:
            raise RuntimeError(f"the gradient's norm is {np.sqrt(sums.gradient)} after {len(errors)} iterations, not {within}")
        tried = [step]
        while True:
            beta, now = now * (1 / t - 1), _next(t)
            pair, sums = problem.step(pair, 0.0 if plain else beta, tried[-1])
            rounding = ROUNDING * abs(sums.error_at_y) if plain else 0.0
            if not sums.error > sums.error_at_y + 0.5 * tried[-1] * sums.gradient + rounding:
                break
            tried.append(tried[-1] * shrink)
        t, pair = now, problem.settle(pair)
        errors.append(sums.error)
        steps.append(tried)
        near = within is None or not np.sqrt(sums.gradient) > max(within, LEAST * np.sqrt(sums.size))
        if early_stop and len(errors) > 1 and abs(errors[-2] - errors[-1]) <= tol * errors[-2]:
            return Run(problem.images(pair), errors, "tol", steps)
        if early_stop and sums.change <= xtol**2 * sums.size:
            return Run(problem.images(pair), errors, "xtol", steps)
    return Run(problem.images(pair), errors, "iterations" if within is None else "within", steps)


def fixed(problem: Problem, start: DataFrame, iterations: int, step: float) -> Run:
    """Steps of one size with momentum. Where the error grows, the iteration is done again from the last iterate without momentum."""
    pair, t, now, before = problem.begin(start), 1.0, 1.0, float("inf")
    errors: list[float] = []
    steps: list[list[float]] = []
    for _ in range(iterations):
        pair, sums = problem.step(pair, now * (1 / t - 1), step, keep="s")
        t, now = now, _next(t)
        steps.append([step])
        if sums.error > before:
            pair, sums = problem.step(pair, 0.0, step, base="x")
            steps[-1].append(step)
        before = sums.error
        errors.append(before)
    return Run(problem.images(pair), errors, "iterations", steps)


class Callables:
    """Minimises ``error`` (a frame of rows to a number) with ``gradient`` (a frame to a frame), which the user gives.

    ``save`` writes a frame to the shared folder and reads it again; its ``drop``, if it has one, removes what no later step reads.
    """

    def __init__(self, gradient: Callable[[DataFrame], DataFrame], error: Callable[[DataFrame], float], save: Callable[[DataFrame, str], DataFrame]) -> None:
        self.gradient, self.error, self.save, self.k = gradient, error, save, 0
        self.known: dict[str, float] = {}

    def begin(self, start: DataFrame) -> tuple:
        return (self._save(start, "start"),) * 2

    def _save(self, df: DataFrame, what: str) -> tuple[DataFrame, str]:
        name = f"{what}{self.k}"
        self.k += 1
        return self.save(df, name), name

    def _drop(self, *names: str) -> None:
        for name in names:
            if hasattr(self.save, "drop"):
                self.save.drop(name)

    def _error(self, x: tuple[DataFrame, str]) -> float:
        if x[1] not in self.known:
            self.known = {**dict(list(self.known.items())[-3:]), x[1]: float(self.error(x[0]))}
        return self.known[x[1]]

    def step(self, pair: tuple, beta: float, step: float, base: str = "s", keep: str = "x") -> tuple:
        x, s = pair
        moved = base == "s" and beta and x is not s
        y = self._save(move(s[0], A.subtract(s[0], x[0]), beta), "y") if moved else x if base == "x" else s
        g = self._save(self.gradient(y[0]), "g")
        c = self._save(move(y[0], g[0], -step), "x")
        total = lambda df: df.agg(A.squares(df)).first()[0] or 0.0
        sums = Sums(self._error(c), self._error(y), total(g[0]), A.squared_difference(c[0], x[0]).first()[0] or 0.0, total(c[0]))
        kept = x if keep == "x" else s
        self._drop(g[1], *([y[1]] if moved else []), *{v[1] for v in pair if v is not kept})
        return (kept, c), sums

    def settle(self, pair: tuple) -> tuple:
        if pair[0] is not pair[1]:
            self._drop(pair[0][1])
        return pair[1], pair[1]

    def images(self, pair: tuple) -> DataFrame:
        return pair[1][0]


def move(a: DataFrame, b: DataFrame, by: float) -> DataFrame:
    """a + b * by."""
    from pyspark.sql import functions as F

    return A.zip_arrays(a, b, lambda x, y: x + y * F.lit(float(by)))
