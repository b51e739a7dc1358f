"""Newton steps for penalised likelihoods, with an optional absolute-value (L1) part."""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np

#: (value, gradient, Hessian) of the smooth part.
Smooth = tuple[float, np.ndarray, np.ndarray]


def damped(hess: np.ndarray) -> np.ndarray:
    """The Hessian, raised on its diagonal until it is positive definite."""
    ridge, eye = 0.0, np.eye(len(hess))
    while True:
        try:
            np.linalg.cholesky(hess + ridge * eye)
            return hess + ridge * eye
        except np.linalg.LinAlgError:
            ridge = max(2 * ridge, 1e-6 * (1 + np.abs(np.diag(hess)).max()))


def quadratic_minimum(theta: np.ndarray, grad: np.ndarray, hess: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Minimum of the local quadratic plus ``l1 * |theta|``, by coordinate descent."""
    if not l1.any():
        return theta - np.linalg.solve(hess, grad)
    out, slope = theta.copy(), grad.copy()  # slope of the quadratic at ``out``
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(out)):
            centre = hess[j, j] * out[j] - slope[j]
            new = np.sign(centre) * max(abs(centre) - l1[j], 0.0) / hess[j, j]
            if new != out[j]:
                slope += hess[:, j] * (new - out[j])
                moved = max(moved, abs(new - out[j]) * np.sqrt(hess[j, j]))
                out[j] = new
        if moved < 1e-12:
            break
    return out


def stationarity(theta: np.ndarray, grad: np.ndarray, l1: np.ndarray) -> float:
    """Largest violation of the optimum conditions; the gradient's norm without an L1 part."""
    at_zero = np.maximum(np.abs(grad) - l1, 0.0)
    return float(np.where(theta == 0, at_zero, np.abs(grad + l1 * np.sign(theta))).max(initial=0.0))


#: Asks for the smooth part at a point; ends with (point, smooth part there, evaluations).
Steps = Generator[np.ndarray, Smooth, tuple[np.ndarray, Smooth, int]]


def newton_steps(theta: np.ndarray, l1: np.ndarray, max_iter: int, tol: float, longest: float) -> Steps:
    """Proximal Newton with backtracking; steps are at most ``longest`` in any coordinate."""
    got, used = (yield theta), 1
    for _ in range(max_iter):
        value, grad, hess = got
        if stationarity(theta, grad, l1) < tol:
            break
        step = quadratic_minimum(theta, grad, damped(hess), l1) - theta
        size = min(1.0, longest / max(np.abs(step).max(), 1e-12))
        before = float(l1 @ np.abs(theta))
        fall = float(grad @ step) + float(l1 @ np.abs(theta + step)) - before
        for _ in range(25):
            trial = theta + size * step
            new = yield trial
            used += 1
            if np.isfinite(new[0]) and new[0] + float(l1 @ np.abs(trial)) <= value + before + 1e-4 * size * fall + 1e-15:
                break
            size /= 2
        else:
            break
        theta, got = trial, new
    return theta, got, used


def minimise_together(
    evaluate: Callable[[dict[int, np.ndarray]], dict[int, Smooth]], runs: dict[int, Steps]
) -> dict[int, tuple[np.ndarray, Smooth, int]]:
    """Several minimisations side by side: ``evaluate`` takes the points of all that still run."""
    found, asked = {}, {k: next(run) for k, run in runs.items()}
    while asked:
        got, asked = evaluate(asked), {}
        for k, smooth in got.items():
            try:
                asked[k] = runs[k].send(smooth)
            except StopIteration as end:
                found[k] = end.value
    return found


def minimise(
    evaluate: Callable[[np.ndarray], Smooth], theta: np.ndarray, l1: np.ndarray, max_iter: int,
    tol: float, longest: float,
) -> tuple[np.ndarray, Smooth, int]:
    steps = newton_steps(theta, l1, max_iter, tol, longest)
    return minimise_together(lambda asked: {0: evaluate(asked[0])}, {0: steps})[0]
