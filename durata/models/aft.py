"""Accelerated failure time models (Weibull, log-normal) by penalised Newton steps.

Each step is one narrow pass: tasks return the summed log-likelihood, gradient and
curvature of their rows, a vector whose length depends only on the number of features.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, TIME
from durata.functions.columns import nn
from durata.functions.impute import MedianImputer, Standardizer
from durata.functions.labels import positive_time
from durata.models.base import HorizonModel, default_features, with_probabilities
from durata.models.newton import minimise, minimise_together, newton_steps, stationarity
from durata.operators.partials import partition_sums
from durata.operators.quantiles import exact_quantiles


def erfc_scaled(x: np.ndarray) -> np.ndarray:
    """exp(x^2) * erfc(x) for x >= 0: a series below 2.5, a continued fraction above."""
    small = np.minimum(x, 2.5)
    term = small.copy()
    total = small.copy()
    for k in range(1, 70):
        term = term * (2 * small * small) / (2 * k + 1)
        total += term
    near = np.exp(small * small) - 2.0 / math.sqrt(math.pi) * total
    large = np.maximum(x, 2.5)
    frac = np.zeros_like(large)
    for k in range(80, 0, -1):
        frac = (k / 2.0) / (large + frac)
    far = 1.0 / (math.sqrt(math.pi) * (large + frac))
    return np.where(x < 2.5, near, far)


def normal_upper(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the upper normal tail, hazard pdf / tail), accurate far into both tails."""
    x = w / math.sqrt(2.0)
    scaled = erfc_scaled(np.abs(x))
    decay = np.exp(-x * x)
    log_right = np.log(0.5 * scaled) - x * x
    with np.errstate(divide="ignore"):
        log_left = np.log1p(-0.5 * scaled * decay)
    log_sf = np.where(x >= 0, log_right, log_left)
    log_pdf = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
    return log_sf, np.exp(log_pdf - log_sf)


def _weibull_terms(w: np.ndarray, e: np.ndarray, sigma: float):
    """Log-likelihood with first and second derivatives in (location, log scale)."""
    # far below, exp(w) is zero anyway; far above, the value is infinite and the step is cut
    with np.errstate(over="ignore"):
        ew = np.exp(w)
    ll = e * (w - math.log(sigma)) - ew
    g_mu, g_s = (ew - e) / sigma, w * ew - e * (w + 1)
    h_mm, h_ms = -ew / sigma**2, (e - ew * (1 + w)) / sigma
    return ll, g_mu, g_s, h_mm, h_ms, e * w - w * ew * (1 + w)


def _lognormal_terms(w: np.ndarray, e: np.ndarray, sigma: float):
    log_sf, lam = normal_upper(w)
    c = 1 - e
    curve = lam * (lam - w)
    ll = e * (-0.5 * w * w - math.log(sigma)) + c * log_sf
    lin = e * w + c * lam
    g_mu, g_s = lin / sigma, e * (w * w - 1) + c * lam * w
    weight = e + c * curve
    h_mm, h_ms = -weight / sigma**2, -(lin + w * weight) / sigma
    return ll, g_mu, g_s, h_mm, h_ms, -2 * e * w * w - c * (w * w * curve + lam * w)


def likelihood_sums(
    terms: Callable, z: np.ndarray, t: np.ndarray, e: np.ndarray, theta: np.ndarray
) -> np.ndarray:
    """Summed log-likelihood, gradient and Hessian of rows with scaled features and log time."""
    q = len(theta)
    x = np.column_stack([np.ones(len(z)), z])
    sigma = math.exp(theta[-1])
    ll, g_mu, g_s, h_mm, h_ms, h_ss = terms((t - x @ theta[:-1]) / sigma, e, sigma)
    hess = np.zeros((q, q))
    hess[:-1, :-1] = x.T @ (x * h_mm[:, None])
    hess[:-1, -1] = hess[-1, :-1] = x.T @ h_ms
    hess[-1, -1] = h_ss.sum()
    return np.concatenate([[ll.sum()], x.T @ g_mu, [g_s.sum()], hess.ravel()])


def pooled(moments: dict[float, np.ndarray], fold: int, fill: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and standard deviations of all folds but ``fold``; ``fill`` stands for missing
    values (NaN: they are left out)."""
    parts = [m for f, m in moments.items() if f != fold]
    rows = np.array([m[0] for m in parts])
    known, mean, var = (np.array([m[1 + i :: 3] for m in parts]) for i in range(3))
    n = np.vstack([known, np.where(np.isnan(fill), 0.0, (rows[:, None] - known).sum(axis=0))])
    mean = np.vstack([mean, fill])
    var = np.vstack([var, np.zeros(len(fill))])
    mean, var = np.where(n > 0, mean, 0.0), np.where(n > 0, var, 0.0)
    total = np.maximum(n.sum(axis=0), 1.0)
    centre = (n * mean).sum(axis=0) / total
    spread = (n * (var + (mean - centre) ** 2)).sum(axis=0) / total
    return float(rows.sum()), centre, np.sqrt(spread)


@dataclass
class AFTModel(HorizonModel):
    """log T = intercept + z.beta + sigma * error; the penalty, split between squares and
    absolute values by ``l1_ratio``, is on beta only."""

    distribution: str = "weibull"
    penalizer: float = 0.01
    max_iter: int = 50
    tol: float = 1e-7
    features: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    params: list[float] = field(default_factory=list)
    gradient_norm: float = float("nan")
    l1_ratio: float = 0.0
    evaluations: int = 0

    def fit(self, df: DataFrame, features: list[str] | None = None) -> AFTModel:
        self.features = default_features(df, features)
        imputer = MedianImputer(self.features).fit(df)
        self.medians = imputer.medians
        filled = imputer.transform(df.select(*self.features, TIME, EVENT))
        scaler = Standardizer(self.features).fit(filled)
        self.mean = [scaler.mean[c] for c in self.features]
        self.scale = [scaler.scale[c] for c in self.features]
        rows = (
            scaler.transform(filled)
            .withColumns({"__t": F.ln(positive_time()), "__e": F.col(EVENT).cast("double")})
            .select(*self.features, "__t", "__e")
            .persist()
        )
        n, mean_log, spread = rows.selectExpr("count(*)", "avg(__t)", "stddev_pop(__t)").first()
        theta, l1 = self._start(mean_log, spread)
        found = minimise(lambda x: self._evaluate(rows, x, n), theta, l1, self.max_iter, self.tol, 3.0)
        rows.unpersist()
        return self._fitted(found, l1)

    def fit_folds(
        self, df: DataFrame, features: list[str] | None, folds: list[int], fold_col: str = "fold"
    ) -> dict[int, AFTModel]:
        """One model per fold, trained on the other folds; all folds share every pass, and no
        fold has a copy of its rows."""
        names = default_features(df, features)
        models = {f: copy.deepcopy(self) for f in folds}
        # each fold's columns over the rows of the others
        train = {(f, c): F.when(F.col(fold_col) != f, nn(c)) for f in folds for c in names}
        medians = exact_quantiles(df, train, [0.5])
        fold = F.col(fold_col).cast("double")
        rows = df.where(f"`{fold_col}` is not null").select(
            *[nn(c).alias(c) for c in names], F.ln(positive_time()).alias("__t"),
            F.col(EVENT).cast("double").alias("__e"), fold.alias("__f"),
        )
        if not df.is_cached:
            rows = rows.persist()
        moments = self._moments(rows, names)
        size, starts, l1 = {}, {}, np.zeros(0)
        for f, m in models.items():
            m.features = names
            m.medians = {c: float(medians[f, c][0] or 0.0) for c in names}
            size[f], mean, spread = pooled(moments, f, np.array([*m.medians.values(), np.nan]))
            if not size[f]:
                raise ValueError(f"no rows outside fold {f}")
            m.mean = mean[:-1].tolist()
            scale = np.where(spread[:-1] > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])), spread[:-1], 1.0)
            m.scale = scale.tolist()
            theta, l1 = m._start(mean[-1], spread[-1])
            starts[f] = newton_steps(theta, l1, self.max_iter, self.tol, 3.0)

        def evaluate(asked: dict[int, np.ndarray]):
            q = len(names) + 2
            wide = 1 + q + q * q
            held = {f: (np.array([models[f].medians[c] for c in names]), np.array(models[f].mean), np.array(models[f].scale)) for f in asked}
            terms = self._terms()

            def fn(m: np.ndarray) -> np.ndarray:
                out = np.zeros(len(asked) * wide)
                missing = np.isnan(m[:, :-3])
                for i, (f, theta) in enumerate(asked.items()):
                    med, mean, scale = held[f]
                    rest = m[:, -1] != f
                    z = (np.where(missing, med, m[:, :-3])[rest] - mean) / scale
                    out[i * wide : (i + 1) * wide] = likelihood_sums(terms, z, m[rest, -3], m[rest, -2], theta)
                return out

            sums = partition_sums(rows, fn, len(asked) * wide)
            return {
                f: self._smooth(sums[i * wide : (i + 1) * wide], theta, size[f])
                for i, (f, theta) in enumerate(asked.items())
            }

        found = minimise_together(evaluate, starts)
        if not df.is_cached:
            rows.unpersist()
        return {f: m._fitted(found[f], l1) for f, m in models.items()}

    @staticmethod
    def _moments(rows: DataFrame, names: list[str]) -> dict[float, np.ndarray]:
        """Per fold: rows, then known values, mean and variance of every feature and of ``__t``."""
        aggs = [
            e for c in [*names, "__t"]
            for e in (F.count(c).cast("double"), F.avg(c), F.var_pop(c))
        ]
        found = rows.groupBy("__f").agg(F.count("*").cast("double"), *aggs).collect()
        return {r[0]: np.array([np.nan if v is None else v for v in r[1:]]) for r in found}

    def _start(self, mean_log: float, spread: float | None) -> tuple[np.ndarray, np.ndarray]:
        """First parameters and the weights of the absolute values."""
        q = len(self.features) + 2
        theta, l1 = np.zeros(q), np.zeros(q)
        theta[0], theta[-1] = mean_log + 0.5, math.log(max(spread or 1.0, 1e-3))
        l1[1:-1] = self.penalizer * self.l1_ratio
        return theta, l1

    def _fitted(self, found: tuple, l1: np.ndarray) -> AFTModel:
        theta, (_, grad, _), self.evaluations = found
        self.params, self.gradient_norm = theta.tolist(), stationarity(theta, grad, l1)
        return self

    def _terms(self) -> Callable:
        return _weibull_terms if self.distribution == "weibull" else _lognormal_terms

    def _evaluate(self, rows: DataFrame, theta: np.ndarray, n: int):
        """Mean negative penalised log-likelihood, gradient and Hessian."""
        q, terms = len(theta), self._terms()

        def fn(m: np.ndarray) -> np.ndarray:
            return likelihood_sums(terms, m[:, :-2], m[:, -2], m[:, -1], theta)

        return self._smooth(partition_sums(rows, fn, 1 + q + q * q), theta, n)

    def _smooth(self, out: np.ndarray, theta: np.ndarray, n: float):
        q = len(theta)
        ridge = np.zeros(q)
        ridge[1:-1] = self.penalizer * (1 - self.l1_ratio)
        value = -out[0] / n + 0.5 * float((ridge * theta * theta).sum())
        grad = -out[1 : 1 + q] / n + ridge * theta
        return value, grad, -out[1 + q :].reshape(q, q) / n + np.diag(ridge)

    def predict(self, df: DataFrame) -> DataFrame:
        medians = np.array([self.medians[c] for c in self.features])
        mean, scale, theta = np.array(self.mean), np.array(self.scale), np.array(self.params)
        weibull = self.distribution == "weibull"

        def fn(x: np.ndarray) -> np.ndarray:
            z = (np.where(np.isnan(x), medians, x) - mean) / scale
            location = theta[0] + z @ theta[1:-1]
            logs = np.log(np.array(HORIZONS, dtype=float))
            w = (logs[None, :] - location[:, None]) / math.exp(theta[-1])
            log_sf = -np.exp(np.clip(w, -700, 700)) if weibull else normal_upper(w)[0]
            return 1.0 - np.exp(log_sf)

        return with_probabilities(df, self.features, fn)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> AFTModel:
        return AFTModel(**json.loads(text))


def weibull_model(penalizer: float = 0.01, l1_ratio: float = 0.0) -> AFTModel:
    return AFTModel("weibull", penalizer, l1_ratio=l1_ratio)


def lognormal_model(penalizer: float = 0.01, l1_ratio: float = 0.0) -> AFTModel:
    return AFTModel("lognormal", penalizer, l1_ratio=l1_ratio)
