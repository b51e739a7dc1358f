"""Cox proportional hazards with Efron ties, by Newton steps over time-sorted partitions.

Rows are ranged by time over the partitions and sorted once. An evaluation is three narrow
passes that move no row: sums per partition (what is at risk after it), the weights that its
hit times add up to (what lies before it), and value, gradient and information matrix. The
information needs no sums of products over risk sets: the weights of all times up to a row's
own multiply that row's product. A time that spans partitions is put together on the driver
from its parts, at most two such times a partition, so a time shared by a third of all rows
is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, ID, TIME
from durata.functions.impute import MedianImputer, Standardizer
from durata.models.base import HorizonModel, default_features, with_probabilities
from durata.models.newton import Smooth, minimise, stationarity
from durata.models.trees import pass_partitions, summed
from durata.operators.partials import batch_matrix

TERMS = 1_000_000  # tied hits summed at once


def efron_weights(s0: np.ndarray, d0: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Per time: sums over its d tied hits of log s, 1/s, q/s, 1/s^2, q/s^2, q^2/s^2.

    s = s0 - q * d0 is what is at risk when the share q = 0, 1/d, .. of the tied hits left.
    """
    out = np.zeros((len(d), 6))
    single = d == 1
    one = s0[single]
    out[single, 0], out[single, 1], out[single, 3] = np.log(one), 1 / one, 1 / one**2
    for i in np.flatnonzero(d > 1):
        for start in range(0, int(d[i]), TERMS):
            q = np.arange(start, min(start + TERMS, int(d[i]))) / d[i]
            s = s0[i] - q * d0[i]
            w = 1 / s
            out[i] += np.log(s).sum(), w.sum(), (q * w).sum(), (w * w).sum(), (q * w * w).sum(), (q * q * w * w).sum()
    return out


class TimeSorted:
    """Standardised rows ranged and sorted by time, with the passes of one evaluation."""

    def __init__(self, df: DataFrame, p: int) -> None:
        parts = pass_partitions(df)
        # the row key spreads a time shared by many rows over several partitions
        self.df = df.repartitionByRange(parts, "t", "key").sortWithinPartitions("t").persist()
        self.p, self.partitions = p, self.df.rdd.getNumPartitions()

    def decode(self):
        names = [f"z{k}" for k in range(self.p)]

        def read(batch: pa.RecordBatch) -> SimpleNamespace:
            t = batch.column("t").to_numpy(zero_copy_only=False)
            e = batch.column("e").to_numpy(zero_copy_only=False)
            return SimpleNamespace(ids=t, extra={"t": t, "e": e}, z=batch_matrix(batch, names))

        return read

    @staticmethod
    def groups(rows: SimpleNamespace, beta: np.ndarray):
        """Sums over equal times: (times, 1 + p) at risk, the same of hits, hits, and places."""
        t, start = np.unique(rows.extra["t"], return_index=True)
        r = np.exp(rows.z @ beta)
        x = np.column_stack([r, rows.z * r[:, None]])
        e = rows.extra["e"]
        return t, start, r, np.add.reduceat(x, start), np.add.reduceat(x * e[:, None], start), np.add.reduceat(e, start)

    def evaluate(self, beta: np.ndarray, event_sum: np.ndarray, n: int) -> Smooth:
        """Mean negative log partial likelihood, its gradient and Hessian."""
        p, parts, groups = self.p, self.partitions, self.groups
        w = 1 + p

        def edges(rows: SimpleNamespace) -> np.ndarray:
            out = np.zeros((parts, 3 + 5 * w + 2))
            t, _, _, x, xd, d = groups(rows, beta)
            out[rows.extra["part"][0]] = np.concatenate([
                [1.0, t[0], t[-1]], x.sum(axis=0), x[0], xd[0], x[-1], xd[-1], [d[0], d[-1]]
            ])
            return out

        got = summed(self, edges, parts, 3 + 5 * w + 2, whole=True)
        used = np.flatnonzero(got[:, 0])
        low, high = got[used, 1], got[used, 2]
        total, first, first_d, last, last_d = (got[used][:, 3 + k * w : 3 + (k + 1) * w] for k in range(5))
        hits_first, hits_last = got[used, -2], got[used, -1]
        after = np.zeros((parts, w))
        after[used] = np.cumsum(total[::-1], axis=0)[::-1] - total
        # times at partition edges: at-risk sums from the first partition that has them
        border: dict[float, list[np.ndarray]] = {}
        for i, part in enumerate(used):
            ends = [(low[i], first[i], first_d[i], hits_first[i])]
            if high[i] != low[i]:
                ends.append((high[i], last[i], last_d[i], hits_last[i]))
            for t, x, xd, d in ends:
                here = border.setdefault(t, [np.zeros(w), np.zeros(w), 0.0, np.zeros(w)])
                here[0], here[1], here[2] = here[0] + x, here[1] + xd, here[2] + d
                here[3] = after[part] if t == high[i] else after[part] + total[i] - x
        names = sorted(border)
        s = np.array([border[t][0] + border[t][3] for t in names])
        sd = np.array([border[t][1] for t in names])
        weights = efron_weights(s[:, 0], sd[:, 0], np.array([border[t][2] for t in names]))
        a_of, b_of = dict(zip(names, weights[:, 1], strict=True)), dict(zip(names, weights[:, 2], strict=True))

        def inner(rows: SimpleNamespace):
            """Sums and weights of the times that lie within one partition."""
            t, start, r, x, xd, d = groups(rows, beta)
            at_risk = after[rows.extra["part"][0]] + np.cumsum(x[::-1], axis=0)[::-1]
            mine = (t != t[0]) & (t != t[-1])
            weight = np.zeros((len(t), 6))
            weight[mine] = efron_weights(at_risk[mine, 0], xd[mine, 0], d[mine])
            return t, start, r, at_risk, xd, weight

        def before(rows: SimpleNamespace) -> np.ndarray:
            out = np.zeros((parts, 1))
            out[rows.extra["part"][0], 0] = inner(rows)[5][:, 1].sum()
            return out

        a = summed(self, before, parts, 1, whole=True)[:, 0]
        a_before = np.cumsum(a) - a
        border_t = np.array(names)
        border_a = np.concatenate([[0.0], np.cumsum(weights[:, 1])])

        def sums(rows: SimpleNamespace) -> np.ndarray:
            t, start, r, at_risk, xd, weight = inner(rows)
            place = np.repeat(np.arange(len(t)), np.diff([*start, len(r)]))
            # weights of all times up to the row's own
            upto = a_before[rows.extra["part"][0]] + np.cumsum(weight[:, 1]) + border_a[np.searchsorted(border_t, t, "right")]
            b = weight[:, 2] + np.array([b_of.get(x, 0.0) for x in t])
            factor = r * (upto[place] - rows.extra["e"] * b[place])
            hess = rows.z.T @ (rows.z * factor[:, None])
            s1, d1 = at_risk[:, 1:], xd[:, 1:]
            cross = s1.T @ (d1 * weight[:, 4:5])
            hess -= s1.T @ (s1 * weight[:, 3:4]) - cross - cross.T + d1.T @ (d1 * weight[:, 5:6])
            eta = float((rows.z @ beta) @ rows.extra["e"])
            return np.concatenate([[eta - weight[:, 0].sum()], rows.z.T @ factor, hess.ravel()])

        out = summed(self, sums, 1, 1 + p + p * p, whole=True)[0]
        s1, d1 = s[:, 1:], sd[:, 1:]
        cross = s1.T @ (d1 * weights[:, 4:5])
        hess = out[1 + p :].reshape(p, p) - (s1.T @ (s1 * weights[:, 3:4]) - cross - cross.T + d1.T @ (d1 * weights[:, 5:6]))
        value = out[0] - weights[:, 0].sum()
        if not np.isfinite(value):
            return float("inf"), np.zeros(p), np.eye(p)
        return float(-value / n), (out[1 : 1 + p] - event_sum) / n, hess / n

    def hazard(self, beta: np.ndarray) -> list[float]:
        """Breslow cumulative hazard at the horizons."""
        parts, groups = self.partitions, self.groups

        def edges(rows: SimpleNamespace) -> np.ndarray:
            out = np.zeros((parts, 6))
            t, _, _, x, _, d = groups(rows, beta)
            out[rows.extra["part"][0]] = 1.0, t[0], x[:, 0].sum(), x[-1, 0], t[-1], d[0]
            return out

        got = summed(self, edges, parts, 6, whole=True)
        used = np.flatnonzero(got[:, 0])
        after, tied = np.zeros(parts), np.zeros(parts)
        after[used] = np.cumsum(got[used, 2][::-1])[::-1] - got[used, 2]
        high, ends = got[used, 4], np.concatenate([[0.0], np.cumsum(got[used, 3])])
        place = np.arange(len(used))
        tied[used] = ends[place] - ends[np.minimum(np.searchsorted(high, got[used, 1], "left"), place)]

        def steps(rows: SimpleNamespace) -> np.ndarray:
            part = rows.extra["part"][0]
            t, _, _, x, _, d = groups(rows, beta)
            at_risk = after[part] + np.cumsum(x[::-1, 0])[::-1] + np.where(t == t[0], tied[part], 0.0)
            return np.array([(d / at_risk)[t <= h].sum() for h in HORIZONS])

        return summed(self, steps, 1, len(HORIZONS), whole=True)[0].tolist()


@dataclass
class CoxModel(HorizonModel):
    """``penalizer * ((1 - l1_ratio) / 2 * |beta|^2 + l1_ratio * |beta|_1)`` is added to the
    mean negative log partial likelihood of standardised features."""

    penalizer: float = 0.1
    max_iter: int = 40
    tol: float = 1e-6
    features: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)
    hazard: list[float] = field(default_factory=list)
    gradient_norm: float = float("nan")
    log_likelihood: float = float("nan")
    l1_ratio: float = 0.0
    evaluations: int = 0

    def fit(self, df: DataFrame, features: list[str] | None = None) -> CoxModel:
        self.features = default_features(df, features)
        rows = self._prepare(df)
        p = len(self.features)
        n, *events = rows.selectExpr("count(*)", *[f"coalesce(sum(e * z{k}), 0D)" for k in range(p)]).first()
        event_sum = np.array(events, dtype=float)
        table = TimeSorted(rows, p)
        ridge, l1 = self.penalizer * (1 - self.l1_ratio), np.full(p, self.penalizer * self.l1_ratio)

        def smooth(beta: np.ndarray) -> Smooth:
            value, grad, hess = table.evaluate(beta, event_sum, n)
            return value + 0.5 * ridge * float(beta @ beta), grad + ridge * beta, hess + (ridge + 1e-12) * np.eye(p)

        beta, (value, grad, _), self.evaluations = minimise(smooth, np.zeros(p), l1, self.max_iter, self.tol, 5.0)
        self.coef, self.gradient_norm = beta.tolist(), stationarity(beta, grad, l1)
        self.log_likelihood = float(-n * (value - 0.5 * ridge * beta @ beta))
        self.hazard = table.hazard(beta)
        table.df.unpersist()
        return self

    def _prepare(self, df: DataFrame) -> DataFrame:
        imputer = MedianImputer(self.features).fit(df)
        self.medians = imputer.medians
        key = [ID] if ID in df.columns else []
        filled = imputer.transform(df.select(*dict.fromkeys([*self.features, TIME, EVENT, *key])))
        scaler = Standardizer(self.features).fit(filled)
        self.mean = [scaler.mean[c] for c in self.features]
        self.scale = [scaler.scale[c] for c in self.features]
        z = scaler.transform(filled)
        return z.select(
            *[F.col(c).alias(f"z{k}") for k, c in enumerate(self.features)],
            F.col(TIME).cast("double").alias("t"), F.col(EVENT).cast("double").alias("e"),
            F.xxhash64(*(key or self.features)).alias("key"),
        ).where("t is not null and e is not null")

    def predict(self, df: DataFrame) -> DataFrame:
        medians = np.array([self.medians[c] for c in self.features])
        mean, scale = np.array(self.mean), np.array(self.scale)
        beta, hazard = np.array(self.coef), np.array(self.hazard)

        def fn(x: np.ndarray) -> np.ndarray:
            z = (np.where(np.isnan(x), medians, x) - mean) / scale
            relative = np.exp(np.clip(z @ beta, -700, 700))
            return 1.0 - np.exp(-relative[:, None] * hazard[None, :])

        return with_probabilities(df, self.features, fn)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> CoxModel:
        return CoxModel(**json.loads(text))
