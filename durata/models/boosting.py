"""Boosted trees: logistic loss per horizon, and Cox partial likelihood."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from durata.constants import EVENT, HORIZONS, MONOTONE_SIGNS, TIME
from durata.models.base import HorizonModel, default_features, with_probabilities
from durata.models.trees import (
    MAX_BINS,
    Binning,
    FlatTree,
    FoldBins,
    Grower,
    Rows,
    SplitRules,
    TrainingTable,
    Tree,
    _binary,
    hash_uniform,
    summed,
    training_table,
)
from durata.session import cut_lineage

REFRESH = 10


def monotone_vector(features: list[str], overrides: dict[str, int] | None = None) -> list[int]:
    """Sign per feature; unknown features are unconstrained, overrides win."""
    signs = {**MONOTONE_SIGNS, **(overrides or {})}
    return [int(signs.get(f, 0)) for f in features]


class Margins:
    """The training table with the margins of all finished rounds.

    Each round's trees are added once and the rows kept in memory, so the passes of a round
    read their margins; every ``REFRESH`` rounds a reliable checkpoint cuts the lineage.
    """

    def __init__(self, table: TrainingTable, rate: float, fold_of: list[int]) -> None:
        self.table, self.rate, self.fold_of, self.rounds = table, rate, fold_of, 0
        self.old: list[DataFrame] = []

    def add(self, grown: list[Tree]) -> None:
        table, rate, fold_of = self.table, self.rate, self.fold_of
        decode, names = table.decode(), table.df.columns
        flat = [FlatTree(t) for t in grown]

        def run(batches):
            for b in batches:
                rows = decode(b)
                margin = rows.margin.copy()
                for s, tree in enumerate(flat):
                    margin[:, s] += rate * tree.values(rows.bins(fold_of[s]))
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names[:-1]] + [_binary(margin)], names=names)

        self.release()
        self.rounds += 1
        fresh = table.df.mapInArrow(run, table.df.schema)
        fresh = cut_lineage(fresh) if self.rounds % REFRESH == 0 else fresh.persist()
        self.old.append(table.df)
        self.table = TrainingTable(fresh, table.bins, table.extras, table.slots, table.partitions)

    def release(self) -> None:
        """Frees the tables before the present one; call when the present one has been read."""
        for df in self.old:
            df.unpersist()
        self.old.clear()

    def close(self) -> None:
        self.release()
        self.table.df.unpersist()


@dataclass
class BoostedHorizons(HorizonModel):
    """One boosted binary classifier per horizon, all horizons (and folds) in the same jobs.

    ``growth`` is ``depth`` (level-wise), ``leaf`` (the open leaf of best gain is split next,
    under a leaf budget) or ``oblivious`` (one cut per level).
    """

    n_estimators: int = 300
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 1.0
    growth: str = "depth"
    max_leaves: int = 31
    min_samples_leaf: int = 1
    monotone: dict[str, int] | bool | None = None
    seed: int = 42
    max_bins: int = MAX_BINS
    features: list[str] = field(default_factory=list)
    edges: list[list[float]] = field(default_factory=list)
    base: list[float] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str] | None = None) -> BoostedHorizons:
        fitted = self._fit_slots(df, default_features(df, features), [-1], None)[-1]
        self.__dict__.update(fitted.__dict__)
        return self

    def fit_folds(self, df, features, folds, fold_col="fold"):
        return self._fit_slots(df, default_features(df, features), folds, fold_col)

    def _settings(self) -> dict[str, Any]:
        keep = (
            "n_estimators", "max_depth", "learning_rate", "subsample", "colsample", "reg_lambda",
            "growth", "max_leaves", "min_samples_leaf", "monotone", "seed", "max_bins",
        )
        return {k: getattr(self, k) for k in keep}

    def _fit_slots(self, df, features, folds, fold_col) -> dict[int, BoostedHorizons]:
        labels = {
            f"y{h}": f"case when `{EVENT}` = 1 and `{TIME}` <= {h} then 1 else 0 end" for h in HORIZONS
        }
        fold_sql = f"`{fold_col}`" if fold_col else "-2"
        bins = FoldBins.fit(df, features, folds, fold_sql, self.max_bins)
        slots = [(f, h) for f in folds for h in HORIZONS]
        fold_of = [i for i in range(len(folds)) for _ in HORIZONS]
        means = df.selectExpr(
            *[
                f"avg(case when {fold_sql} <> {f} then {labels[f'y{h}']} end)"
                for f, h in slots
            ]
        ).first()
        rate0 = np.clip(np.array([m or 0.0 for m in means], dtype=float), 1e-6, 1 - 1e-6)
        base = np.log(rate0 / (1 - rate0))
        extras = {**labels, "fold": fold_sql}
        table = training_table(df, bins, extras, len(slots), base)
        signs = None
        if self.monotone:
            overrides = self.monotone if isinstance(self.monotone, dict) else None
            signs = monotone_vector(features, overrides)
        rules = SplitRules(
            self.reg_lambda, self.min_samples_leaf, 2, signs, self.growth, self.max_depth, self.max_leaves
        )
        # one stream per fold, so that a fold's model is what a fit on its rows alone gives
        rngs = [np.random.default_rng(self.seed) for _ in folds]
        done: list[list[Tree]] = [[] for _ in slots]
        state, sub = Margins(table, self.learning_rate, fold_of), self.subsample
        for r in range(self.n_estimators):
            seed = self.seed * 1_000_003 + r

            def gradients(rows: Rows, s: int, seed=seed):
                fold, h = slots[s]
                y = rows.extra[f"y{h}"]
                p = 1.0 / (1.0 + np.exp(-rows.margin[:, s]))
                w = (rows.extra["fold"] != fold).astype(float)
                if sub < 1.0:
                    w *= hash_uniform(rows.ids, seed) < sub
                return (p - y) * w, p * (1 - p) * w, w

            allowed = []
            for s in range(len(slots)):
                mask = np.zeros(len(features), dtype=bool)
                take = max(1, round(self.colsample * len(features)))
                mask[rngs[fold_of[s]].choice(len(features), take, replace=False)] = True
                allowed.append(mask)
            grown = Grower(state.table, gradients, fold_of, rules, allowed).grow()
            for s, t in enumerate(grown):
                done[s].append(t)
            if r + 1 < self.n_estimators:
                state.add(grown)
        state.close()
        out = {}
        for i, f in enumerate(folds):
            part = slice(i * len(HORIZONS), (i + 1) * len(HORIZONS))
            out[f] = BoostedHorizons(
                **self._settings(), features=features, edges=[e.tolist() for e in bins.parts[i].edges],
                base=base[part].tolist(), trees=done[part],
            )
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        binning = Binning(self.features, [np.array(e) for e in self.edges])
        trees, base, lr = [[FlatTree(t) for t in ts] for ts in self.trees], self.base, self.learning_rate

        def fn(x: np.ndarray) -> np.ndarray:
            bins = binning.encode(x)
            f = np.column_stack([base[k] + lr * sum(t.values(bins) for t in trees[k]) + np.zeros(len(x)) for k in range(len(base))])
            return 1.0 / (1.0 + np.exp(-f))

        return with_probabilities(df, self.features, fn)

    def to_json(self) -> str:
        d = {**self._settings(), "features": self.features, "edges": self.edges, "base": self.base}
        return json.dumps({**d, "trees": [[t.to_dict() for t in ts] for ts in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostedHorizons:
        d = json.loads(text)
        d["trees"] = [[Tree.from_dict(t) for t in ts] for ts in d["trees"]]
        return BoostedHorizons(**d)


# --- fixed values: parameter names of other boosting programs and ours ---
ALIASES = {
    "colsample_bytree": "colsample", "iterations": "n_estimators", "depth": "max_depth",
    "l2_leaf_reg": "reg_lambda", "random_state": "seed",
}


def _boosted(defaults: dict[str, Any], given: dict[str, Any]) -> BoostedHorizons:
    """Known settings under either name; others are ignored with a warning."""
    known = {f.name for f in fields(BoostedHorizons)}
    renamed = {ALIASES.get(k, k): v for k, v in given.items()}
    for k in sorted(set(renamed) - known):
        warnings.warn(f"ignored unknown parameter {k}", stacklevel=3)
    return BoostedHorizons(**{**defaults, **{k: v for k, v in renamed.items() if k in known}})


def level_wise_model(**kw: Any) -> BoostedHorizons:
    """Second-order boosting, level-wise, monotone on request."""
    return _boosted({"n_estimators": 300, "max_depth": 6, "reg_lambda": 1.0}, kw)


def leaf_wise_model(**kw: Any) -> BoostedHorizons:
    defaults = {"growth": "leaf", "max_depth": -1, "reg_lambda": 0.0, "min_samples_leaf": 20}
    return _boosted(defaults, kw)


def symmetric_model(**kw: Any) -> BoostedHorizons:
    defaults = {"growth": "oblivious", "max_depth": 6, "reg_lambda": 3.0, "subsample": 1.0, "colsample": 1.0}
    return _boosted(defaults, kw)


@dataclass
class RiskScan:
    """Exact risk sets and cumulative hazard over a table ranged and sorted by time.

    Each partition holds consecutive times. A few numbers per partition and slot give the
    driver what lies before and after it; a time that spans partitions (ties) is put
    together from its parts. Nothing is binned and no row moves.
    """

    folds: list[int]
    after: np.ndarray
    tied_before: np.ndarray
    tied_hits: np.ndarray
    hazard_before: np.ndarray

    def _local(self, rows: Rows, s: int):
        """Relative risk, weighted relative risk and hits, first and last place of equal times."""
        t = rows.extra["t"]
        w = (rows.extra["fold"] != self.folds[s]).astype(float)
        relative = np.exp(rows.margin[:, s])
        return relative, relative * w, rows.extra["e"] * w, np.searchsorted(t, t, "left"), np.searchsorted(t, t, "right")

    def increments(self, rows: Rows, s: int):
        """Per row: relative risk, at-risk sum of its time, hazard that its hit adds, last place."""
        part, t = int(rows.extra["part"][0]), rows.extra["t"]
        relative, r, hits, first, last = self._local(rows, s)
        before = np.concatenate([[0.0], np.cumsum(r)])
        at_risk = self.after[part, s] + before[-1] - before[first]
        at_risk += np.where(t == t[0], self.tied_before[part, s], 0.0)
        step = np.divide(hits, at_risk, out=np.zeros_like(hits), where=at_risk > 0)
        return relative, at_risk, step, last

    def cumulative(self, rows: Rows, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Relative risk and cumulative hazard at every row's time."""
        part, t = int(rows.extra["part"][0]), rows.extra["t"]
        relative, at_risk, step, last = self.increments(rows, s)
        total = self.hazard_before[part, s] + np.cumsum(step)[last - 1]
        late = np.divide(self.tied_hits[part, s], at_risk, out=np.zeros_like(at_risk), where=at_risk > 0)
        return relative, total + np.where(t == t[-1], late, 0.0)

    @staticmethod
    def over(table: TrainingTable, folds: list[int]) -> RiskScan:
        n, ns = table.partitions, len(folds)
        zero = np.zeros((n, ns))
        scan = RiskScan(folds, zero, zero, zero, zero)

        def edges(rows: Rows) -> np.ndarray:
            out = np.zeros((n, 3 + 4 * ns))
            part, t = int(rows.extra["part"][0]), rows.extra["t"]
            out[part, :3] = 1.0, t[0], t[-1]
            for s in range(ns):
                _, r, hits, _, _ = scan._local(rows, s)
                low, high = t == t[0], t == t[-1]
                out[part, 3 + 4 * s : 7 + 4 * s] = r.sum(), r[low].sum(), r[high].sum(), hits[low].sum()
            return out

        got = summed(table, edges, n, 3 + 4 * ns, whole=True)
        used = np.flatnonzero(got[:, 0])
        low, high = got[used, 1], got[used, 2]
        risk, _, risk_high, hits_low = (got[used][:, 3 + k :: 4] for k in range(4))
        after, tied, later = (np.zeros((n, ns)) for _ in range(3))
        after[used] = np.cumsum(risk[::-1], axis=0)[::-1] - risk
        # partitions that end in one time are consecutive, and so are those that begin in it
        ends = np.concatenate([np.zeros((1, ns)), np.cumsum(risk_high, axis=0)])
        starts = np.concatenate([np.zeros((1, ns)), np.cumsum(hits_low, axis=0)])
        place = np.arange(len(used))
        tied[used] = ends[place] - ends[np.minimum(np.searchsorted(high, low, "left"), place)]
        later[used] = starts[np.maximum(np.searchsorted(low, high, "right"), place + 1)] - starts[place + 1]
        scan = RiskScan(folds, after, tied, later, zero)

        def hazards(rows: Rows) -> np.ndarray:
            out = np.zeros((n, ns))
            for s in range(ns):
                out[int(rows.extra["part"][0]), s] = scan.increments(rows, s)[2].sum()
            return out

        got = summed(table, hazards, n, ns, whole=True)
        scan.hazard_before = np.cumsum(got, axis=0) - got
        return scan

    def at(self, table: TrainingTable, times: tuple[int, ...]) -> np.ndarray:
        """(slots, times): cumulative hazard at fixed times."""
        ns = len(self.folds)

        def fn(rows: Rows) -> np.ndarray:
            out = np.zeros((ns, len(times)))
            for s in range(ns):
                step = self.increments(rows, s)[2]
                out[s] = [step[rows.extra["t"] <= h].sum() for h in times]
            return out

        return summed(table, fn, ns, len(times), whole=True)


@dataclass
class BoostedSurvival(HorizonModel):
    """Gradient boosting of the Cox partial likelihood (Breslow ties) with exact risk sets.

    Trees are fitted to martingale residuals; the risk sets of a round come from a scan over
    the time-sorted partitions, see ``RiskScan``.
    """

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    subsample: float = 1.0
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    seed: int = 42
    max_bins: int = MAX_BINS
    features: list[str] = field(default_factory=list)
    edges: list[list[float]] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    hazard: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str] | None = None) -> BoostedSurvival:
        fitted = self._fit_slots(df, default_features(df, features), [-1], None)[-1]
        self.__dict__.update(fitted.__dict__)
        return self

    def fit_folds(self, df, features, folds, fold_col="fold"):
        return self._fit_slots(df, default_features(df, features), folds, fold_col)

    def _settings(self) -> dict[str, Any]:
        keep = (
            "n_estimators", "learning_rate", "max_depth", "subsample", "min_samples_split",
            "min_samples_leaf", "seed", "max_bins",
        )
        return {k: getattr(self, k) for k in keep}

    def _fit_slots(self, df, features, folds, fold_col) -> dict[int, BoostedSurvival]:
        fold_sql = f"`{fold_col}`" if fold_col else "-2"
        bins = FoldBins.fit(df, features, folds, fold_sql, self.max_bins)
        ns = len(folds)
        extras = {"t": f"`{TIME}`", "e": f"`{EVENT}`", "fold": fold_sql}
        table = training_table(df, bins, extras, ns, order="t")
        rules = SplitRules(
            0.0, self.min_samples_leaf, self.min_samples_split, None, "depth", self.max_depth
        )
        sub, fold_of = self.subsample, list(range(ns))
        done: list[list[Tree]] = [[] for _ in folds]
        state = Margins(table, self.learning_rate, fold_of)
        allowed = [np.ones(len(features), dtype=bool)] * ns
        for r in range(self.n_estimators):
            scan = RiskScan.over(state.table, folds)
            seed = self.seed * 1_000_003 + r

            def gradients(rows: Rows, s: int, scan=scan, seed=seed):
                relative, hazard = scan.cumulative(rows, s)
                w = (rows.extra["fold"] != folds[s]).astype(float)
                if sub < 1.0:
                    w *= hash_uniform(rows.ids, seed) < sub
                return -(rows.extra["e"] - relative * hazard) * w, w, w

            grown = Grower(state.table, gradients, fold_of, rules, allowed, whole=True).grow()
            for s, t in enumerate(grown):
                done[s].append(t)
            state.add(grown)
        hazard = RiskScan.over(state.table, folds).at(state.table, HORIZONS)
        state.close()
        return {
            f: BoostedSurvival(
                **self._settings(), features=features, edges=[e.tolist() for e in bins.parts[i].edges],
                trees=done[i], hazard=hazard[i].tolist(),
            )
            for i, f in enumerate(folds)
        }

    def predict(self, df: DataFrame) -> DataFrame:
        binning = Binning(self.features, [np.array(e) for e in self.edges])
        trees, lr, hazard = [FlatTree(t) for t in self.trees], self.learning_rate, np.array(self.hazard)

        def fn(x: np.ndarray) -> np.ndarray:
            bins = binning.encode(x)
            relative = np.exp(lr * sum(t.values(bins) for t in trees) + np.zeros(len(x)))
            return 1.0 - np.exp(-relative[:, None] * hazard[None, :])

        return with_probabilities(df, self.features, fn)

    def to_json(self) -> str:
        d = asdict(self)
        d["trees"] = [t.to_dict() for t in self.trees]
        return json.dumps(d)

    @staticmethod
    def from_json(text: str) -> BoostedSurvival:
        d = json.loads(text)
        d["trees"] = [Tree.from_dict(t) for t in d["trees"]]
        return BoostedSurvival(**d)
