"""Random survival forest: log-rank splits, trees of any depth, all trees grown together."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, HORIZONS, TIME
from durata.models.base import HorizonModel, default_features, with_probabilities
from durata.models.trees import (
    EPS,
    JOB_CELLS,
    SKETCH,
    Binning,
    FlatTree,
    FoldBins,
    Rows,
    TrainingTable,
    Tree,
    hash_uniform,
    leading,
    summed,
    training_table,
)
from durata.session import spent_shuffles_go

#: Rows of a node from which on the whole subtree below it is grown in one task.
NODE_ROWS = 500_000
#: Rows that are dealt to such tasks in one job, over all trees.
DEALT_ROWS = 40_000_000
#: Rows up to which a node's cuts are scored from its rows, in classes of these sizes; beyond, from histograms.
SIZES = (4, 8, 16, 32)
#: Numbers in an array that the nodes of a level are worked through with: what a core's cache holds.
CELLS = 50_000


def poisson_weight(ids: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) bootstrap count of a row in one tree, from its id."""
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cumulative, hash_uniform(ids, seed), "right").astype(float)


def time_edges(df: DataFrame, bins: int, folds: list[int], fold_sql: str) -> list[np.ndarray]:
    """Upper ends of the time bins of every fold: its own hit-time quantiles and the horizons."""
    probs = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])
    hits = F.when(F.col(EVENT) == 1, F.nanvl(F.col(TIME).cast("double"), F.lit(None)))
    row = df.agg(*[
        F.percentile_approx(F.when(F.expr(f"{fold_sql} <> {f}"), hits), probs, SKETCH) for f in folds
    ]).first()
    return [np.unique(np.array([*(x or []), *map(float, HORIZONS)])) for x in row]


def children(key: int) -> tuple[int, int]:
    """Keys of a node's children; keys seed the choice of features, whatever the depth."""
    a, b = children_of(np.array([key], dtype=np.uint64))
    return int(a[0]), int(b[0])


def children_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        z = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        z ^= z >> np.uint64(31)
        return z * np.uint64(0xBF58476D1CE4E5B9), z * np.uint64(0x94D049BB133111EB) + np.uint64(7)


def logrank(hits_left: np.ndarray, risk_left: np.ndarray, hits: np.ndarray, risk: np.ndarray) -> np.ndarray:
    """(O - E)^2 / V of the left side over the last axis (times); zero without variance."""
    safe = np.maximum(risk, 1.0)
    share = risk_left / safe
    observed = (hits_left - hits * share).sum(axis=-1)
    spread = hits * share * (1 - share) * (risk - hits) / np.maximum(risk - 1, 1.0)
    variance = np.where(risk > 1, spread, 0.0).sum(axis=-1)
    return np.divide(observed**2, variance, out=np.zeros_like(observed), where=variance > EPS)


def survival_at(hits: np.ndarray, risk: np.ndarray, at: list[int]) -> np.ndarray:
    """Product-limit survival at time bins, from hits and rows at risk per bin."""
    ratio = np.divide(hits, risk, out=np.zeros_like(risk), where=risk > 0)
    return np.cumprod(1.0 - np.minimum(ratio, 1.0), axis=-1)[..., at]


@dataclass
class Leaves:
    """Rules and random choices that are the same in every task."""

    p: int
    bins: int
    times: list[np.ndarray]
    min_split: float
    min_leaf: float
    max_depth: int | None

    def picked(self, seed: int, key: int) -> np.ndarray:
        """The features that a node may split on, in ascending order."""
        return self.picked_of(seed, np.array([key], dtype=np.uint64))[0]

    def picked_of(self, seed: int, keys: np.ndarray) -> np.ndarray:
        """The same for many nodes: the features of lowest hash."""
        with np.errstate(over="ignore"):
            places = np.arange(1, self.p + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            drawn = hash_uniform((keys[:, None] ^ places[None, :]).ravel(), seed).reshape(len(keys), self.p)
        return np.sort(np.argsort(drawn, axis=1, kind="stable")[:, : max(1, int(math.sqrt(self.p)))], axis=1)

    def horizons(self, fold: int) -> list[int]:
        return [int(np.searchsorted(self.times[fold], float(h), "left")) for h in HORIZONS]

    def subtree(self, bins, w, tb, e, fold: int, seed: int, key: int, depth: int) -> dict[str, np.ndarray]:
        """The whole tree below one node, from its rows: an array per field of ``Tree``.

        Grown level by level, the nodes of a level together; rows lie sorted by their node.
        """
        nt = len(self.times[fold]) + 1
        levels: list[list[np.ndarray]] = []
        node, keys, first = np.zeros(len(w), dtype=np.int64), np.array([key], dtype=np.uint64), 0
        while len(keys):
            k = len(keys)
            begin = np.searchsorted(node, np.arange(k + 1))
            feature, cut = np.full(k, -1, dtype=np.int16), np.zeros(k, dtype=np.uint8)
            value = np.empty((k, len(HORIZONS)))
            open_ = self.max_depth is None or depth < self.max_depth
            step = max(1, CELLS // (4 * nt))
            for lo in range(0, k, step):
                hi = min(k, lo + step)
                at = slice(begin[lo], begin[hi])
                some = _Level(bins[at], w[at], tb[at], e[at], node[at] - lo, begin[lo : hi + 1] - begin[lo], nt)
                value[lo:hi] = survival_at(some.hits, some.risk, self.horizons(fold))
                if open_:
                    feature[lo:hi], cut[lo:hi] = self.chosen(some, self.picked_of(seed, keys[lo:hi]))
            split = feature >= 0
            rank = np.cumsum(split) - 1
            left = np.where(split, first + k + 2 * rank, 0).astype(np.int32)
            levels.append([feature, cut, left, left + split.astype(np.int32), np.full(k, depth, dtype=np.int32), value])
            on = np.flatnonzero(split[node])
            low = bins[on, feature[node[on]]] <= cut[node[on]]
            child = 2 * rank[node[on]] + ~low
            order = np.argsort(child, kind="stable")
            on, node = on[order], child[order]
            bins, w, tb, e = bins[on], w[on], tb[on], e[on]
            keys = np.stack(children_of(keys[split]), axis=1).ravel()
            first, depth = first + k, depth + 1
        return dict(zip(FIELDS, map(np.concatenate, zip(*levels, strict=True)), strict=True))

    def chosen(self, level: _Level, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, cut) of the best split of every node, -1 where none is allowed."""
        k = len(level.size)
        top, feature, cut = np.zeros(k), np.full(k, -1), np.zeros(k, dtype=np.int64)
        can = (level.risk[:, 0] >= self.min_split) & level.hits.any(axis=1)
        for f in picked.T:
            x = level.bins[np.arange(len(level.node)), f[level.node]]
            least = 0
            for most in (*SIZES, None):
                mine = np.flatnonzero(can & (level.size > least) & ((most is None) | (level.size <= (most or 0))))
                room = max(1, CELLS // (most**2 if most else self.bins * level.nt))
                for lo in range(0, len(mine), room):
                    i = mine[lo : lo + room]
                    score, at = self._by_rows(level, x, i, most) if most else self._by_bins(level, x, i)
                    better = (score > EPS) & (score > top[i] * (1 + 1e-9))
                    i = i[better]
                    top[i], feature[i], cut[i] = score[better], f[i], at[better]
                least = most
        return feature, cut

    def _leading(self, score: np.ndarray, left: np.ndarray, total: np.ndarray, cuts: np.ndarray):
        score[(left < self.min_leaf) | (total[:, None] - left < self.min_leaf)] = 0.0
        best = leading(score)
        at = np.arange(len(score))
        return score[at, best], np.broadcast_to(cuts, score.shape)[at, best]

    def _by_bins(self, level: _Level, x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Statistic and cut of the nodes' best split, from hits and rows at risk per bin and time."""
        place = np.full(len(level.size), -1)
        place[nodes] = np.arange(len(nodes))
        rows = np.flatnonzero(place[level.node] >= 0)
        shape = (len(nodes), self.bins, level.nt)
        cell = (place[level.node[rows]] * self.bins + x[rows]) * level.nt + level.tb[rows]
        size = int(np.prod(shape))
        dead = np.bincount(cell, level.dead[rows], size).reshape(shape)
        n = np.bincount(cell, level.w[rows], size).reshape(shape)
        left = np.cumsum(n.sum(axis=2), axis=1)[:, :-1]
        at_risk = np.cumsum(n[:, :, ::-1], axis=2)[:, :, ::-1]
        score = logrank(
            np.cumsum(dead, axis=1)[:, :-1], np.cumsum(at_risk, axis=1)[:, :-1],
            level.hits[nodes][:, None, :], level.risk[nodes][:, None, :],
        )
        return self._leading(score, left, level.risk[nodes, 0], np.arange(self.bins - 1)[None, :])

    def _by_rows(self, level: _Level, x: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for nodes of at most ``most`` rows: a cut after each row in order of its bin,
        and the times of the node's own hits in place of all."""
        held = np.arange(most)[None, :] < level.size[nodes][:, None]
        rows = np.where(held, level.begin[nodes][:, None] + np.arange(most), 0)
        b = np.where(held, x[rows].astype(np.int64), 1 << 20)
        order = np.argsort(b, axis=1, kind="stable")
        rows, held, b = (np.take_along_axis(v, order, axis=1) for v in (rows, held, b))
        w, dead = np.where(held, level.w[rows], 0.0), np.where(held, level.dead[rows], 0.0)
        t = level.tb[rows]
        same = t[:, :, None] == t[:, None, :]
        hit = dead > 0
        # a time is a column once, at the first of its hits
        earlier = np.tril(np.ones((most, most), dtype=bool), -1).T
        column = hit & ~(same & hit[:, :, None] & earlier[None]).any(axis=1)
        killed = np.cumsum(same * dead[:, :, None], axis=1) * column[:, None, :]
        at_risk = np.cumsum((t[:, :, None] >= t[:, None, :]) * w[:, :, None], axis=1)
        score = logrank(killed, at_risk, killed[:, -1:, :], at_risk[:, -1:, :])
        score[:, :-1][b[:, :-1] == b[:, 1:]] = 0.0
        left = np.cumsum(w, axis=1)
        return self._leading(score, left, left[:, -1], b)


#: Fields of a finished tree, an array each.
FIELDS = ("feature", "cut", "left", "right", "depth", "value")
TYPES = {"feature": "i2", "cut": "u1", "left": "i4", "right": "i4", "depth": "i4", "value": "f8"}


class _Level:
    """Rows of some nodes of a level, sorted by node, and each node's hits and rows at risk per time."""

    def __init__(self, bins, w, tb, e, node, begin, nt: int) -> None:
        self.bins, self.w, self.tb, self.node, self.begin, self.nt = bins, w, tb, node, begin[:-1], nt
        self.size, self.dead = np.diff(begin), w * e
        cell, shape = node * nt + tb, (len(self.size), nt)
        self.hits = np.bincount(cell, self.dead, shape[0] * nt).reshape(shape)
        self.risk = np.cumsum(np.bincount(cell, w, shape[0] * nt).reshape(shape)[:, ::-1], axis=1)[:, ::-1]


def assembled(tree: Tree, below: list[tuple[int, dict[str, np.ndarray]]]) -> Tree:
    """``tree`` as arrays, with subtrees in the place of some leaves; parents come before children."""
    own = [np.asarray(getattr(tree, f), dtype=TYPES[f]) for f in FIELDS[:-1]]
    own.append(np.array([v if np.ndim(v) else np.ones(len(HORIZONS)) for v in tree.value], dtype=float))
    parts, size = [own], len(own[0])
    for node, sub in below:
        for name in ("left", "right"):
            # the root takes the leaf's place, so all others move up by one
            sub[name] = np.where(sub["feature"] >= 0, sub[name] + size - 1, 0).astype(TYPES[name])
        for whole, name in zip(own, FIELDS, strict=True):
            whole[node] = sub[name][0]
        parts.append([sub[name][1:] for name in FIELDS])
        size += len(sub["feature"]) - 1
    done = dict(zip(FIELDS, map(np.concatenate, zip(*parts, strict=True)), strict=True))
    return Tree(**done, bounds=[], parent=[])


@dataclass
class SurvivalForest(HorizonModel):
    """Each split maximises the log-rank statistic of its two sides.

    Times are binned (``time_bins`` hit-time quantiles plus the horizons), features too.
    Nodes of many rows are split from histograms of hits and rows at risk over (node,
    feature, bin, time) that tasks add up; a node of at most ``NODE_ROWS`` rows goes to one
    task with its rows and is grown there to the end by the same statistic. Without
    ``max_depth`` only the minimum sizes stop a tree.
    """

    n_estimators: int = 100
    max_depth: int | None = None
    min_samples_split: int = 6
    min_samples_leaf: int = 3
    seed: int = 42
    max_bins: int = 32
    time_bins: int = 64
    features: list[str] = field(default_factory=list)
    edges: list[list[float]] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def fit(self, df: DataFrame, features: list[str] | None = None) -> SurvivalForest:
        fitted = self._fit_slots(df, default_features(df, features), [-1], None)[-1]
        self.__dict__.update(fitted.__dict__)
        return self

    def fit_folds(self, df, features, folds, fold_col="fold"):
        return self._fit_slots(df, default_features(df, features), folds, fold_col)

    def _fit_slots(self, df, features, folds, fold_col) -> dict[int, SurvivalForest]:
        fold_sql = f"`{fold_col}`" if fold_col else "-2"
        bins = FoldBins.fit(df, features, folds, fold_sql, self.max_bins)
        times = time_edges(df, self.time_bins, folds, fold_sql)
        table = training_table(df, bins, {"t": f"`{TIME}`", "e": f"`{EVENT}`", "fold": fold_sql}, 1)
        rules = Leaves(
            len(features), bins.bins, times, self.min_samples_split, self.min_samples_leaf, self.max_depth
        )
        slots = [(i, self.seed * 7919 + k) for i in range(len(folds)) for k in range(self.n_estimators)]
        trees = _grow(table, folds, slots, rules)
        table.df.unpersist()
        keep = ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "seed", "max_bins", "time_bins")
        settings = {k: getattr(self, k) for k in keep}
        n = self.n_estimators
        return {
            f: SurvivalForest(
                **settings, features=features, edges=[e.tolist() for e in bins.parts[i].edges],
                trees=trees[i * n : (i + 1) * n],
            )
            for i, f in enumerate(folds)
        }

    def predict(self, df: DataFrame) -> DataFrame:
        binning = Binning(self.features, [np.array(e) for e in self.edges])
        trees = [FlatTree(t) for t in self.trees]

        def fn(x: np.ndarray) -> np.ndarray:
            bins = binning.encode(x)
            total = np.zeros((len(x), len(HORIZONS)))
            for t in trees:
                total += t.values(bins)
            return 1.0 - total / len(trees)

        return with_probabilities(df, self.features, fn)

    def to_json(self) -> str:
        d = asdict(self)
        d["trees"] = [t.to_dict() for t in self.trees]
        return json.dumps(d)

    @staticmethod
    def from_json(text: str) -> SurvivalForest:
        d = json.loads(text)
        d["trees"] = [Tree.from_dict(t) for t in d["trees"]]
        return SurvivalForest(**d)


Slot = tuple[int, int]


def _weights(rows: Rows, slot: Slot, folds: list[int]) -> np.ndarray:
    return poisson_weight(rows.ids, slot[1]) * (rows.extra["fold"] != folds[slot[0]])


def _grow(table: TrainingTable, folds: list[int], slots: list[Slot], rules: Leaves) -> list[Tree]:
    trees = [Tree() for _ in slots]
    keys = [{0: 1} for _ in slots]
    sizes = _node_rows(table, folds, slots)
    rows_of = {(s, 0): n for s, n in enumerate(sizes)}
    small = [(s, 0) for s, n in enumerate(sizes) if n <= NODE_ROWS]
    big = [(s, 0) for s, n in enumerate(sizes) if n > NODE_ROWS]
    depth = 0
    while big:
        ready = big
        big = []
        for part in _chunks(ready, rules):
            for (s, n), found in zip(part, _split_big(table, folds, slots, trees, keys, part, rules), strict=True):
                trees[s].value[n] = found[5:]
                if found[0] <= EPS or (rules.max_depth is not None and depth >= rules.max_depth):
                    continue
                a, b = trees[s].split(n, int(found[1]), int(found[2]))
                keys[s][a], keys[s][b] = children(keys[s][n])
                for child, size in ((a, found[3]), (b, found[4])):
                    rows_of[s, child] = size
                    (small if size <= NODE_ROWS else big).append((s, child))
        depth += 1
    small.sort()
    for part in _turns(small, [rows_of[x] for x in small]):
        below: dict[int, list] = {}
        for s, n, sub in _finish_small(table, folds, slots, trees, keys, part, rules):
            below.setdefault(s, []).append((n, sub))
        for s, subs in below.items():
            trees[s] = assembled(trees[s], subs)
    return [t if isinstance(t.feature, np.ndarray) else assembled(t, []) for t in trees]


def _turns(nodes: list[tuple[int, int]], sizes: list[float]) -> Iterator[list[tuple[int, int]]]:
    """Nodes of whole trees with up to ``DEALT_ROWS`` rows together, or of one tree."""
    part, rows = [], 0.0
    for i, x in enumerate(nodes):
        if part and x[0] != part[-1][0] and rows + sum(
            m for y, m in zip(nodes[i:], sizes[i:], strict=True) if y[0] == x[0]
        ) > DEALT_ROWS:
            yield part
            part, rows = [], 0.0
        part.append(x)
        rows += sizes[i]
    if part:
        yield part


def _node_rows(table: TrainingTable, folds: list[int], slots: list[Slot]) -> np.ndarray:
    """Weighted rows of every tree's root."""

    def fn(rows: Rows) -> np.ndarray:
        return np.array([_weights(rows, x, folds).sum() for x in slots])

    return summed(table, fn, len(slots), 1)[:, 0]


def _chunks(nodes: list[tuple[int, int]], rules: Leaves) -> Iterator[list[tuple[int, int]]]:
    cells = max(1, int(math.sqrt(rules.p))) * rules.bins * (max(map(len, rules.times)) + 1) * 2
    room = max(1, JOB_CELLS // cells)
    for i in range(0, len(nodes), room):
        yield nodes[i : i + room]


def _split_big(table, folds, slots, trees, keys, nodes, rules: Leaves) -> np.ndarray:
    """Per node: statistic, feature, cut, rows left and right, survival at the horizons."""
    b, nt = rules.bins, max(map(len, rules.times)) + 1
    picked = np.stack([rules.picked(slots[s][1], keys[s][n]) for s, n in nodes])
    m = picked.shape[1]
    by_slot: dict[int, list[tuple[int, int]]] = {}
    for i, (s, n) in enumerate(nodes):
        by_slot.setdefault(s, []).append((i, n))

    def count(rows: Rows) -> np.ndarray:
        out = np.zeros((len(nodes), m, b * nt * 2))
        for s, places in by_slot.items():
            fold = slots[s][0]
            bins, w = rows.bins(fold), _weights(rows, slots[s], folds)
            tb = np.searchsorted(rules.times[fold], rows.extra["t"], "left")
            leaf = trees[s].leaf_of(bins)
            for i, n in places:
                r = np.flatnonzero((leaf == n) & (w > 0))
                for j, f in enumerate(picked[i]):
                    cell = (bins[r, f].astype(np.int64) * nt + tb[r]) * 2
                    out[i, j] += np.bincount(cell, weights=w[r] * rows.extra["e"][r], minlength=b * nt * 2)
                    out[i, j] += np.bincount(cell + 1, weights=w[r], minlength=b * nt * 2)
        return out

    def choose(which: np.ndarray, sums: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), 5 + len(HORIZONS)))
        for row, (key, cells) in enumerate(zip(which, sums, strict=True)):
            s = nodes[key // m][0]
            h = cells.reshape(b, nt, 2)
            at_risk = np.cumsum(h[:, ::-1, 1], axis=1)[:, ::-1]
            hits, risk = h[:, :, 0].sum(axis=0), at_risk.sum(axis=0)
            n_left = np.cumsum(h[:, :, 1].sum(axis=1))[:-1]
            n = h[:, :, 1].sum()
            score = logrank(np.cumsum(h[:, :, 0], axis=0)[:-1], np.cumsum(at_risk, axis=0)[:-1], hits, risk)
            score[(n_left < rules.min_leaf) | (n - n_left < rules.min_leaf)] = 0.0
            if n < rules.min_split:
                score[:] = 0.0
            cut = int(leading(score))
            out[row, :5] = score[cut], picked[key // m, key % m], cut, n_left[cut], n - n_left[cut]
            out[row, 5:] = survival_at(hits, risk, rules.horizons(slots[s][0]))
        return out

    got = summed(table, count, len(nodes) * m, b * nt * 2, choose, 5 + len(HORIZONS))
    got = got.reshape(len(nodes), m, -1)
    return got[np.arange(len(nodes)), leading(got[:, :, 0])]


def _finish_small(table, folds, slots, trees, keys, nodes, rules: Leaves):
    """(slot, node, subtree): each node's rows meet in one task, bounded by ``NODE_ROWS``."""
    if not nodes:
        return
    by_slot: dict[int, list[tuple[int, int]]] = {}
    for i, (s, n) in enumerate(nodes):
        by_slot.setdefault(s, []).append((i, n))
    decode, p = table.decode(), rules.p

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = decode(b)
            made: list[tuple[int, bytes]] = []
            for s, places in by_slot.items():
                fold = slots[s][0]
                bins, w = rows.bins(fold), _weights(rows, slots[s], folds)
                at = np.full(len(trees[s].feature), -1)
                at[[n for _, n in places]] = [i for i, _ in places]
                to = at[trees[s].leaf_of(bins)]
                r = np.flatnonzero((to >= 0) & (w > 0))
                r = r[np.argsort(to[r], kind="stable")]
                tb = np.searchsorted(rules.times[fold], rows.extra["t"][r], "left")
                columns = [bins[r], w[r].astype("u1"), tb.astype("u2"), rows.extra["e"][r].astype("f4")]
                ends = [*(np.flatnonzero(np.diff(to[r])) + 1), len(r)] if len(r) else []
                for begin, end in zip([0, *ends], ends, strict=False):
                    made.append((int(to[r[begin]]), b"".join(c[begin:end].tobytes() for c in columns)))
            if made:
                node, data = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["node", "data"])

    depths = {i: int(trees[s].depth[n]) for i, (s, n) in enumerate(nodes)}
    seeds = {i: keys[s][n] for i, (s, n) in enumerate(nodes)}

    def grow(group: pa.Table) -> pa.Table:
        i = group.column("node")[0].as_py()
        fold, seed = slots[nodes[i][0]]
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for data in group.column("data").to_pylist():
            n, at = len(data) // (p + 7), 0
            for part, kind, width in zip(parts, ("u1", "u1", "u2", "f4"), (p, 1, 1, 1), strict=True):
                part.append(np.frombuffer(data, kind, n * width, at))
                at += part[-1].nbytes
        x, w, tb, e = map(np.concatenate, parts)
        sub = rules.subtree(
            x.reshape(-1, p), w.astype(float), tb.astype(np.int64), e.astype(float), fold, seed, seeds[i], depths[i]
        )
        made = {name: pa.array([sub[name].astype(TYPES[name]).tobytes()], pa.binary()) for name in FIELDS}
        return pa.table({"node": pa.array([i], pa.int64()), **made})

    dealt = table.df.mapInArrow(deal, "node long, data binary")
    # a number of tasks that adaptive execution leaves as it is: rows tell the work, not bytes
    tasks = min(len(nodes), 4 * table.df.sparkSession.sparkContext.defaultParallelism)
    grouped = dealt.repartition(tasks, "node").groupBy("node")
    with spent_shuffles_go(table.df.sparkSession):
        done = grouped.applyInArrow(grow, "node long, " + ", ".join(f"{name} binary" for name in FIELDS)).toArrow()
    for b in done.to_batches():
        for row in b.to_pylist():
            sub = {name: np.frombuffer(row[name], TYPES[name]) for name in FIELDS}
            yield *nodes[row["node"]], {**sub, "value": sub["value"].reshape(-1, len(HORIZONS))}
