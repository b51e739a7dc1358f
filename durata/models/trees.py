"""Histogram trees grown from per-task partial histograms, many trees in the same jobs.

Feature values are coded once. A pass over the rows evaluates the open nodes of every tree
being grown (all horizons, folds or forest members together): tasks add up one histogram per
(node, feature), and the best cut of each is chosen where the sums meet - on the driver
while they are few, else on the executors, which then return one short row per histogram.
Of two children only the smaller is counted while the parent's histogram is at hand, the
other is the difference.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import ID
from durata.functions.columns import nn
from durata.operators.partials import batch_matrix

MAX_BINS = 64
JOB_CELLS = 8_000_000  # sums that one task holds; more nodes take several jobs
DIRECT_CELLS = 4_000_000  # up to here the tasks' partial sums are added on the driver
RANGE_ROWS = 200_000  # rows of one range of a sorted table
KEPT_CELLS = 8_000_000  # parents' histograms kept for subtraction
SKETCH = 5_000  # accuracy of the quantile sketch behind the bin edges
EPS = 1e-12


@dataclass
class Binning:
    """Bin 0 holds missing values; bin i + 1 holds values above i of the sorted edges."""

    features: list[str]
    edges: list[np.ndarray] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
        return out


@dataclass
class FoldBins:
    """Bin edges of every training fold, each from its own rows only.

    Rows are coded once, on the union of all edges; ``codes[f]`` turns a union code of a
    feature into the code that fold ``f`` alone would have given.
    """

    union: Binning
    parts: list[Binning]
    codes: np.ndarray

    @staticmethod
    def fit(df: DataFrame, features: list[str], folds: list[int], fold_sql: str, max_bins: int) -> FoldBins:
        if not 2 <= max_bins <= 254:
            raise ValueError("max_bins must lie between 2 and 254")
        if len(folds) * max_bins > 65_000:
            raise ValueError("too many folds for this number of bins")
        probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        cuts = [
            F.percentile_approx(F.when(F.expr(f"{fold_sql} <> {f}"), nn(c)), probs, SKETCH)
            for f in folds for c in features
        ]
        row = df.agg(*cuts).first()
        edges = [np.unique(np.array(r if r is not None else [], dtype=float)) for r in row]
        p = len(features)
        parts = [Binning(features, edges[i * p : (i + 1) * p]) for i in range(len(folds))]
        union = Binning(features, [np.unique(np.concatenate(e)) for e in zip(*(x.edges for x in parts), strict=True)])
        codes = np.zeros((len(folds), p, union.bins), dtype=np.uint8)
        for f, part in enumerate(parts):
            for j, (e, u) in enumerate(zip(part.edges, union.edges, strict=True)):
                codes[f, j, 1] = 1
                codes[f, j, 2 : len(u) + 2] = 1 + np.searchsorted(e, u, "right")
        return FoldBins(union, parts, codes)

    @property
    def bins(self) -> int:
        return max(x.bins for x in self.parts)


@dataclass
class Tree:
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    bounds: list = field(default_factory=lambda: [(-np.inf, np.inf)])
    depth: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])

    def parent_of(self, node: int) -> int:
        return self.parent[node]

    def mate_of(self, node: int) -> int:
        up = self.parent[node]
        return -1 if up < 0 else self.left[up] + self.right[up] - node

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = a, a + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(self.value[node])
            self.bounds.append(self.bounds[node])
            self.depth.append(self.depth[node] + 1)
            self.parent.append(node)
        return a, a + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node reached by every row."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(max(self.depth)):
            f = feature[node]
            go_left = bins[rows, np.maximum(f, 0)] <= cut[node]
            node = np.where(f < 0, node, np.where(go_left, left[node], right[node]))
        return node

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def to_dict(self) -> dict:
        return {
            **{c: np.asarray(getattr(self, c)).tolist() for c in ("feature", "cut", "left", "right", "depth")},
            "value": np.asarray(self.value, dtype=float).tolist(),
        }

    @staticmethod
    def from_dict(d: dict) -> Tree:
        return Tree(d["feature"], d["cut"], d["left"], d["right"], d["value"], [], d["depth"], [])


class FlatTree:
    """A finished tree as arrays: what prediction ships to the tasks."""

    def __init__(self, tree: Tree) -> None:
        self.feature, self.cut = np.array(tree.feature, np.int32), np.array(tree.cut, np.uint8)
        self.left, self.right = np.array(tree.left, np.int32), np.array(tree.right, np.int32)
        self.value = np.asarray(tree.value, dtype=float)

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Leaf value of every row; rows that have arrived are not looked at again."""
        node = np.zeros(len(bins), dtype=np.int32)
        on = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(on):
            at = node[on]
            low = bins[on, self.feature[at]] <= self.cut[at]
            node[on] = np.where(low, self.left[at], self.right[at])
            on = on[self.feature[node[on]] >= 0]
        return self.value[node]


def hash_uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniform in [0, 1) from the id and a seed (splitmix64 finaliser)."""
    mask = 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & mask)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass
class Rows:
    """Decoded columns of one or more Arrow batches of a training table."""

    ids: np.ndarray
    coded: np.ndarray
    codes: np.ndarray
    extra: dict[str, np.ndarray]
    margin: np.ndarray
    known: dict[int, np.ndarray] = field(default_factory=dict)

    def bins(self, fold: int) -> np.ndarray:
        """Bins of the rows in the edges of one fold (by position)."""
        if fold not in self.known:
            out = np.empty(self.coded.shape, dtype=np.uint8)
            for j in range(out.shape[1]):
                out[:, j] = self.codes[fold, j][self.coded[:, j]]
            self.known[fold] = out
        return self.known[fold]


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Equal-length binary values as a matrix, without copying row by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :]
    start = int(offsets[0])
    size = len(column) * width * np.dtype(dtype).itemsize
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + size]
    return flat.view(dtype).reshape(len(column), width) if start % 8 == 0 else np.frombuffer(
        flat.tobytes(), dtype=dtype
    ).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix)
    width = data.dtype.itemsize * data.shape[1]
    offsets = (np.arange(len(data) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


@dataclass
class TrainingTable:
    """Coded rows: id, packed codes, numeric extras and packed margins of every slot."""

    df: DataFrame
    bins: FoldBins
    extras: list[str]
    slots: int
    partitions: int

    def decode(self) -> Callable[[pa.RecordBatch], Rows]:
        p, extras, slots, codes = len(self.bins.union.features), self.extras, self.slots, self.bins.codes

        def read(batch: pa.RecordBatch) -> Rows:
            return Rows(
                batch.column("id").to_numpy(zero_copy_only=False),
                _fixed(batch.column("x"), np.uint16, p), codes,
                {c: batch.column(c).to_numpy(zero_copy_only=False) for c in extras},
                _fixed(batch.column("margin"), np.float64, slots),
            )

        return read


def pass_partitions(df: DataFrame) -> int:
    """Partitions of a table that many passes read: one a core, more once they are full."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS))


def training_table(
    df: DataFrame, bins: FoldBins, extras: dict[str, str], slots: int,
    start: np.ndarray | None = None, order: str | None = None,
) -> TrainingTable:
    """``order`` names an extra by whose value rows are ranged over the partitions and sorted."""
    names, features = list(extras), bins.union.features
    columns = df.selectExpr(
        f"cast(`{ID}` as long) as id",
        *[f"cast(`{c}` as double) as `f{i}`" for i, c in enumerate(features)],
        *[f"cast({e} as double) as `{n}`" for n, e in extras.items()],
    )
    p, union = len(features), bins.union
    first = np.zeros(slots) if start is None else start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = union.encode(batch_matrix(b, [f"f{i}" for i in range(p)]))
            margin = np.tile(first, (len(x), 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), _binary(x), *[b.column(n) for n in names], _binary(margin)],
                names=["id", "x", *names, "margin"],
            )

    schema = "id long, x binary, " + "".join(f"{n} double, " for n in names) + "margin binary"
    parts = pass_partitions(df)
    if order is None:
        # every pass starts a task a partition: many small ones cost more than their rows
        many = columns.rdd.getNumPartitions() >= parts
        rows = (columns.coalesce(parts) if many else columns.repartition(parts, "id")).mapInArrow(run, schema)
    else:
        rows = columns.mapInArrow(run, schema).where(f"{order} is not null")
        rows = rows.repartitionByRange(parts, order, F.xxhash64("id")).sortWithinPartitions(order)
    rows = rows.persist()
    return TrainingTable(rows, bins, names, slots, rows.rdd.getNumPartitions())


Choose = Callable[[np.ndarray, np.ndarray], np.ndarray]


def summed(
    table: TrainingTable, fn: Callable[[Rows], np.ndarray], keys: int, width: int,
    choose: Choose | None = None, out: int = 0, whole: bool = False,
) -> np.ndarray:
    """(keys, width) sums over all rows of ``fn``, or what ``choose`` makes of them.

    ``choose`` takes keys and their sums and returns ``out`` numbers for each. Where the
    tasks' partial sums are more than the driver should add, they are shuffled by key,
    added and chosen from on the executors. ``whole`` hands ``fn`` all rows of a partition
    at once, with the partition's number as ``extra["part"]``.
    """
    decode = table.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width))
        if whole:
            from pyspark import TaskContext

            every = [b for b in batches if b.num_rows]
            if every:
                rows = decode(pa.Table.from_batches(every).combine_chunks().to_batches()[0])
                rows.extra["part"] = np.full(len(rows.ids), TaskContext.get().partitionId())
                total += fn(rows).reshape(keys, width)
        else:
            for b in batches:
                if b.num_rows:
                    total += fn(decode(b)).reshape(keys, width)
        hit = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), _binary(total[hit])], names=["key", "v"])

    partials = table.df.mapInArrow(run, "key long, v binary")
    near = table.partitions * keys * width <= DIRECT_CELLS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("key").to_pylist(), _fixed(b.column("v"), np.float64, width) if b.num_rows else [], strict=True):
                if k in sums:
                    sums[k] += v
                else:
                    sums[k] = v.copy()
        if sums:
            at = np.array(list(sums))
            made = np.stack(list(sums.values()))
            made = made if choose is None else choose(at, made)
            yield pa.RecordBatch.from_arrays([pa.array(at), _binary(made)], names=["key", "v"])

    size = width if near or choose is None else out
    if not near:
        partials = partials.repartition("key").mapInArrow(add, "key long, v binary")
    result = np.zeros((keys, size))
    for b in partials.toArrow().to_batches():
        if b.num_rows:
            np.add.at(result, b.column("key").to_numpy(), _fixed(b.column("v"), np.float64, size))
    return choose(np.arange(keys), result) if near and choose is not None else result


Gradients = Callable[[Rows, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class SplitRules:
    reg_lambda: float = 1.0
    min_leaf: float = 1.0
    min_split: float = 2.0
    signs: list[int] | None = None
    growth: str = "depth"
    max_depth: int = 6
    max_leaves: int = 31


@dataclass
class Found:
    """Sums (gradient, hessian, count) of a node, and its best cut if it has one."""

    total: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    left: np.ndarray | None = None


def leading(values: np.ndarray) -> np.ndarray:
    """First place along the last axis that is the maximum up to rounding."""
    top = values.max(axis=-1, keepdims=True)
    return (values >= np.where(np.isfinite(top), top - 1e-9 * np.abs(top), top)).argmax(axis=-1)


def gains(hist: np.ndarray, rules: SplitRules, sign: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Gain of every cut of (m, bins, 3) histograms, -inf where a rule forbids it; left sums."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist.sum(axis=1)[:, None]
    right = total - left
    lam = rules.reg_lambda + EPS
    score = lambda a: a[..., 0] ** 2 / (a[..., 1] + lam)
    gain = score(left) + score(right) - score(total)
    ok = (left[..., 2] >= rules.min_leaf) & (right[..., 2] >= rules.min_leaf)
    ok &= total[..., 2] >= rules.min_split
    if rules.signs is not None:
        wl = np.clip(-left[..., 0] / (left[..., 1] + lam), lo[:, None], hi[:, None])
        wr = np.clip(-right[..., 0] / (right[..., 1] + lam), lo[:, None], hi[:, None])
        ok &= (wr - wl) * sign[:, None] >= 0
    return np.where(ok & (gain > EPS), gain, -np.inf), left


class Grower:
    """Evaluates nodes of several trees together and grows them by one of three rules."""

    def __init__(
        self, table: TrainingTable, gradients: Gradients, fold_of: list[int], rules: SplitRules,
        allowed: list[np.ndarray], whole: bool = False,
    ) -> None:
        self.table, self.gradients, self.fold_of = table, gradients, fold_of
        self.rules, self.allowed, self.whole = rules, allowed, whole
        self.p, self.b = len(table.bins.union.features), table.bins.bins
        self.trees = [Tree() for _ in fold_of]
        self.found: list[dict[int, Found]] = [{} for _ in fold_of]
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    # --- passes over the rows ---

    def _chunks(self, nodes: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        room = max(1, JOB_CELLS // (self.p * self.b * 3))
        for i in range(0, len(nodes), room):
            yield nodes[i : i + room]

    def _counted(self, nodes: list[tuple[int, int]]) -> Callable[[Rows], np.ndarray]:
        """Histograms (nodes, features, bins, 3) of one batch."""
        trees, gradients, fold_of, p, b = self.trees, self.gradients, self.fold_of, self.p, self.b
        by_slot: dict[int, list[tuple[int, int]]] = {}
        for i, (s, n) in enumerate(nodes):
            by_slot.setdefault(s, []).append((i, n))

        def fn(rows: Rows) -> np.ndarray:
            out = np.zeros((len(nodes), p, b, 3))
            for s, places in by_slot.items():
                at = np.full(len(trees[s].feature), -1)
                at[[n for _, n in places]] = np.arange(len(places))
                bins = rows.bins(fold_of[s])
                k = at[trees[s].leaf_of(bins)]
                g, h, w = gradients(rows, s)
                keep = np.flatnonzero((k >= 0) & (w > 0))
                m = len(places)
                sums = np.empty((m, p, b, 3))
                base = k[keep] * b
                for f in range(p):
                    cell = base + bins[keep, f]
                    for j, v in enumerate((g, h, w)):
                        sums[:, f, :, j] = np.bincount(cell, weights=v[keep], minlength=m * b).reshape(m, b)
                out[[i for i, _ in places]] += sums
            return out

        return fn

    def _chosen(self, nodes: list[tuple[int, int]]) -> Choose:
        """Per (node, feature): gain, cut, left sums, total sums."""
        p, b, rules = self.p, self.b, self.rules
        sign = np.array(rules.signs if rules.signs is not None else [0] * p)
        lo = np.array([self.trees[s].bounds[n][0] for s, n in nodes])
        hi = np.array([self.trees[s].bounds[n][1] for s, n in nodes])
        allowed = np.stack([self.allowed[s] for s, _ in nodes])

        def choose(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
            node, f = keys // p, keys % p
            hist = sums.reshape(-1, b, 3)
            gain, left = gains(hist, rules, sign[f], lo[node], hi[node])
            gain[~allowed[node, f]] = -np.inf
            cut = leading(gain)
            rows = np.arange(len(keys))
            return np.column_stack([gain[rows, cut], cut, left[rows, cut], hist.sum(axis=1)])

        return choose

    def evaluate(self, nodes: list[tuple[int, int]]) -> None:
        """Fills ``found`` for (slot, node) pairs."""
        for part in self._chunks(nodes):
            known = set(part)
            spare: dict[tuple[int, int], tuple] = {}
            cells = self.p * self.b * 3
            near = self.table.partitions * len(part) * cells <= DIRECT_CELLS
            if near:
                for s, n in part:
                    up = self.trees[s].parent_of(n)
                    mate = self.trees[s].mate_of(n)
                    if (s, up) in self.kept and (s, mate) in known and (s, mate) not in spare:
                        small, large = sorted(((s, n), (s, mate)), key=lambda x: (self._size(*x), x))
                        spare[large] = (small, (s, up))
            counted = [x for x in part if x not in spare]
            choose = self._chosen(counted)
            if near:
                hist = summed(self.table, self._counted(counted), len(counted), cells, None, 0, self.whole)
                hist = hist.reshape(len(counted), self.p, self.b, 3)
                at = {x: h for x, h in zip(counted, hist, strict=True)}
                for large, (small, up) in spare.items():
                    at[large] = self.kept[up] - at[small]
                for up in {u for _, u in spare.values()}:
                    del self.kept[up]
                if (len(self.kept) + len(at)) * cells <= KEPT_CELLS:
                    self.kept.update(at)
                got = self._chosen(part)(
                    np.arange(len(part) * self.p), np.stack([at[x] for x in part]).reshape(-1, self.b * 3)
                )
            else:
                got = summed(
                    self.table, self._counted(counted), len(counted) * self.p, self.b * 3, choose, 8, self.whole
                )
            got = got.reshape(len(part), self.p, 8)
            for (s, n), rows in zip(part, got, strict=True):
                f = int(leading(rows[:, 0]))
                best = rows[f]
                found = Found(best[5:])
                # histograms that no task reported are all zero
                if np.isfinite(best[0]) and best[0] > EPS:
                    found = Found(best[5:], float(best[0]), f, int(best[1]), best[2:5])
                self.found[s][n] = found

    def _size(self, s: int, n: int) -> float:
        up = self.trees[s].parent_of(n)
        f = self.found[s][up]
        return f.left[2] if self.trees[s].left[up] == n else f.total[2] - f.left[2]

    # --- growth ---

    def split(self, s: int, n: int) -> list[int]:
        """Both children of a node along its best cut, with values and bounds."""
        tree, x = self.trees[s], self.found[s][n]
        a, b = tree.split(n, x.feature, x.cut)
        lo, hi = tree.bounds[n]
        lam = self.rules.reg_lambda + EPS
        for child, sums in ((a, x.left), (b, x.total - x.left)):
            tree.value[child] = float(np.clip(-sums[0] / (sums[1] + lam), lo, hi))
        signs = self.rules.signs
        if signs is not None and signs[x.feature] != 0:
            mid = (tree.value[a] + tree.value[b]) / 2
            below, above = (lo, mid), (mid, hi)
            tree.bounds[a], tree.bounds[b] = (below, above) if signs[x.feature] > 0 else (above, below)
        return [a, b]

    def _can(self, s: int, n: int) -> bool:
        deep = self.rules.max_depth > 0 and self.trees[s].depth[n] >= self.rules.max_depth
        return not deep and self.found[s][n].feature >= 0

    def _level(self, s: int, active: list[int]) -> list[int]:
        return [c for n in active if self._can(s, n) for c in self.split(s, n)]

    def _ahead(self, s: int, active: list[int]) -> list[int]:
        """Leaf-wise: nodes that the next best splits may need.

        The tree holds more nodes than will stay. Splits are replayed best gain first; where
        the replay meets a node that is not evaluated, every node that could still be split
        with the leaves left over gets its children, all evaluated in the next pass.
        """
        _, queue, room = self.replay(s)
        ready = [n for _, _, n in sorted(queue)[:room] if self.trees[s].feature[n] < 0]
        return [c for n in ready for c in self.split(s, n)]

    def replay(self, s: int) -> tuple[list[int], list, int]:
        """Splits in order of their gains as far as known, what is queued, and leaves left."""
        tree, found = self.trees[s], self.found[s]
        done: list[int] = []
        queue = [(-found[0].gain, 0, 0)] if self._can(s, 0) else []
        serial, room = 0, self.rules.max_leaves - 1
        while queue and room > 0:
            n = queue[0][2]
            kids = [tree.left[n], tree.right[n]] if tree.feature[n] >= 0 else []
            if not kids or kids[0] not in found:
                break
            heapq.heappop(queue)
            done.append(n)
            room -= 1
            for c in kids:
                serial += 1
                if self._can(s, c):
                    heapq.heappush(queue, (-found[c].gain, serial, c))
        return done, queue, room

    def _pruned(self, s: int) -> Tree:
        """The tree of the replayed splits only, nodes numbered in their order."""
        source, out = self.trees[s], Tree()
        out.value[0] = source.value[0]
        name = {0: 0}
        for n in self.replay(s)[0]:
            pair = out.split(name[n], source.feature[n], source.cut[n])
            for c, made in zip((source.left[n], source.right[n]), pair, strict=True):
                name[c] = made
                out.value[made], out.bounds[made] = source.value[c], source.bounds[c]
        return out

    def _same_cut(self, active: list[list[int]]) -> list[list[int]]:
        """Symmetric: one cut for a whole level; nodes that it cannot split stay leaves."""
        totals = [np.zeros((self.p, self.b - 1)) for _ in self.trees]
        nodes = [(s, n) for s, ns in enumerate(active) for n in ns]
        sign = np.array(self.rules.signs if self.rules.signs is not None else [0] * self.p)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in self._chunks(nodes):
            hist = summed(self.table, self._counted(part), len(part) * self.p, self.b * 3, None, 0, self.whole)
            for (s, n), h in zip(part, hist.reshape(len(part), self.p, self.b, 3), strict=True):
                lo, hi = (np.full(self.p, x) for x in self.trees[s].bounds[n])
                gain, left = gains(h, self.rules, sign, lo, hi)
                gain[~self.allowed[s]] = -np.inf
                totals[s] += np.where(np.isfinite(gain), gain, 0)
                self.found[s][n] = Found(h[0].sum(axis=0))
                sums[s, n] = np.concatenate([gain[..., None], left], axis=-1)
        out: list[list[int]] = []
        for s, ns in enumerate(active):
            if ns == [0]:
                self._root(s)
            best = int(leading(totals[s].ravel()))
            f, t = divmod(best, self.b - 1)
            kids: list[int] = []
            for n in ns:
                gain, *left = sums[s, n][f, t]
                if np.isfinite(gain):
                    self.found[s][n] = Found(self.found[s][n].total, float(gain), f, t, np.array(left))
                    if self._can(s, n):
                        kids += self.split(s, n)
            out.append(kids)
        return out

    def _root(self, s: int) -> None:
        g, h, _ = self.found[s][0].total
        self.trees[s].value[0] = -g / (h + self.rules.reg_lambda + EPS)

    def grow(self) -> list[Tree]:
        active = [[0] for _ in self.trees]
        level = 0
        while any(active):
            if self.rules.growth == "oblivious":
                active = self._same_cut(active)
            else:
                self.evaluate([(s, n) for s, nodes in enumerate(active) for n in nodes])
                if level == 0:
                    for s in range(len(self.trees)):
                        self._root(s)
                step = self._ahead if self.rules.growth == "leaf" else self._level
                active = [step(s, nodes) if nodes else [] for s, nodes in enumerate(active)]
            level += 1
            if self.rules.growth != "leaf" and 0 < self.rules.max_depth <= level:
                break
        if self.rules.growth == "leaf":
            return [self._pruned(s) for s in range(len(self.trees))]
        return self.trees
