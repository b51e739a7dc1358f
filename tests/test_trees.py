"""The tree engine against brute force: leaf-wise growth, log-rank splits, folds, risk sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.models import forest, trees
from durata.models.boosting import (
    BoostedHorizons,
    BoostedSurvival,
    RiskScan,
    leaf_wise_model,
    level_wise_model,
    symmetric_model,
)
from durata.models.forest import Leaves, SurvivalForest, logrank, survival_at
from durata.models.trees import FoldBins, Grower, SplitRules, training_table

FEATURES = ["a", "b", "c"]
COLS = "event_id long, a double, b double, c double, time_to_hit_hours double, event long"


def planted(n, seed=0, ties=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        t = rng.expovariate(math.exp(-3.4 - 1.1 * a + 0.7 * b * c))
        stop = rng.uniform(10, 100)
        rows.append((i, a, b, c if i % 9 else None, max(ties, math.ceil(min(t, stop, 72.0) / ties) * ties), int(t <= min(stop, 72.0))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return planted(700)


@pytest.fixture(scope="module")
def train(spark, rows):
    return spark.createDataFrame(rows, COLS).repartition(5, "event_id").persist()


def flat(tree):
    """Splits from the root on, independent of node numbers."""

    def walk(n):
        if tree.feature[n] < 0:
            return np.round(np.asarray(tree.value[n], dtype=float), 9).tolist()
        return tree.feature[n], tree.cut[n], walk(tree.left[n]), walk(tree.right[n])

    return walk(0)


def brute_leaf_wise(x, g, h, leaves, lam, least):
    """Split the open leaf of best gain until the budget is spent; nested tuples."""

    def best(rows):
        top = (1e-12, None, None)
        for f in range(x.shape[1]):
            for cut in range(int(x[:, f].max())):
                low = x[rows, f] <= cut
                if low.sum() < least or (~low).sum() < least:
                    continue
                score = lambda m: g[rows][m].sum() ** 2 / (h[rows][m].sum() + lam)
                gain = score(low) + score(~low) - score(low | ~low)
                if gain > top[0] * (1 + 1e-9):
                    top = (gain, f, cut)
        return top

    nodes = [{"rows": np.arange(len(x)), "best": best(np.arange(len(x)))}]
    opened = [0]
    while len(opened) < leaves:
        able = [n for n in opened if nodes[n]["best"][1] is not None]
        if not able:
            break
        n = max(able, key=lambda k: (nodes[k]["best"][0], -k))
        _, f, cut = nodes[n]["best"]
        low = x[nodes[n]["rows"], f] <= cut
        nodes[n]["kids"] = []
        for part in (low, ~low):
            r = nodes[n]["rows"][part]
            nodes[n]["kids"].append(len(nodes))
            opened.append(len(nodes))
            nodes.append({"rows": r, "best": best(r)})
        opened.remove(n)

    def walk(n):
        if "kids" not in nodes[n]:
            r = nodes[n]["rows"]
            return round(float(-g[r].sum() / (h[r].sum() + lam)), 9)
        return (*nodes[n]["best"][1:], *map(walk, nodes[n]["kids"]))

    return walk(0)


@pytest.mark.parametrize("direct", [trees.DIRECT_CELLS, 0])
@pytest.mark.parametrize("leaves", [6, 31])
def test_leaf_wise_tree_equals_brute_force(train, rows, monkeypatch, direct, leaves):
    monkeypatch.setattr(trees, "DIRECT_CELLS", direct)
    bins = FoldBins.fit(train, FEATURES, [-1], "-2", 32)
    table = training_table(train, bins, {"e": "event", "t": "time_to_hit_hours"}, 1)
    rules = SplitRules(0.5, 4, 2, None, "leaf", -1, leaves)

    def gradients(part, s):
        return part.extra["e"] * 1.5 - part.extra["t"] / 60, 1 + part.extra["t"] / 100, np.ones(len(part.ids))

    grown = Grower(table, gradients, [0], rules, [np.ones(3, bool)]).grow()[0]
    x = bins.parts[0].encode(np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])).astype(int)
    t, e = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    assert len(grown.leaves()) == leaves
    assert flat(grown) == brute_leaf_wise(x, e * 1.5 - t / 60, 1 + t / 100, leaves, 0.5, 4)


@pytest.mark.parametrize("make", [level_wise_model, leaf_wise_model, symmetric_model])
def test_executors_choose_the_same_trees(train, monkeypatch, make):
    """Sums added on the driver, with subtraction, or chosen from on the executors."""
    kw = {"n_estimators": 3, "max_depth": 4, "learning_rate": 0.4, "monotone": {"a": -1}}
    kw |= {"max_leaves": 9, "min_samples_leaf": 5} if make is leaf_wise_model else {}
    near = make(**kw).fit(train, FEATURES)
    monkeypatch.setattr(trees, "DIRECT_CELLS", 0)
    far = make(**kw).fit(train, FEATURES)
    assert [[flat(t) for t in ts] for ts in near.trees] == [[flat(t) for t in ts] for ts in far.trees]


MODELS = {
    "level": lambda: BoostedHorizons(n_estimators=4, max_depth=3, learning_rate=0.3),
    "leaf": lambda: leaf_wise_model(n_estimators=3, max_leaves=7, learning_rate=0.3),
    "survival_boost": lambda: BoostedSurvival(n_estimators=4, learning_rate=0.3, subsample=0.7),
    "forest": lambda: SurvivalForest(n_estimators=3),
}


@pytest.mark.parametrize("name", list(MODELS))
def test_a_fold_model_equals_a_separate_fit(train, name):
    """Held-out rows shape nothing: bin edges, time bins, rates, random choices."""
    far = F.when(F.col("event_id") % 3 == 1, F.col("a") * 50 + 7).otherwise(F.col("a"))
    tagged = train.withColumn("fold", F.col("event_id") % 3).withColumn("a", far).persist()
    together = MODELS[name]().fit_folds(tagged, FEATURES, [0, 1, 2])
    for f in (0, 1):
        alone = MODELS[name]().fit(tagged.where(F.col("fold") != f), FEATURES)
        assert [list(e) for e in together[f].edges] == [list(e) for e in alone.edges]
        a, b = (m.predict(tagged).select("event_id", "prob_24h", "prob_72h") for m in (together[f], alone))
        assert np.allclose(sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect())))


def test_logrank_is_the_two_sample_statistic():
    rng = random.Random(3)
    data = [(rng.randrange(1, 9), rng.randrange(2), rng.randrange(2)) for _ in range(60)]
    u = v = 0.0
    for s in sorted({t for t, e, _ in data if e}):
        risk = [(t, e, g) for t, e, g in data if t >= s]
        d, n, n1 = sum(t == s and e for t, e, _ in risk), len(risk), sum(g for *_, g in risk)
        u += sum(t == s and e and g for t, e, g in risk) - d * n1 / n
        v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    times = range(1, 9)
    count = lambda ok: np.array([sum(map(lambda r: ok(s, *r), data)) for s in times], float)
    got = logrank(
        count(lambda s, t, e, g: t == s and e and g), count(lambda s, t, e, g: t >= s and g),
        count(lambda s, t, e, g: t == s and e), count(lambda s, t, e, g: t >= s),
    )
    assert got == pytest.approx(u * u / v)


def brute_forest_tree(x, w, tb, e, rules, seed):
    """Every cut of every picked feature tried from the rows; depth first."""

    def node(rows, key):
        nt = len(rules.times[0]) + 1
        hits = np.array([(w * e)[rows][tb[rows] == s].sum() for s in range(nt)])
        risk = np.array([w[rows][tb[rows] >= s].sum() for s in range(nt)])
        value = np.round(survival_at(hits, risk, rules.horizons(0)), 9).tolist()
        top, choice = 1e-12, None
        if w[rows].sum() >= rules.min_split:
            for f in rules.picked(seed, key):
                for cut in range(int(x[:, f].max())):
                    low = rows[x[rows, f] <= cut]
                    if min(w[low].sum(), w[rows].sum() - w[low].sum()) < rules.min_leaf:
                        continue
                    hl = np.array([(w * e)[low][tb[low] == s].sum() for s in range(nt)])
                    rl = np.array([w[low][tb[low] >= s].sum() for s in range(nt)])
                    score = float(logrank(hl, rl, hits, risk))
                    if score > top * (1 + 1e-9):
                        top, choice = score, (int(f), cut)
        if choice is None:
            return value
        low = x[rows, choice[0]] <= choice[1]
        a, b = forest.children(key)
        return (*choice, node(rows[low], a), node(rows[~low], b))

    return node(np.flatnonzero(w > 0), 1)


@pytest.mark.parametrize("node_rows,direct", [(forest.NODE_ROWS, trees.DIRECT_CELLS), (90, trees.DIRECT_CELLS), (90, 0), (0, 0)])
def test_forest_trees_equal_brute_force(spark, monkeypatch, node_rows, direct):
    """Whole trees, whether nodes are split from histograms or grown in one task."""
    rows = planted(260, 5)
    df = spark.createDataFrame(rows, COLS).repartition(4, "event_id")
    monkeypatch.setattr(forest, "NODE_ROWS", node_rows)
    monkeypatch.setattr(trees, "DIRECT_CELLS", direct)
    model = SurvivalForest(n_estimators=2, max_bins=12, time_bins=10, seed=3).fit(df, FEATURES)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    binning = trees.Binning(FEATURES, [np.array(e) for e in model.edges])
    codes = binning.encode(x).astype(int)
    times = forest.time_edges(df, 10, [-1], "-2")
    rules = Leaves(3, binning.bins, times, 6, 3, None)
    t, e = np.array([r[4] for r in rows]), np.array([float(r[5]) for r in rows])
    tb = np.searchsorted(times[0], t, "left")
    ids = np.array([r[0] for r in rows])
    for k, tree in enumerate(model.trees):
        w = forest.poisson_weight(ids, 3 * 7919 + k)

        def plain(t):
            return t if isinstance(t, list) else (int(t[0]), int(t[1]), plain(t[2]), plain(t[3]))

        got, want = flat(tree), brute_forest_tree(codes, w, tb, e, rules, 3 * 7919 + k)
        assert len(tree.leaves()) > 8
        # a cut between the same rows may sit on any empty bin: compare rows of the leaves
        assert same_partition(got, want, codes[w > 0])


def same_partition(a, b, x):
    """Do two nested trees part the rows alike, with the same values?"""

    def reach(tree, rows, out):
        if isinstance(tree, list):
            out.append((rows.tolist(), tree))
        else:
            low = x[rows, tree[0]] <= tree[1]
            reach(tree[2], rows[low], out)
            reach(tree[3], rows[~low], out)
        return out

    p, q = (sorted(reach(t, np.arange(len(x)), [])) for t in (a, b))
    return [r for r, _ in p] == [r for r, _ in q] and np.allclose([v for _, v in p], [v for _, v in q])


def test_forest_without_depth_limit_goes_deep(spark):
    """Each split peels off one group, so the tree has to be a long path."""
    rows = [(i, float(i // 8), 0.0, 0.0, 1.0 + i // 8, 1) for i in range(8 * 26)]
    df = spark.createDataFrame(rows, COLS)
    model = SurvivalForest(n_estimators=4, min_samples_leaf=1, min_samples_split=2, max_bins=64).fit(df, ["a"])
    assert max(max(t.depth) for t in model.trees) > 5
    limited = SurvivalForest(n_estimators=2, max_depth=2).fit(df, ["a"])
    assert max(max(t.depth) for t in limited.trees) == 2


@pytest.mark.parametrize("ties,n", [(1.0, 500), (0.001, 2600), (24.0, 400)])
def test_risk_sets_equal_the_double_sum(spark, ties, n):
    """Cumulative hazards on both sides of 1,024 hit times, and with times over partitions."""
    rows = planted(n, 7, ties)
    df = spark.createDataFrame(rows, COLS).withColumn("fold", F.col("event_id") % 4)
    folds = [0, -1]
    bins = FoldBins.fit(df, FEATURES, folds, "fold", 16)
    extras = {"t": "time_to_hit_hours", "e": "event", "fold": "fold"}
    table = training_table(df, bins, extras, 2, np.array([0.0, 0.3]), order="t")
    table.df = table.df.persist()
    scan = RiskScan.over(table, folds)
    hits = {r[4] for r in rows if r[5]}
    assert (len(hits) > 1024) == (ties == 0.001)
    t, e, fold = (np.array([r[k] for r in rows]) for k in (4, 5, 0))
    got = scan.at(table, (12, 24, 48, 72))
    for s, (f, margin) in enumerate(zip(folds, (0.0, 0.3), strict=True)):
        w = (fold % 4 != f).astype(float)
        risk = {x: (w * np.exp(margin))[t >= x].sum() for x in hits}
        step = np.array([wi * ei / risk[ti] if ei else 0.0 for ti, ei, wi in zip(t, e, w, strict=True)])
        assert got[s] == pytest.approx([step[t <= h].sum() for h in (12, 24, 48, 72)], rel=1e-10)
    # the value that each row's gradient uses
    want = {r[0]: step[t <= r[4]].sum() for r in rows}
    import pyarrow as pa
    from pyspark import TaskContext

    decode = table.decode()

    def values(batches):
        every = [b for b in batches if b.num_rows]
        if every:
            part = decode(pa.Table.from_batches(every).combine_chunks().to_batches()[0])
            part.extra["part"] = np.full(len(part.ids), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(scan.cumulative(part, 1)[1])], names=["i", "v"])

    for r in table.df.mapInArrow(values, "i long, v double").collect():
        assert r["v"] == pytest.approx(want[r["i"]], rel=1e-10)
