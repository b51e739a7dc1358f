"""Combining member predictions held in long form (id, model, probabilities)."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.constants import (
    BRIER_WEIGHTS,
    EVENT,
    HORIZONS,
    HYBRID_BRIER_WEIGHT,
    HYBRID_C_WEIGHT,
    ID,
    PROB_COLS,
    TIME,
)
from durata.functions.columns import enforce_monotonicity
from durata.functions.labels import horizon_label, scored_at
from durata.operators.concordance import concordances
from durata.operators.metrics import brier_censor_aware, core_scores, weighted_brier


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    if not weights:
        raise ValueError("no predictions given")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to a positive value")
    return {m: w / total for m, w in weights.items()}


def members_wide(predictions: DataFrame, models: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per id with a column per member and horizon (one keyed aggregate)."""
    keep = keep or []
    aggs = [
        F.expr(f"max(case when model = '{m}' then `{c}` end) as `{c}__{i}`")
        for i, m in enumerate(models)
        for c in PROB_COLS
    ]
    first = [F.expr(f"any_value(`{c}`) as `{c}`") for c in keep]
    # an id has a row a member: partial aggregates would be as many, each with every member's columns
    rows = predictions.select(*dict.fromkeys([ID, "model", *keep, *PROB_COLS])).repartition(ID)
    return rows.groupBy(ID).agg(*first, *aggs, F.count("*").alias("__members"))


def check_members(predictions: DataFrame, models: list[str]) -> None:
    """Every model must predict every id exactly once."""
    known = predictions.filter(F.col("model").isin(models))
    per_id = known.groupBy(ID).agg(F.count("*").alias("n"), F.count_distinct("model").alias("m"))
    bad = per_id.filter((F.col("n") != len(models)) | (F.col("m") != len(models)))
    n = bad.count()
    if n:
        raise ValueError(f"{n} ids do not have exactly one prediction per member")


def weighted_average(
    predictions: DataFrame, weights: dict[str, float], validate: bool = False
) -> DataFrame:
    """Convex combination of members, repaired to be monotone in the horizon."""
    w = normalized_weights(weights)
    if validate:
        check_members(predictions, list(w))
    cases = " ".join(f"when '{m}' then {v!r}D" for m, v in w.items())
    weighted = predictions.withColumn("__w", F.expr(f"case model {cases} end")).filter("__w is not null")
    sums = weighted.groupBy(ID).agg(*[F.expr(f"sum(__w * `{c}`) as `{c}`") for c in PROB_COLS])
    return enforce_monotonicity(sums)


def average_of(wide: DataFrame, models: list[str], weights: dict[str, float]) -> DataFrame:
    """``weighted_average`` row by row: the rows of ``members_wide`` with the combined probabilities."""
    w = normalized_weights(weights)
    texts = combine_columns(models, [w.get(m, 0.0) for m in models], "")
    kept = [c for c in wide.columns if c not in PROB_COLS]
    return enforce_monotonicity(wide.selectExpr(*[f"`{c}`" for c in kept], *[f"{x} as `{c}`" for c, x in texts.items()]))


def combine_columns(models: list[str], weights: list[float], out: str) -> dict[str, str]:
    """SQL text of one weighted combination over the wide member columns."""
    return {
        c: "(" + " + ".join(f"{w!r}D * `{c}__{i}`" for i, w in enumerate(weights)) + ")"
        for c in PROB_COLS
    }


def simplex_grid(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors with components in multiples of 1/steps."""
    cuts = itertools.combinations(range(steps + n - 1), n - 1)
    out = []
    for c in cuts:
        edges = (-1, *c, steps + n - 1)
        out.append(tuple((edges[i + 1] - edges[i] - 1) / steps for i in range(n)))
    return out


def score_candidates(
    wide: DataFrame, models: list[str], candidates: list[tuple[float, ...]], objective: str
) -> list[float]:
    """Objective of every candidate (higher is better), all scored in the same jobs."""
    if objective not in ("hybrid", "brier"):
        raise ValueError(f"Unknown objective: {objective}")
    structs, risks = [], []
    for j, weights in enumerate(candidates):
        texts = combine_columns(models, list(weights), "")
        fields = [f"'candidate',{j}"]
        running: list[str] = []
        for c in PROB_COLS:
            running.append(texts[c])
            top = running[0] if len(running) == 1 else f"greatest({', '.join(running)})"
            fields.append(f"'{c}',least(greatest({top}, 0D), 1D)")
        structs.append(f"named_struct({', '.join(fields)})")
        risks.append(f"least(greatest({top}, 0D), 1D)")
    # a mean per candidate: only the tasks' sums are shuffled
    tall = wide.selectExpr(TIME, EVENT, f"inline(array({', '.join(structs)}))")
    if objective == "brier":
        scores = core_scores(tall, ["candidate"]).select("candidate", "brier_mean")
    else:
        scores = weighted_brier(tall, ["candidate"]).select("candidate", "weighted_brier")
    error = {r[0]: r[1] for r in scores.collect()}
    if objective == "brier":
        return [-error[j] if error.get(j) is not None else -np.inf for j in range(len(candidates))]
    return _hybrids(wide, risks, [error.get(j) for j in range(len(candidates))])


def _hybrids(wide: DataFrame, risks: list[str], error: list[float | None]) -> list[float]:
    """Hybrid scores from the candidates' risks (SQL texts over ``wide``) and errors."""
    return [
        HYBRID_C_WEIGHT * c + HYBRID_BRIER_WEIGHT * (1 - e) if c is not None and e is not None else -np.inf
        for c, e in zip(concordances(wide, risks), error, strict=True)
    ]


def error_moments(wide: DataFrame, n: int, known_only: bool) -> dict[int, np.ndarray] | None:
    """Mean products of the members' errors per horizon, from one aggregate.

    As weights add up to one, the Brier score of a combination is the quadratic form of its
    weights with this matrix. That holds only where the repair changes nothing, so the result
    is None unless every member's probabilities are known, in [0, 1] and rise with the horizon.
    ``known_only`` leaves out rows censored before the horizon.
    """
    sound = F.lit(True)
    for i in range(n):
        p = [F.col(f"{c}__{i}") for c in PROB_COLS]
        steps = [a <= b for a, b in zip([F.lit(0.0), *p], [*p, F.lit(1.0)], strict=True)]
        for ok in steps:
            sound = sound & F.coalesce(ok, F.lit(False))
    horizons = list(BRIER_WEIGHTS if known_only else HORIZONS)
    places = [(h, i, j) for h in horizons for i in range(n) for j in range(i, n)]
    aggs = []
    for h, i, j in places:
        a, b = (F.col(f"prob_{h}h__{k}") - horizon_label(h) for k in (i, j))
        aggs.append(F.avg(F.when(scored_at(h), a * b) if known_only else a * b))
    row = wide.agg(F.bool_and(sound), *aggs).first()
    if not row[0] or any(x is None for x in row[1:]):
        return None
    out = {h: np.zeros((n, n)) for h in horizons}
    for (h, i, j), x in zip(places, row[1:], strict=True):
        out[h][i, j] = out[h][j, i] = x
    return out


def score_by_moments(
    wide: DataFrame, moments: dict[int, np.ndarray], candidates: list[tuple[float, ...]], objective: str
) -> list[float]:
    """As ``score_candidates``: errors from the moments, only ranks from the rows."""
    w = np.array(candidates)
    brier = {h: np.einsum("ci,ij,cj->c", w, m, w) for h, m in moments.items()}
    if objective == "brier":
        return list(-sum(brier.values()) / len(brier))
    error = sum(BRIER_WEIGHTS[h] * b for h, b in brier.items())
    terms = [" + ".join(f"{x!r}D * `prob_72h__{i}`" for i, x in enumerate(weights)) for weights in candidates]
    return _hybrids(wide, [f"least(greatest({x}, 0D), 1D)" for x in terms], list(error))


def hybrid_of_columns(df: DataFrame, sets: dict[str, list[str]]) -> list[tuple[str, float | None, float | None, float | None]]:
    """(name, hybrid_score, weighted_brier, c_index) of prediction sets that lie side by side in
    the columns of ``df`` (a column per horizon); rows are not repeated per set. Persist ``df``."""
    at = {h: i for i, h in enumerate(HORIZONS)}
    aggs = [brier_censor_aware(h, cols[at[h]]) for cols in sets.values() for h in BRIER_WEIGHTS]
    row, n = df.agg(*aggs).first(), len(BRIER_WEIGHTS)
    ranks = concordances(df, [f"`{cols[at[max(HORIZONS)]]}`" for cols in sets.values()])
    out = []
    for i, (name, c) in enumerate(zip(sets, ranks, strict=True)):
        parts = row[i * n : (i + 1) * n]
        brier = None if None in parts else sum(w * x for w, x in zip(BRIER_WEIGHTS.values(), parts, strict=True))
        known = c is not None and brier is not None
        out.append((name, HYBRID_C_WEIGHT * c + HYBRID_BRIER_WEIGHT * (1.0 - brier) if known else None, brier, c))
    return out


def optimize_weights(
    predictions: DataFrame,
    models: list[str],
    objective: str = "hybrid",
    rounds: int = 3,
    grid_steps: int = 4,
) -> dict[str, float]:
    """Weights on the simplex maximising the hybrid score (or minimising the mean Brier).

    The hybrid score is piecewise constant in its rank part, so candidates are compared
    directly: a coarse grid, then ever smaller moves of mass between members around the
    best one. Errors of all candidates come from one matrix of second moments where the
    members are monotone; only the ranks are computed from rows, for candidates not seen before.
    """
    if not models:
        raise ValueError("no predictions given")
    if len(models) == 1:
        return {models[0]: 1.0}
    if objective not in ("hybrid", "brier"):
        raise ValueError(f"Unknown objective: {objective}")
    wide = members_wide(predictions, models, [TIME, EVENT]).drop(ID, "__members").persist()
    out = best_weights(wide, models, objective, rounds, grid_steps)
    wide.unpersist()
    return out


def best_weights(
    wide: DataFrame, models: list[str], objective: str = "hybrid", rounds: int = 3, grid_steps: int = 4
) -> dict[str, float]:
    """As ``optimize_weights``, from stored rows of ``members_wide`` with the targets."""
    if len(models) == 1:
        return {models[0]: 1.0}
    moments = error_moments(wide, len(models), objective == "hybrid")
    equal = tuple(1.0 / len(models) for _ in models)
    candidates = [equal, *simplex_grid(len(models), grid_steps)]
    best, best_score = equal, -np.inf
    step = 0.5 / grid_steps
    seen: dict[tuple[float, ...], float] = {}
    for _ in range(rounds):
        new = [c for c in dict.fromkeys(candidates) if c not in seen]
        if new and moments is None:
            seen |= zip(new, score_candidates(wide, models, new, objective), strict=True)
        elif new:
            seen |= zip(new, score_by_moments(wide, moments, new, objective), strict=True)
        scores = [seen[c] for c in candidates]
        top = int(np.argmax(scores))
        if scores[top] > best_score:
            best, best_score = candidates[top], scores[top]
        moved = set()
        for i, j in itertools.permutations(range(len(models)), 2):
            amount = min(step, best[i])
            if amount > 0:
                w = list(best)
                w[i], w[j] = w[i] - amount, w[j] + amount
                moved.add(tuple(w))
        candidates = sorted(moved)
        step /= 2
    return normalized_weights(dict(zip(models, best, strict=True)))
