"""Exact order statistics without gathering a column, or a key's values, in one place.

Small inputs use ``percentile``. Beyond ``small`` values that aggregate would hold one
map entry per distinct value in a single task, so one pass sketches all columns, a second
counts the values at and between the sketched cuts, and a third ranks the few values of the
gaps that hold a wanted rank. The number of passes depends neither on the columns nor on
the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from durata.operators.partials import batch_matrix
from durata.operators.scan import POINTS, equi_depth_splits, prefix_sums, sketched_quantiles, with_bucket

#: Values that the maps of one aggregate hold at most, over all its columns.
SMALL = 2_000_000
#: Share of the values by which the sketched cuts lie beside a wanted rank.
MARGIN = 4.0 / POINTS


def exact_quantiles(
    df: DataFrame, exprs: dict[str, Column], probs: list[float], small: int = SMALL
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several (nullable, NaN-free) expressions at once."""
    names = list(exprs)
    cols = df.select(*[exprs[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    counts = cols.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    out: dict[str, list[float | None]] = {}
    little = [i for i in range(len(names)) if counts[i] <= small]
    for part in _batches(little, lambda i: counts[i], small):
        row = cols.agg(
            *[F.percentile(f"c{i}", F.array(*[F.lit(float(p)) for p in probs])) for i in part]
        ).first()
        for j, i in enumerate(part):
            out[names[i]] = list(row[j]) if row[j] is not None else [None] * len(probs)
    big = [i for i in range(len(names)) if counts[i] > small]
    if big:
        ranks = {}
        for i in big:
            for p in probs:
                at = p * (counts[i] - 1)
                ranks.setdefault(i, set()).update({math.floor(at), math.ceil(at)})
        values = _order_statistics(cols, ranks, {i: counts[i] for i in big})
        for i in big:
            found = []
            for p in probs:
                at = p * (counts[i] - 1)
                below, above = math.floor(at), math.ceil(at)
                lo, hi = values[i, below], values[i, above]
                # as ``percentile`` interpolates, to the last bit
                found.append(lo if lo == hi else (above - at) * lo + (at - below) * hi)
            out[names[i]] = found
    return {n: out[n] for n in names}


def _batches(items: Iterable, size: Callable[..., int], most: int) -> Iterator[list]:
    """``items`` in lists of total size ``most``; a single one may be that large."""
    part, held = [], 0
    for x in items:
        if part and held + size(x) > most:
            yield part
            part, held = [], 0
        part.append(x)
        held += size(x)
    if part:
        yield part


def _order_statistics(
    cols: DataFrame, ranks: dict[int, set[int]], counts: dict[int, int]
) -> dict[tuple[int, int], float]:
    """Values of the wanted ranks (from 0) of columns ``c0``, ``c1``, ...

    A column's cell 2j holds the values between its sketched cuts j - 1 and j, cell 2j + 1
    those equal to cut j. The cuts enclose every wanted rank closely, so the cells whose
    values are fetched are a small share of the rows; a poor sketch makes them larger only.
    """
    places = list(ranks)
    names = [f"c{i}" for i in places]
    near = [
        sorted({min(1.0, max(0.0, k / counts[i] + d)) for k in ranks[i] for d in (-MARGIN, MARGIN)}) for i in places
    ]
    cuts = [np.unique(c) for c in sketched_quantiles(cols, names, near)]

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        matrix = batch_matrix(batch, names)
        for j, cut in enumerate(cuts):
            x = matrix[:, j]
            x = x[~np.isnan(x)]
            at = np.searchsorted(cut, x, "left")
            yield j, x, 2 * at + (cut[np.minimum(at, len(cut) - 1)] == x)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(2 * len(cut) + 1, dtype=np.int64) for cut in cuts]
        for batch in batches:
            for j, _, cell in cells(batch):
                held[j] += np.bincount(cell, minlength=len(held[j]))
        for j, n in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), j)), pa.array(np.arange(len(n))), pa.array(n)], names=["col", "cell", "n"]
            )

    upto = [np.zeros(2 * len(cut) + 1, dtype=np.int64) for cut in cuts]
    counted = cols.mapInArrow(count, "col long, cell long, n long").groupBy("col", "cell")
    for r in counted.agg(F.sum("n").alias("n")).collect():
        upto[r["col"]][r["cell"]] = r["n"]
    done: dict[tuple[int, int], float] = {}
    gaps: list[tuple[int, int, int, int]] = []
    open_: list[np.ndarray] = [np.zeros(len(x), dtype=bool) for x in upto]
    for j, i in enumerate(places):
        upto[j] = np.cumsum(upto[j])
        for k in ranks[i]:
            cell = int(np.searchsorted(upto[j], k, "right"))
            if cell % 2:
                done[i, k] = float(cuts[j][cell // 2])
            else:
                open_[j][cell] = True
                gaps.append((j, cell, k - (int(upto[j][cell - 1]) if cell else 0), k))
    if not gaps:
        return done

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, x, cell in cells(batch):
                kept = open_[j][cell]
                if kept.any():
                    col = np.full(int(kept.sum()), j)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col), pa.array(cell[kept]), pa.array(x[kept])], names=["col", "cell", "x"]
                    )

    values = cols.mapInArrow(fetch, "col long, cell long, x double").groupBy("col", "cell", "x")
    running = Window.partitionBy("col", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(running))
    wanted = cols.sparkSession.createDataFrame(gaps, "col long, cell long, inside long, rank long")
    hit = ranked.join(F.broadcast(wanted), ["col", "cell"]).where("upto - n <= inside and inside < upto")
    for r in hit.select("col", "rank", "x").collect():
        done[places[r["col"]], r["rank"]] = r["x"]
    return done


def keyed_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], small: int = SMALL
) -> DataFrame:
    """(keys, quantiles) per key, linearly interpolated; keys may be many, hot or null.

    Beyond ``small`` values the ranks come from prefix sums over a key's distinct values. The
    buckets of those sums are cut by depth over the values of all keys together, so no bucket
    of any key holds more than its share of the table. Null values are left out.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__one"))
    known = df.select(key.alias("__k"), F.col(value).cast("double").alias("__x")).where("__x is not null")
    if known.count() <= small:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        found = known.groupBy("__k").agg(F.percentile("__x", wanted).alias("quantiles"))
    else:
        counts = known.groupBy("__k", "__x").agg(F.count("*").alias("__n"))
        cut = with_bucket(counts, "__x", equi_depth_splits(known, "__x"))
        ranked = prefix_sums(cut, ["__k"], "__x", {"__upto": "__n"})
        totals = known.groupBy("__k").agg((F.count("*") - 1).alias("__last"))
        spots = [(f"floor({p!r}D * __last)", f"ceil({p!r}D * __last)") for p in map(float, probs)]
        held = "max(case when __upto - __n <= {0} and {0} < __upto then __x end)"
        ends = ranked.join(totals, "__k").groupBy("__k", "__last").agg(
            *[F.expr(held.format(x)).alias(f"{n}{i}") for i, pair in enumerate(spots) for n, x in zip("ab", pair, strict=True)]
        )
        parts = [f"a{i} + (b{i} - a{i}) * ({p!r}D * __last - {spots[i][0]})" for i, p in enumerate(map(float, probs))]
        found = ends.selectExpr("__k", f"array({', '.join(parts)}) as quantiles")
    return found.select(*[F.col("__k")[k].alias(k) for k in keys], "quantiles")
