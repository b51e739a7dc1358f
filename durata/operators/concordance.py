"""Harrell's concordance, exact, without comparing all pairs.

Rows are first collapsed to distinct (time, status, risk) with counts. Times and risks
are cut into buckets that never split equal values. A comparable pair then differs

* in both buckets: counted from the bucket-by-bucket count matrix,
* or shares the time bucket: counted inside it,
* or shares only the risk bucket: counted inside it with time reduced to its bucket.

Each class is counted by the same in-task routine on a bounded group, and a key with few rows
in one group. Where buckets are small enough, as counts tell, rows are dealt out once. A bucket that
still holds too many distinct rows is cut again by the same scheme, so heavy values
change the number of rounds and not the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from durata.constants import EVENT, TIME
from durata.operators.partials import batch_matrix
from durata.operators.scan import equi_depth_splits_of, sketched_quantiles, with_bucket
from durata.session import cut_lineage, spent_shuffles_go

GROUP_ROWS = 200_000
MAX_CUTS = 512
#: ``concordances``: fewest buckets, risks that are counted in one job, rows that a task packs at once.
MIN_CUTS, TURN, DEALT_ROWS = 16, 4, 200_000
TIMES, RISKS, CELLS = range(3)
COUNTED_TYPES = {
    "risk": pa.int32(), "part": pa.int32(), "concordant": pa.float64(), "tied": pa.float64(),
    "comparable": pa.float64(), "cells": pa.binary(),
}
COUNTED = "risk int, part int, concordant double, tied double, comparable double, cells binary"


def count_pairs(
    pos: np.ndarray, risk: np.ndarray, ne: np.ndarray, na: np.ndarray
) -> tuple[float, float, float]:
    """(concordant, tied, comparable) over pairs i before j, weighted ne_i * na_j.

    ``pos`` and ``risk`` are dense integer ranks. For every binary digit of the position
    the pairs that first differ there are counted by cumulative sums over sorted risks.
    """
    if not len(pos):
        return 0.0, 0.0, 0.0
    by_pos_e = np.bincount(pos, weights=ne)
    by_pos_a = np.bincount(pos, weights=na)
    later = by_pos_a.sum() - np.cumsum(by_pos_a)
    comparable = float((by_pos_e * later).sum())
    order = np.argsort(risk, kind="stable")
    pos, risk, ne, na = pos[order], risk[order], ne[order], na[order]
    concordant = tied = 0.0
    # rows lie sorted by (leading digits, risk); a level deals them by one more digit, in order
    for bit in range(int(pos.max()).bit_length() - 1, -1, -1):
        node = pos >> (bit + 1)
        second = ((pos >> bit) & 1).astype(bool)
        new_node = np.concatenate([[True], node[1:] != node[:-1]])
        new_tie = new_node.copy()
        new_tie[1:] |= risk[1:] != risk[:-1]
        first_events = np.concatenate([[0.0], np.cumsum(np.where(second, 0.0, ne))])
        weight = np.concatenate([[0.0], np.cumsum(np.where(second, na, 0.0))])
        ties, nodes = (np.append(np.flatnonzero(x), len(pos)) for x in (new_tie, new_node))
        w, lo, hi = np.diff(weight[ties]), first_events[ties[:-1]], first_events[ties[1:]]
        tied += float((w * (hi - lo)).sum())
        concordant += float((np.diff(weight[nodes]) * first_events[nodes[1:]]).sum() - (w * hi).sum())
        zeros = np.concatenate([[0], np.cumsum(~second)])
        at = np.cumsum(new_node) - 1
        begin, before = nodes[at], zeros[nodes[at]]
        rank = zeros[:-1] - before
        place = begin + np.where(second, zeros[nodes[at + 1]] - before + np.arange(len(pos)) - begin - rank, rank)
        dealt = np.empty_like(place)
        dealt[place] = np.arange(len(pos))
        pos, risk, ne, na = pos[dealt], risk[dealt], ne[dealt], na[dealt]
    return concordant, tied, comparable


def _dense(*columns: np.ndarray) -> np.ndarray:
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(change)
    return out


def _count_group(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    pos = _dense(pdf["p1"].to_numpy(), pdf["p2"].to_numpy())
    risk = _dense(pdf["r"].to_numpy())
    conc, tied, comp = count_pairs(pos, risk, pdf["ne"].to_numpy(), pdf["na"].to_numpy())
    kind = pdf["kind"].iloc[0]
    if kind == "both":
        tied = 0.0
    elif kind == "risk":
        comp = 0.0
    row = {k: pdf[k].iloc[0] for k in keys}
    return pd.DataFrame([{**row, "concordant": conc, "tied": tied, "comparable": comp}])


def _equal_width(df: DataFrame, keys: list[str], value: Column, name: str, cuts: int) -> DataFrame:
    """Bucket of a value between its own key's minimum and maximum (which never share one)."""
    span = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = F.floor((value - F.col("__lo")) * cuts / (F.col("__hi") - F.col("__lo")))
    bucket = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(at, F.lit(cuts - 1))
    )
    return df.join(span, keys).withColumn(name, bucket.cast("int")).drop("__lo", "__hi")


def _count(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count every (keys, kind, part) group in its own task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.groupBy(*keys, "kind", "part").applyInPandas(
        lambda pdf: _count_group(pdf, keys),
        f"{fields}, concordant double, tied double, comparable double",
    )


def _largest(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _pairs(
    rows: DataFrame, keys: list[str], depth: int, group_rows: int, cuts: int, held: list[DataFrame]
) -> list[DataFrame]:
    """Contribution frames (keys, concordant, tied, comparable) of a weighted row frame.

    What it persists is added to ``held``.
    """
    if depth == 0:
        by_time, by_risk = equi_depth_splits_of(rows, ["p1", "r"], cuts)
        rows = with_bucket(rows, "p1", by_time, "tb")
        rows = with_bucket(rows, "r", by_risk, "rb")
    else:
        rows = _equal_width(rows, keys, F.col("p1"), "tb", cuts)
        rows = _equal_width(rows, keys, F.col("r"), "rb", cuts)
        # a single time that cannot be cut further is cut by status
        one_time = rows.groupBy(*keys).agg((F.min("p1") == F.max("p1")).alias("__one"))
        rows = (
            rows.join(one_time, keys)
            .withColumn("tb", F.when(F.col("__one"), F.col("p2").cast("int")).otherwise(F.col("tb")))
            .drop("__one")
        )
    if depth == 0:
        rows = rows.persist()
        held.append(rows)
    else:
        rows = cut_lineage(rows)
    parts = [*keys, "kind", "part"]
    both = rows.groupBy(*keys, "tb", "rb").agg(F.sum("ne").alias("ne"), F.sum("na").alias("na"))
    both = both.select(
        *keys, F.lit("both").alias("kind"), F.lit(0).alias("part"),
        F.col("tb").cast("double").alias("p1"), F.lit(0.0).alias("p2"),
        F.col("rb").cast("double").alias("r"), "ne", "na",
    )
    same_time = rows.select(
        *keys, F.lit("time").alias("kind"), F.col("tb").alias("part"), "p1", "p2", "r", "ne", "na"
    )
    same_risk = rows.select(
        *keys, F.lit("risk").alias("kind"), F.col("rb").alias("part"), F.col("tb").cast("double").alias("p1"),
        F.lit(0.0).alias("p2"), "r", "ne", "na",
    )
    if depth == 0 and all(_largest(rows, [*keys, b]) <= group_rows for b in ("tb", "rb")):
        return [_count(both.unionByName(same_time).unionByName(same_risk), keys)]
    same_risk = same_risk.groupBy(*keys, "kind", "part", "p1", "p2", "r").agg(
        F.sum("ne").alias("ne"), F.sum("na").alias("na")
    )
    inner = same_time.unionByName(same_risk)
    size = inner.groupBy(*parts).agg(
        F.count("*").alias("rows_"),
        F.sum("ne").alias("events_"),
        (F.min(F.struct("p1", "p2")) == F.max(F.struct("p1", "p2"))).alias("one_pos"),
    )
    # no event or one position only: nothing to compare inside
    live = size.filter((F.col("events_") > 0) & ~F.col("one_pos"))
    large = live.filter(F.col("rows_") > group_rows)
    any_large = bool(large.limit(1).count())
    small = live.filter(F.col("rows_") <= group_rows).select(*parts)
    todo = both.unionByName(inner.join(small, parts, "left_semi")) if any_large else both.unionByName(
        inner.join(live.select(*parts), parts, "left_semi")
    )
    out = [_count(todo, keys)]
    if any_large:
        tag = f"__part{depth}"
        deeper = (
            inner.join(large.select(*parts), parts, "left_semi")
            .withColumn(tag, F.concat_ws("|", "kind", F.col("part").cast("string")))
            .select(*keys, tag, "p1", "p2", "r", "ne", "na")
        )
        for piece in _pairs(deeper, [*keys, tag], depth + 1, group_rows, max(2, min(cuts, 256)), held):
            comp = F.when(F.col(tag).startswith("risk"), F.lit(0.0)).otherwise(F.col("comparable"))
            out.append(piece.withColumn("comparable", comp).drop(tag))
    return out


def concordance(
    df: DataFrame,
    keys: list[str] | None = None,
    risk: str = "prob_72h",
    time: str = TIME,
    event: str = EVENT,
    group_rows: int = GROUP_ROWS,
    cuts: int | None = None,
) -> DataFrame:
    """C-index per key with its pair counts; null where nothing is comparable.

    The earlier member of a comparable pair was hit; at equal times a hit precedes a
    censoring. Equal risks count one half.
    """
    keys = keys or []
    keyed = df if keys else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    p1, p2 = F.col(time).cast("double"), (1 - F.col(event)).cast("double")
    hits = F.col("na") * F.col(event)
    rows = (
        keyed.groupBy(*by, time, event, risk)
        .agg(F.count("*").cast("double").alias("na"))
        .select(
            *by, p1.alias("p1"), p2.alias("p2"), F.col(risk).cast("double").alias("r"),
            hits.cast("double").alias("ne"), "na",
        )
        .persist()
    )
    held = [rows]
    n = _largest(rows, by) if cuts is None else None
    if n is not None and n <= group_rows:
        # few enough distinct rows for one bounded group per key
        whole = rows.withColumns({"kind": F.lit("time"), "part": F.lit(0)})
        counts = _count(whole, by)
    else:
        cuts = cuts or max(2, min(MAX_CUTS, math.ceil(2 * n / group_rows)))
        counts = reduce(DataFrame.unionByName, _pairs(rows, by, 0, group_rows, cuts, held))
    total = counts.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")]
    )
    # a row per key stays; the distinct rows are let go
    total = total.persist()
    total.count()
    for df in held:
        df.unpersist()
    score = F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable"))
    return total.withColumn("c_index", score).drop("__all")


@dataclass
class Cuts:
    """Buckets [cut, next cut) of a value. One that holds a single value of many rows is ``lone``."""

    at: np.ndarray
    lone: np.ndarray

    @staticmethod
    def of(sketched: np.ndarray) -> Cuts:
        """From sketched quantiles; a value that is several of them gets a bucket of its own."""
        values, times = np.unique(sketched[np.isfinite(sketched)], return_counts=True)
        heavy = values[times > 1]
        at = np.unique(np.concatenate([values, np.nextafter(heavy, np.inf)]))
        return Cuts(at, np.concatenate([[False], np.isin(at, heavy)]))

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, x, "right")


def _between_buckets(ne: np.ndarray, na: np.ndarray, lone: np.ndarray) -> tuple[float, float, float]:
    """What pairs of different time buckets (rows) give where risk buckets (columns) differ or hold one value."""
    earlier = np.cumsum(ne, axis=0) - ne
    higher = earlier.sum(axis=1, keepdims=True) - np.cumsum(earlier, axis=1)
    tied = (na * earlier)[:, lone].sum()
    return float((na * higher).sum()), float(tied), float((na * earlier.sum(axis=1, keepdims=True)).sum())


def concordances(
    df: DataFrame, risks: list[str], time: str = TIME, event: str = EVENT,
    group_rows: int = GROUP_ROWS, cuts: int | None = None, turn: int = TURN,
) -> list[float | None]:
    """C-index of each of several risks (SQL texts over ``df``) against the same times; exact.

    As ``concordance``, but rows are never repeated per risk: tasks count the cells of time and
    risk buckets, and shuffle the rows once by time bucket, for all risks of a turn, and once a
    risk by risk bucket, packed. A value of many rows is a bucket of its own, whose pairs the cells
    give, so no other bucket holds much more than its share. ``turn`` risks are counted in one job,
    which bounds the shuffle files. Rows without a time or status are in no pair. Persist ``df``.
    """
    named = {f"r{i}": r for i, r in enumerate(risks)}
    rows = df.selectExpr(
        f"cast(`{time}` as double) as t", f"cast(`{event}` as double) as e",
        *[f"cast({r} as double) as {c}" for c, r in named.items()],
    ).where("t is not null and not isnan(t) and e is not null")
    n = cuts or max(MIN_CUTS, min(MAX_CUTS, math.ceil(2 * rows.count() / group_rows)))
    probs = [i / n for i in range(1, n)]
    found = [Cuts.of(x) for x in sketched_quantiles(rows, ["t", *named], [probs] * (1 + len(risks)))]
    out: list[float | None] = []
    for start in range(0, len(risks), turn):
        out += _count_turn(rows, list(named)[start : start + turn], found[0], found[1 + start : 1 + start + turn])
    return out


def _count_turn(rows: DataFrame, risks: list[str], times: Cuts, cuts: list[Cuts]) -> list[float | None]:
    k, nt = len(risks), 2 * len(times.lone)
    widths = [len(c.lone) for c in cuts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros((2, nt * w)) for w in widths]

        def packed(kind: int, risk: int, part: np.ndarray, kept: np.ndarray, columns: list[np.ndarray]):
            """A row a bucket, with the columns of its rows as bytes."""
            kept = kept[np.argsort(part[kept], kind="stable")]
            ends = np.append(np.flatnonzero(np.diff(part[kept])) + 1, len(kept)) if len(kept) else []
            begin = 0
            for end in ends:
                some = kept[begin:end]
                yield kind, risk, int(part[some[0]]), b"".join(c[some].tobytes() for c in columns)
                begin = end

        def emitted(m: np.ndarray) -> Iterator[tuple]:
            t, e, r = m[:, 0], m[:, 1], m[:, 2:]
            tb = times.bucket(t)
            lone = times.lone[tb]
            place = 2 * tb + np.where(lone, 1 - e, 0).astype(np.int64)
            flag = e.astype(np.uint8)
            yield from packed(TIMES, 0, tb, np.flatnonzero(~lone), [t, flag, *[np.ascontiguousarray(x) for x in r.T]])
            for i, c in enumerate(cuts):
                rb = c.bucket(r[:, i])
                cell = place * widths[i] + rb
                cells[i][0] += np.bincount(cell, weights=e, minlength=nt * widths[i])
                cells[i][1] += np.bincount(cell, minlength=nt * widths[i])
                own = np.ascontiguousarray(r[:, i])
                yield from packed(RISKS, i, rb, np.flatnonzero(~c.lone[rb]), [own, place.astype(np.uint16), flag])

        def batch(made: list[tuple]) -> pa.RecordBatch:
            kind, risk, part, data = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(risk, pa.int32()), pa.array(part, pa.int32()), pa.array(data, pa.binary())],
                names=["kind", "risk", "part", "data"],
            )

        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                held.append(batch_matrix(b))
            if sum(map(len, held)) >= DEALT_ROWS:
                made = list(emitted(np.concatenate(held)))
                held = []
                if made:
                    yield batch(made)
        if held:
            made = list(emitted(np.concatenate(held)))
            if made:
                yield batch(made)
        for i, w in enumerate(widths):
            full = cells[i].reshape(2, nt, w)
            seen = np.flatnonzero(full[1].any(axis=1))
            if len(seen):
                yield batch([(CELLS, i, int(j), full[:, j].tobytes()) for j in seen])

    def count(group: pa.Table) -> pa.Table:
        kind, risk, part = (group.column(c)[0].as_py() for c in ("kind", "risk", "part"))
        chunks = group.column("data").to_pylist()
        if kind == CELLS:
            total = sum(np.frombuffer(x) for x in chunks)
            return _counted([(risk, part, 0.0, 0.0, 0.0, total.tobytes())])
        kinds = ["f8", "u1", *["f8"] * k] if kind == TIMES else ["f8", "u2", "u1"]
        columns = _unpacked(chunks, kinds)
        if kind == RISKS:
            r, pos, e = columns
            conc, tied, _ = count_pairs(_dense(pos.astype(np.int64)), _dense(r), e.astype(float), np.ones(len(r)))
            return _counted([(risk, part, conc, tied, 0.0, None)])
        t, e, *r = columns
        hit = e.astype(float)
        pos = _dense(t, 1 - hit)
        return _counted([(i, part, *count_pairs(pos, _dense(x), hit, np.ones(len(x))), None) for i, x in enumerate(r)])

    dealt = rows.select("t", "e", *risks).mapInArrow(deal, "kind int, risk int, part int, data binary")
    with spent_shuffles_go(rows.sparkSession):
        counted = dealt.groupBy("kind", "risk", "part").applyInArrow(count, COUNTED).toArrow().to_pylist()
    sums = np.zeros((k, 3))
    matrix = [np.zeros((2, nt, w)) for w in widths]
    for row in counted:
        sums[row["risk"]] += row["concordant"], row["tied"], row["comparable"]
        if row["cells"] is not None:
            matrix[row["risk"]][:, row["part"]] = np.frombuffer(row["cells"]).reshape(2, -1)
    for i, (ne, na) in enumerate(matrix):
        sums[i] += _between_buckets(ne, na, cuts[i].lone)
    return [(float(c) + 0.5 * float(d)) / float(p) if p else None for c, d, p in sums]


def _unpacked(chunks: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns that ``deal`` packed one after the other, chunk by chunk."""
    width = sum(np.dtype(x).itemsize for x in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for data in chunks:
        n, at = len(data) // width, 0
        for column, x in zip(parts, kinds, strict=True):
            column.append(np.frombuffer(data, x, n, at))
            at += n * np.dtype(x).itemsize
    return [np.concatenate(x) for x in parts]


def _counted(rows: list[tuple]) -> pa.Table:
    return pa.table({
        name: pa.array(column, kind)
        for (name, kind), column in zip(COUNTED_TYPES.items(), zip(*rows, strict=True), strict=True)
    })
