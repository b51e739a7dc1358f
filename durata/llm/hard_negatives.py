"""Hard-negative mining over an inverted multi-index with certified stopping.

Vectors are cut into two halves. A codebook per half (k-means on at most ``SAMPLE``
components' worth of hash-chosen rows, a documented bound) gives every row a pair of
codewords, its cell; the largest distance of a row to its codeword is the codeword's
radius. For an anchor, ``half . codeword + |half| * radius`` bounds what the half can add
to a score, so the sum of two half bounds holds for a whole cell. A multi-sequence heap
yields the cells of one anchor by falling bound; a popped cell is scored only if its own,
tighter radii still reach.

Two searches run over the index, each in rounds that first visit some rows and then stop
where the next bound proves that nothing can change:

1. positives: until the next bound is below the anchor's worst positive so far;
2. negatives: each positive has a window of scores; until the next bound is below the worst
   kept negative of every full window and below the lower end of the others. Cells whose
   lower bound lies above every window are passed over.

Visited cells are scored in groups of one first codeword, one part of its rows and one block
of anchors, so a task holds bounded matrices whatever the largest cell; the codebooks and at
most ``CODEWORDS`` squared cell rows are all that reaches the driver. Where bounds prove
nothing (high dimension, flat data), every cell is visited and results are still exact.

Components are floor(scale * x) (beyond a long: the nearest long), scores exact integers cut
off at the ends of a long. Rows with a null id, label or vector, or a null or non-finite
component take no part; shorter vectors count as padded with zeros. Repeated rows each
count, an anchor's own row is excluded by id. Labels may have any type that has equality.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from durata.llm.common import stored

CODEWORDS = 32
#: Components that the codebooks are fitted on at most.
SAMPLE = 2_000_000
#: Rows of a first codeword's part, anchors of a block.
PART, BLOCK = 2048, 2048
#: Rows that the first round visits for each anchor, and by how much later rounds grow.
FIRST, GROWTH = 2048, 16
LONG = 2**63 - 1


@dataclass
class Index:
    """Codebooks, codeword radii, and rows and radii of every cell."""

    books: list[np.ndarray]
    radius: list[np.ndarray]
    rows: np.ndarray
    inner: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.books[0].shape[1] + self.books[1].shape[1]

    def halves(self, v: np.ndarray) -> list[np.ndarray]:
        cut = self.books[0].shape[1]
        return [v[:, :cut], v[:, cut:]]

    def visits(self, v: np.ndarray) -> Iterator[tuple[float, float, float, int, int]]:
        """(bound, cell's own upper and lower bound, codewords) by falling bound."""
        dots, norms = [], []
        for half, book in zip(self.halves(v[None, :]), self.books, strict=True):
            dots.append(half[0] @ book.T)
            norms.append(float(np.sqrt((half[0] ** 2).sum())))
        # rounding of the products themselves
        slack = 1e-9 * sum(n * (np.abs(b).max(initial=0) * np.sqrt(b.shape[1]) + r.max(initial=0))
                           for n, b, r in zip(norms, self.books, self.radius, strict=True)) + 1e-6
        s = [d + n * r for d, n, r in zip(dots, norms, self.radius, strict=True)]
        order = [np.argsort(-x, kind="stable") for x in s]
        ranked = [x[o].tolist() for x, o in zip(s, order, strict=True)]
        heap = [(-(ranked[0][0] + ranked[1][0]), 0, 0)]
        while heap:
            minus, i, j = heapq.heappop(heap)
            if j + 1 < len(ranked[1]):
                heapq.heappush(heap, (-(ranked[0][i] + ranked[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(ranked[0]):
                heapq.heappush(heap, (-(ranked[0][i + 1] + ranked[1][0]), i + 1, 0))
            a, b = int(order[0][i]), int(order[1][j])
            middle = dots[0][a] + dots[1][b]
            reach = norms[0] * self.inner[0][a, b] + norms[1] * self.inner[1][a, b] + slack
            yield slack - minus, middle + reach, middle - reach, a, b


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from rows at even steps of the sample; empty codewords stay where they are."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    book = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, book)
        n = np.bincount(at, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, at, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * (x @ book.T)).argmin(1)


def padded(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def unpacked(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(len(column), width)


def vectors(table: DataFrame, id_col: str, label: Column, vec: str, anchors: Column, scale: int) -> DataFrame:
    """(id, label, anchor, v: integer components) of the rows that take part."""
    finite = F.forall(F.col("x"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    v = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return (
        table.select(
            F.col(id_col).cast("long").alias("id"), label.alias("label"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vec).cast("array<double>").alias("x"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
        .select("id", "label", "anchor", v.alias("v"))
    )


def indexed(rows: DataFrame, codewords: int) -> tuple[DataFrame, Index]:
    """Every row with its cell, and the index over them."""
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, 2)
    cut = width // 2
    room = max(64, SAMPLE // width)
    share = min(1.0, 1.2 * room / max(n, 1))
    picked = rows.where(F.abs(F.xxhash64("id") % 1_000_003) < F.lit(share * 1_000_003)).select("v").limit(room)
    sample = padded([r[0] for r in picked.collect()], width).astype(np.float64)
    books = [codebook(sample[:, :cut], codewords), codebook(sample[:, cut:], codewords)]
    label = rows.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() * 7919
        for b in batches:
            v = padded(b.column("v").to_pylist(), width)
            halves = [v[:, :cut].astype(np.float64), v[:, cut:].astype(np.float64)]
            at = [nearest(h, book) for h, book in zip(halves, books, strict=True)]
            far = [np.sqrt(((h - book[a]) ** 2).sum(1)) for h, book, a in zip(halves, books, at, strict=True)]
            raw = pa.array([x.tobytes() for x in v], pa.binary())
            salt = np.arange(count, count + len(v))
            count += len(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"), raw, *map(pa.array, (*at, *far, salt))],
                names=["id", "label", "anchor", "v", "c1", "c2", "d1", "d2", "salt"],
            )

    schema = f"id long, label {label}, anchor boolean, v binary, c1 long, c2 long, d1 double, d2 double, salt long"
    cells = stored(rows.mapInArrow(assign, schema))
    sizes = [len(b) for b in books]
    index = Index(books, [np.zeros(k) for k in sizes], np.zeros(sizes, np.int64), [np.zeros(sizes), np.zeros(sizes)])
    for r in cells.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("d1"), F.max("d2")).collect():
        index.rows[r[0], r[1]] = r[2]
        index.inner[0][r[0], r[1]], index.inner[1][r[0], r[1]] = r[3], r[4]
    index.radius = [index.inner[0].max(axis=1), index.inner[1].max(axis=0)]
    parts = [max(1, -(-int(x) // PART)) for x in index.rows.sum(axis=1)]
    part = F.col("salt") % F.element_at(F.array(*map(F.lit, parts)), (F.col("c1") + 1).cast("int"))
    return cells.withColumn("part", part.cast("int")).drop("salt", "d1", "d2"), index


#: What a round knows of an anchor: cells popped, score that must be reached (null: none
#: proven), highest score of use, windows and the least useful score in each.
STATE = "seen int, need double, top double, lo array<long>, hi array<long>, least array<long>"


def planned(open_: DataFrame, index: Index, room: int) -> DataFrame:
    """Adds the cells to visit next (a bit mask per first codeword), ``seen`` and ``next``.

    With a proven need all cells that reach it are visited, else about ``room`` rows' worth.
    """
    names = ["aid", "id", "label", "v", "lo", "hi", "least"]
    kinds = {f.name: f.dataType.simpleString() for f in open_.schema.fields}
    seconds = index.rows.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = df[names].copy()
            seen, ahead, cells = [], [], []
            vs = unpacked(df["v"], index.width).astype(np.float64) if len(df) else []
            for v, start, need, top in zip(vs, df["seen"], df["need"], df["top"], strict=True):
                sure = not pd.isna(need)
                chosen: dict[int, np.ndarray] = {}
                rows, at, following = 0, 0, None
                for at, (bound, high, low, a, b) in enumerate(index.visits(v)):  # noqa: B007
                    if at < start:
                        continue
                    if (sure and bound < need) or (not sure and rows >= room):
                        following = bound
                        break
                    if index.rows[a, b] and low <= top and not (sure and high < need):
                        chosen.setdefault(a, np.zeros(seconds, bool))[b] = True
                        rows += int(index.rows[a, b])
                seen.append(at if following is not None else index.rows.size)
                ahead.append(following)
                cells.append([{"c1": a, "mask": np.packbits(m).tobytes()} for a, m in chosen.items()])
            out["seen"], out["next"], out["cells"] = seen, pd.Series(ahead, dtype="float64"), cells
            yield out

    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return stored(open_.mapInPandas(run, f"{schema}, seen int, next double, cells array<struct<c1: long, mask: binary>>"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, cut off at the ends of a long."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    longest = np.sqrt((x * x).sum(1)).max(initial=0)
    wide = np.sqrt((y * y).sum(1)) * longest >= 2.0**52
    out[:, ~wide] = np.rint(x @ y[~wide].T).astype(np.int64)
    if wide.any():
        exact = a.astype(object) @ b[wide].astype(object).T
        out[:, wide] = np.clip(exact, -LONG - 1, LONG).astype(np.int64)
    return out


def leading(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, the earlier of equal ones first kept."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > kth)
    return np.concatenate([above, np.flatnonzero(score == kth)[: k - len(above)]])


def scored(plan: DataFrame, cells: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(aid, w, score, found): the k best rows of each anchor's window in the planned cells.

    ``same``: rows of the anchor's label, one window without ends; else rows of others.
    """
    parts = [max(1, -(-int(x) // PART)) for x in index.rows.sum(axis=1)]
    seen = plan.select("aid", "id", "label", "v", "lo", "hi", "least", F.explode("cells").alias("c")).select(
        "aid", "id", "label", "v", "lo", "hi", "least", F.col("c.c1").alias("c1"), F.col("c.mask").alias("mask")
    )
    blocks = [1] * len(parts)
    for c1, n in seen.groupBy("c1").count().collect():
        blocks[c1] = -(-n // BLOCK)
    per = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c1") + 1).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = seen.withColumn("block", F.pmod(F.xxhash64("aid"), per(blocks)).cast("int")).withColumn(
        "part", every(per(parts))
    )
    right = cells.select("c1", "part", "c2", F.col("id").alias("row"), F.col("label").alias("its"), F.col("v").alias("rv"))
    right = right.join(F.broadcast(seen.select("c1").distinct()), "c1", "left_semi").withColumn(
        "block", every(per(blocks))
    )
    width = index.width

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(c):
            c = c.sort_values("row", kind="stable")
            rows, its, c2, b = c["row"].to_numpy(), c["its"].to_numpy(), c["c2"].to_numpy(), unpacked(c["rv"], width)
            for start in range(0, len(q), 256):
                part = q.iloc[start : start + 256]
                score = products(unpacked(part["v"], width), b)
                for i, r in enumerate(part.itertuples(index=False)):
                    here = np.unpackbits(np.frombuffer(r.mask, np.uint8))[c2].astype(bool)
                    here &= (its == r.label) if same else (its != r.label)
                    here &= rows != r.id
                    for w, (lo, hi, least) in enumerate(zip(r.lo, r.hi, r.least, strict=True)):
                        pick = np.flatnonzero(here & (score[i] >= max(lo, least)) & (score[i] <= hi))
                        pick = pick[leading(score[i, pick], k)]
                        found += [(r.aid, w, int(s), int(x)) for s, x in zip(score[i, pick], rows[pick], strict=True)]
        return pd.DataFrame(found, columns=["aid", "w", "score", "found"])

    keys = ["c1", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, "aid long, w int, score long, found long"
    )


def leaders(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, cells: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(aid, w, rank, score, found): exact k best of every window of every anchor.

    ``anchors`` has (aid, id, label, v) and the state columns.
    """
    names, best, room = anchors.columns, None, FIRST
    while True:
        plan = planned(anchors, index, room)
        new = scored(plan, cells, index, same, k)
        if best is not None:
            new = new.unionByName(best.select("aid", "w", "score", "found"))
        best = stored(leaders(new, k))
        left = plan.where(F.col("next").isNotNull())
        # the k-th score of each full window is the least that is still of use there
        kth = best.where(F.col("rank") == k).groupBy("aid").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth")
        )
        least = F.transform(
            "least", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("int")), x))
        )
        after = left.join(kth, "aid", "left").withColumn("least", least)
        need = F.array_min(F.expr(
            "transform(filter(arrays_zip(lo, hi, least), x -> x.lo <= x.hi), x -> greatest(x.lo, x.least))"
        ))
        after = after.withColumn("need", F.when(need > -LONG - 1, need.cast("double")))
        after = after.withColumn("top", F.array_max("hi").cast("double"))
        anchors = stored(after.where("need is null or next >= need").select(*names))
        if anchors.isEmpty():
            return best
        room *= GROWTH


def hard_negatives(
    table: DataFrame, anchors: Column, id_col: str = "vec_id", label: str | Column = "label",
    vec: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, codewords: int = CODEWORDS,
) -> DataFrame:
    """Per anchor and positive the best rows of other labels within low..high percent of it.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    cells, index = indexed(vectors(table, id_col, label, vec, anchors, scale), codewords)
    chosen = stored(
        cells.where("anchor").select(F.monotonically_increasing_id().alias("aid"), "id", "label", "v")
    )
    ends = {"lo": -LONG - 1, "hi": LONG, "least": -LONG - 1}
    state = chosen.withColumns(
        {"seen": F.lit(0), "need": F.lit(None).cast("double"), "top": F.lit(float("inf"))}
        | {n: F.array(F.lit(v).cast("long")) for n, v in ends.items()}
    )
    found = search(state, cells, index, True, positives)
    # exact integer ends of the window of each positive; empty for negative scores
    wide = F.col("score").cast("decimal(38,0)")
    window = found.select(
        "aid", (F.col("rank") - 1).alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"),
        F.ceil(wide * low / 100).cast("long").alias("lo"), F.floor(wide * high / 100).cast("long").alias("hi"),
    )
    window = stored(window)
    listed = window.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("ws"))
    second = (
        chosen.join(listed, "aid")
        .withColumns({"lo": F.col("ws.lo"), "hi": F.col("ws.hi"), "least": F.col("ws.lo")})
        .where(F.exists("ws", lambda x: x.lo <= x.hi))
        .withColumns({"seen": F.lit(0), "need": F.lit(None).cast("double"), "top": F.array_max("hi").cast("double")})
        .select(*state.columns)
    )
    mined = search(stored(second), cells, index, False, negatives)
    return (
        window.join(mined, ["aid", "w"]).join(chosen.select("aid", F.col("id").alias("anchor_id")), "aid")
        .select(
            "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 50 == 0, label=label)


SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as anchor_id, a.label = b.label as same, b.id as id,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.id % 50 = 0 and a.id <> b.id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id,
       row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 3
"""
